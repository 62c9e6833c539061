"""Each rule on a page that breaks it and one that does not; every case is a site of its own, audited in one job."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sitelumen.plans import audit as A
from sitelumen.plans.catalog import RULES
from sitelumen.sources.pages import Capabilities, raw_pages

WORDS = "kelime sayfa icerik metin uzun yazi konu baslik alan deger ".split()


def words(n: int) -> str:
    return " ".join(WORDS[i % 10] + str(i) for i in range(n))


def page(body: str = "", head: str = "", lang: str = ' lang="tr"', charset: str = '<meta charset="utf-8">') -> str:
    return f'<!-- first --><!doctype html><html{lang}><head>{charset}<meta name="viewport" content="width=device-width">{head}</head><body>{body}</body></html>'


def ld(**x) -> str:
    return f'<script type="application/ld+json">{json.dumps(x)}</script>'


ORG = {"@context": "https://schema.org", "@type": "Organization", "name": "x", "url": "y"}
H = "https://s.test/a"
IMG = '<img src="/{0}.webp" alt="bir resim" width="1" height="1" loading="lazy">'
#: (rule, breaks it, does not, url of both); None: no such case.
CASES = [
    ("soft-404", page("<p>Sayfa bulunamadı</p>"), page("<p>" + words(130) + " sayfa bulunamadı</p>"), H),
    ("canonical-missing", page(), page(head='<link rel="canonical" href="/a">'), H),
    ("canonical-relative-url", page(head='<link rel="canonical" href="//s.test/a">'), page(head='<link rel="canonical" href="https://s.test/a">'), H),
    ("canonical-cross-host", page(head='<link rel="canonical" href="https://other.test/a">'), page(head='<link rel="canonical" href="https://www.s.test/a">'), H),
    ("meta-robots-nofollow", page(head='<meta name="robots" content="index, nofollow">'), page(head='<meta name="robots" content="NOFOLLOX">'), H),
    ("mixed-content", page('<img src="http://s.test/a.png">'), page('<img src="/a.png">'), H),
    ("url-turkish-charset", page(), None, "https://s.test/%C5%9Fehir"),
    ("url-uppercase-underscore", page(), None, "https://s.test/a_b"),
    ("url-excessive-depth", page(), None, "https://s.test/1/2/3/4/5"),
    ("title-missing", page(head="<!-- <title>x</title> -->"), page(head="<title>x</title>"), H),
    ("title-pixel-width", page(head=f"<title>{'W' * 40}</title>"), page(head=f"<title>{'i' * 60}</title>"), H),
    ("title-too-short", page(head="<title>kısa</title>"), page(head=f"<title>{'a' * 30}</title>"), H),
    ("meta-description-missing", page(), page(head='<meta name="description" content="x">'), H),
    ("meta-description-length", page(head='<meta name="description" content="x">'), page(head=f'<meta name="description" content="{"a" * 80}">'), H),
    ("h1-missing", page("<h2>x</h2>"), page("<h1>x</h1>"), H),
    ("h1-count", page("<h1>a</h1><h1>b</h1>"), page("<h1>a</h1>"), H),
    ("heading-hierarchy-skip", page("<h1>a</h1><h4>b</h4>"), page("<h1>a</h1><h2>b</h2><h1>c</h1>"), H),
    ("heading-empty", page("<h1> </h1>"), page("<h1>a</h1>"), H),
    ("thin-content", page(f"<main>{words(299)}</main>"), page(f"<main>{words(300)}</main>"), H),
    ("turkish-mojibake", page("HoÅŸ gÃ¼zel"), page("tek Ã¼"), H),
    ("charset-declaration-late", page(charset=f"<style>{'a' * 1100}</style><meta charset=utf-8>"), page(), H),
    ("viewport-meta-missing", "<html lang=tr><body>x", page(), H),
    ("lang-attribute-missing", page(lang=""), page(), H),
    ("jsonld-parse-error", page('<script type="application/ld+json">{"a":1,}</script>'), page(ld(**ORG)), H),
    ("jsonld-missing", page(), page(ld(**ORG)), H),
    ("jsonld-context-invalid", page(ld(**{"@type": "Organization"})), page(ld(**ORG)), H),
    ("jsonld-required-props", page(ld(**{"@context": "https://schema.org", "@type": "Article", "headline": "x"})), page(ld(**ORG)), H),
    ("jsonld-faq-mismatch", page(ld(**{"@context": "https://schema.org", "@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "Gizli soru?"}]})), page("Açık soru? " + ld(**{"@context": "https://schema.org", "@type": "FAQPage", "mainEntity": [{"name": "Açık soru?"}]})), H),
    ("jsonld-service-missing", page("<h1>Çözüm</h1>"), page(ld(**{"@context": "https://schema.org", "@type": "Service"}) + "<h1>Hizmet</h1>"), H),
    ("jsonld-breadcrumb-missing", page(), page(ld(**{"@context": "https://schema.org", "@type": "BreadcrumbList"})), "https://s.test/a/b"),
    ("og-missing", page(), page(head="".join(f'<meta property="og:{k}" content="x">' for k in ("title", "description", "image", "url"))), H),
    ("twitter-card-missing", page(), page(head='<meta name="twitter:card" content="summary">'), H),
    ("jsonld-organization-missing", page(), page(ld(**ORG)), H),
    ("jsonld-sameas-missing", page(ld(**ORG)), page(ld(**ORG, sameAs=["https://x.test"])), H),
    ("render-blocking-css", page(head='<link rel="stylesheet" href="a"><link rel="stylesheet" href="b">'), page(head='<link rel="stylesheet" href="a"><link rel="stylesheet" href="b" media="print">'), H),
    ("render-blocking-js", page(head='<script src="a.js"></script>'), page(head='<script src="a.js" defer></script>'), H),
    ("lcp-candidate-lazy", page('<img src="a.png" loading="lazy">'), page('<img src="a.png">'), H),
    ("html-size-excessive", page("x" * 260_000), page("x" * 1000), H),
    ("dom-node-count", page("<i></i>" * 1500), page("<i></i>" * 900), H),
    ("inline-style-bloat", page(f"<style>{'a' * 52_000}</style>"), page("<style>a</style>"), H),
    ("third-party-script-count", page("".join(f'<script async src="https://h{i}.test/a.js"></script>' for i in range(9))), page('<script async src="https://h.test/a.js"></script>'), H),
    ("font-display-missing", page("<style>@font-face{a:b}</style>"), page("<style>@font-face{font-display: swap}</style>"), H),
    ("preconnect-missing", page('<script async src="https://h.test/a.js"></script>'), page('<script async src="https://h.test/a.js"></script>', head='<link rel="preconnect" href="https://h.test">'), H),
    ("lang-attribute-mismatch", page("bir ve ile için " * 20, lang=' lang="en"'), page("bir ve ile için " * 20), H),
    ("lang-region-format", page(lang=' lang="tr_TR"'), page(lang=' lang="tr-TR"'), H),
    ("hreflang-invalid-code", page(head='<link rel="alternate" hreflang="tr_TR" href="/a">'), page(head='<link rel="alternate" hreflang="x-default" href="/a">'), H),
    ("hreflang-self-missing", page(head='<link rel="alternate" hreflang="tr" href="/b">'), page(head='<link rel="alternate" hreflang="tr" href="/a">'), H),
    ("hreflang-canonical-conflict", page(head='<link rel="alternate" hreflang="tr" href="/a"><link rel="canonical" href="/b">'), page(head='<link rel="alternate" hreflang="tr" href="/a"><link rel="canonical" href="/a">'), H),
    ("hreflang-x-default-missing", page(head='<link rel="alternate" hreflang="tr" href="/a"><link rel="alternate" hreflang="en" href="/b">'), page(head='<link rel="alternate" hreflang="tr" href="/a"><link rel="alternate" hreflang="x-default" href="/b">'), H),
    ("content-server-rendered", page('<div id="root"></div>'), page(f'<div id="root">{words(250)}</div>'), H),
    ("client-side-rendering", page('<div id="root"></div>'), page(f'<div id="root">{words(250)}</div>'), H),
    ("answerable-summary-missing", page(f"<p>kısa</p>{words(320)}"), page(f"<p>{'a' * 100}</p>{words(320)}"), H),
    ("faq-block-missing", page(words(260)), page(f"<h2>Nasıl yapılır</h2><h2>Bu mu?</h2>{words(260)}"), "https://s.test/hizmet"),
    ("content-freshness-missing", page(words(520)), page("Güncelleme 3 mayıs " + words(520)), H),
    ("heading-question-form", page(words(810)), page(f"<h2>Neden?</h2>{words(810)}"), H),
    ("toc-missing", page(words(1510)), None, H),
    ("anchor-text-generic", page('<a href="/b">Devamı</a>'), page('<a href="/b">ürün listesi</a>'), H),
    ("anchor-text-empty", page('<a href="/b"></a>'), page('<a href="/b"><img src="x.png" alt="ev"></a>'), H),
    ("target-blank-no-noopener", page('<a href="/b" target="_blank" rel="noreferrer">x</a>'), page('<a href="/b" target=_blank rel="noopener">x</a>'), H),
    ("internal-link-nofollow", page('<a href="/b" rel="nofollow">x</a>'), page('<a href="https://o.test" rel="nofollow">x</a>'), H),
    ("internal-links-few", page(words(310)), page('<a href="/b">b</a><a href="/c">c</a><a href="/d">d</a>' + words(310)), H),
    ("excessive-links", page('<a href="/b">b</a>' * 151), page('<a href="/b">b</a>' * 150), H),
    ("link-to-http", page('<a href="http://s.test/b">b</a>'), page('<a href="http://o.test/b">b</a>'), H),
    ("img-missing-alt", page('<img src="a.png">'), page('<img src="a.png" alt="">'), H),
    ("img-alt-quality", page('<img src="a.png" alt="kale kale kale">'), page('<img src="a.png" alt="kale ve deniz">'), H),
    ("img-missing-dimensions", page('<img src="a.png">'), page('<img src="a.png" style="aspect-ratio: 1">'), H),
    ("img-legacy-format", page('<img src="a.JPG">'), page('<picture><source type="image/webp" srcset="a.webp"><img src="a.jpg"></picture>'), H),
    ("img-lazy-missing", page('<img src="a.png">' * 4), page('<img src="a.png">' * 2 + '<img src="a.png" loading="lazy">' * 2), H),
    ("img-filename-quality", page('<img src="/x/IMG_7.jpg">'), page('<img src="/x/studyo.jpg">'), H),
    ("video-missing-schema", page('<iframe src="https://www.youtube.com/embed/x" title="x"></iframe>'), page("<video></video>" + ld(**{"@context": "https://schema.org", "@type": "VideoObject"})), H),
    ("audio-missing-transcript", page("<audio></audio>"), page("<audio></audio>" + words(90) + ld(**{"@context": "https://schema.org", "@type": "AudioObject"})), H),
    ("iframe-missing-title", page('<iframe src="/x"></iframe>'), page('<iframe src="/x" title="harita"></iframe>'), H),
    ("sri-missing", page('<script async src="https://h.test/a.js"></script>'), page('<script async src="https://h.test/a.js" integrity="sha"></script>'), H),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for k, (rule, bad, good, url) in enumerate(CASES):
        rows.append((f"{k}-bad", url, bad))
        if good:
            rows.append((f"{k}-good", url, good))
    raw = raw_pages(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n bigint, site_id string, url string, html string"), "n")
    done = A.audit(raw)
    got = {(r["site_id"], r["rule_id"]) for r in done.findings.select("site_id", "rule_id").collect()}
    assert not done.pages.where("parse_error IS NOT NULL").count()
    return got, {(r["site_id"], r["rule_id"]): (r["applicable"], r["failed"]) for r in done.applicability.collect()}


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_rule(found, k):
    rule, _, good, _ = CASES[k]
    assert (f"{k}-bad", rule) in found[0]
    assert found[1][f"{k}-bad", rule] == (1, 1)
    if good:
        assert (f"{k}-good", rule) not in found[0]


def test_network_rules_leave_no_trace_offline(found):
    assert {r for _, r in found[1]} == {r.id for r in RULES if r.offline}


def test_site_rules_with_side_inputs(spark):
    """Sites with several pages, statuses, robots, sitemaps."""
    a = page('<a href="/b">b</a><a href="/gone">g</a><a href="/moved">m</a>' + words(150), head='<title>Aynı Başlık</title><meta name="description" content="d"><link rel="canonical" href="/gone"><link rel="alternate" hreflang="en" href="/b"><link rel="alternate" hreflang="de" href="/gone">')
    b = page(words(150) + " fark", head='<title>aynı  başlık</title><meta name="description" content="D"><meta name="robots" content="noindex">')
    c = page(words(150), head='<title>AYNI BAŞLIK</title><meta name="description" content="d">')
    rows = [(0, "https://s.test/a", a), (1, "https://s.test/b", b), (2, "https://s.test/c", c), (3, "https://www.s.test/", page("x"))]
    raw = raw_pages(spark.createDataFrame(rows, "n bigint, url string, html string").withColumn("redirect_chain", F.expr("if(n = 2, array(named_struct('url', 'x', 'status', 301, 'to', 'y'), named_struct('url', 'y', 'status', 301, 'to', 'z')), array())")), "n")
    status = spark.createDataFrame([("s.test", "https://s.test/gone", 404, 0), ("s.test", "https://s.test/moved", 200, 1)], "site_id string, url string, status int, redirects int")
    entries = spark.createDataFrame([("s.test", "https://s.test/b", None), ("s.test", "https://s.test/gone", "2024-01-01")], "site_id string, loc string, lastmod string")
    maps = spark.createDataFrame([("s.test", "m1", True), ("s.test", "m2", False)], "site_id string, url string, ok boolean")
    robots = spark.createDataFrame([("s.test", "User-agent: GPTBot\nDisallow: /")], "site_id string, raw string")
    done = A.audit(raw, A.SideInputs(status, robots, maps, entries), Capabilities(headers=True, net=True))
    got = {}
    for r in done.findings.collect():
        got.setdefault(r["rule_id"], []).append(r)
    assert {
        "redirect-chain", "canonical-non-200", "robots-noindex-conflict", "sitemap-invalid-xml", "sitemap-url-non-indexable", "sitemap-orphan-pages", "sitemap-lastmod-invalid", "http-status-error",
        "www-https-canonicalization", "duplicate-content-cluster", "title-duplicate", "meta-description-duplicate", "hreflang-return-tag", "hreflang-non-200", "ai-crawler-blocked", "llms-txt-missing",
        "broken-internal-link", "internal-redirect-link", "orphan-page", "hreflang-missing-multilocale",
    } - set(got) == {"hreflang-missing-multilocale"}
    assert got["title-duplicate"][0]["pages"] == ["https://s.test/a", "https://s.test/c"]
    assert got["orphan-page"][0]["pages"] == ["https://s.test/a", "https://s.test/c"]
    assert "robots-txt-missing" not in got and "sitemap-missing" not in got
    critical = {r["rule_id"]: r["priority"] for r in done.actions.where("severity = 'critical'").collect()}
    assert critical and set(critical.values()) == {"P0"}
    assert done.site_scores.first()["verdict"] == "critical"
