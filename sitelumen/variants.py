"""Pages and sites derived from the rows of ``pages`` on which each rule fails or holds by a number of its own.

Of page number ``page_id`` two pages are made for rule ``page_id % R`` of VARIANTS, with ``n = page_id // R % 3`` and that
plus three, so every rule meets every n on 3 R pages, and SQL can say from n alone where the rule fails and what it
measures. For the rules of NETWORK, which take more than one page, each row gives a site of its own, with what a crawl
knows of it, and ``n = page_id // R % 6``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelumen.functions.text import LETTER_WIDTHS
from sitelumen.sources.pages import raw_pages

STEPS = 6
_WORDS = "kelime sayfa icerik metin uzun yazi konu baslik alan deger".split()


def words(n: int) -> str:
    return " ".join(_WORDS[i % 10] + str(i) for i in range(n))


def _ld(**x) -> str:
    return f'<script type="application/ld+json">{json.dumps(x)}</script>'


def _schema(kind: str, **x) -> str:
    return _ld(**{"@context": "https://schema.org", "@type": kind} | x)


class V:
    """One rule's pages: ``page(n)`` gives (head, body), ``fails`` and ``measure`` are SQL over n."""

    def __init__(self, fails: str, page: Callable[[int], tuple[str, str]] = lambda n: ("", ""), measure: str = "NULL", path: Callable[[int], str] = lambda n: "/a", headers: Callable[[int], dict[str, str]] = lambda n: {}, lang: Callable[[int], str] = lambda n: ' lang="tr"', early: str = '<meta charset="utf-8"><meta name="viewport" content="width=device-width">'):
        self.fails, self.page, self.measure, self.path, self.headers, self.lang, self.early = fails, page, measure, path, headers, lang, early

    def html(self, n: int) -> str:
        head, body = self.page(n)
        return f"<!doctype html><html{self.lang(n)}><head>{self.early}{head}</head><body>{body}</body></html>"


def _canonical(href: str) -> str:
    return f'<link rel="canonical" href="{href}">'


def _alternates(n: int, own: bool) -> str:
    return "".join(f'<link rel="alternate" hreflang="{k}" href="/{k}">' for k in ("en", "de", "fr", "es", "it")[:n]) + ('<link rel="alternate" hreflang="tr" href="/a">' if own else "")


GOOD = {"content-type": "text/html", "strict-transport-security": "max-age=31536000", "content-security-policy": "default-src 'self'; frame-ancestors 'none'"}

#: Width of 9 n + 1 capital W.
_PX = f"floor(((9 * n + 1) * {next(w for glyphs, w in LETTER_WIDTHS if 'W' in glyphs)} + 5) / 10)"

VARIANTS: dict[str, V] = {
    "soft-404": V("n < 3", lambda n: ("", f"<p>Sayfa bulunamadı {words(40 * n)}</p>")),
    "canonical-missing": V("n % 2 = 0", lambda n: (_canonical("/a") * (n % 2), "")),
    "canonical-relative-url": V("n % 3 = 1", lambda n: ("" if n % 3 == 0 else _canonical(("https://s.test/a", "/a", "https://x.test/")[n % 3]), "")),
    "canonical-cross-host": V("n >= 4", lambda n: (_canonical(("/a", "/b", "?x=1", "/c", "https://other.test/a", "https://www.v.test/a")[n]), "")),
    "meta-robots-nofollow": V("n % 3 = 2", lambda n: (f'<meta name="robots" content="{("index", "all", "index, nofollow")[n % 3]}">', "")),
    "mixed-content": V("n > 0", lambda n: ("", f'<img src="/b.png">' + '<img src="http://s.test/a.png">' * n), "n"),
    "url-uppercase-underscore": V("n IN (1, 3)", path=lambda n: ("/a", "/a_b", "/a-b", "/A", "/a/b", "/a?B=_")[n]),
    "url-excessive-depth": V("n + 2 > 4", path=lambda n: "/1/2" + "/x" * n, measure="n + 2"),
    "url-turkish-charset": V("n % 2 = 1", path=lambda n: ("/sehir", "/%C5%9Fehir")[n % 2]),
    "title-missing": V("n % 2 = 0", lambda n: ("<title>x</title>" * (n % 2), "")),
    "title-pixel-width": V(f"{_PX} > 580", lambda n: (f"<title>{'W' * (9 * n + 1)}</title>", ""), _PX),
    "title-too-short": V("10 * n + 1 < 30", lambda n: (f"<title>{'a' * (10 * n + 1)}</title>", ""), "10 * n + 1"),
    "meta-description-missing": V("n % 2 = 0", lambda n: ('<meta name="description" content="x">' * (n % 2), "")),
    "meta-description-length": V("20 * n + 10 < 70", lambda n: (f'<meta name="description" content="{"i" * (20 * n + 10)}">', ""), "20 * n + 10"),
    "h1-missing": V("n = 0", lambda n: ("", "<h1>x</h1>" * n)),
    "h1-count": V("n > 1", lambda n: ("", "<h1>x</h1>" * n), "n"),
    "heading-hierarchy-skip": V("n > 0", lambda n: ("", "<h1>a</h1>" + "<h2>b</h2><h4>c</h4>" * n), "n"),
    "heading-empty": V("n % 2 = 1", lambda n: ("", "<h1>a</h1>" + "<h2> </h2>" * (n % 2))),
    "thin-content": V("100 * n < 300", lambda n: ("", f"<main>{words(100 * n)}</main>"), "100 * n"),
    "turkish-mojibake": V("n >= 2", lambda n: ("", " ".join(("Ã¼", "ÅŸ", "Ã¶", "Ä±", "Ã§")[:n]))),
    "charset-declaration-late": V("300 * n + 152 > 1024", lambda n: (f"<style>{'a' * (300 * n + 100)}</style><meta charset=utf-8>", ""), "300 * n + 152", early=""),
    "viewport-meta-missing": V("n % 2 = 0", lambda n: ('<meta name="viewport" content="width=device-width">' * (n % 2), ""), early='<meta charset="utf-8">'),
    "lang-attribute-missing": V("n % 2 = 0", lang=lambda n: ' lang="tr"' * (n % 2)),
    "jsonld-parse-error": V("n > 0", lambda n: ("", _schema("Thing") + '<script type="application/ld+json">{"a":1,}</script>' * n), "n"),
    "jsonld-missing": V("n = 0", lambda n: ("", _schema("Thing") * n)),
    "jsonld-context-invalid": V("n % 2 = 1", lambda n: ("", _ld(**{"@context": "https://example.org" if n % 2 else "https://schema.org", "@type": "Thing"}))),
    "jsonld-required-props": V("n > 0", lambda n: ("", _schema("Thing") + _schema("Article", headline="x") * n), "n"),
    "jsonld-faq-mismatch": V("n > 0", lambda n: ("", "Açık soru? " + _schema("FAQPage", mainEntity=[{"@type": "Question", "name": "Açık soru?"}, *({"@type": "Question", "name": f"Gizli {k}?"} for k in range(n))])), "n"),
    "jsonld-breadcrumb-missing": V("n >= 2", path=lambda n: "/x" * n or "/"),
    "og-missing": V("n < 4", lambda n: ("".join(f'<meta property="og:{k}" content="x">' for k in ("title", "description", "image", "url", "type")[:n]), "")),
    "twitter-card-missing": V("n % 2 = 0", lambda n: ('<meta name="twitter:card" content="summary">' * (n % 2), "")),
    "render-blocking-css": V("n > 1", lambda n: ('<link rel="stylesheet" href="a.css">' * n, ""), "n"),
    "render-blocking-js": V("n > 0", lambda n: ('<script src="/a.js"></script>' * n + '<script src="/b.js" defer></script>', ""), "n"),
    "lcp-candidate-lazy": V("n % 3 = 1", lambda n: ("", ("", '<img src="a.png" loading="lazy">', '<img src="a.png">')[n % 3])),
    "dom-node-count": V("400 * n + 10 > 1500", lambda n: ("", "<i></i>" * (400 * n + 4)), "NULL"),
    "inline-style-bloat": V("n >= 4", lambda n: (f"<style>{'a' * (15_000 * n)}</style>", ""), "15000 * n"),
    "third-party-script-count": V("2 * n > 8", lambda n: ("", "".join(f'<script async src="https://h{i}.test/a.js"></script>' for i in range(2 * n))), "2 * n"),
    "font-display-missing": V("n % 3 = 1", lambda n: (("", "<style>@font-face{a:b}</style>", "<style>@font-face{font-display: swap}</style>")[n % 3], "")),
    "preconnect-missing": V("n % 3 = 1", lambda n: ('<link rel="preconnect" href="https://h.test">' if n % 3 == 2 else "", '<script async src="https://h.test/a.js"></script>' * min(n % 3, 1))),
    "lang-region-format": V("n IN (1, 4)", lang=lambda n: f' lang="{("tr", "tr_TR", "tr-TR", "en-GB", "TR", "x-default")[n]}"'),
    "lang-attribute-mismatch": V("n >= 3", lambda n: ("", "bir ve ile için " * (5 * n)), lang=lambda n: ' lang="en"'),
    "hreflang-invalid-code": V("n % 2 = 1", lambda n: (f'<link rel="alternate" hreflang="{("tr", "tr_TR")[n % 2]}" href="/a">', "")),
    "hreflang-self-missing": V("n IN (2, 4)", lambda n: (_alternates(n, n % 2 == 1), "")),
    "answerable-summary-missing": V("n = 0 OR 100 * n > 400", lambda n: ("", f"<p>{'a' * (100 * n + 20 * (n == 0))}</p>{words(320)}"), "CASE WHEN n > 0 THEN 100 * n END"),
    "content-server-rendered": V("100 * n < 200", lambda n: ("", f'<div id="root">{words(100 * n)}</div>')),
    "heading-question-form": V("n = 0", lambda n: ("", "<h2>Neden?</h2>" * n + words(810))),
    "toc-missing": V("true", lambda n: ("", '<a href="#x">x</a>' * n + words(1510))),
    "anchor-text-generic": V("n > 0", lambda n: ("", '<a href="/b">ürün listesi</a>' + '<a href="/b">Devamı</a>' * n), "n"),
    "anchor-text-empty": V("n % 2 = 1", lambda n: ("", f'<a href="/b">{"" if n % 2 else "x"}</a>')),
    "target-blank-no-noopener": V("n % 3 = 1", lambda n: ("", f'<a href="/b"{("", " target=_blank", " target=_blank rel=noopener")[n % 3]}>x</a>')),
    "internal-link-nofollow": V("n % 3 = 1", lambda n: ("", f'<a href="{("/b", "/b", "https://o.test/")[n % 3]}"{" rel=nofollow" * (n % 3 > 0)}>x</a>')),
    "internal-links-few": V("n < 3", lambda n: ("", "".join(f'<a href="/{i}">b</a>' for i in range(n)) + words(310)), "n"),
    "excessive-links": V("40 * n > 150", lambda n: ("", '<a href="/b">b</a>' * (40 * n)), "40 * n"),
    "link-to-http": V("n % 3 = 1", lambda n: ("", f'<a href="{("/b", "http://v.test/b", "http://o.test/b")[n % 3]}">b</a>')),
    "img-missing-alt": V("n > 0", lambda n: ("", '<img src="a.png" alt="">' + '<img src="a.png">' * n), "n"),
    "img-alt-quality": V("n >= 3", lambda n: ("", f'<img src="a.png" alt="deniz {"kale " * n}">')),
    "img-missing-dimensions": V("n > 0", lambda n: ("", '<img src="a.png" width="1" height="1">' + '<img src="a.png">' * n), "n"),
    "img-legacy-format": V("n % 3 = 1", lambda n: ("", ("", '<img src="a.JPG">', '<picture><source type="image/webp" srcset="a.webp"><img src="a.jpg"></picture>')[n % 3])),
    "img-lazy-missing": V("n > 2", lambda n: ("", '<img src="a.png" loading="lazy">' + '<img src="a.png">' * n)),
    "img-filename-quality": V("n IN (1, 3)", lambda n: ("", f'<img src="/x/{("studyo", "DSC_12", "deniz-kale", "şehir", "mavi", "gri")[n]}.webp">')),
    "video-missing-schema": V("n % 3 = 1", lambda n: ("", "<video></video>" * min(n % 3, 1) + _schema("VideoObject") * (n % 3 == 2))),
    "audio-missing-transcript": V("n < 2", lambda n: ("", "<audio></audio>" + words(45 * n) + _schema("AudioObject"))),
    "iframe-missing-title": V("n % 2 = 1", lambda n: ("", f'<iframe src="/x"{"" if n % 2 else " title=harita"}></iframe>')),
    "sri-missing": V("n > 0", lambda n: ("", '<script async src="https://h.test/a.js" integrity="sha"></script>' + '<script async src="https://h.test/b.js"></script>' * n), "n"),
    "hsts-missing": V("n % 2 = 0", headers=lambda n: GOOD if n % 2 else {"content-type": "text/html"}),
    "hsts-weak": V("n > 0 AND 4000000 * n < 15552000", headers=lambda n: {"a": "b"} | ({"strict-transport-security": f"max-age={4_000_000 * n}; preload"} if n else {})),
    "csp-missing": V("n % 2 = 0", headers=lambda n: GOOD if n % 2 else {"content-type": "text/html"}),
    "csp-unsafe": V("n IN (1, 2, 4)", headers=lambda n: {"content-security-policy": ("default-src 'self'", "script-src 'unsafe-inline'", "script-src *", "script-src *.x.test", "script-src 'UNSAFE-EVAL'", "img-src *")[n]}),
    "x-content-type-options-missing": V("n % 2 = 0", headers=lambda n: {"a": "b"} | {"x-content-type-options": "NoSniff"} if n % 2 else {"a": "b"}),
    "clickjacking-protection-missing": V("n % 3 = 0", headers=lambda n: ({"a": "b"}, {"x-frame-options": "DENY"}, {"content-security-policy": "Frame-Ancestors 'none'"})[n % 3]),
    "referrer-policy-missing": V("n % 2 = 0", headers=lambda n: {"referrer-policy": "no-referrer"} if n % 2 else {"a": "b"}),
    "permissions-policy-missing": V("n % 2 = 0", headers=lambda n: {"permissions-policy": "camera=()"} if n % 2 else {"a": "b"}),
    "cookie-flags-weak": V("n IN (1, 2, 3, 5)", headers=lambda n: {"a": "b"} | ({} if n == 0 else {"set-cookie": "a=1" + "; Secure" * (n in (1, 2, 4)) + "; HttpOnly" * (n in (2, 3, 4)) + "; SameSite=Lax" * (n in (3, 4, 5))})),
    "server-version-disclosure": V("n IN (1, 3)", headers=lambda n: ({"a": "b"}, {"server": "nginx/1.18"}, {"server": "nginx"}, {"x-powered-by": "PHP/8.2"}, {"x-generator": "own"}, {"etag": "1.2"})[n]),
    "no-compression": V("600 * n >= 2048 AND n <> 5", lambda n: ("", "k" * (600 * n)), "NULL", headers=lambda n: {"content-encoding": "br" if n == 5 else "identity"}),
}


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def variant_pages(pages: DataFrame) -> DataFrame:
    """Raw pages, two of each row of ``pages(page_id)``, numbered ``2 * page_id`` and up; the site is the rule that they are made for."""
    made = []
    for rule, v in VARIANTS.items():
        for n in range(STEPS):
            headers = ", ".join(f"{_literal(k)}, {_literal(x)}" for k, x in v.headers(n).items())
            made.append(f"({len(made)}, '{rule}', {_literal(v.path(n))}, {_literal(v.html(n))}, CAST(map({headers}) AS map<string,string>))")
    table = pages.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(made)} AS v(k, rule, path, html, headers)")
    rows = pages.select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    n = F.pmod(F.floor(F.col("page_id") / len(VARIANTS)), F.lit(STEPS // 2)) + F.col("half") * (STEPS // 2)
    rows = rows.select((2 * F.col("page_id") + F.col("half")).alias("page_id"), (F.pmod("page_id", F.lit(len(VARIANTS))) * STEPS + n).alias("k")).join(F.broadcast(table), "k")
    url = F.concat(F.lit("https://x"), F.col("page_id").cast("string"), F.lit(".v.test"), "path")
    return raw_pages(rows.select("page_id", F.col("rule").alias("site_id"), url.alias("url"), "html", "headers"), "page_id")


def _oracle(variants: dict, n: str, source: str, columns: str) -> str:
    rules = ", ".join(f"({i}, '{rule}')" for i, rule in enumerate(variants))
    fails = " ".join(f"WHEN {i} THEN {v.fails}" for i, v in enumerate(variants.values()))
    measures = " ".join(f"WHEN {i} THEN {v.measure}" for i, v in enumerate(variants.values()) if v.measure != "NULL")
    return (
        f"WITH r(i, rule_id) AS (VALUES {rules}), p AS (SELECT {columns}, page_id % {len(variants)} AS i, {n} AS n FROM {source}) "
        f"SELECT {columns}, rule_id, (CASE i {measures} END)::DOUBLE AS measure FROM p JOIN r USING (i) WHERE CASE i {fails} END"
    )


def oracle() -> str:
    """SQL of (page_id, half, rule_id) where the page's rule fails, with the measure where VARIANTS gives one."""
    return _oracle(VARIANTS, f"page_id // {len(VARIANTS)} % {STEPS // 2} + half * {STEPS // 2}", "pages, (VALUES (0), (1)) h(half)", "page_id, half")


# --- rules that take a whole site ---


class Site:
    """One rule's sites: ``pages(n)`` gives (path, head, body) of each page, ``known(n)`` what a crawl knows; ``@`` is the origin."""

    def __init__(self, fails: str, pages: Callable[[int], list[tuple[str, str, str]]] = lambda n: [("@/a", "", "")], known: Callable[[int], dict] = lambda n: {}, measure: str = "NULL"):
        self.fails, self.pages, self.known, self.measure = fails, pages, known, measure


def _alternate(lang: str, href: str) -> str:
    return f'<link rel="alternate" hreflang="{lang}" href="{href}">'


def _one(head: str = "", body: str = "", path: str = "@/a") -> list[tuple[str, str, str]]:
    return [(path, head, body)]


#: Keys of ``known``: status (url, status, redirects), robots, maps (url, ok), entries (loc, lastmod), llms, hops (of the first page).
NETWORK: dict[str, Site] = {
    "redirect-chain": Site("n >= 2", known=lambda n: {"hops": n}, measure="n"),
    "canonical-non-200": Site("n IN (1, 3, 4, 5)", lambda n: _one(_canonical("/c")), lambda n: {"status": [("@/c", (200, 404, 0, 301, 200, 503)[n], int(n == 4))]}),
    "robots-noindex-conflict": Site("n IN (1, 3)", lambda n: _one('<meta name="robots" content="noindex">' * (n % 2), '<a href="/a">x</a>' * (n == 3)), lambda n: {"entries": [("@/a", "2024-01-01")] * (n in (1, 2))}),
    "robots-txt-missing": Site("n % 2 = 0", known=lambda n: {"robots": "User-agent: *"} if n % 2 else {}),
    "sitemap-missing": Site("n < 2", known=lambda n: {"maps": [("@/m", n > 1)] * min(n, 1)}),
    "sitemap-invalid-xml": Site("n % 3 > 0", known=lambda n: {"maps": [("@/m", True), ("@/k", False), ("@/l", False)][: 1 + n % 3]}, measure="n % 3"),
    "sitemap-url-non-indexable": Site("n IN (1, 2, 3)", lambda n: _one('<meta name="robots" content="noindex">' * (n == 3)), lambda n: {"entries": [("@/a", None), ("@/b", None)], "status": [("@/b", 404 if n == 1 else 200, int(n == 2))]}, "1"),
    "sitemap-orphan-pages": Site("n % 2 = 0", lambda n: [("@/a", "", ""), ("@/b", "", "")], lambda n: {"entries": [("@/a", None), ("@/b", None)][: 1 + n % 2]}, "1"),
    "sitemap-lastmod-invalid": Site("n IN (1, 2, 3, 5)", known=lambda n: {"entries": [("@/a", ("2024-01-01", None, "x", "2999-01-01", "2024-01-01T10:00:00Z", "01.02.2024")[n])]}, measure="1"),
    "http-status-error": Site("n IN (1, 4)", known=lambda n: {"status": [("@/a", 200, 0), ("https://other.test/z" if n == 2 else "@/z", (200, 404, 404, 0, 500, 301)[n], 0)]}, measure="1"),
    "www-https-canonicalization": Site("n % 2 = 1", lambda n: [("@/a", "", ""), ("https://www.#/a" if n % 2 else "@/b", "", "")]),
    "jsonld-service-missing": Site("n IN (0, 3, 5)", lambda n: _one("", ("", "", _schema("Service"), "<h1>Fiyat listesi</h1>", _schema("Product"), _schema("Thing"))[n], "@" + ("/hizmet", "/a", "/hizmet", "/b", "/pricing", "/paket")[n])),
    "jsonld-sameas-missing": Site("n % 3 = 1", lambda n: _one("", ("", _schema("Organization", name="x"), _schema("Organization", sameAs=["https://o.test"]))[n % 3])),
    "hreflang-return-tag": Site("n % 2 = 0", lambda n: [("@/a", _alternate("tr", "/a") + _alternate("en", "/b"), ""), ("@/b", _alternate("tr", "/a") * (n % 2), "")], measure="1"),
    "hreflang-non-200": Site("n % 3 > 0", lambda n: _one(_alternate("en", "/en")), lambda n: {"status": [("@/en", (200, 404, 200)[n % 3], int(n % 3 == 2))]}, "1"),
    "hreflang-canonical-conflict": Site("n % 2 = 1", lambda n: _one(_alternate("tr", "/a") + _canonical("/b" if n % 2 else "/a"))),
    "hreflang-x-default-missing": Site("n % 3 = 1", lambda n: _one("".join(_alternate(x, f"/{x}") for x in (("en",), ("en", "de"), ("en", "de", "x-default"))[n % 3]))),
    "ai-crawler-blocked": Site("n % 3 = 1", known=lambda n: {"robots": ("User-agent: *\nDisallow: /", "User-agent: GPTBot\nDisallow: /", "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nAllow: /")[n % 3]}, measure="1"),
    "llms-txt-missing": Site("n NOT IN (3, 5)", known=lambda n: {"llms": " " if n == 1 else "# x"} if n % 2 else {}),
    "faq-block-missing": Site("n IN (0, 4)", lambda n: _one("", ("", "<h2>Neden?</h2><h2>Ne zaman?</h2>", _schema("FAQPage"), "", "<h2>Kaça?</h2>", "")[n] + words(100 if n == 5 else 260), "@/a" if n == 3 else "@/hizmet")),
    "broken-internal-link": Site("n IN (1, 2)", lambda n: _one("", '<a href="/b">b</a>' * n), lambda n: {"status": [("@/b", 404 if n in (1, 2) else 200, 0)]}, "n"),
    "internal-redirect-link": Site("n >= 3", lambda n: _one("", '<a href="/b">b</a>' * n), lambda n: {"status": [("@/b", 200, int(n >= 3))]}, "n"),
}
_KNOWN = "pages array<struct<url:string,html:string>>, status array<struct<url:string,status:int,redirects:int>>, robots string, maps array<struct<url:string,ok:boolean>>, entries array<struct<loc:string,lastmod:string>>, llms string, hops int"


def network_sites(pages: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Raw pages of a site for each row of ``pages(page_id)``, called by its number, and the tables of what a crawl knows of them."""
    made = []
    for rule, v in NETWORK.items():
        for n in range(STEPS):
            own = [(url, f'<!doctype html><html lang="tr"><head><meta charset="utf-8">{head}</head><body>{body}</body></html>') for url, head, body in v.pages(n)]
            known = v.known(n)
            made.append((len(made), own, known.get("status", []), known.get("robots"), known.get("maps", []), known.get("entries", []), known.get("llms"), known.get("hops", 0)))
    table = pages.sparkSession.createDataFrame(made, "k int, " + _KNOWN)  # as many rows as there are rules and steps
    k = F.pmod("page_id", F.lit(len(NETWORK))) * STEPS + F.pmod(F.floor(F.col("page_id") / len(NETWORK)), F.lit(STEPS))
    sites = pages.select("page_id", F.col("page_id").cast("string").alias("site_id"), F.concat(F.lit("x"), F.col("page_id").cast("string"), F.lit(".n.test")).alias("host"), k.cast("int").alias("k")).join(F.broadcast(table), "k")
    origin = lambda c: F.replace(F.replace(F.col(c), F.lit("@"), F.concat(F.lit("https://"), "host")), F.lit("#"), F.col("host")).alias(c)
    hop = F.struct(origin("url"), F.lit(301).alias("status"), origin("url").alias("to"))
    rows = sites.select("page_id", "site_id", "host", "hops", F.posexplode("pages").alias("at", "page")).select("page_id", "site_id", "host", "hops", "at", "page.*")
    chain = F.when(F.col("at") == 0, F.array_repeat(hop, F.col("hops"))).otherwise(F.array_repeat(hop, F.lit(0)))
    raw = raw_pages(rows.select((4 * F.col("page_id") + F.col("at")).alias("n"), "site_id", origin("url"), "html", chain.alias("redirect_chain"), F.expr("map('content-type', 'text/html')").alias("headers")), "n")
    side = {
        "url_status": sites.select("site_id", "host", F.inline("status")).select("site_id", origin("url"), "status", "redirects"),
        "robots": sites.where("robots IS NOT NULL").select("site_id", F.col("robots").alias("raw")),
        "sitemaps": sites.select("site_id", "host", F.inline("maps")).select("site_id", origin("url"), "ok"),
        "sitemap_entries": sites.select("site_id", "host", F.inline("entries")).select("site_id", origin("loc"), "lastmod"),
        "llms_txt": sites.where("llms IS NOT NULL").select("site_id", F.col("llms").alias("text")),
    }
    return raw, side


def network_oracle() -> str:
    """SQL of (page_id, rule_id) where the site's rule fails, with the measure where NETWORK gives one."""
    return _oracle(NETWORK, f"page_id // {len(NETWORK)} % {STEPS}", "pages", "page_id")
