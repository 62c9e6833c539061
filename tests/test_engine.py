"""Catalogue, functions, sources, sinks, command line, crawl and stream."""

from __future__ import annotations

import gzip
import json
import random
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sitelumen import cli
from sitelumen.functions import text as T
from sitelumen.functions import url as U
from sitelumen.operators import near_duplicates as N
from sitelumen.plans import audit as A
from sitelumen.plans import report
from sitelumen.plans.catalog import CATEGORY_WEIGHT, RULES, Rule, catalog_digest
from sitelumen.sources import crawl as C
from sitelumen.sources import pages as P
from sitelumen.sources.html_tree import tree
from sitelumen.streaming import ingest


def test_catalogue():
    assert len(RULES) == 107 and abs(sum(CATEGORY_WEIGHT.values()) - 1) < 1e-9 and CATEGORY_WEIGHT["security"] == 0
    assert sum(r.offline for r in RULES) / len(RULES) > 0.6
    assert catalog_digest(RULES[::-1]) == catalog_digest() and len(catalog_digest()) == 16
    for bad in ({"category": "x"}, {"severity": "x"}, {"weight": 11}, {"effort": "x"}, {"scope": "x"}, {"needs": ("x",)}, {"fails": ""}):
        with pytest.raises(ValueError):
            Rule(**{"id": "a", "category": "links", "severity": "error", "weight": 1, "impact": 1, "effort": "low", "applies": "true", "fails": "true"} | bad)


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [
        ("https://a.test/x?utm_Source=1&b=2&a=1&fbclid=3", None, "https://a.test/x?a=1&b=2"),
        ("HTTPS://A.test:443/#z", None, "https://a.test/"),
        ("../c?x=%c4%b1", "https://a.test/a/b/", "https://a.test/a/c?x=%C4%B1"),
        ("/şehir yolu", "http://a.test", "http://a.test/%C5%9Fehir%20yolu"),
        ("//b.test/x", "https://a.test", "https://b.test/x"),
        ("?q=1", "https://a.test/x?y#z", "https://a.test/x?q=1"),
        ("ftp://a.test/", None, None),
        ("https://", None, None),
        ("http://a b/", None, None),
        ("", None, None),
        (None, None, None),
        ("https://user:pw@a.test:8443/x", None, "https://a.test:8443/x"),
    ],
)
def test_normalize(url, base, want):
    assert U.normalize(url, base) == want


def test_url_parts(spark):
    for href in ("mailto:a@b.c", "tel:1", "#x", " ", "javascript:void(0)", "WhatsApp:1", None):
        assert U.resolve(href, "https://a.test/") is None
    assert U.site_of("https://alt.ornek.com.tr/") == "ornek.com.tr" and U.same_site("https://a.b.test/", "http://c.b.test") and not U.same_site(None, None)
    row = spark.createDataFrame([("https://www.a.b.co.uk/x%C4%B1/y/?q",)], "u string").select(U.registrable_domain("u").alias("d"), U.path_depth("u").alias("n"), U.has_raw_turkish("u").alias("t"), U.has_uppercase_or_underscore("u").alias("x"), U.without_trailing_slash("u").alias("w")).first()
    assert tuple(row) == ("b.co.uk", 2, True, True, "https://www.a.b.co.uk/x%C4%B1/y?q")


def test_inlinks_of_all_targets_equal_brute_force(spark, tmp_path):
    from sitelumen import queries

    hrefs = ["/a", "/şehir", "/bir yol", "/%c4%b1", "/ü?q=ş", "https://other.test/x"]
    pages = [(i, f"https://www.ornek.test/p{i}", "<html><body>" + "".join(f'<a href="{h}">x</a>' for h in hrefs[: i + 1]) + "</body></html>") for i in range(6)]
    sample = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    fields = {f.name: f.dataType.simpleString() for f in sample.schema.fields}
    made = spark.createDataFrame(pages, "page_id long, url string, html string")
    made.select(*[(F.col(n) if n in made.columns else F.lit(None)).cast(t).alias(n) for n, t in fields.items()]).write.parquet(f"{tmp_path}/pages.parquet")
    want: dict[str, int] = {}
    for i, url, _ in pages:
        for h in hrefs[: i + 1]:
            target = U.normalize(h, url)
            if U.same_site(target, url):
                want[target] = want.get(target, 0) + 1
    got = {r["target"]: r["inlinks"] for r in queries.QUERIES["inlinks"](spark, str(tmp_path)).collect()}
    assert got == want and sum("%" in t for t in got) == 4


def test_tree():
    text = lambda h: tree(h).text().strip()
    assert text("<title>a</title><p>b<p>c</div>d") == "abcd" and text("<script>x</div></script>") == "x</div>" and text("a&amp;b &lt;") == "a&b <"
    root = tree("<p><b>x<p>y</b>z<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>")
    tags = [n.tag for n in root.walk()]
    assert tags.count("p") == 2 and tags.count("b") == 2 and tags.count("li") == 2 and tags.count("tr") == 2 and tags.count("td") == 3
    assert [n.attrs for n in tree("<A HREF=/x data-y='1' z>").walk()][-1] == {"href": "/x", "data-y": "1", "z": ""}
    rng = random.Random(0)
    for _ in range(300):
        tree("".join(rng.choices(["<", ">", "/", "p", "b", " ", "=", '"', "'", "<!--", "-->", "<script>", "</script>", "<a", "<table><tr>", "</p>", "&", "ş", "</body>", "<title>"], k=30)))
    tree("<div>" * 20_000 + "x")
    for hostile in ("<b>" * 3000 + "<p>x" * 3000, "<p><b>x" * 3000, "".join(f"<p><i id={i}>x" for i in range(3000))):
        assert sum(1 for _ in tree(hostile).walk()) < 3000 * 70


def test_simhash_and_px(spark):
    near = "bir iki uc dort bes alti yedi sekiz dokuz on " * 4
    row = spark.createDataFrame([(near, near.replace("uc", "yuz", 1), "tamamen baska bir konu hakkinda yazi", "")], "a string, b string, c string, e string")
    codes = row.select(*[T.simhash(T.tokens(c)).alias(c) for c in "abce"])
    got = codes.select(T.hamming(F.col("a"), F.col("b")).alias("n"), T.hamming(F.col("a"), F.col("c")).alias("f"), F.col("e")).first()
    assert got["n"] <= 6 < got["f"] and got["e"] == 0
    px = spark.createDataFrame([("iii", "WWW", "", None, "İI1!")], "a string, b string, c string, d string, e string").select(*[T.text_px(c).alias(c) for c in "abcde"]).first()
    assert tuple(px) == (14, 50, 0, 0, 27)
    assert row.select(T.tr_equals(F.lit("ISPARTA"), F.lit("ısparta")).alias("x")).first()["x"]


@pytest.mark.parametrize("most", [{2: 1 << 16, 3: 1 << 21, 4: 1 << 26}, {2: 70, 3: 99, 4: 100}, {2: 0, 3: 75, 4: 100}, {2: 0, 3: 0, 4: 1000}, {2: 0, 3: 0, 4: 0}])
def test_banded_near_duplicates_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(N, "MOST_CODES", most)
    rng = random.Random(4)
    codes = [rng.getrandbits(64) for _ in range(40)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for c in codes for _ in range(3)]
    signed = [(f"s{i % 2}", c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    got = {(r["site_id"], r["a"], r["b"]) for r in N.near_classes(spark.createDataFrame(signed, "site_id string, simhash bigint")).collect()}
    rows = set(signed)
    want = {(s, a, b) for s, a in rows for t, b in rows if s == t and a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 6}
    assert got == want and want
    counts = N.near_counts(spark.createDataFrame(signed, "site_id string, simhash bigint")).collect()
    for r in counts[:40]:
        assert r["near"] == sum(s == r["site_id"] and ((c ^ r["simhash"]) & (1 << 64) - 1).bit_count() <= 6 for s, c in signed) - 1


def test_last_page_of_a_url_wins(spark):
    from sitelumen.operators.site import last_wins

    rows = spark.createDataFrame([("s", "u", 1, "a"), ("s", "u", 5, "b"), ("s", "v", 3, "c")], "site_id string, normalized_url string, ingest_seq bigint, x string")
    assert {(r["normalized_url"], r["x"], r["seq"]) for r in last_wins(rows).collect()} == {("u", "b", 1), ("v", "c", 3)}


SITE = {
    "index.html": '<html lang="tr"><head><title>Ana <script></title></head><body><h1>Ana</h1><a href="/b">| [x](javascript:1) | <b>b</b></a>',
    "b.html": '<html lang="tr"><head><title>İkinci</title><link rel="canonical" href="/c"></head><body><p>metin',
    "alt/d.htm": "<html><body>d",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("site")
    for name, html in SITE.items():
        (out / name).parent.mkdir(exist_ok=True)
        (out / name).write_text(html, encoding="utf-8")
    return out


def test_directory_and_command_line(spark, folder, tmp_path):
    raw = A.remapped(P.from_directory(spark, str(folder), "https://ornek.test"))
    assert {r["url"] for r in raw.select("url").collect()} == {"https://ornek.test/", "https://ornek.test/c", "https://ornek.test/alt/d"}
    out = str(tmp_path / "out")
    assert cli.main(["--input-dir", str(folder), "--base-url", "https://ornek.test", "--out", out, "--format", "json,md,html", "--quiet"], spark) == cli.OK
    (document,) = report.read_documents(spark, f"{out}/json")
    assert (document["site"]["site_id"], document["site"]["page_count"], document["site"]["status"]) == ("ornek.test", 3, "ok") and document["run"]["rules"] == 107
    assert document["site"]["hosts"] == ["ornek.test"] and json.loads(document["run"]["options"])["min_words"] == 300 and not document["run"].get("rule_errors")
    assert [p["url"] for p in document["pages"]] == sorted(p["url"] for p in document["pages"])
    assert [(e["url"], e["kind"]) for e in document["run"]["errors"]] == [(e["url"], "url-mapping: https://ornek.test/c") for e in document["run"]["errors"]] and len(document["run"]["errors"]) == 1
    md, html = report.markdown(document), report.html_report(document)
    assert "ornek.test" in md and "<script>" not in html and "Offline run" in md
    assert cli.main(["--from-audit", f"{out}/json", "--out", out, "--fail-on", "critical", "--quiet"], spark) == cli.THRESHOLD  # a page has no title
    assert cli.main(["--from-audit", f"{out}/json", "--out", out, "--quiet"], spark) == cli.OK
    assert cli.main(["--from-audit", f"{out}/json", "--out", out, "--min-score", "101", "--quiet"], spark) == cli.THRESHOLD
    assert cli.main([], spark) == cli.USAGE and cli.main(["--input-dir", "x"], spark) == cli.USAGE


def test_escapes():
    assert report.md_safe("[x](y)|`<b>\n#") == r"\[x\]\(y\)\|\`\<b\> \#" and report.esc("<a href=\"x\">'&") == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"


def test_pairs(spark):
    frame, skipped = P.from_pairs(spark, [{"url": "https://a.test/", "html": "<p>x"}, {"url": "bad", "html": "y"}, {"url": "https://a.test/b", "html": " "}])
    assert frame.count() == 1 and [s["url"] for s in skipped] == ["bad"]
    for bad in ([], [{"url": "bad", "html": "x"}], [{"url": "https://a.test", "html": ""}]):
        with pytest.raises(ValueError):
            P.from_pairs(spark, bad)


PAGES = {
    "https://c.test/robots.txt": (200, "User-agent: *\nDisallow: /private\nSitemap: https://c.test/index.xml"),
    "https://c.test/index.xml": (200, "<sitemapindex><sitemap><loc>https://c.test/map.xml</loc></sitemap><sitemap><loc>https://c.test/none.xml</loc></sitemap></sitemapindex>"),
    "https://c.test/map.xml": (200, "<urlset><url><loc>https://c.test/a</loc></url><url><loc>https://c.test/island</loc></url><url><loc>https://o.test/x</loc></url><url><loc>https://c.test/f.pdf</loc></url></urlset>"),
    "https://c.test/llms.txt": (200, "hello"),
    "https://c.test/": (200, '<a href="/a">a</a><a href="/private/x">p</a><a href="/f.pdf">f</a><a href="https://o.test/">o</a>'),
    "https://c.test/a": (200, '<a href="/">home</a><a href="/lost">l</a>'),
    "https://c.test/island": (200, "<p>no page links here"),
    "https://c.test/lost": (404, "gone"),
}


def fake(url: str) -> dict:
    status, html = PAGES.get(url, (0, None))
    return {"url": url, "status": status, "html": html, "headers": {"content-type": "text/html"}, "redirect_chain": [], "final_url": url, "ttfb_ms": 5, "error": None if status else "dns", "transfer_bytes": 1}


def challenge(url: str) -> dict:
    if url == "https://c.test/" or url.endswith((".txt", ".xml")):
        found = fake(url)
        return found | {"html": "".join(f'<a href="/{i}">x</a>' for i in range(9))} if found["status"] and url.endswith("/") else found
    return fake(url) | {"status": 403, "html": "Just a moment...", "headers": {}, "error": None}


FAST = C.CrawlConfig(delay_ms=0)


def test_crawl(spark):
    got = C.crawl(spark, "https://c.test/", FAST, fake)
    # the sitemap leads to a page without inlinks; other sites, files and barred paths are not asked for
    assert {(r["url"], r["status"]) for r in got["url_status"].collect()} == {("https://c.test/", 200), ("https://c.test/a", 200), ("https://c.test/island", 200), ("https://c.test/lost", 404)}
    assert {(r["url"], r["depth"]) for r in got["raw"].collect()} == {("https://c.test/", 0), ("https://c.test/a", 1), ("https://c.test/island", 1)}
    assert got["status"] == "ok" and got["llms_txt"].first()["text"] == "hello"
    assert {(r["url"], r["ok"]) for r in got["sitemaps"].collect()} == {("https://c.test/index.xml", True), ("https://c.test/map.xml", True), ("https://c.test/none.xml", False)}
    assert len(got["sitemap_entries"].collect()) == 4
    counters = got["counters"].first()
    assert (counters["requested"], counters["fetched"], counters["failed"], counters["skipped_by_robots"]) == (4, 3, 1, 1)
    pages = A.derived(A.page_models(P.raw_pages(got["raw"])))
    for robots, more in ((None, {"https://c.test/private/x"}), (got["robots"], set())):
        known = C.probe(pages, got["url_status"], FAST, fake, robots)
        assert {r["url"] for r in known.collect()} - {r["url"] for r in got["url_status"].collect()} == {"https://c.test/f.pdf"} | more
        assert {r["site_id"] for r in known.collect()} == {"c.test"}
    few = C.crawl(spark, "https://c.test/", C.CrawlConfig(delay_ms=0, max_pages=2, concurrency=1), fake)
    assert few["raw"].count() == 2 and C.crawl(spark, "https://c.test/", C.CrawlConfig(delay_ms=0, max_depth=0), fake)["raw"].count() == 1
    assert C.crawl(spark, "https://nowhere.test/", FAST, fake)["status"] == "failed"


def test_crawl_tries_both_usual_sitemaps_and_reads_no_page_as_robots(spark):
    site = {
        "https://d.test/robots.txt": (200, "<!DOCTYPE html><p>Disallow: /"), "https://d.test/sitemap_index.xml": (200, "<urlset><url><loc>https://d.test/b</loc></url></urlset>"),
        "https://d.test/": (200, "<p>x"), "https://d.test/b": (200, "<p>y"),
    }
    got = C.crawl(spark, "https://d.test/", FAST, lambda u: fake(u) | {"status": site.get(u, (404, ""))[0], "html": site.get(u, (404, ""))[1], "error": None})
    assert {r["url"] for r in got["raw"].collect()} == {"https://d.test/", "https://d.test/b"} and got["robots"].count() == 0
    assert {(r["url"], r["ok"]) for r in got["sitemaps"].collect()} == {("https://d.test/sitemap.xml", False), ("https://d.test/sitemap_index.xml", True)}


def test_blocked_crawl_is_reported(spark):
    config = C.CrawlConfig(delay_ms=0, concurrency=1, check_external=False)
    got = C.crawl(spark, "https://c.test/", config, challenge)
    counters = got["counters"].first()
    assert got["status"] == "blocked" and counters["requested"] == 1 + C.STREAK and counters["fetched"] == 1
    done = A.audit(P.raw_pages(got["raw"]), A.SideInputs(got["url_status"], got["robots"], got["sitemaps"], got["sitemap_entries"], got["llms_txt"]), P.Capabilities(True, True), crawl=got["counters"])
    document = json.loads(report.documents(done).first()["document"])
    assert document["run"]["status"] == "blocked" and document["run"]["counters"]["requested"] == 4 and document["site"]["llms_txt"] is True
    assert "challenge pages" in report.markdown(document) and "challenge pages" in report.html_report(document)
    assert {f["confidence"] for f in document["findings"]} == {"medium"}
    assert [m["url"] for m in document["site"]["sitemaps"]] == ["https://c.test/index.xml", "https://c.test/map.xml", "https://c.test/none.xml"]


def test_responses():
    assert C.unpacked(gzip.compress(b"x"), 9) == b"x" and C.unpacked(b"y", 9) == b"y" and C.unpacked(zlib.compress(b"z" * 50), 9, "deflate") == b"z" * 9
    assert len(C.unpacked(gzip.compress(b"0" * 30_000_000), 1000)) == 1000 and C.unpacked(gzip.compress(b"abc" * 99)[:20], 99) is not None
    answers = [(403, {}, "Just a moment..."), (200, {}, "Just a moment..."), (200, {"cf-mitigated": "challenge"}, ""), (503, None, None)]
    assert [C.challenged({"status": s, "headers": h, "html": b}) for s, h, b in answers] == [True, False, True, False]
    assert [C.classify_error(e) for e in (TimeoutError("timed out"), OSError("getaddrinfo failed"), ConnectionRefusedError("refused"), OSError("ssl x"), OSError("x"))] == ["timeout", "dns", "connection-refused", "tls", "network"]


def test_fetch_asks_for_compression_and_caps_what_it_unpacks():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/from":
                self.send_response(301)
                self.send_header("Location", "/to")
                self.end_headers()
                return
            body = gzip.compress(b"<p>" + b"0" * 3_000_000) if "gzip" in self.headers["Accept-Encoding"] else b"plain"
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.send_header("Content-Encoding", "gzip")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = C.http_fetch(f"http://127.0.0.1:{server.server_port}/from", C.CrawlConfig(max_bytes=100_000))
    finally:
        server.shutdown()
    assert got["status"] == 200 and len(got["html"]) == 100_000 and got["headers"]["content-encoding"] == "gzip" and got["transfer_bytes"] < 10_000 and len(got["redirect_chain"]) == 1


def test_findings_say_what_and_how(spark):
    html = "<title>" + "W" * 60 + '</title><img src="a.png"><img src="b.png"><a href="/b"></a>'
    raw = P.raw_pages(spark.createDataFrame([(i, f"https://v{i // 3}.test/{i}", html) for i in range(6)], "n bigint, url string, html string"), "n")
    done = A.audit(raw)
    found = done.findings.collect()
    assert found and all(r["message"] and r["fix"] and "{" not in r["message"] for r in found)
    one = {r["rule_id"]: r for r in found if r["site_id"] == "v0.test" and r["page"] in (None, "https://v0.test/0")}
    assert one["img-missing-alt"]["message"] == "2 images have no alt attribute." and json.loads(one["img-missing-alt"]["evidence"]) == {"value": 2.0, "sample": ["a.png", "b.png"]}
    assert one["title-duplicate"]["message"] == "3 pages share one title." and len(one["title-duplicate"]["pages"]) == 3
    actions = {(r["site_id"], r["rule_id"]): r for r in done.actions.collect()}
    assert all(r["message"] and r["fix"] for r in actions.values())
    assert actions["v0.test", "img-missing-alt"]["count"] == 3 and actions["v1.test", "title-duplicate"]["samples"] == [f"https://v1.test/{i}" for i in (3, 4, 5)]
    md = report.markdown(json.loads(report.documents(done).where("site_id = 'v0.test'").first()["document"]))
    assert "2 images have no alt attribute" in md and "To do: Describe them" in md and "## Method" in md


def test_lists_in_findings_are_bounded_and_counts_are_not(spark, monkeypatch):
    from sitelumen.operators import site as S

    monkeypatch.setattr(S.first_listed, "__defaults__", (2,))
    html = "<html><head><title>same</title></head><body>x"
    done = A.audit(P.raw_pages(spark.createDataFrame([(i, f"https://v.test/{i}", html) for i in range(7)], "n bigint, url string, html string"), "n"))
    found = {r["rule_id"]: r for r in done.findings.where("scope = 'site'").collect()}
    for rule in ("title-duplicate", "orphan-page"):
        assert found[rule]["pages"] == ["https://v.test/0", "https://v.test/1"] and found[rule]["affected"] == 7 and json.loads(found[rule]["evidence"])["pages"] == 7
    assert {r["rule_id"]: r["count"] for r in done.actions.collect()}["orphan-page"] == 7


def test_rules_of_ones_own(spark):
    def check(row):
        if "7" in row["url"]:
            raise KeyError("seven")
        return len(row["title"]) if row["title"] and len(row["title"]) > 5 else None

    own = [
        Rule("long", "onpage", "error", 5, 3, "low", "ok", check=check, reads=("url", "title"), message="{value} letters", fix="shorten"),
        Rule("broken", "onpage", "error", 5, 3, "low", "no_such_column", "true"),
        Rule("crooked", "onpage", "error", 5, 3, "low", "ok AND (", "true"),
        Rule("whole", "links", "error", 5, 3, "low", "true", check=lambda row: row["pages"] > 2, reads=("pages",), scope="site", needs=("site",)),
    ]
    pages = [(i, f"https://v.test/{i}", f"<title>{'x' * i}</title>") for i in range(9)]
    done = A.audit(P.raw_pages(spark.createDataFrame(pages, "n bigint, url string, html string"), "n"), rules=[*RULES, *own])
    found = done.findings.where("rule_id IN ('long', 'whole')").collect()
    assert sorted((r["rule_id"], r["page"], r["message"]) for r in found if r["rule_id"] == "long") == [("long", "https://v.test/6", "6 letters"), ("long", "https://v.test/8", "8 letters")]
    assert [r["message"] for r in found if r["rule_id"] == "whole"] == ["The rule whole fails."]
    counts = {r["rule_id"]: (r["applicable"], r["failed"]) for r in done.applicability.collect()}
    assert counts["long"] == (9, 2) and counts["whole"] == (1, 1) and "broken" not in counts and counts["title-missing"][0] == 9
    errors = {(r["rule_id"], r["page"]): r["error"] for r in done.rule_errors.collect()}
    assert set(errors) == {("long", "https://v.test/7"), ("broken", None), ("crooked", None)} and "seven" in errors["long", "https://v.test/7"]
    assert len(json.loads(report.documents(done).first()["document"])["run"]["rule_errors"]) == 3


def test_pages_that_cannot_be_parsed_are_judged_by_no_rule(spark, monkeypatch):
    from sitelumen.sources import html_extract

    plain = html_extract.safe_extract
    monkeypatch.setattr(html_extract, "safe_extract", lambda u, h, x: plain(u, "", x) | {"parse_error": "ValueError: x"} if u.endswith("/1") else plain(u, h, x))
    done = A.audit(P.raw_pages(spark.createDataFrame([(i, f"https://v.test/{i}", "<p>x") for i in range(3)], "n bigint, url string, html string"), "n"))
    assert [r["page"] for r in done.unread.collect()] == ["https://v.test/1"] and done.findings.where("page = 'https://v.test/1'").count() == 0
    assert {r["applicable"] for r in done.applicability.where("rule_id = 'title-missing'").collect()} == {2}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "https://s.test/a", "<html><body>x"), (2, "https://s.test/b", "<html lang=tr><head><title>t</title>")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "in"))
    query = ingest.write_findings(ingest.read_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    rows = {(r["page"], r["rule_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("https://s.test/a", "lang-attribute-missing") in rows and ("https://s.test/b", "lang-attribute-missing") not in rows


def test_documents_are_json_and_views_work(spark):
    raw = P.raw_pages(spark.createDataFrame([(0, "https://v.test/", "<title>x</title>")], "n bigint, url string, html string"), "n")
    done = A.audit(raw)
    done.views()
    assert spark.sql("SELECT count(*) AS n FROM findings").first()["n"] > 5
    document = json.loads(report.documents(done).first()["document"])
    assert document["summary"]["findings"] == len(document["findings"]) and document["scores"]["verdict"] == "critical" or document["scores"]["overall"] is not None
