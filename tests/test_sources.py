"""Robots patterns, headers, sitemaps, stored responses, sinks, streams and what an audit builds."""

from __future__ import annotations

import json
import os
import random
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sitelumen.operators import site as S
from sitelumen.plans import audit as A
from sitelumen.plans import files, report
from sitelumen.plans.catalog import RULES
from sitelumen.sources import captures
from sitelumen.sources import crawl as C
from sitelumen.sources import pages as P
from sitelumen.sources import robots as R
from sitelumen.sources import sitemap as M
from sitelumen.streaming import audit_stream as X

ROOT = Path(__file__).resolve().parent.parent

# --- robots ----------------------------------------------------------------------------------------------------------


def plain_access(rules: list[tuple[str, bool]], paths: list[str]) -> list[bool]:
    """Every rule against every path, by regular expressions."""
    best, said, column = [-1] * len(paths), [True] * len(paths), pa.array(paths)
    for rule, allow in rules:
        body = rule[:-1] if rule.endswith("$") else rule
        quoted = "".join(".*" if c == "*" else c if c.isalnum() or c in "/_" else "\\" + c for c in body)
        met = pc.match_substring_regex(column, "(?s)^" + quoted + ("$" if rule.endswith("$") else "")).to_numpy(zero_copy_only=False)
        for i in met.nonzero()[0].tolist():
            if len(rule) > best[i]:
                best[i], said[i] = len(rule), allow
            elif len(rule) == best[i]:
                said[i] = said[i] or allow
    return said


def _paths(rng, n):
    parts = ["a", "b", "ab", "urun", "x.html", "p-1", "q", "deep", "z$", "s+"]
    return sorted({"/" + "/".join(rng.choice(parts) + rng.choice(("", str(rng.randrange(90)))) for _ in range(rng.randint(0, 4))) + rng.choice(("", "/", ".pdf")) for _ in range(n)})


def _rules(rng, paths, n):
    out = set()
    while len(out) < n:
        path = rng.choice(paths)
        kind = rng.randrange(6)
        at = rng.randint(1, len(path))
        out.add((("" if kind else "$") + (path[:at], path[:at] + "*", "/*" + path[-at:], path + "$", path[: at // 2] + "*" + path[at // 2 + 1 :], "*" + path[-2:] + "$")[kind], rng.random() < 0.4))
    return sorted((r, a) for r, a in out if r)


def test_robots_of_a_large_site_equal_brute_force(spark):
    rng = random.Random(3)
    paths = _paths(rng, 130_000)[:100_000]
    rules = _rules(rng, paths, 2000)
    table = spark.createDataFrame([("big", 1, i, "allow" if a else "disallow", p) for i, (p, a) in enumerate(rules)] + [("small", 1, 0, "disallow", "/")], "site_id string, group_no int, seq int, type string, path string")
    groups = spark.createDataFrame([("big", "Bot", 1), ("small", "Bot", 1), ("free", "Bot", 9)], "site_id string, token string, group_no int")
    asked = spark.createDataFrame([("big", p) for p in paths] + [("small", "/x"), ("free", "/x"), ("unknown", "/x")], "site_id string, path string")
    got = R.access(table, groups, asked)
    plan = got._jdf.queryExecution().toString().lower()
    assert "rlike" not in plan and "mapinarrow" in plan
    found = {(r["site_id"], r["path"]): r["allowed"] for r in got.collect()}
    assert len(found) == len(paths) + 2 and found["small", "/x"] is False and found["free", "/x"] is True
    want = plain_access(rules, paths)
    assert [found["big", p] for p in paths] == want and 1000 < sum(want) < len(want) - 1000


def test_a_sites_paths_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(R, "PATHS", 7)
    rng = random.Random(5)
    paths = _paths(rng, 300)
    rules = _rules(rng, paths, 60)
    table = spark.createDataFrame([("s", 1, i, "allow" if a else "disallow", p) for i, (p, a) in enumerate(rules)], "site_id string, group_no int, seq int, type string, path string")
    got = R.access(table, spark.createDataFrame([("s", "Bot", 1)], "site_id string, token string, group_no int"), spark.createDataFrame([("s", p) for p in [*paths, None]], "site_id string, path string"))
    found = {r["path"]: r["allowed"] for r in got.collect()}
    assert found.pop(None) is True and [found[p] for p in paths] == plain_access(rules, paths)


def test_pattern_states_are_forgotten(monkeypatch):
    monkeypatch.setattr(R, "MOST_STATES", 5)
    rng = random.Random(6)
    paths = _paths(rng, 200)
    rules = _rules(rng, paths, 80)
    patterns = R.Patterns(rules)
    assert [patterns.allowed(p) for p in paths] == plain_access(rules, paths)


# --- headers ---------------------------------------------------------------------------------------------------------


def test_last_value_of_a_header_name_counts(spark):
    rows = spark.sql("SELECT 1L AS n, 'https://a.test/' AS url, '' AS html, map('Server', 'a/1.0', 'server', 'b', 'X', '1') AS headers UNION ALL SELECT 2L, 'https://a.test/b', '', NULL UNION ALL SELECT 3L, 'https://a.test/c', '', map()")
    got = {r["url"]: r["headers"] for r in P.raw_pages(rows, "n").collect()}
    assert got == {"https://a.test/": {"server": "b", "x": "1"}, "https://a.test/b": {}, "https://a.test/c": {}}


# --- sitemaps --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ("<urlset><url><loc>a</loc></url><url><loc>b", [("url", "a", None), ("url", "b", None)]),
        ("<urlset><url><loc>a</loc><lastmod>2024</lastmod></url><url><loc>b</lo", [("url", "a", "2024"), ("url", "b", None)]),
        ("<s:urlset><s:url><s:loc> a&amp;b&#65;&#x42;&nbsp; </s:loc></s:url></s:urlset>", [("url", "a&bAB&nbsp;", None)]),
        ("<urlset><!-- <url><loc>no</loc></url> --><url><loc><![CDATA[a&amp;<b>]]></loc></url></urlset>", [("url", "a&amp;<b>", None)]),
        ("<sitemapindex><sitemap><loc>m</loc></sitemap><sitemap/><sitemap><loc> </loc></sitemap></sitemapindex>", [("sitemap", "m", None)]),
        ("<urlset><url><loc>a<url><loc>b</loc><loc>c</loc></url>", [("url", "a", None), ("url", "b", None)]),
        ("<urlset><url><loc/><loc>a</loc></url> 1 < 2 <url><priority>1</priority></url></urlset>", [("url", "a", None)]),
        ("no xml at all", []), ("", []), ("<", []), ("<url", []), ("<!-- x", []), ("<url><loc><![CDATA[a", [("url", "a", None)]),
    ],
)
def test_sitemap_entries_of_broken_documents(xml, want):
    assert [(k, e["loc"], e["lastmod"]) for k, e in M.entries_of(xml)] == want


def test_sitemap_of_many_megabytes(spark):
    entry = "<url><loc>https://a.test/{0}</loc><xhtml:link rel='alternate' hreflang='tr' href='/t&amp;{0}'/></url>\n"
    body = "<urlset>" + "".join(entry.format(i) for i in range(120_000))
    import gzip

    rows = spark.createDataFrame([("s", "m", body.encode()), ("s", "z", gzip.compress(body.encode())), ("s", "n", None)], "site_id string, sitemap_url string, xml binary")
    got = M.entries(rows).groupBy("sitemap_url").agg(F.count("*").alias("n"), F.max(F.expr("alternates[0].href")).alias("href"), F.count_distinct("loc").alias("locs")).collect()
    assert {(r["sitemap_url"], r["n"], r["href"], r["locs"]) for r in got} == {("m", 120_000, "/t&99999", 120_000), ("z", 120_000, "/t&99999", 120_000)}
    cut = M.entries(rows.where("sitemap_url = 'z'"), most=len(body) // 2).count()
    assert 59_000 < cut < 61_000


# --- sinks -----------------------------------------------------------------------------------------------------------


def test_documents_are_streamed_as_they_are_built(spark, tmp_path):
    html = "<html lang=tr><head><title>{}</title></head><body><img src=a.png><a href='/0'>x \"y\" \\ \n</a>" + "kelime " * 60
    rows = [(i, f"https://v{i % 2}.test/{i}{'ÅçZz'[i % 4]}", html.format(i % 3)) for i in range(40)]
    done = A.audit(P.raw_pages(spark.createDataFrame(rows, "n bigint, url string, html string"), "n"))
    report.write_documents(done, str(tmp_path / "json"))
    assert sorted(os.listdir(tmp_path / "json")) == ["v0.test.json", "v1.test.json"]
    want = {r["site_id"]: json.loads(r["document"]) for r in report.documents(done).collect()}
    for site, document in want.items():
        got = json.loads((tmp_path / "json" / f"{site}.json").read_text())
        for key in ("rule_errors", "unread_pages"):
            assert got["run"].pop(key) == document["run"].pop(key, [])
        assert got == document
    report.write_reports(report.summaries(done), str(tmp_path), ["md", "html"])
    for site, document in want.items():
        assert (tmp_path / f"{site}.md").read_text() == report.markdown(document) and (tmp_path / f"{site}.html").read_text() == report.html_report(document)
    plan = report.document_rows(done)._jdf.queryExecution().toString()
    assert not any(f"collect_list(struct({c}" in plan for c in ("url", "page"))


def test_a_large_file_is_written_as_rows_come_and_failure_leaves_nothing(spark, tmp_path):
    rows = spark.range(100_000).select(F.lit("big/one.txt").alias("file"), F.when(F.col("id") < 99_999, 1).otherwise(2).alias("part"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"), (F.col("id") < 99_999).alias("item"), "id")
    files.write_files(rows, str(tmp_path / "out"), ["id"])
    text = (tmp_path / "out" / "big" / "one.txt").read_text()
    assert text == ",".join(f"x{i}" for i in range(99_999)) + "x99999"
    files.write_files(rows.where("id < 3 OR id = 99999"), str(tmp_path / "out"), ["id"])
    assert (tmp_path / "out" / "big" / "one.txt").read_text() == "x0,x1,x2x99999" and os.listdir(tmp_path / "out") == ["big"]
    broken = rows.withColumn("text", F.when(F.col("id") == 50_000, F.raise_error(F.lit("no more"))).otherwise(F.col("text"))).withColumn("file", F.concat(F.lit("f"), (F.col("id") % 7).cast("string")))
    with pytest.raises(Exception, match="no more"):
        files.write_files(broken, str(tmp_path / "bad"), ["id"])
    assert not (tmp_path / "bad").exists() or os.listdir(tmp_path / "bad") == []


# --- stored responses ------------------------------------------------------------------------------------------------


class Server(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        if self.path == "/moved":
            self.send_response(301)
            self.send_header("Location", "/a")
            self.end_headers()
            return
        body = f"<title>{self.path}</title>".encode()
        self.send_response(404 if self.path == "/gone" else 200)
        self.send_header("Content-Type", "text/html")
        self.send_header("X-Path", self.path)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_responses_by_http_and_from_captures_equal_the_crawl(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        origin = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(origin + p,) for p in ("/a", "/b", "/gone", "/moved", "/a")] + [("http://127.0.0.1:9/x",), (None,)], "url string")
        urls.write.parquet(str(tmp_path / "urls"))
        config = C.CrawlConfig(delay_ms=0)
        drop = ["ttfb_ms"]
        want = sorted(map(str, C.fetched(urls.where("url IS NOT NULL").distinct(), lambda u: C.http_fetch(u, config), config).withColumn("headers", F.map_filter("headers", lambda k, _: k != "date")).drop(*drop).collect()))
        got = captures.read_responses(spark, urls=tmp_path / "urls", partitions=3, delay_ms=0)
        assert sorted(map(str, got.withColumn("headers", F.map_filter("headers", lambda k, _: k != "date")).drop(*drop).collect())) == want and len(want) == 5
        got.select(F.to_json(F.struct("*")).alias("value")).write.text(str(tmp_path / "stored"))
        (tmp_path / "stored" / "bad.json").write_text('no json\n[1]\n{"url": 5}\n')
        again = captures.read_responses(spark, captures=tmp_path / "stored")
        assert sorted(map(str, again.withColumn("headers", F.map_filter("headers", lambda k, _: k != "date")).drop(*drop).collect())) == want
        assert {r["status"] for r in P.raw_pages(again).collect()} == {200, 404, 0}
    finally:
        server.shutdown()


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_blocked_sites_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(captures, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows, want = [], {}
    for s in range(25):
        hits = [rng.random() < s / 25 for _ in range(rng.randint(1, 14))]
        longest = run = 0
        for i, hit in enumerate(hits):
            run = run + 1 if hit else 0
            longest = max(longest, run)
            rows.append((f"s{s}", "https://h.test/", i + 5, 503 if hit else 200, {}, "Checking your browser" if hit else "x"))
        want[f"s{s}"] = (len(hits), sum(hits), longest)
    rows += [("down", None, i, 0, None, None) for i in range(2)] + [("partly", "https://p.test/", i, 0 if i < 2 else 200, {"cf-mitigated": ""}, None) for i in range(5)]
    got = {r["site_id"]: r for r in captures.crawl_status(spark.createDataFrame(rows, "site_id string, url string, ord bigint, status int, headers map<string,string>, html string")).collect()}
    assert {s: (r["requested"], r["challenged"], r["streak"]) for s, r in got.items() if s in want} == want
    assert got["down"]["status"] == "failed" and got["partly"]["status"] == "partial"
    assert all((r["status"] == "blocked") == (r["streak"] >= 3) for s, r in got.items())


# --- stream ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 3])
def test_any_split_of_the_stream_ends_as_one_batch(spark, tmp_path, batches):
    rng = random.Random(1)
    html = ["<html lang=tr><head><title>t</title>", "<html><h1>a</h1><h1>b</h1>", "<p>x", "<html lang=en><title>" + "W" * 70 + "</title><img src=a.png>"]
    rows = [(i, f"https://s{rng.randrange(3)}.test/{rng.randrange(6)}{'?utm_source=x' * (i % 2)}", html[rng.randrange(4)]) for i in range(40)]
    rng.shuffle(rows)
    schema = "page_id bigint, url string, html string"
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = X.write_changes(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert run.awaitTermination(600)
    changed = X.read_changes(spark, str(tmp_path / "out"))
    done = A.audit(P.raw_pages(spark.createDataFrame(rows, schema), "page_id"), rules=X.page_rules())
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, X.current_findings(changed).collect())) == sorted(map(key, done.findings.select("site_id", "rule_id", "page", "measure").collect()))
    assert sorted(map(tuple, X.current_applicability(changed).collect())) == sorted(map(tuple, done.applicability.where("applicable > 0").collect()))
    assert {r["site_id"]: r["pages"] for r in X.current_sites(changed).collect()} == {r["site_id"]: r["count"] for r in done.pages.groupBy("site_id").count().collect()}
    if batches > 1:
        assert changed.where("delta < 0").count() > 0


# --- what an audit builds --------------------------------------------------------------------------------------------


def test_only_facts_that_rules_name_are_made(spark, monkeypatch):
    called = []
    for where, name in ((S, "orphans"), (S, "inlinks"), (S, "duplicate_groups"), (A.N, "pair_total"), (S, "missing_return"), (S, "status_by_link")):
        monkeypatch.setattr(where, name, lambda *a, f=getattr(where, name), n=name, **k: called.append(n) or f(*a, **k))
    raw = P.raw_pages(spark.createDataFrame([(0, "https://v.test/", "<title>x</title>"), (1, "https://v.test/b", "<title>x</title>")], "n bigint, url string, html string"), "n")
    A.audit(raw, rules=[r for r in RULES if r.id in ("title-missing", "thin-content")])
    assert called == []
    done = A.audit(raw, rules=[r for r in RULES if r.id in ("title-duplicate", "hreflang-return-tag")])
    assert sorted(set(called)) == ["duplicate_groups", "missing_return"] and done.findings.select("rule_id").collect()[0]["rule_id"] == "title-duplicate"


def test_rules_with_several_findings_a_page_and_by_frame(spark):
    def each_image(row):
        if "boom" in row["url"]:
            raise ValueError("no images")
        return [{"message": f"{i['src']} is bad", "measure": len(i["src"]), "sample": [i["src"]]} for i in row["images"] if "bad" in (i["src"] or "")]

    def long_titles(frame):
        if frame["title"].str.contains("oops").any():
            raise KeyError("oops")
        return frame["title"].str.len().where(frame["title"].str.len() > 3)

    own = [
        A.Rule("bad-image", "media", "error", 5, 3, "low", "ok", finds=each_image, reads=("url", "images"), message="unused", fix="mend"),
        A.Rule("long-title", "onpage", "notice", 2, 2, "low", "title IS NOT NULL", check=long_titles, reads=("title",), by_frame=True, message="{value} letters"),
        A.Rule("two-of-a-site", "links", "notice", 2, 2, "low", "true", finds=lambda row: [{"message": "one"}, {"measure": 2, "message": "{value} in all"}], reads=("pages",), scope="site", needs=("site",)),
    ]
    pages = [(0, "https://v.test/", "<title>abcdef</title><img src=bad1.png><img src=ok.png><img src=bad22.png>"), (1, "https://v.test/b", "<title>ab</title><img src=ok.png>"), (2, "https://v.test/boom", "<img src=bad.png>")]
    done = A.audit(P.raw_pages(spark.createDataFrame(pages, "n bigint, url string, html string"), "n"), rules=[*RULES, *own])
    found = sorted((r["rule_id"], r["message"], json.loads(r["evidence"]).get("sample"), json.loads(r["evidence"]).get("value")) for r in done.findings.where("rule_id IN ('bad-image', 'long-title', 'two-of-a-site')").collect())
    assert found == [("bad-image", "bad1.png is bad", ["bad1.png"], 8.0), ("bad-image", "bad22.png is bad", ["bad22.png"], 9.0), ("long-title", "6 letters", None, 6.0), ("two-of-a-site", "2 in all", None, 2.0), ("two-of-a-site", "one", None, None)]
    counts = {r["rule_id"]: (r["applicable"], r["failed"]) for r in done.applicability.collect()}
    assert counts["bad-image"] == (3, 1) and counts["long-title"] == (2, 1) and counts["two-of-a-site"] == (1, 1)
    assert {r["rule_id"]: r["count"] for r in done.actions.collect()}["bad-image"] == 2
    assert [(r["rule_id"], r["page"], r["error"]) for r in done.rule_errors.collect()] == [("bad-image", "https://v.test/boom", "ValueError: no images")]
    wrong = A.audit(P.raw_pages(spark.createDataFrame([(0, "https://v.test/", "<title>oops</title>")], "n bigint, url string, html string"), "n"), rules=own[1:2])
    assert [r["error"] for r in wrong.rule_errors.collect()] == ["KeyError: 'oops'"] and wrong.findings.count() == 0


def test_the_entry_loads_without_the_operators():
    code = "import sys, warnings; sys.modules['xxhash'] = None; warnings.simplefilter('always'); import __spark_entry__ as e; print(len(e.queries()), 'op1_substring_dedup' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=120)
    there = (ROOT / "sitelumen" / "llm").exists()
    assert said.returncode == 0 and said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 40, said.stderr
    assert not there or "left out" in said.stderr


# --- many sites at once ----------------------------------------------------------------------------------------------


def test_fifty_sites_are_crawled_in_one_run(spark, tmp_path):
    log = str(tmp_path / "log")
    os.makedirs(log)

    def fetch(url):  # in a worker: each request leaves a file that says when
        import time
        import uuid

        host, path = url.split("/")[2], "/" + "/".join(url.split("/")[3:])
        number = int(host[1:].split(".")[0])
        Path(log, uuid.uuid4().hex).write_text(f"{time.time()} {url}")
        blocked, body = number % 10 == 7 and path not in ("/robots.txt", "/llms.txt"), "<p>x" + "".join(f"<a href='/{k}'>x</a>" for k in range(number % 7))
        if path == "/robots.txt":
            status, body = (200, "User-agent: *\nDisallow: /3") if number % 5 == 0 else (404, "")
        elif path == "/sitemap.xml" and number % 4 == 0:
            status, body = 200, f"<urlset><url><loc>https://{host}/listed</loc></url><url><loc>https://elsewhere.test/x</loc></url></urlset>"
        elif path in ("/llms.txt", "/sitemap.xml", "/sitemap_index.xml"):
            status = 404
        else:
            status = 0 if number % 10 == 9 else 200
        headers = {"content-type": "text/html"} | ({"cf-mitigated": "challenge"} if blocked else {})
        return {"url": url, "status": status, "html": body, "headers": headers, "redirect_chain": [], "final_url": url, "ttfb_ms": 1, "error": "timeout" if status == 0 else None, "transfer_bytes": len(body)}

    found = C.crawl_sites(spark, [f"https://s{i}.test/" for i in range(50)], C.CrawlConfig(max_pages=4, max_depth=2, delay_ms=30), fetch)
    counters = {r["site_id"]: r for r in found["counters"].collect()}
    assert len(counters) == 50
    for i in range(50):
        own = counters[f"s{i}.test"]
        links = [k for k in range(i % 7) if not (i % 5 == 0 and k == 3)]
        pages = 0 if i % 10 in (7, 9) else min(4, 1 + len(links) + (i % 4 == 0))
        assert own["fetched"] == pages and own["status"] == ("failed" if i % 10 == 9 else "ok"), i  # one challenge is no run
        assert own["skipped_by_robots"] == int(i % 5 == 0 and i % 7 > 3 and i % 10 not in (7, 9))
    asked = sorted((p.read_text().split(" ") for p in Path(log).iterdir()), key=lambda x: float(x[0]))
    pages = [u for _, u in asked if not u.endswith((".txt", ".xml"))]
    assert len(pages) == len(set(pages)) and not any("elsewhere" in u for u in pages)
    raw = {r["url"]: r["site_id"] for r in found["raw"].collect()}
    assert raw["https://s4.test/listed"] == "s4.test" and len(raw) == sum(r["fetched"] for r in counters.values())
    last: dict[str, float] = {}
    for at, url in asked:
        host = url.split("/")[2]
        if not url.endswith((".txt", ".xml")):
            assert float(at) - last.get(host, 0) > 0.005
            last[host] = float(at)
