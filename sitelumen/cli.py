"""Command line: choose a source, audit it, write reports, and answer thresholds with exit codes."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sitelumen.plans import audit as A
from sitelumen.plans import report
from sitelumen.plans.catalog import SEVERITIES
from sitelumen.session import cut, ship_package
from sitelumen.sources import crawl as C
from sitelumen.sources import pages as P

OK, USAGE, THRESHOLD, NOTHING = 0, 1, 2, 3


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sitelumen", description=__doc__)
    p.add_argument("url", nargs="?", help="start of a live crawl")
    p.add_argument("--input-dir")
    p.add_argument("--base-url")
    p.add_argument("--input-file")
    p.add_argument("--page-url")
    p.add_argument("--input-table", help="Parquet table with url and html")
    p.add_argument("--from-audit")
    p.add_argument("--max-pages", type=int, default=150)
    p.add_argument("--depth", type=int, default=4)
    p.add_argument("--concurrency", type=int, default=4)
    p.add_argument("--delay", type=int, default=500)
    p.add_argument("--timeout", type=int, default=15_000)
    p.add_argument("--user-agent", default=C.AGENT)
    p.add_argument("--check-external", action="store_true")
    p.add_argument("--ignore-robots", action="store_true")
    p.add_argument("--i-own-this-site", action="store_true")
    p.add_argument("--min-words", type=int, default=300)
    p.add_argument("--out", default="audit-out")
    p.add_argument("--format", default="json,md")
    p.add_argument("--fail-on", choices=SEVERITIES)
    p.add_argument("--min-score", type=int)
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--verbose", action="store_true")
    return p


def outcome(documents: list[dict], fail_on: str | None, min_score: int | None) -> int:
    """2 where a finding is as severe as ``fail_on`` or a score is below ``min_score``."""
    severe = SEVERITIES[: SEVERITIES.index(fail_on) + 1] if fail_on else ()
    for d in documents:
        if any((d.get("summary") or {}).get(s) for s in severe):
            return THRESHOLD
        if min_score is not None and (d["scores"].get("overall") is None or d["scores"]["overall"] < min_score):
            return THRESHOLD
    return OK


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return OK if not e.code else USAGE
    sources = [x for x in (a.url, a.input_dir, a.input_file, a.input_table, a.from_audit) if x]
    if len(sources) != 1 or (a.input_dir and not a.base_url) or (a.input_file and not a.page_url) or (a.ignore_robots and not a.i_own_this_site):
        print("give one source; a folder needs --base-url, a file --page-url, and --ignore-robots needs --i-own-this-site", file=sys.stderr)
        return USAGE
    spark = spark or SparkSession.builder.appName("sitelumen").getOrCreate()
    ship_package(spark)
    formats = a.format.split(",")
    if a.from_audit:
        shown = report.stored_documents(spark, a.from_audit)
    else:
        side, caps, single, crawl, mappings = A.SideInputs(), P.Capabilities(), False, None, None
        if a.input_dir:
            raw = P.from_directory(spark, a.input_dir, a.base_url)
            mappings = cut(A.url_mappings(raw))
            raw = A.remapped(raw, mappings)
        elif a.input_file:
            raw, single = P.from_file(spark, a.input_file, a.page_url), True
        elif a.input_table:
            raw = P.from_table(spark, a.input_table)
        else:
            config = C.CrawlConfig(a.max_pages, a.depth, a.delay, a.timeout, user_agent=a.user_agent, concurrency=a.concurrency, respect_robots=not a.ignore_robots, check_external=a.check_external)
            found = C.crawl(spark, a.url, config)
            if found["status"] == "failed":
                return NOTHING
            raw, caps = P.raw_pages(found["raw"]), P.Capabilities(headers=True, net=True)
            status = C.probe(A.derived(A.page_models(raw)), found["url_status"], config, robots_txt=found["robots"])
            side = A.SideInputs(status, found["robots"], found["sitemaps"], found["sitemap_entries"], found["llms_txt"])
            crawl = found["counters"]
        if raw.isEmpty():
            return NOTHING
        done = A.audit(raw, side, caps, a.min_words, single, crawl=crawl, options={k: v for k, v in vars(a).items() if v is not None}, mappings=mappings)
        if "json" in formats:
            report.write_documents(done, f"{a.out}/json")
        shown = report.summaries(done)
    shown = cut(shown)
    report.write_reports(shown, a.out, formats)
    brief = shown.select("site_id", *[F.from_json("document", "scores struct<overall:int,verdict:string>, summary map<string,string>").alias("d")])
    documents = [{"site": {"site_id": r["site_id"]}, "scores": r["d"]["scores"].asDict(), "summary": {k: int(v) for k, v in (r["d"]["summary"] or {}).items() if k != "by_category"}} for r in brief.toLocalIterator()]  # a line a site
    if not a.quiet:
        for d in documents:
            print(f"{d['site']['site_id']}: {d['scores'].get('overall')} ({d['scores'].get('verdict')}), {(d.get('summary') or {}).get('findings', 0)} findings")
    return outcome(documents, a.fail_on, a.min_score)


if __name__ == "__main__":
    sys.exit(main())
