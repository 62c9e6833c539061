"""Page sources: every one gives the same raw-pages frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.functions import url as U

RAW_SCHEMA = (
    "site_id string, ingest_seq bigint, url string, html string, status int, headers map<string,string>, "
    "redirect_chain array<struct<url:string,status:int,to:string>>, final_url string, ttfb_ms bigint, depth int, source string, transfer_bytes bigint"
)
_DEFAULTS = {
    "status": "200", "headers": "map()", "redirect_chain": "array()", "final_url": "url", "ttfb_ms": "NULL", "depth": "0", "source": "'table'", "transfer_bytes": "NULL",
}


@dataclass(frozen=True)
class Capabilities:
    """What a source knows besides html; rules that need more leave no trace in the denominators."""

    headers: bool = False
    net: bool = False


def header_map(headers: Column) -> Column:
    """Headers by lower-case name; of names that are then equal the last one's value stays, and null gives none."""
    entries = F.transform(F.map_entries(F.coalesce(headers.cast("map<string,string>"), F.expr("map()").cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"].alias("value"))))


def raw_pages(df: DataFrame, seq: str | None = None) -> DataFrame:
    """Any frame with ``url`` and ``html`` as raw pages: missing columns get their defaults.

    ``site_id`` defaults to the registrable domain and ``ingest_seq`` to the column ``seq``. Header names are
    lower-cased, the last value wins.
    """
    if "site_id" not in df.columns:
        df = df.withColumn("site_id", U.registrable_domain("url"))
    if "ingest_seq" not in df.columns:
        df = df.withColumn("ingest_seq", F.col(seq).cast("bigint") if seq else F.monotonically_increasing_id())
    for name, default in _DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.expr(default))
    kinds = dict(part.strip().split(" ", 1) for part in _split(RAW_SCHEMA))
    return df.withColumn("headers", header_map(F.col("headers"))).select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def from_table(spark: SparkSession, path: str, seq: str = "page_id") -> DataFrame:
    """Captured pages in a Parquet table (url, html)."""
    return raw_pages(spark.read.parquet(path), seq)


def from_pairs(spark: SparkSession, pages: list[dict]) -> tuple[DataFrame, list[dict]]:
    """An in-memory list of ``{url, html}``; blank html is left out, and invalid URLs are returned apart."""
    if not pages:
        raise ValueError("no pages given")
    if U.parse(pages[0].get("url")) is None:
        raise ValueError(f"invalid URL: {pages[0].get('url')!r}")
    good = [(i, p["url"], p["html"]) for i, p in enumerate(pages) if (p.get("html") or "").strip() and U.parse(p.get("url"))]
    if not good:
        raise ValueError("no readable page")
    skipped = [{"url": p.get("url"), "reason": "invalid url"} for p in pages if (p.get("html") or "").strip() and not U.parse(p.get("url"))]
    frame = spark.createDataFrame(good, "ingest_seq bigint, url string, html string").withColumn("site_id", F.lit(U.site_of(pages[0]["url"])))
    return raw_pages(frame.withColumn("source", F.lit("pairs"))), skipped


def file_url(relative: F.Column, base: str) -> F.Column:
    """URL of a file under the base: index files stand for their folder, the extension goes."""
    plain = F.regexp_replace(F.regexp_replace(relative, r"(?i)index\.html?$", ""), r"(?i)\.html?$", "")
    return F.concat(F.lit(base.rstrip("/") + "/"), plain)


def from_directory(spark: SparkSession, folder: str, base_url: str) -> DataFrame:
    """Every .html and .htm file below a folder, read as whole texts, in path order.

    Where a page's canonical link names another URL of the same site, that URL becomes the page's (see ``audit.remapped``).
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[hH][tT][mM]*")
    path = F.regexp_replace(F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/+", "/")
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    files = files.select(path.alias("path"), F.col("value").alias("html")).where(F.col("path").rlike(r"(?i)\.html?$"))
    relative = F.when(F.col("path").startswith(root), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path"))
    named = files.withColumn("url", U.normalize_url(file_url(relative, base_url)))
    # Path order without numbering in one task: a prefix of the path's bytes orders files as far as last-wins needs.
    seq = F.conv(F.substring(F.hex(F.substr("path", F.lit(len(root) + 1))), 1, 14), 16, 10).cast("bigint")
    return raw_pages(named.withColumn("ingest_seq", seq).withColumn("site_id", F.lit(U.site_of(base_url))).withColumn("source", F.lit("dir")).drop("path"))


def from_file(spark: SparkSession, file: str, page_url: str) -> DataFrame:
    """One file as one page."""
    rows = spark.read.text(file, wholetext=True).select(F.col("value").alias("html"), F.lit(page_url).alias("url"), F.lit(0).alias("ingest_seq"))
    return raw_pages(rows.withColumn("site_id", F.lit(U.site_of(page_url))).withColumn("source", F.lit("single")))
