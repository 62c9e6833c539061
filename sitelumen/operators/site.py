"""Site-level relations derived from pages: links, inlinks, duplicates, alternates, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelumen.functions import text as T


#: Pages that a list in a finding shows, in order, unless told otherwise; counts are of all.
LISTED = 1000


def last_wins(pages: DataFrame, keys: tuple[str, ...] = ("site_id", "normalized_url"), order: str = "ingest_seq") -> DataFrame:
    """One row a key: the last by ``order``; ``seq`` is the key's first place.

    Each task keeps its own last row of a key before rows are dealt out, so a key of very many rows is not hot.
    """
    ranked = pages.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_rank = 1").drop("_rank")
    return ranked.join(pages.groupBy(*keys).agg(F.min(order).alias("seq")), [*keys])


def first_listed(rows: DataFrame, keys: list[str], most: int | None = LISTED) -> DataFrame:
    """``(*keys, listed, n)`` of ``rows(*keys, seq, normalized_url)``: the first URLs in order, and how many there are.

    Only ``most`` rows of a key leave a task; without ``most`` all URLs are listed.
    """
    if most is None:
        every = F.array_sort(F.collect_list(F.struct("seq", "normalized_url")))["normalized_url"]
        return rows.groupBy(*keys).agg(every.alias("listed"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "normalized_url"))
    first = rows.select(*keys, "seq", "normalized_url").withColumn("_rank", rank).where(F.col("_rank") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "normalized_url")))["normalized_url"]
    return first.groupBy(*keys).agg(listed.alias("listed")).join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)


def links(pages: DataFrame) -> DataFrame:
    """One row a link."""
    return pages.select("site_id", F.col("normalized_url").alias("page_url"), "seq", F.inline("links"))


def inlinks(pages: DataFrame) -> DataFrame:
    """``(site_id, target, inlinks)``; links of a page to itself count."""
    return links(pages).where("internal").groupBy("site_id", F.col("normalized").alias("target")).agg(F.count("*").alias("inlinks"))


def inlink_lists(pages: DataFrame, most: int = 100) -> DataFrame:
    """``(site_id, target, inlinks, sources)``: up to ``most`` sources each, in page and link order."""
    one = links(pages).where("internal").select("site_id", F.col("normalized").alias("target"), F.struct("seq", "pos", F.col("page_url").alias("from"), "anchor", "area").alias("link"))
    first = one.withColumn("n", F.row_number().over(Window.partitionBy("site_id", "target").orderBy("link"))).where(F.col("n") <= most)
    sources = first.groupBy("site_id", "target").agg(F.array_sort(F.collect_list("link")).alias("sources"))
    return inlinks(pages).join(sources, ["site_id", "target"])


def duplicate_groups(pages: DataFrame, column: str, listed: int | None = LISTED) -> DataFrame:
    """``(site_id, key, pages, n, first)``: normalised values that two or more indexable pages have, the first ``listed`` pages (None: all) in order."""
    keyed = pages.where("idx").select("site_id", T.normalize_key(column).alias("key"), "seq", "normalized_url").where("key <> ''")
    firsts = keyed.groupBy("site_id", "key").agg(F.min("seq").alias("first"), F.count("*").alias("c")).where("c >= 2").drop("c")
    shared = keyed.join(firsts, ["site_id", "key"])
    return first_listed(shared, ["site_id", "key", "first"], listed).select("site_id", "key", F.col("listed").alias("pages"), "n", "first")


def orphans(pages: DataFrame) -> DataFrame:
    """Indexable pages other than the root that no internal link points to."""
    candidates = pages.where("idx AND path <> '/'")
    to = inlinks(pages).select("site_id", F.col("target").alias("normalized_url"))
    return candidates.join(to, ["site_id", "normalized_url"], "left_anti").select("site_id", "normalized_url", "seq")


def status_by_link(pages: DataFrame, url_status: DataFrame) -> DataFrame:
    """``(site_id, normalized_url, broken_links, redirect_links)`` of pages with such internal links."""
    status = url_status.select("site_id", F.col("url").alias("normalized"), "status", "redirects")
    met = links(pages).where("internal").join(status, ["site_id", "normalized"])
    counted = met.groupBy("site_id", F.col("page_url").alias("normalized_url")).agg(F.count_if(F.expr("status >= 400")).alias("broken_links"), F.count_if(F.expr("redirects > 0 AND status < 400")).alias("redirect_links"))
    return counted.where("broken_links > 0 OR redirect_links > 0")


def alternate_edges(pages: DataFrame) -> DataFrame:
    """``(site_id, source, target)`` of the alternates that name a page."""
    edges = pages.select("site_id", F.col("normalized_url").alias("source"), F.explode("hreflang").alias("h"))
    return edges.select("site_id", "source", F.col("h.normalized").alias("target")).where("target IS NOT NULL").distinct()


def missing_return(pages: DataFrame) -> DataFrame:
    """``(site_id, normalized_url, no_return)``: crawled alternates without one back to the page."""
    edges = alternate_edges(pages)
    crawled = pages.select("site_id", F.col("normalized_url").alias("target"))
    forth = edges.where("source <> target").join(crawled, ["site_id", "target"], "left_semi")
    back = edges.select("site_id", F.col("target").alias("source"), F.col("source").alias("target"))
    lost = forth.join(back, ["site_id", "source", "target"], "left_anti")
    return lost.groupBy("site_id", F.col("source").alias("normalized_url")).agg(F.count("*").alias("no_return"))


def bad_alternates(pages: DataFrame, url_status: DataFrame) -> DataFrame:
    """``(site_id, normalized_url, hreflang_bad)``: alternates that fail or redirect."""
    edges = pages.select("site_id", "normalized_url", F.explode("hreflang").alias("h")).select("site_id", "normalized_url", F.col("h.normalized").alias("url"))
    met = edges.join(url_status.select("site_id", "url", "status", "redirects"), ["site_id", "url"]).where("status >= 400 OR redirects > 0")
    return met.groupBy("site_id", "normalized_url").agg(F.count("*").alias("hreflang_bad"))


def canonical_status(pages: DataFrame, url_status: DataFrame) -> DataFrame:
    """``(site_id, normalized_url, canonical_bad)`` of pages whose canonical URL's status is known."""
    own = pages.where("canonical_norm IS NOT NULL").select("site_id", "normalized_url", F.col("canonical_norm").alias("url"))
    met = own.join(url_status.select("site_id", "url", "status", "redirects"), ["site_id", "url"])
    bad = (F.col("status") != 0) & (~F.col("status").between(200, 299) | (F.col("redirects") > 0))
    return met.select("site_id", "normalized_url", bad.alias("canonical_bad"))


def sitemap_problems(locs: DataFrame, url_status: DataFrame, pages: DataFrame) -> DataFrame:
    """``(site_id, loc, problem)``: ``status`` over ``redirect`` over ``noindex``."""
    status = url_status.select("site_id", F.col("url").alias("loc"), "status", "redirects")
    hidden = pages.where("ok AND NOT robots_index").select("site_id", F.col("normalized_url").alias("loc"), F.lit(True).alias("hidden"))
    met = locs.join(status, ["site_id", "loc"], "left").join(hidden, ["site_id", "loc"], "left")
    problem = F.when(F.col("status") >= 400, F.lit("status")).when(F.col("redirects") > 0, F.lit("redirect")).when(F.col("hidden"), F.lit("noindex"))
    return met.select("site_id", "loc", problem.alias("problem")).where("problem IS NOT NULL")


def sitemap_orphans(pages: DataFrame, locs: DataFrame) -> DataFrame:
    """Indexable pages whose URL, raw or normalised, is in no sitemap of a site that has one."""
    mapped = pages.where("idx").join(locs.select("site_id").distinct(), "site_id", "left_semi")
    raw = locs.select("site_id", F.col("loc").alias("url"))
    normal = locs.select("site_id", F.col("loc").alias("normalized_url"))
    return mapped.join(raw, ["site_id", "url"], "left_anti").join(normal, ["site_id", "normalized_url"], "left_anti").select("site_id", "normalized_url", "seq")
