"""Registered queries of the audit engine, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelumen import variants
from sitelumen.functions import text as T
from sitelumen.functions import url as U
from sitelumen.operators import near_duplicates as N
from sitelumen.operators import site as S
from sitelumen.plans import audit as A
from sitelumen.session import cut, ensure_checkpoint_dir
from sitelumen.sources import captures, html_extract
from sitelumen.sources import pages as P
from sitelumen.sources import robots as R
from sitelumen.sources import sitemap as M
from sitelumen.streaming import audit_stream as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return P.from_table(spark, f"{d}/pages.parquet")


def _site(spark: SparkSession, d: str) -> DataFrame:
    """The parsed and derived page frame, written once."""
    return cut(A.derived(A.page_models(_pages(spark, d))))


# --- text ------------------------------------------------------------------------------------------------------------

LOWER = "lower(translate(coalesce({0}, ''), 'IİŞĞÜÖÇ', 'ıişğüöç'))"
TOKENS = "list_filter(regexp_split_to_array(" + LOWER + ", '[^a-zçğıöşü0-9]+'), lambda w: length(w) > 1)"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"SELECT doc_id, length({LOWER.format('text')})::INTEGER AS n, md5({LOWER.format('text')}) AS digest FROM documents")
def tr_lower_docs(spark, d):
    low = T.tr_lower("text")
    return _docs(spark, d).select("doc_id", F.length(low).alias("n"), F.md5(low.cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len({TOKENS.format('text')})::INTEGER AS words FROM documents")
def word_count_docs(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count("text").alias("words"))


@query(f"WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents) SELECT doc_id, len(w)::INTEGER AS words, len(list_filter(w, lambda x: x IN ({STOPS})))::INTEGER AS hits FROM t")
def tr_stopword_ratio_docs(spark, d):
    words = T.tokens("text")
    return _docs(spark, d).select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("words"), T.stop_word_hits(F.col("w")).alias("hits"))


_COUNTS = " + ".join(f"((length(t) - length(replace(t, '{s}', ''))) / {len(s)})::INTEGER" for s in T.MOJIBAKE)
_KINDS = " + ".join(f"(contains(t, '{s}'))::INTEGER" for s in T.MOJIBAKE)


@query(f"SELECT page_id, coalesce(({_COUNTS.replace('(t', '(html')}) >= 4 OR ({_KINDS.replace('(t', '(html')}) >= 2, false) AS broken FROM pages")
def mojibake_values(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.is_mojibake("html").alias("broken"))


@query(f"SELECT doc_id, ({_COUNTS.replace('(t', '(text')})::INTEGER AS sequences FROM documents")
def mojibake_docs(spark, d):
    return _docs(spark, d).select("doc_id", F.aggregate(T.mojibake_counts("text"), F.lit(0), lambda a, n: a + n).alias("sequences"))


_WIDTHS = {**{g: w for gs, w in T.LETTER_WIDTHS for g in gs}, **T.PUNCTUATION_WIDTHS}
_WIDTH_MAP = "MAP {" + ", ".join(f"'{g.replace(chr(39), chr(39) * 2)}': {w}" for g, w in _WIDTHS.items()) + "}"

# --- pages: what the regular markup of the pages table gives to regular expressions ---

_CLEAN = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
_TEXT = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace({0}, '(?s)<[^>]*(>|$)', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
BASE = f"""
r AS (
  SELECT page_id, url, html, {_CLEAN} AS clean, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^(https?://[^?#]*)', 1) AS head,
         list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT (string_split(p, '=')[1] IN ({", ".join(f"'{x}'" for x in U.TRACKING_PARAMS)}))) AS q
  FROM pages
), u AS (
  SELECT *, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS site_id, head || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS nurl FROM r
), p AS (
  SELECT *, min(page_id) OVER (PARTITION BY site_id, nurl) AS seq FROM u QUALIFY row_number() OVER (PARTITION BY site_id, nurl ORDER BY page_id DESC) = 1
), x AS (
  SELECT p.*, {_TEXT.format("clean")} AS text,
         {_TEXT.format("regexp_extract(clean, '(?s)<article>(.*?)(</article>|<footer>|$)', 1)")} AS main,
         nullif({_TEXT.format("regexp_extract(clean, '(?s)<title>(.*?)</title>', 1)")}, '') AS title,
         {_TEXT.format("regexp_extract(clean, '(?s)<h1>(.*?)</h1>', 1)")} AS h1,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
         list_filter(regexp_extract_all(clean, '<a href="([^"]*)"', 1), lambda h: h <> '' AND NOT starts_with(h, '#')) AS hrefs,
         len(list_filter(string_split(regexp_extract(nurl, '^https?://[^/]+([^?]*)', 1), '/'), lambda s: s <> '')) AS depth
  FROM p
)
"""


@query(f"WITH {BASE} SELECT page_id, nurl AS normalized_url, site_id FROM u")
def url_normalize(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", U.normalize_url("url").alias("normalized_url"), U.registrable_domain("url").alias("site_id"))


@query(f"WITH {BASE} SELECT page_id, nurl AS normalized_url FROM u")
def url_normalize_native(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", U.normalize_native("url").alias("normalized_url"))


@query(
    rf"""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
    len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''))::INTEGER AS depth,
    regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[A-Z_]') AS upper_or_underscore,
    regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '(?i)[.]({"|".join(U.ASSET_EXTENSIONS)})$') AS non_html FROM pages"""
)
def url_flags(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet")
    return rows.select("page_id", U.host_of("url").alias("host"), U.path_of("url").alias("path"), U.path_depth("url").alias("depth"), U.has_uppercase_or_underscore("url").alias("upper_or_underscore"), U.looks_non_html("url").alias("non_html"))


#: Other spellings of each page's URL, by its number: host in capitals with its usual port, tracking and fragment, dots in the path, and no web address.
_SPELLINGS = """CASE page_id % 5
    WHEN 0 THEN concat(upper(regexp_extract(url, '^(https?://[^/?#]+)', 1)), CASE WHEN url LIKE 'https:%' THEN ':443' ELSE ':80' END, regexp_extract(url, '^https?://[^/?#]+(.*)$', 1))
    WHEN 1 THEN concat(regexp_extract(url, '^([^#]*)', 1), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_source=x&fbclid=1#z')
    WHEN 2 THEN concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/.', regexp_extract(url, '^https?://[^/?#]+(.*)$', 1))
    WHEN 3 THEN concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/x/..', regexp_extract(url, '^https?://[^/?#]+(.*)$', 1))
    ELSE concat('mailto:', url) END"""


@query(f"WITH {BASE} SELECT page_id, CASE WHEN page_id % 5 < 4 THEN nurl END AS normalized_url FROM u")
def url_normalize_values(spark, d):
    """Whatever the spelling, the page's normalised URL comes out; what is no web address has none."""
    spelt = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.expr(_SPELLINGS).alias("url"))
    return spelt.select("page_id", U.normalize_url("url").alias("normalized_url"))


@query(f"WITH {BASE} SELECT site_id, nurl AS normalized_url, page_id AS last_id, seq FROM p")
def page_dedupe(spark, d):
    rows = _pages(spark, d).select("site_id", "ingest_seq", U.normalize_url("url").alias("normalized_url"))
    return S.last_wins(rows).select("site_id", "normalized_url", F.col("ingest_seq").alias("last_id"), "seq")


@query(f"WITH {BASE} SELECT nurl AS normalized_url, title, h1, md5(text) AS text_md5, md5(main) AS main_md5, len({TOKENS.format('text')})::INTEGER AS wc, len({TOKENS.format('main')})::INTEGER AS mw, lang FROM x")
def page_extract(spark, d):
    return _site(spark, d).select(
        "normalized_url", "title", F.col("first_h1").alias("h1"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.md5(F.col("main_text").cast("binary")).alias("main_md5"), "wc", "mw", "lang"
    )


@query(
    f"""WITH {BASE} SELECT nurl AS normalized_url, {LOWER.format('title')} AS low, upper(replace(translate(title, 'iışğüöç', 'İIŞĞÜÖÇ'), 'ß', 'SS')) AS up, trim(regexp_replace({LOWER.format('title')}, '\\s+', ' ', 'g')) AS key,
    regexp_replace(regexp_replace(strip_accents({LOWER.format("translate(title, 'ıİşŞğĞüÜöÖçÇ', 'iIsSgGuUoOcC')")}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM x WHERE title IS NOT NULL"""
)
def case_and_keys(spark, d):
    titles = _site(spark, d).where("title IS NOT NULL")
    return titles.select("normalized_url", T.tr_lower("title").alias("low"), T.tr_upper("title").alias("up"), T.normalize_key("title").alias("key"), T.slugify("title").alias("slug"))


@query(f"WITH {BASE} SELECT nurl AS normalized_url, floor((list_sum(list_transform(string_split(title, ''), lambda c: coalesce({_WIDTH_MAP}[c], {T.OTHER_WIDTH}))) + 5) / 10)::INTEGER AS px FROM x WHERE title IS NOT NULL")
def text_px_titles(spark, d):
    return _site(spark, d).where("title IS NOT NULL").select("normalized_url", F.col("title_px").alias("px"))


@query("SELECT page_id, octet_length(encode(html))::INTEGER AS html_bytes FROM pages")
def utf8_bytes(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.utf8_bytes("html").alias("html_bytes"))


_IN = "len(list_filter(regexp_extract_all({0}, '<a href=\"([^\"]*)\"', 1), lambda h: h <> '' AND NOT starts_with(h, '#')))::INTEGER"
_NAV = "regexp_extract(clean, '(?s)<nav>(.*?)</nav>', 1)"


@query(f"WITH {BASE} SELECT nurl AS normalized_url, len(hrefs)::INTEGER AS links, {_IN.format(_NAV)} AS nav_links, {_IN.format("regexp_replace(clean, '(?s)<(nav|footer)>.*?</(nav|footer)>', '', 'g')")} AS main_links FROM x")
def link_area_counts(spark, d):
    links = lambda area: F.size(F.filter("links", lambda x: x["area"] == area))
    return _site(spark, d).select("normalized_url", F.size("links").alias("links"), links("nav").alias("nav_links"), links("main").alias("main_links"))


_TARGET = "regexp_extract(x.url, '^(https?://[^/]+)', 1) || "


@query(f"WITH {BASE}, l AS (SELECT x.nurl, {_TARGET} unnest(hrefs) AS target FROM x) SELECT nurl AS page_url, count(*) AS links, count(DISTINCT target) AS targets FROM l GROUP BY nurl")
def link_extract(spark, d):
    return S.links(_site(spark, d)).groupBy("page_url").agg(F.count("*").alias("links"), F.count_distinct("normalized").alias("targets"))


#: Characters outside ASCII are escaped as UTF-8.
_ESCAPED = "list_aggregate(list_transform(string_split(target, ''), lambda c: CASE WHEN c > '~' THEN url_encode(c) ELSE c END), 'string_agg', '')"


@query(f"WITH {BASE}, l AS (SELECT x.site_id, {_TARGET} unnest(hrefs) AS target FROM x) SELECT site_id, {_ESCAPED} AS target, count(*) AS inlinks FROM l GROUP BY ALL")
def inlinks(spark, d):
    return S.inlinks(_site(spark, d)).select("site_id", "target", "inlinks")


@query(
    f"""WITH {BASE}, l AS (SELECT x.site_id, {_TARGET} unnest(hrefs) AS target FROM x)
    SELECT site_id, nurl AS normalized_url FROM x WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.site_id = x.site_id AND l.target = x.nurl) AND depth > 0"""
)
def orphan_pages(spark, d):
    return S.orphans(_site(spark, d)).select("site_id", "normalized_url")


_KEY = "trim(regexp_replace(" + LOWER.format("title") + ", '\\s+', ' ', 'g'))"


@query(f"WITH {BASE} SELECT site_id, {_KEY} AS key, count(*)::INTEGER AS pages, string_agg(nurl, ' ' ORDER BY seq) AS urls FROM x WHERE title IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def duplicate_titles(spark, d):
    return S.duplicate_groups(_site(spark, d), "title", None).select("site_id", "key", F.size("pages").alias("pages"), F.array_join("pages", " ").alias("urls"))


# --- near duplicates -------------------------------------------------------------------------------------------------

_FNV = "list_reduce(list_prepend({1}::UBIGINT, list_transform(string_split(w, ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_BITS = " | ".join(f"(CASE WHEN 2 * sum((h{k} >> {i}) & 1) > count(*) THEN {1 << (i + 32 * k)}::UBIGINT ELSE 0::UBIGINT END)" for k in (0, 1) for i in range(32))
_SIMHASH = f"""
t AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS w FROM documents),
v AS (SELECT w, {_FNV.replace("{1}", str(T.SEEDS[0]))} AS h0, {_FNV.replace("{1}", str(T.SEEDS[1]))} AS h1 FROM (SELECT DISTINCT w FROM t)),
s AS (SELECT doc_id, {_BITS} AS code FROM t JOIN v USING (w) GROUP BY doc_id)
"""


@query(f"WITH {_SIMHASH} SELECT d.doc_id, printf('%016x', coalesce(code, 0::UBIGINT)) AS simhash FROM documents d LEFT JOIN s USING (doc_id)")
def simhash_docs(spark, d):
    return _docs(spark, d).select("doc_id", F.lpad(F.lower(F.hex(T.simhash(T.tokens("text")))), 16, "0").alias("simhash"))


@query(
    f"""WITH {_SIMHASH}, c AS (SELECT d.doc_id, d.source, coalesce(code, 0::UBIGINT) AS code FROM documents d LEFT JOIN s USING (doc_id))
    SELECT a.doc_id, count(b.doc_id) AS near FROM c a LEFT JOIN c b ON a.source = b.source AND a.doc_id <> b.doc_id AND bit_count(xor(a.code, b.code)) <= {N.NEAR_BITS} GROUP BY a.doc_id"""
)
def near_dup_docs(spark, d):
    """Number of near-duplicates of each document within its source; copies are counted and not listed."""
    rows = cut(_docs(spark, d).select("doc_id", F.col("source").alias("site_id"), T.simhash(T.tokens("text")).alias("simhash")))
    return rows.join(N.near_counts(rows), ["site_id", "simhash"]).select("doc_id", "near")


# --- joins with what a crawl knows -----------------------------------------------------------------------------------

_STATUS_CASE = "CASE WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 5 = 0 THEN 0 ELSE 200 END"
_REDIRECT_CASE = "CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END"


def _statuses(pages: DataFrame) -> DataFrame:
    """A made-up status of each link target: that of the first page that has it."""
    first = S.links(pages).groupBy("site_id", F.col("normalized").alias("url")).agg(F.min("seq").alias("page_id"))
    return first.select("site_id", "url", F.expr(_STATUS_CASE).alias("status"), F.expr(_REDIRECT_CASE).alias("redirects"))


@query(
    f"""WITH {BASE}, l AS (SELECT x.site_id, x.nurl, x.seq, {_TARGET} unnest(hrefs) AS target FROM x),
    f AS (SELECT site_id, target, min(seq) AS page_id FROM l GROUP BY ALL), st AS (SELECT site_id, target, {_STATUS_CASE} AS status, {_REDIRECT_CASE} AS redirects FROM f)
    SELECT nurl AS normalized_url, count(*) FILTER (status >= 400) AS broken_links, count(*) FILTER (redirects > 0 AND status < 400) AS redirect_links
    FROM l JOIN st USING (site_id, target) GROUP BY nurl HAVING broken_links > 0 OR redirect_links > 0"""
)
def broken_links(spark, d):
    pages = _site(spark, d)
    return S.status_by_link(pages, _statuses(pages)).select("normalized_url", "broken_links", "redirect_links")


#: Alternates of a page by its number: itself, and pages a few numbers away on its site, which may or may not name it too.
_ALTERNATES = {0: "page_id % 2 = 0", 3: "page_id % 3 <> 0", -3: "page_id % 4 <> 0", 9: "page_id % 5 = 0"}
_EDGES = "e AS (" + " UNION ALL ".join(f"SELECT a.site_id, a.nurl AS s, b.nurl AS t FROM p a JOIN p b ON b.site_id = a.site_id AND b.page_id = a.page_id + {k} WHERE a.{rule}" for k, rule in _ALTERNATES.items()) + ")"


def _alternates(spark: SparkSession, d: str) -> DataFrame:
    """The deduplicated pages with alternates derived from their numbers."""
    pages = S.last_wins(_pages(spark, d).select("site_id", "ingest_seq", U.normalize_url("url").alias("normalized_url"))).withColumnRenamed("ingest_seq", "page_id")
    other = pages.select("site_id", F.col("page_id").alias("to"), F.col("normalized_url").alias("normalized"))
    edges = [pages.where(rule).withColumn("to", F.col("page_id") + k).join(other, ["site_id", "to"]) for k, rule in _ALTERNATES.items()]
    every = edges[0].unionByName(edges[1]).unionByName(edges[2]).unionByName(edges[3])
    listed = every.groupBy("site_id", "normalized_url").agg(F.collect_list(F.struct(F.lit("tr").alias("lang"), "normalized")).alias("hreflang"))  # four at most
    return pages.join(listed, ["site_id", "normalized_url"], "left").withColumn("hreflang", F.coalesce("hreflang", F.expr("array()")))


@query(
    f"""WITH {BASE}, {_EDGES} SELECT site_id, s AS normalized_url, count(DISTINCT t) AS no_return FROM e
    WHERE s <> t AND NOT EXISTS (SELECT 1 FROM e b WHERE b.site_id = e.site_id AND b.s = e.t AND b.t = e.s) GROUP BY ALL"""
)
def hreflang_return(spark, d):
    return S.missing_return(cut(_alternates(spark, d)))


@query(f"WITH {BASE}, {_EDGES} SELECT site_id, nurl AS normalized_url, EXISTS (SELECT 1 FROM e WHERE e.site_id = p.site_id AND e.s = p.nurl AND e.t = p.nurl) AS self FROM p")
def hreflang_self(spark, d):
    return _alternates(spark, d).select("site_id", "normalized_url", F.exists("hreflang", lambda h: h["normalized"] == F.col("normalized_url")).alias("self"))


#: What the sitemaps of a site list, and what a crawl knows of it, by the numbers of its pages.
_LISTED, _GONE, _MOVED, _KNOWN, _OK, _HIDDEN = "page_id % 3 <> 0", "page_id % 7 = 0", "page_id % 11 = 0", "page_id % 2 = 0", "page_id % 13 <> 0", "page_id % 6 = 5"
_MAPS = f"""m AS (SELECT site_id, nurl AS loc FROM p WHERE {_LISTED} UNION SELECT site_id, nurl || '-none' FROM p WHERE page_id % 5 = 0),
st AS (SELECT site_id, nurl AS loc, CASE WHEN {_GONE} THEN 404 ELSE 200 END AS status, CASE WHEN {_MOVED} THEN 1 ELSE 0 END AS redirects FROM p WHERE {_KNOWN}
       UNION ALL SELECT site_id, nurl || '-none', 410, 0 FROM p WHERE page_id % 10 = 0)"""


def _mapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sitemap entries, statuses and pages, derived from the numbers of the deduplicated pages."""
    pages = S.last_wins(_pages(spark, d).select("site_id", "url", "ingest_seq", U.normalize_url("url").alias("normalized_url"))).withColumnRenamed("ingest_seq", "page_id")
    pages = pages.withColumns({"ok": F.expr(_OK), "robots_index": ~F.expr(_HIDDEN), "idx": F.expr(_OK) & ~F.expr(_HIDDEN)})
    none = F.concat("normalized_url", F.lit("-none"))
    locs = pages.where(_LISTED).select("site_id", F.col("normalized_url").alias("loc")).union(pages.where("page_id % 5 = 0").select("site_id", none)).distinct()
    status = pages.where(_KNOWN).select("site_id", F.col("normalized_url").alias("url"), F.expr(f"CASE WHEN {_GONE} THEN 404 ELSE 200 END").alias("status"), F.expr(f"CASE WHEN {_MOVED} THEN 1 ELSE 0 END").alias("redirects"))
    status = status.union(pages.where("page_id % 10 = 0").select("site_id", none, F.lit(410), F.lit(0)))
    return locs, status, pages


@query(
    f"""WITH {BASE}, {_MAPS} SELECT m.site_id, m.loc, CASE WHEN status >= 400 THEN 'status' WHEN redirects > 0 THEN 'redirect' ELSE 'noindex' END AS problem
    FROM m LEFT JOIN st USING (site_id, loc) LEFT JOIN p ON p.site_id = m.site_id AND p.nurl = m.loc AND {_OK} AND {_HIDDEN}
    WHERE status >= 400 OR redirects > 0 OR p.nurl IS NOT NULL"""
)
def sitemap_non_indexable(spark, d):
    return S.sitemap_problems(*_mapped(spark, d))


@query(f"WITH {BASE}, {_MAPS} SELECT site_id, nurl AS normalized_url FROM p WHERE {_OK} AND NOT ({_HIDDEN}) AND NOT EXISTS (SELECT 1 FROM m WHERE m.site_id = p.site_id AND (m.loc = p.url OR m.loc = p.nurl)) AND EXISTS (SELECT 1 FROM m WHERE m.site_id = p.site_id)")
def sitemap_orphans(spark, d):
    locs, _, pages = _mapped(spark, d)
    return S.sitemap_orphans(pages, locs).select("site_id", "normalized_url")


#: A date for each page, written in ways that are valid or not.
_LASTMOD = """CASE page_id % 8 WHEN 0 THEN day WHEN 1 THEN concat(day, 'T10:00:00Z') WHEN 2 THEN concat(substring(day, 9, 2), '.', substring(day, 6, 2), '.', substring(day, 1, 4)) WHEN 3 THEN NULL
    WHEN 4 THEN concat('2999', substring(day, 5, 6)) WHEN 5 THEN concat(substring(day, 1, 5), '13-01') WHEN 6 THEN concat(day, 'T10:00+03:00') ELSE concat(day, ' 10:00:00+0300') END"""


@query(
    f"""WITH v AS (SELECT page_id, {_LASTMOD} AS lastmod FROM (SELECT page_id, CAST(DATE '2023-01-01' + CAST(page_id % 2500 AS INTEGER) AS VARCHAR) AS day FROM pages))
    SELECT page_id, CASE WHEN lastmod IS NULL OR lastmod = '' THEN 'missing'
    WHEN NOT regexp_full_match(lastmod, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}(:\\d{{2}})?(\\.\\d+)?(Z|[+-]\\d{{2}}:?\\d{{2}})?)?') OR try_cast(substr(lastmod, 1, 10) AS DATE) IS NULL THEN 'format'
    WHEN try_cast(substr(lastmod, 1, 10) AS DATE) > DATE '2030-01-02' THEN 'future' END AS problem FROM v"""
)
def lastmod_check(spark, d):
    days = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.expr("CAST(date_add(DATE '2023-01-01', CAST(page_id % 2500 AS INT)) AS STRING)").alias("day"))
    return days.select("page_id", T.lastmod_problem(F.expr(_LASTMOD), F.to_timestamp(F.lit("2030-01-01"))).alias("problem"))


_ROBOTS = r"User-agent: *\nDisallow: /de/\nAllow: /de/1\nDisallow: /*.html$\n\n# comment\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nUser-agent: ClaudeBot\nDisallow:\nSitemap: https://s.test/sitemap.xml"


def _robots(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT explode(array('example.com', 'example.net', 'example.org')) AS site_id, '{_ROBOTS}' AS raw")


@query(
    f"""WITH {BASE}, a AS (SELECT DISTINCT site_id, regexp_extract(nurl, '^https?://[^/]+([^?]*)', 1) AS path FROM p)
    SELECT site_id, path, CASE WHEN regexp_matches(path, '^/de/1') THEN length('/de/1') >= CASE WHEN path LIKE '%.html' THEN length('/*.html$') ELSE 0 END
    WHEN path LIKE '/de/%' OR path LIKE '%.html' THEN false ELSE true END AS allowed FROM a"""
)
def robots_allow(spark, d):
    paths = _pages(spark, d).select("site_id", U.path_of(U.normalize_url("url")).alias("path")).distinct()
    agents, rules = R.robots_rules(_robots(spark))
    groups = R.chosen_group(agents, spark.sql("SELECT 'AuditBot' AS token"))
    return R.access(rules, groups, paths).select("site_id", "path", "allowed")


#: A robots.txt for each page, as if it were a site of its own.
_OWN_ROBOTS = """CASE page_id % 7 WHEN 0 THEN 'User-agent: *\\nDisallow: /' WHEN 1 THEN 'User-agent: GPTBot\\nUser-agent: CCBot\\nDisallow: /' WHEN 2 THEN 'user-agent: claudebot\\r\\ndisallow: /\\nallow: /$'
    WHEN 3 THEN 'User-agent: PerplexityBot\\nDisallow:' WHEN 4 THEN '# all\\nUser-agent: Bytespider # one\\nDisallow: /*' WHEN 5 THEN concat('User-agent: Google-Extended\\nDisallow: ', {path}) ELSE NULL END"""


@query(
    r"""SELECT 's' || page_id AS site_id, unnest(CASE page_id % 7 WHEN 1 THEN ['GPTBot', 'CCBot'] WHEN 4 THEN ['Bytespider'] ELSE CASE WHEN regexp_matches(url, '^https?://[^/]+/?([?#].*)?$') THEN ['Google-Extended'] ELSE [] END END) AS agent
    FROM pages WHERE page_id % 7 IN (1, 4, 5)"""
)
def ai_blocked(spark, d):
    sites = _pages(spark, d).select(F.concat(F.lit("s"), F.col("ingest_seq").cast("string")).alias("site_id"), F.expr(_OWN_ROBOTS.format(path="'@'").replace("page_id", "ingest_seq")).alias("raw"), U.path_of("url").alias("path"))
    return R.blocked_ai_agents(sites.select("site_id", F.replace("raw", F.lit("@"), "path").alias("raw")))


#: A rule from each page's path: as it is, its first half as a prefix or before an end, its last part anywhere, and all of it as the end.
_RULE_PATH = """CASE page_id % 5 WHEN 0 THEN path WHEN 1 THEN concat(left(path, CAST(floor(length(path) / 2) + 1 AS INT)), '*') WHEN 2 THEN concat('/*', right(path, 3)) WHEN 3 THEN concat(path, '$') ELSE concat(left(path, 2), '*', right(path, 2), '$') END"""


@query(
    f"""WITH a AS (SELECT page_id, 'g' || (page_id // 50) AS site_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
    r AS (SELECT site_id, page_id % 3 = 1 AS allow, {_RULE_PATH} AS rule FROM a),
    q AS (SELECT *, '^' || replace(regexp_replace(CASE WHEN rule LIKE '%$' THEN left(rule, length(rule) - 1) ELSE rule END, '([.+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN rule LIKE '%$' THEN '$' ELSE '' END AS pattern FROM r),
    asked AS (SELECT DISTINCT site_id, path FROM a),
    met AS (SELECT asked.*, max({{'n': length(rule), 'allow': allow}}) AS best FROM asked JOIN q USING (site_id) WHERE regexp_matches(path, pattern) GROUP BY ALL)
    SELECT site_id, path, coalesce(met.best.allow, true) AS allowed FROM asked LEFT JOIN met USING (site_id, path)"""
)
def robots_paths(spark, d):
    """Every fifty pages as a site whose robots.txt has a rule of each page's path, asked for the paths of them all."""
    pages = _pages(spark, d).select(F.col("ingest_seq").alias("page_id"), F.concat(F.lit("g"), F.expr("CAST(ingest_seq DIV 50 AS STRING)")).alias("site_id"), U.path_of("url").alias("path"))
    rules = pages.select("site_id", F.lit(1).alias("group_no"), F.col("page_id").alias("seq"), F.expr("if(page_id % 3 = 1, 'allow', 'disallow')").alias("type"), F.expr(_RULE_PATH).alias("path"))
    groups = pages.select("site_id", F.lit("AuditBot").alias("token"), F.lit(1).alias("group_no")).distinct()
    return R.access(rules, groups, pages.select("site_id", "path").distinct()).select("site_id", "path", "allowed")


#: A sitemap for each page: plain, with prefixes and an alternate, as CDATA in a commented document, and cut off within its second entry.
_OWN_SITEMAP = """concat('<?xml version="1.0"?>', CASE page_id % 4
    WHEN 0 THEN concat('<urlset><url><loc> ', loc, ' </loc><lastmod>2024-01-01</lastmod></url><url><loc></loc></url></urlset>')
    WHEN 1 THEN concat('<s:urlset xmlns:s="x"><s:url><s:lastmod/><s:loc>', loc, '</s:loc><xhtml:link rel="alternate" hreflang="tr" href="', loc, '"/></s:url></s:urlset>')
    WHEN 2 THEN concat('<!-- <url><loc>no</loc></url> --><urlset><url><loc><![CDATA[', url, ']]></loc><priority>1</priority></url></urlset>')
    ELSE concat('<urlset><url><loc>', loc, '</loc></url><url><loc>', loc, '&amp;part=2', CASE WHEN page_id % 8 = 3 THEN '' ELSE '</lo' END) END)"""


@query(
    """SELECT page_id::VARCHAR AS sitemap_url, unnest(CASE WHEN page_id % 4 = 3 THEN [url, url || '&part=2'] ELSE [url] END) AS loc, CASE WHEN page_id % 4 = 0 THEN '2024-01-01' END AS lastmod, CASE WHEN page_id % 4 = 1 THEN url END AS alternate FROM pages"""
)
def sitemap_entries(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("loc", F.replace("url", F.lit("&"), F.lit("&amp;")))
    maps = pages.select(F.lit("s").alias("site_id"), F.col("page_id").cast("string").alias("sitemap_url"), F.expr(_OWN_SITEMAP).alias("xml"))
    return M.entries(maps).select("sitemap_url", "loc", "lastmod", F.expr("try_element_at(alternates, 1).href").alias("alternate"))


# --- what a crawl left -----------------------------------------------------------------------------------------------

#: Responses by the number of a page, ten to a site: challenge pages (in runs that differ from site to site), none at all, others.
_CHALLENGED, _UNANSWERED = "page_id * 7919 % 31 < 3 + page_id // 10 % 23", "page_id // 10 % 5 = 4 AND page_id % 10 < 2 * (page_id // 50 % 6)"


@query(
    f"""WITH r AS (SELECT page_id, 'g' || (page_id // 10) AS site_id, CASE WHEN {_UNANSWERED} THEN false ELSE {_CHALLENGED} END AS hit, NOT ({_UNANSWERED}) AS answered FROM pages),
    n AS (SELECT *, page_id - row_number() OVER (PARTITION BY site_id, hit ORDER BY page_id) AS island FROM r),
    runs AS (SELECT site_id, hit, island, count(*) AS n FROM n GROUP BY ALL), s AS (SELECT site_id, coalesce(max(n) FILTER (hit), 0) AS streak FROM runs GROUP BY site_id),
    c AS (SELECT site_id, count(*) AS requested, count(*) FILTER (answered) AS answered, count(*) FILTER (hit) AS challenged FROM r GROUP BY site_id)
    SELECT site_id, requested, answered, challenged, streak, CASE WHEN streak >= 3 THEN 'blocked' WHEN answered = 0 THEN 'failed' WHEN (requested - answered) / requested > 0.2 THEN 'partial' ELSE 'ok' END AS status
    FROM c JOIN s USING (site_id)"""
)
def crawl_status(spark, d):
    """Which sites blocked a crawl, from its stored responses, derived from the numbers of the pages."""
    integer = lambda sql: F.expr(sql.replace("//", "DIV"))
    rows = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("ord"), "page_id", "html", F.expr("concat('g', CAST(page_id DIV 10 AS STRING))").alias("site_id"))
    rows = rows.withColumns({"lost": integer(_UNANSWERED), "hit": integer(_CHALLENGED)}).withColumn("hit", F.expr("hit AND NOT lost"))
    body = F.when(F.expr("hit AND page_id % 2 = 0"), F.lit("<title>Just a Moment</title>")).otherwise(F.col("html"))
    headers = F.expr("CASE WHEN hit AND page_id % 2 = 1 THEN map('cf-mitigated', 'challenge') ELSE map('content-type', 'text/html') END")
    status = F.expr("CASE WHEN lost THEN 0 WHEN hit AND page_id % 2 = 0 THEN 503 ELSE 200 END")
    responses = rows.select("site_id", F.concat(F.lit("https://"), "site_id", F.lit(".test/")).alias("url"), "ord", status.alias("status"), headers.alias("headers"), body.alias("html"))
    return captures.crawl_status(responses)


# --- rules that need headers -----------------------------------------------------------------------------------------

_GOOD = {
    "content-type": "text/html; charset=utf-8", "strict-transport-security": "max-age=31536000", "content-security-policy": "default-src 'self'; frame-ancestors 'none'",
    "x-content-type-options": "nosniff", "referrer-policy": "no-referrer", "permissions-policy": "camera=()", "content-encoding": "br",
}
#: Headers of a page by its number, some of them sent twice in different spellings, with what then fails.
_HEADER_CASES: list[tuple[list[tuple[str, str]], list[str]]] = [
    ([*_GOOD.items()], []),
    ([("Content-Type", "text/html")], ["csp-missing", "x-content-type-options-missing", "clickjacking-protection-missing", "referrer-policy-missing", "permissions-policy-missing"]),
    ([*_GOOD.items(), ("Server", "nginx"), ("server", "nginx/1.18"), ("Set-Cookie", "a=1; Secure")], ["server-version-disclosure", "cookie-flags-weak"]),
    ([*_GOOD.items(), ("Strict-Transport-Security", "max-age=600"), ("Content-Security-Policy", "script-src 'unsafe-inline' *")], ["hsts-weak", "csp-unsafe", "clickjacking-protection-missing"]),
    ([("SERVER", "nginx/1.18"), *_GOOD.items(), ("server", "nginx"), ("SET-COOKIE", "a=1; Secure; HttpOnly; SameSite=Lax")], []),
]


def _entries_sql(headers: list[tuple[str, str]]) -> str:
    return "map_from_entries(array(" + ", ".join("struct('{}', '{}')".format(k, v.replace("'", "\\'")) for k, v in headers) + "))"


def header_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages with headers and a time to the first byte that their numbers give them."""
    rows = spark.read.parquet(f"{d}/pages.parquet")
    cases = " ".join(f"WHEN {i} THEN {_entries_sql(h)}" for i, (h, _) in enumerate(_HEADER_CASES))
    headers = F.expr(f"CASE page_id % {len(_HEADER_CASES)} {cases} END")
    return P.raw_pages(rows.withColumns({"headers": headers, "ttfb_ms": F.expr("CAST(700 + page_id % 4 * 50 AS BIGINT)")}), "page_id")


@query(
    f"""WITH {BASE}, h AS (SELECT nurl AS page, unnest(list_concat(CASE page_id % {len(_HEADER_CASES)} {" ".join(f"WHEN {i} THEN {ids}" for i, (_, ids) in enumerate(_HEADER_CASES) if ids)} ELSE [] END,
      list_concat(CASE WHEN page_id % 4 = 3 THEN ['ttfb-slow'] ELSE [] END,
      CASE WHEN page_id % {len(_HEADER_CASES)} = 1 THEN list_concat(CASE WHEN url LIKE 'https:%' THEN ['hsts-missing'] ELSE [] END, CASE WHEN octet_length(encode(html)) >= 2048 THEN ['no-compression'] ELSE [] END) ELSE [] END))) AS rule_id FROM p)
    SELECT page, rule_id FROM h"""
)
def header_rules(spark, d):
    chosen = [r for r in A.RULES if "headers" in r.needs and r.id != "redirect-chain"]
    done = A.audit(header_pages(spark, d), caps=P.Capabilities(headers=True), rules=chosen)
    return done.findings.select("page", "rule_id")


@query(variants.oracle())
def rule_variants(spark, d):
    """Where each of the rules that a single page can fail does, and by how much, on pages made for them from the numbers of the pages table."""
    rules = [r for r in A.RULES if r.id in variants.VARIANTS]
    found = A.audit(variants.variant_pages(spark.read.parquet(f"{d}/pages.parquet")), caps=P.Capabilities(headers=True), rules=rules).findings
    measured = [k for k, v in variants.VARIANTS.items() if v.measure != "NULL"]
    own = found.where("rule_id = site_id")
    return own.select(F.expr("seq DIV 2").alias("page_id"), F.expr("CAST(seq % 2 AS INT)").alias("half"), "rule_id", F.when(F.col("rule_id").isin(measured), F.col("measure")).alias("measure"))


@query(variants.network_oracle())
def network_variants(spark, d):
    """Where each of the rules that take several pages, statuses, robots, sitemaps or redirects does, on sites made from the numbers of the pages table."""
    rules = [r for r in A.RULES if r.id in variants.NETWORK]
    raw, side = variants.network_sites(spark.read.parquet(f"{d}/pages.parquet"))
    done = A.audit(raw, A.SideInputs(**side), P.Capabilities(True, True), rules=rules, now=F.to_timestamp(F.lit("2030-01-01")))
    order = F.array(*[F.lit(r) for r in variants.NETWORK])
    own = done.findings.withColumn("page_id", F.col("site_id").cast("bigint")).where(F.col("rule_id") == F.get(order, F.pmod("page_id", F.lit(len(variants.NETWORK))).cast("int")))
    measured = [k for k, v in variants.NETWORK.items() if v.measure != "NULL"]
    return own.select("page_id", "rule_id", F.when(F.col("rule_id").isin(measured), F.col("measure")).alias("measure"))


# --- the audit -------------------------------------------------------------------------------------------------------

_FACTS = BASE.rstrip() + f""", f AS (
  SELECT *, len({TOKENS.format("text")}) AS wc, len({TOKENS.format("main")}) AS mw,
         len(list_filter({TOKENS.format("text")}, lambda w: w IN ({STOPS}))) AS hits,
         floor((list_sum(list_transform(string_split(title, ''), lambda c: coalesce({_WIDTH_MAP}[c], {T.OTHER_WIDTH}))) + 5) / 10) AS px,
         {_KEY} AS title_key
  FROM x
)"""
#: Rules that the pages table can tell apart, as DuckDB expressions (applies, fails) over f.
AUDIT_RULES = {
    "canonical-missing": ("true", "true"),
    "meta-description-missing": ("true", "true"),
    "title-missing": ("true", "title IS NULL"),
    "title-pixel-width": ("title IS NOT NULL", "px > 580"),
    "title-too-short": ("title IS NOT NULL", "length(title) < 30"),
    "h1-missing": ("true", "NOT contains(clean, '<h1>')"),
    "h1-count": ("true", "len(regexp_extract_all(clean, '<h1>')) > 1"),
    "thin-content": ("true", "mw < 300"),
    "viewport-meta-missing": ("true", "true"),
    "lang-attribute-missing": ("true", "lang = ''"),
    "lang-attribute-mismatch": ("lang <> '' AND wc >= 50", "hits / wc >= 0.06 AND lang NOT LIKE 'tr%'"),
    "url-uppercase-underscore": ("true", "regexp_matches(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '[A-Z_]')"),
    "url-excessive-depth": ("true", "depth > 4"),
    "jsonld-missing": ("true", "true"),
    "og-missing": ("true", "true"),
    "internal-links-few": ("mw > 300", "true"),
    "internal-link-nofollow": ("true", "false"),
    "excessive-links": ("true", "len(hrefs) > 150"),
    "anchor-text-empty": ("len(hrefs) > 0", "false"),
    "toc-missing": ("mw >= 1500", "true"),
}
_EXPANDED = f"""WITH {_FACTS}, e AS (SELECT site_id, nurl, seq, unnest([{", ".join(f"{{rule_id: '{k}', applies: coalesce({a}, false), fails: coalesce(({a}) AND ({b}), false)}}" for k, (a, b) in AUDIT_RULES.items())}], recursive := true) FROM f)"""


def _audited(spark: SparkSession, d: str, only: bool = True) -> A.Audit:
    return A.audit(_pages(spark, d), rules=[r for r in A.RULES if not only or r.id in AUDIT_RULES])


@query(f"{_EXPANDED} SELECT site_id, rule_id, count(*) FILTER (applies) AS applicable, count(*) FILTER (fails) AS failed FROM e GROUP BY ALL")
def rule_applicability(spark, d):
    return _audited(spark, d).applicability


@query(f"{_EXPANDED} SELECT site_id, rule_id, nurl AS page FROM e WHERE fails")
def rule_findings(spark, d):
    return _audited(spark, d).findings.select("site_id", "rule_id", "page")


_DIM = "dim(rule_id, category, severity, weight, impact, effort, multiplier, boost) AS (VALUES " + ", ".join(
    f"('{r.id}', '{r.category}', '{r.severity}', {r.weight}, {r.impact}, {A.EFFORT_FACTOR[r.effort]}::DOUBLE, {A.SEVERITY_MULTIPLIER[r.severity]}::DOUBLE, {A.SEVERITY_BOOST[r.severity]}::DOUBLE)" for r in A.RULES if r.id in AUDIT_RULES
) + ")"
_SCORES = f"""{_EXPANDED}, {_DIM}, n AS (SELECT site_id, rule_id, count(*) FILTER (applies) AS applicable, count(*) FILTER (fails) AS failed FROM e GROUP BY ALL),
c AS (SELECT site_id, category,
  sum(CASE WHEN applicable > 0 AND failed > 0 AND severity <> 'info' THEN weight * multiplier * (0.30::DOUBLE + 0.70::DOUBLE * failed / applicable) ELSE 0 END) AS penalty,
  sum(CASE WHEN applicable > 0 AND severity <> 'info' THEN weight * multiplier ELSE 0 END) AS max_penalty, count(*) FILTER (applicable > 0)::INTEGER AS evaluated_rules FROM n JOIN dim USING (rule_id) GROUP BY ALL),
sc AS (SELECT *, CASE WHEN max_penalty > 0 THEN greatest(0, floor(100 * (1 - penalty / max_penalty) + 0.5))::INTEGER END AS score FROM c)"""


@query(f"{_SCORES} SELECT site_id, category, score, evaluated_rules FROM sc")
def category_scores(spark, d):
    return _audited(spark, d).category_scores.select("site_id", "category", "score", "evaluated_rules")


_WEIGHTS = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in A.CATEGORY_WEIGHT.items()) + " END"


@query(
    f"""{_SCORES}, o AS (SELECT site_id, floor(sum({_WEIGHTS} * score) / sum({_WEIGHTS}) + 0.5)::INTEGER AS overall FROM sc WHERE score IS NOT NULL AND category <> 'security' GROUP BY site_id),
    k AS (SELECT DISTINCT site_id FROM n JOIN dim USING (rule_id) WHERE severity = 'critical' AND failed > 0)
    SELECT site_id, overall, CASE WHEN site_id IN (SELECT site_id FROM k) THEN 'critical' WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 60 THEN 'fair' WHEN overall >= 40 THEN 'weak' ELSE 'poor' END AS verdict FROM o"""
)
def site_scores(spark, d):
    return _audited(spark, d).site_scores.select("site_id", "overall", "verdict")


@query(
    f"""{_SCORES}, pr AS (SELECT site_id, rule_id, failed AS count, failed / applicable AS p, impact * effort * (0.5 + 0.5 * (failed / applicable)) * boost AS raw, severity FROM n JOIN dim USING (rule_id) WHERE failed > 0),
    ps AS (SELECT *, CASE WHEN severity = 'critical' THEN greatest(raw, 5) ELSE raw END AS s FROM pr)
    SELECT site_id, rule_id, count, floor(p * 100 + 0.5) / 100 AS prevalence, floor(s * 100 + 0.5) / 100 AS priority_score, CASE WHEN s >= 5 THEN 'P0' WHEN s >= 3 THEN 'P1' WHEN s >= 1.5 THEN 'P2' ELSE 'P3' END AS priority FROM ps"""
)
def actions_ranked(spark, d):
    return _audited(spark, d).actions.select("site_id", "rule_id", "count", "prevalence", "priority_score", "priority")


@query(
    f"""{_EXPANDED}, {_DIM}, w AS (SELECT site_id, nurl AS page, count(*) FILTER (severity IN ('critical', 'error')) AS severe, count(*) AS total FROM e JOIN dim USING (rule_id) WHERE fails GROUP BY ALL)
    SELECT site_id, page, severe, total, row_number() OVER (PARTITION BY site_id ORDER BY severe DESC, total DESC, page)::INTEGER AS n FROM w QUALIFY n <= 10"""
)
def worst_pages(spark, d):
    return A.worst_pages(_audited(spark, d).findings)


@query(f"{_EXPANDED}, {_DIM} SELECT severity, category, count(*) AS findings FROM e JOIN dim USING (rule_id) WHERE fails GROUP BY GROUPING SETS ((severity), (category), ())")
def findings_rollup(spark, d):
    """Findings by severity, by category and in all, from one pass."""
    return _audited(spark, d).findings.groupingSets([[F.col("severity")], [F.col("category")], []], F.col("severity"), F.col("category")).agg(F.count("*").alias("findings")).select("severity", "category", "findings")


@query(f"{_EXPANDED} SELECT site_id, rule_id, count(*) FILTER (applies) AS applicable, count(*) FILTER (fails) AS failed FROM e GROUP BY ALL HAVING applicable > 0")
def stream_applicability(spark, d):
    """The counts of rules after a stream of the pages has run dry, some files a micro-batch, added up from its changes."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    captured = spark.readStream.schema("page_id bigint, url string, html string").option("maxFilesPerTrigger", 8).parquet(f"{d}/page[s].parquet")
    run = stream.write_changes(captured, f"{folder}/changes", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.current_applicability(stream.read_changes(spark, f"{folder}/changes")).where(F.col("rule_id").isin([*AUDIT_RULES]))


# --- the audit under all rules that html alone can answer ---

_PARAGRAPH = "list_filter(list_transform(string_split(clean, '<p>')[2:], lambda x: " + _TEXT.format("regexp_extract(x, '(?s)^(.*?)(</p>|</article>|<footer>|$)', 1)") + "), lambda t: length(t) > 40)[1]"
_HEADS = "regexp_extract_all(clean, '<h[2-6][^>]*>[^<]*', 0)"
#: The further page rules that apply on the pages table, as (applies, fails); all others never do.
FULL_RULES = AUDIT_RULES | {
    "anchor-text-generic": ("len(hrefs) > 0", f"len(list_filter(regexp_extract_all(clean, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda t: {LOWER.format('t')} IN ({', '.join(repr(x) for x in html_extract.GENERIC_ANCHORS)}))) > 0"),
    "answerable-summary-missing": ("mw >= 300", "para IS NULL OR length(para) NOT BETWEEN 80 AND 400"),
    "charset-declaration-late": ("true", "instr(html, 'charset') > 1024 OR NOT contains(html, 'charset')"),
    "content-freshness-missing": ("mw >= 500", r"NOT regexp_matches(substr(main, 1, 1200), '(^|[^A-Za-z0-9_])20[0-9][0-9]($|[^A-Za-z0-9_])') AND NOT regexp_matches(main, '(?i)(g[üÜ]ncelleme|g[üÜ]ncellendi|yayınlanma)')"),
    "content-server-rendered": ("true", "mw < 200 AND (regexp_matches(lower(html), '__next_data__|data-reactroot|ng-version|data-vue-meta|id=.(root|__next|app).') OR length(list_aggregate(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), 'string_agg', '')) / length(html) > 0.5)"),
    "dom-node-count": ("true", "len(regexp_extract_all(clean, '<[a-z]')) + 5 > 1500"),
    "heading-empty": ("true", "regexp_matches(clean, '<h[1-6]>\\s*</h[1-6]>')"),
    "heading-hierarchy-skip": ("true", f"len({_HEADS}) > 0 AND NOT regexp_matches({_HEADS}[1], '^<h2')"),
    "heading-question-form": ("mw >= 800", f"len(list_filter({_HEADS}, lambda h: contains(h, '?'))) < floor(mw / 800)"),
    "html-size-excessive": ("true", "floor(octet_length(encode(html)) / 1024 + 0.5) > 250"),
    "inline-style-bloat": ("true", "len(regexp_extract_all(html, '(?s)<style>.*?</style>')) > 50"),
    "jsonld-breadcrumb-missing": ("depth >= 2", "NOT contains(html, 'BreadcrumbList')"),
    "lang-region-format": ("lang <> ''", "NOT regexp_matches(lang, '^[a-z]{2,3}(-[A-Z]{2})?$')"),
    "link-to-http": ("starts_with(url, 'https://')", "len(list_filter(hrefs, lambda h: starts_with(h, 'http://'))) > 0"),
    "meta-robots-nofollow": ("true", "contains(html, 'nofollow')"),
    "mixed-content": ("starts_with(url, 'https://')", "regexp_matches(clean, 'src=.http://')"),
    "render-blocking-css": ("true", "len(regexp_extract_all(clean, 'rel=.stylesheet')) > 1"),
    "render-blocking-js": ("true", "regexp_matches(html, '<script[^>]*src=')"),
    "soft-404": ("true", "wc < 120 AND regexp_matches(lower(text), 'page not found|404 error|bulunamadı')"),
    "third-party-script-count": ("true", "len(regexp_extract_all(html, '<script[^>]*src=')) > 8"),
    "turkish-mojibake": ("true", "(" + _COUNTS.replace("(t", "(html") + ") >= 4 OR (" + _KINDS.replace("(t", "(html") + ") >= 2"),
    "twitter-card-missing": ("true", "NOT contains(html, 'twitter:card')"),
    "url-turkish-charset": ("true", "regexp_matches(url_decode(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '[ıİşŞğĞüÜöÖçÇ]')"),
}
#: What the failing rules measure.
_MEASURES = {"answerable-summary-missing": "length(para)", "h1-count": "len(regexp_extract_all(clean, '<h1>'))", "internal-links-few": "0", "thin-content": "mw", "title-pixel-width": "px", "title-too-short": "length(title)", "url-excessive-depth": "depth", "excessive-links": "len(hrefs)"}
_SITE_RULES = "client-side-rendering duplicate-content-cluster hreflang-missing-multilocale jsonld-organization-missing meta-description-duplicate orphan-page title-duplicate".split()
_ADVICE = "adv(rule_id, category, severity, weight, impact, effort, multiplier, boost, message, fix) AS (VALUES " + ", ".join(
    "('{}', '{}', '{}', {}, {}, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, '{}', '{}')".format(r.id, r.category, r.severity, r.weight, r.impact, A.EFFORT_FACTOR[r.effort], A.SEVERITY_MULTIPLIER[r.severity], A.SEVERITY_BOOST[r.severity], r.says.replace("'", "''"), r.mend.replace("'", "''"))
    for r in A.RULES if r.id in FULL_RULES or r.id in _SITE_RULES
) + ")"
_FULL = f"""WITH {_FACTS}, g AS (SELECT *, {_PARAGRAPH} AS para FROM f), {_ADVICE},
e AS (SELECT site_id, nurl, seq, unnest([{", ".join(f"{{rule_id: '{k}', applies: coalesce({a}, false), fails: coalesce(({a}) AND ({b}), false), measure: ({_MEASURES.get(k, 'NULL')})::DOUBLE}}" for k, (a, b) in FULL_RULES.items())}], recursive := true) FROM g),
sp AS (SELECT site_id, count(*) AS pages, count(DISTINCT nullif(lang, '')) AS langs, arg_min(url, (depth, seq)) AS home FROM g GROUP BY site_id),
dt AS (SELECT site_id, title_key, min(seq) AS first, count(*) AS n, list(nurl ORDER BY seq)[1:5] AS p FROM g WHERE title IS NOT NULL AND title_key <> '' GROUP BY ALL HAVING count(*) >= 2),
l AS (SELECT site_id, {_TARGET.replace("x.url", "url")} unnest(hrefs) AS target FROM g),
orph AS (SELECT site_id, count(*) AS n, list(nurl ORDER BY seq)[1:5] AS p FROM g WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.site_id = g.site_id AND l.target = g.nurl) GROUP BY site_id),
t AS (SELECT site_id, nurl, unnest({TOKENS.format("CASE WHEN main <> '' THEN main ELSE text END")}) AS w FROM g WHERE mw > 100),
v AS (SELECT w, {_FNV.replace("{1}", str(T.SEEDS[0]))} AS h0, {_FNV.replace("{1}", str(T.SEEDS[1]))} AS h1 FROM (SELECT DISTINCT w FROM t)),
codes AS (SELECT site_id, nurl, {_BITS} AS code FROM t JOIN v USING (w) GROUP BY ALL),
nd AS (SELECT a.site_id, count(*) AS n FROM codes a JOIN codes b ON a.site_id = b.site_id AND a.nurl < b.nurl AND bit_count(xor(a.code, b.code)) <= {N.NEAR_BITS} GROUP BY a.site_id),
fd AS (  -- findings of sites: rule, order, affected, measure, first pages
  SELECT site_id, 'title-duplicate' AS rule_id, first AS seq, n AS affected, n::DOUBLE AS measure, p FROM dt
  UNION ALL SELECT site_id, 'orphan-page', 0, n, n, p FROM orph JOIN sp USING (site_id) WHERE pages > 2
  UNION ALL SELECT site_id, 'duplicate-content-cluster', 0, 1, n, NULL FROM nd
  UNION ALL SELECT site_id, 'hreflang-missing-multilocale', 0, 1, NULL, NULL FROM sp WHERE langs >= 2
  UNION ALL SELECT site_id, 'jsonld-organization-missing', 0, 1, NULL, [home] FROM sp
  UNION ALL SELECT site_id, rule_id, seq, 1, measure, [nurl] FROM e WHERE fails
),
ap AS (
  SELECT site_id, rule_id, count(*) FILTER (applies) AS applicable, count(*) FILTER (fails) AS failed FROM e GROUP BY ALL
  UNION ALL SELECT site_id, r.rule_id, CASE r.rule_id WHEN 'orphan-page' THEN pages > 2 WHEN 'hreflang-missing-multilocale' THEN langs >= 2 WHEN 'jsonld-organization-missing' THEN true WHEN 'client-side-rendering' THEN true ELSE pages > 1 END::BIGINT,
         (EXISTS (SELECT 1 FROM fd WHERE fd.site_id = sp.site_id AND fd.rule_id = r.rule_id))::BIGINT
  FROM sp, (VALUES {", ".join(f"('{r}')" for r in _SITE_RULES)}) r(rule_id)
)"""


@query(
    f"""{_FULL}, c AS (SELECT site_id, category,
      sum(CASE WHEN applicable > 0 AND failed > 0 AND severity <> 'info' THEN weight * multiplier * (0.30::DOUBLE + 0.70::DOUBLE * failed / applicable) ELSE 0 END) AS penalty,
      sum(CASE WHEN applicable > 0 AND severity <> 'info' THEN weight * multiplier ELSE 0 END) AS max_penalty, count(*) FILTER (applicable > 0)::INTEGER AS evaluated_rules FROM ap JOIN adv USING (rule_id) GROUP BY ALL),
    k AS (SELECT site_id, category, count(*) AS findings FROM fd JOIN adv USING (rule_id) GROUP BY ALL),
    every AS (SELECT site_id, category FROM sp, (VALUES {", ".join(f"('{c}')" for c in sorted({r.category for r in A.evaluated(A.RULES, P.Capabilities())}))}) x(category))
    SELECT site_id, category, CASE WHEN max_penalty > 0 THEN greatest(0, floor(100 * (1 - penalty / max_penalty) + 0.5))::INTEGER END AS score, round(coalesce(penalty, 0), 6) AS penalty, round(coalesce(max_penalty, 0), 6) AS max_penalty,
           coalesce(evaluated_rules, 0)::INTEGER AS evaluated_rules, coalesce(findings, 0) AS findings
    FROM every LEFT JOIN c USING (site_id, category) LEFT JOIN k USING (site_id, category)"""
)
def full_audit(spark, d):
    """Category scores of every site under all rules that html alone can answer."""
    sums = [F.round(x, 6).alias(x) for x in ("penalty", "max_penalty")]
    return _audited(spark, d, only=False).category_scores.select("site_id", "category", "score", *sums, "evaluated_rules", "findings")


@query(
    f"""{_FULL}, pr AS (SELECT site_id, rule_id, sum(affected)::BIGINT AS count, list(p ORDER BY seq, p)[1:5] AS shown, arg_min(measure, (seq, p)) AS value, arg_min(affected, (seq, p)) AS n_pages FROM fd GROUP BY ALL),
    ps AS (SELECT *, failed / applicable AS pv, impact * effort * (0.5 + 0.5 * (failed / applicable)) * boost AS raw FROM pr JOIN ap USING (site_id, rule_id) JOIN adv USING (rule_id)),
    sc AS (SELECT *, CASE WHEN severity = 'critical' THEN greatest(raw, 5) ELSE raw END AS s FROM ps),
    o AS (SELECT *, floor(s * 100 + 0.5) / 100 AS priority_score FROM sc)
    SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY priority_score DESC, rule_id)::INTEGER AS n, rule_id, count, floor(pv * 100 + 0.5) / 100 AS prevalence, priority_score,
           CASE WHEN s >= 5 THEN 'P0' WHEN s >= 3 THEN 'P1' WHEN s >= 1.5 THEN 'P2' ELSE 'P3' END AS priority, array_to_string(list_filter(flatten(shown), lambda x: x IS NOT NULL)[1:5], ' ') AS samples,
           replace(replace(message, '{{value}}', coalesce(value::BIGINT::VARCHAR, 'no')), '{{pages}}', n_pages::VARCHAR) AS message, fix
    FROM o"""
)
def full_actions(spark, d):
    """Ranked actions of every site under all rules that html alone can answer, with what they say."""
    done = _audited(spark, d, only=False).actions
    order = Window.partitionBy("site_id").orderBy(F.desc("priority_score"), "rule_id")
    ranked = done.withColumn("n", F.row_number().over(order))
    return ranked.select("site_id", "n", "rule_id", "count", "prevalence", "priority_score", "priority", F.array_join("samples", " ").alias("samples"), "message", "fix")
