"""From raw pages to findings, applicability, scores and actions, for many sites in one job."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelumen.functions import text as T
from sitelumen.functions import url as U
from sitelumen.operators import near_duplicates as N
from sitelumen.operators import site as S
from sitelumen.plans.catalog import CATEGORY_WEIGHT, CONTENT_DEPENDENT, EFFORT_FACTOR, RULES, SAMPLES, SEVERITIES, SEVERITY_BOOST, SEVERITY_MULTIPLIER, Rule
from sitelumen.session import cut
from sitelumen.sources import html_extract, robots
from sitelumen.sources.pages import Capabilities

# --- fixed values ---
SOFT_404 = (
    "sayfa bulunamadı", "aradığınız sayfa bulunamadı", "böyle bir sayfa yok", "sayfa mevcut değil", "içerik bulunamadı", "page not found", "404 error",
    "aradığınız içeriğe ulaşılamadı",
)
SPA_MARKERS = (
    "__next_data__", "data-reactroot", "ng-version", "data-vue-meta", 'id="root"', "id='root'", 'id="__next"', "id='__next'", 'id="app"', "id='app'",
)
# --- end of fixed values ---


#: Findings of a rule that may have several a row.
FINDS = "array<struct<message:string,measure:double,sample:array<string>>>"


@dataclass
class SideInputs:
    """What a crawl knows besides pages; every table may be absent."""

    url_status: DataFrame | None = None  # site_id, url, status, redirects
    robots: DataFrame | None = None  # site_id, raw
    sitemaps: DataFrame | None = None  # site_id, url, ok
    sitemap_entries: DataFrame | None = None  # site_id, loc, lastmod
    llms_txt: DataFrame | None = None  # site_id, text


@dataclass
class Audit:
    """The frames of one audit; ``pages`` and ``site_facts`` are written already, the others lazy."""

    pages: DataFrame
    page_facts: DataFrame
    site_facts: DataFrame
    findings: DataFrame
    applicability: DataFrame
    category_scores: DataFrame
    site_scores: DataFrame
    actions: DataFrame
    rules: list[Rule]
    rule_errors: DataFrame
    unread: DataFrame
    side: SideInputs
    caps: Capabilities
    crawl: DataFrame | None = None
    options: dict = field(default_factory=dict)
    mappings: DataFrame | None = None

    def views(self) -> None:
        """Temporary views ``pages``, ``findings`` and so on, for SQL."""
        for name in ("pages", "page_facts", "site_facts", "findings", "applicability", "category_scores", "site_scores", "actions", "rule_errors", "unread"):
            getattr(self, name).createOrReplaceTempView(name)
        S.links(self.pages).createOrReplaceTempView("links")


def _any(text, markers: tuple[str, ...]):
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(text, F.lit(m))
    return found


def page_models(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    """One row a page (last of a normalised URL), with the parsed record's fields and the facts of the raw html.

    Pages that another capture of their URL replaces are left out before anything is parsed. Without ``dedupe`` every
    capture has a row; that works on a stream too.
    """
    raw = raw.withColumn("html", F.coalesce("html", F.lit("")))
    if dedupe:
        raw = S.last_wins(raw.withColumn("normalized_url", F.coalesce(U.normalize_url("url"), "url"))).drop("normalized_url")
    else:
        raw = raw.withColumn("seq", F.col("ingest_seq"))
    raw = raw.select(
        "*",
        F.octet_length("html").alias("html_bytes"),
        T.utf16_length("html").alias("html_length"),
        T.is_mojibake("html").alias("mojibake"),
        F.col("html").rlike("(?i)@font-face").alias("font_face"),
        F.col("html").rlike(r"(?i)font-display\s*:").alias("font_display"),
        _any(F.lower("html"), SPA_MARKERS).alias("spa_marker"),
    )
    keep = [c for c in raw.columns if c not in ("html", "final_url", "transfer_bytes")]
    return html_extract.parsed_pages(raw, keep).select(*keep, "normalized_url", *html_extract.model_columns())


def derived(models: DataFrame) -> DataFrame:
    """The page frame: parsed fields plus everything that follows from one page alone."""
    words, main_words = T.tokens("text"), T.tokens("main_text")
    robots_text = F.concat_ws(",", F.col("robots_meta"), F.when(F.col("headers")["x-robots-tag"] != "", F.col("headers")["x-robots-tag"]))
    d = models.withColumns({"_w": words, "_mw": main_words, "_robots": T.tr_lower(robots_text)})
    d = d.withColumns(
        {
            "wc": F.size("_w"),
            "mw": F.size("_mw"),
            "turkish_ratio": F.when(F.size("_w") < 20, F.lit(0.0)).otherwise(T.stop_word_hits(F.col("_w")) / F.size("_w")),
            "ok": F.col("status").between(200, 299),
            "robots_index": ~F.contains("_robots", F.lit("noindex")),
            "robots_follow": ~F.contains("_robots", F.lit("nofollow")),
            "page_host": U.host_of("url"),
            "path": U.path_of("normalized_url"),
            "path_depth": U.path_depth("url"),
            "url_turkish": U.has_raw_turkish("url"),
            "url_upper": U.has_uppercase_or_underscore("url"),
            "title_px": T.text_px("title"),
            "description_px": T.text_px("meta_description"),
            "canonical_host": U.host_of("canonical"),
            "canonical_norm": U.normalize_url("canonical"),
            "h1_count": F.size(F.filter("headings", lambda h: h["level"] == 1)),
            "first_h1": F.expr("try_element_at(filter(headings, h -> h.level = 1), 1).text"),
            "jumps": F.size(F.filter(F.zip_with(F.col("headings"), F.slice("headings", 2, 10**6), lambda a, b: b["level"] > a["level"] + 1), lambda j: F.coalesce(j, F.lit(False)))),
            "types": F.array_distinct(F.flatten("jsonld.types")),
            "faq_unseen": F.when(F.size("nodes") == 0, F.lit(0)).otherwise(
                F.size(F.filter(F.flatten("nodes.questions"), lambda q: ~F.contains(T.tr_lower("text"), F.substring(T.tr_lower(q), 1, 40))))
            ),
            "third_hosts": F.array_distinct("scripts.host"),
            "paragraph_units": T.utf16_length("first_paragraph"),
            "generic_links": F.size(F.filter("links", lambda x: (x["anchor"] != "") & (T.tr_lower(x["anchor"]).isin(*html_extract.GENERIC_ANCHORS) | x["anchor"].rlike("(?i)^https?://")))),
        }
    )
    soft = (F.col("status") == 200) & (F.col("wc") < 120) & _any(T.tr_lower("text"), SOFT_404)
    spa = (F.col("mw") < 200) & (F.col("spa_marker") | ((F.col("html_length") > 0) & (F.col("script_bytes") / F.greatest(F.lit(1), F.col("html_length")) > 0.5)))
    d = d.withColumns({"idx": F.col("ok") & F.col("robots_index"), "soft404": soft, "spa": spa})
    main_or_all = F.when(F.col("main_text") != "", F.col("_mw")).otherwise(F.col("_w"))
    candidate = F.col("idx") & (F.col("mw") > 100)
    return d.withColumn("simhash", F.when(candidate, T.simhash(main_or_all))).drop("_w", "_mw", "_robots")


def url_mappings(raw: DataFrame) -> DataFrame:
    """``(site_id, ingest_seq, url, mapped)`` of the raw pages of a directory whose canonical link names another URL of their site."""
    models = html_extract.parsed_pages(raw, ["site_id", "ingest_seq", "url"]).select("ingest_seq", "site_id", "url", F.col("model.canonical").alias("to"), "normalized_url")
    to = models.where("to IS NOT NULL").withColumn("mapped", U.normalize_url("to"))
    return to.where((U.registrable_domain("to") == F.col("site_id")) & (F.col("mapped") != F.col("normalized_url"))).select("site_id", "ingest_seq", "url", "mapped")


def remapped(raw: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """Raw pages of a directory with each page's URL replaced by the one that ``url_mappings`` gives it."""
    to = (url_mappings(raw) if mappings is None else mappings).withColumnRenamed("url", "_url")
    moved = raw.join(to, (raw["site_id"] == to["site_id"]) & (raw["ingest_seq"] == to["ingest_seq"]) & (raw["url"] == to["_url"]), "left")
    return moved.select(*[F.coalesce(to["mapped"], raw["url"]).alias("url") if c == "url" else raw[c] for c in raw.columns])


def _left(df: DataFrame, other: DataFrame | None, fills: dict[str, str], keys: list[str]) -> DataFrame:
    if other is None:
        return df.withColumns({c: F.expr(e) for c, e in fills.items()})
    joined = df.join(other, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.expr(e)) for c, e in fills.items()})


def named(rules: list[Rule], scope: str) -> set[str]:
    """The names in the expressions of the rules of a scope: columns that have to be there are among them."""
    texts = [t for r in rules if r.scope == scope for t in (r.applies, r.fails, r.measure, r.sample, r.pages, r.page, *r.reads)]
    return set(re.findall(r"[A-Za-z_]\w*", " ".join(texts)))


def page_facts(pages: DataFrame, side: SideInputs, wanted: set[str] | None = None) -> DataFrame:
    """The page frame with what other pages and the side inputs say about each page.

    Of the facts that take a join only those in ``wanted`` are made; without it all are.
    """
    keys, status = ["site_id", "normalized_url"], side.url_status
    asked = lambda *names: wanted is None or not wanted.isdisjoint(names)
    facts = pages.withColumn("nurl", F.col("normalized_url"))
    if asked("site_pages"):
        facts = facts.join(pages.groupBy("site_id").agg(F.count("*").alias("site_pages")), "site_id")
    if asked("inlinks"):
        facts = _left(facts, S.inlinks(pages).withColumnRenamed("target", "normalized_url"), {"inlinks": "0L"}, keys)
    if asked("no_return"):
        facts = _left(facts, S.missing_return(pages), {"no_return": "0L"}, keys)
    if asked("has_status"):
        facts = _left(facts, None if status is None else status.select("site_id").distinct().withColumn("has_status", F.lit(True)), {"has_status": "false"}, ["site_id"])
    if asked("canonical_bad"):
        facts = _left(facts, None if status is None else S.canonical_status(pages, status), {"canonical_bad": "false"}, keys)
    if asked("hreflang_bad"):
        facts = _left(facts, None if status is None else S.bad_alternates(pages, status), {"hreflang_bad": "0L"}, keys)
    if asked("broken_links", "redirect_links"):
        facts = _left(facts, None if status is None else S.status_by_link(pages, status), {"broken_links": "0L", "redirect_links": "0L"}, keys)
    if not asked("in_sitemap"):
        return facts
    if side.sitemap_entries is None:
        return facts.withColumn("in_sitemap", F.lit(False))
    locs = side.sitemap_entries.select("site_id", "loc").distinct().withColumn("listed", F.lit(True))
    facts = facts.join(locs.withColumnsRenamed({"loc": "url", "listed": "_a"}), ["site_id", "url"], "left")
    facts = facts.join(locs.withColumnsRenamed({"loc": "normalized_url", "listed": "_b"}), keys, "left")
    return facts.withColumn("in_sitemap", F.coalesce("_a", "_b", F.lit(False))).drop("_a", "_b")


def _ordered(rows: DataFrame, name: str, listed: int | None = None) -> DataFrame:
    return S.first_listed(rows, ["site_id"], *([listed] if listed else [])).select("site_id", F.col("listed").alias(name), F.col("n").alias(f"{name}_count"))


def shared_values(pages: DataFrame, rules: list[Rule] = RULES, listed: int | None = None) -> dict[str, DataFrame]:
    """Of each column that a rule groups by, the groups of pages with one value."""
    return {r.groups: S.duplicate_groups(pages, r.groups, listed or S.LISTED) for r in rules if r.groups}


def _gathered(sites: DataFrame, parts: list[tuple[DataFrame | None, dict[str, str]]]) -> DataFrame:
    """``sites`` with the columns of ``parts``, each a frame of at most one row a site and the values where it has none.

    The parts are stacked and reduced to one row a site in one step, and that is joined once.
    """
    fills = {c: e for _, own in parts for c, e in own.items()}
    known = [df.select("site_id", *own) for df, own in parts if df is not None]
    if not known:
        return sites.withColumns({c: F.expr(e) for c, e in fills.items()})
    stacked = known[0]
    for df in known[1:]:
        stacked = stacked.unionByName(df, allowMissingColumns=True)
    columns = [c for c in stacked.columns if c != "site_id"]
    met = sites.join(stacked.groupBy("site_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns]), "site_id", "left")
    return met.withColumns({c: F.coalesce(F.col(c), F.expr(e)) if c in columns else F.expr(e) for c, e in fills.items()})


def site_facts(
    pages: DataFrame, side: SideInputs, caps: Capabilities, single_page: bool = False, now=None, groups: dict[str, DataFrame] | None = None, wanted: set[str] | None = None, lists: int | None = None
) -> DataFrame:
    """One row a site. Of the facts that take more than one pass over the pages only those in ``wanted`` are made; without it all are."""
    groups = shared_values(pages) if groups is None else groups
    now = now if now is not None else F.current_timestamp()
    asked = lambda *names: wanted is None or not wanted.isdisjoint(names)
    home = F.min_by(F.struct("url", "types"), F.struct("path_depth", "seq"))
    facts = pages.groupBy("site_id").agg(
        F.count("*").alias("pages"),
        home.alias("home"),
        F.avg(F.col("spa").cast("int")).alias("spa_share"),
        F.collect_set(F.when(F.coalesce("lang", F.lit("")) != "", F.col("lang"))).alias("locales"),
        F.collect_set("page_host").alias("hosts"),
        F.bool_or(F.array_contains("types", "Organization")).alias("has_organization"),
        F.bool_or(F.exists("nodes", lambda n: F.array_contains(n["types"], "Organization") & n["same_as"])).alias("has_same_as"),
    )
    facts = facts.withColumns({"single_page": F.lit(single_page), "net": F.lit(caps.net), "headers": F.lit(caps.headers)})
    parts: list[tuple[DataFrame | None, dict[str, str]]] = []
    if asked("hreflang_langs"):
        langs = pages.select("site_id", F.explode("hreflang.lang").alias("lang")).distinct().groupBy("site_id").agg(F.collect_set("lang").alias("hreflang_langs"))
        parts.append((langs, {"hreflang_langs": "CAST(array() AS array<string>)"}))
    for column, found in groups.items():
        parts.append((found.groupBy("site_id").agg(F.count("*").alias(f"{column}_groups")), {f"{column}_groups": "0L"}))
    if asked("near_duplicates"):
        parts.append((N.pair_total(pages).withColumnRenamed("pairs", "near_duplicates"), {"near_duplicates": "0L"}))
    if asked("orphans", "orphans_count"):
        parts.append((_ordered(S.orphans(pages), "orphans", lists), {"orphans": "CAST(array() AS array<string>)", "orphans_count": "0L"}))

    status = side.url_status
    counted = None
    if status is not None and asked("statuses", "status_bad"):
        hosts = pages.select("site_id", F.col("page_host").alias("host")).distinct()
        known = status.withColumn("host", U.host_of("url")).join(hosts.withColumn("own", F.lit(True)), ["site_id", "host"], "left")
        counted = known.groupBy("site_id").agg(F.count("*").alias("statuses"), F.count_if(F.expr("own AND status >= 400")).alias("status_bad"))
    parts.append((counted, {"statuses": "0L", "status_bad": "0L"}))

    maps = None if side.sitemaps is None else side.sitemaps.groupBy("site_id").agg(F.count("*").alias("sitemaps"), F.count_if("ok").alias("sitemaps_ok"))
    parts.append((maps, {"sitemaps": "0L", "sitemaps_ok": "0L"}))
    entries = side.sitemap_entries
    listed = bad = lost = None
    if entries is not None:
        problem = T.lastmod_problem("lastmod", now)
        listed = entries.groupBy("site_id").agg(F.count("*").alias("sitemap_entries"), F.count_distinct("loc").alias("sitemap_locs"), F.count_if(problem.isNotNull()).alias("lastmod_bad"))
        locs = entries.select("site_id", "loc").distinct()
        if status is not None and asked("sitemap_bad"):
            bad = S.sitemap_problems(locs, status, pages).groupBy("site_id").agg(F.count("*").alias("sitemap_bad"))
        if asked("sitemap_orphans", "sitemap_orphans_count"):
            lost = _ordered(S.sitemap_orphans(pages, locs), "sitemap_orphans", lists)
    parts.append((listed, {"sitemap_entries": "0L", "sitemap_locs": "0L", "lastmod_bad": "0L"}))
    parts.append((bad, {"sitemap_bad": "0L"}))
    parts.append((lost, {"sitemap_orphans": "CAST(array() AS array<string>)", "sitemap_orphans_count": "0L"}))
    found = blocked = None
    if side.robots is not None:
        found = side.robots.groupBy("site_id").agg(F.bool_or(F.col("raw").isNotNull()).alias("robots_found"))
        blocked = robots.blocked_ai_agents(side.robots).groupBy("site_id").agg(F.count("*").alias("ai_blocked"))
    parts += [(found, {"robots_found": "false"}), (blocked, {"ai_blocked": "0L"})]
    llms = None if side.llms_txt is None else side.llms_txt.groupBy("site_id").agg(F.bool_or(F.trim("text") != "").alias("llms_found"))
    return _gathered(facts, [*parts, (llms, {"llms_found": "false"})])


def evaluated(rules: list[Rule], caps: Capabilities) -> list[Rule]:
    """Rules whose needs the source can meet."""
    return [r for r in rules if not ("headers" in r.needs and not caps.headers) and not ("net" in r.needs and not caps.net)]


def _sql(rule: Rule, min_words: int, n: int = 0) -> dict[str, str]:
    """The rule's expressions by name; those of a rule in Python read what its check has left in ``_check{n}``."""
    applies, said = f"coalesce({rule.applies}, false)", f"_check{n}"
    fails = f"{said}.fails" if rule.python else rule.fails.replace("{min_words}", str(min_words))
    failing = f"({applies}) AND coalesce({fails}, false)"
    measure = f"{said}.measure" if rule.python else rule.measure
    return {
        "applies": applies, "fails": failing, "measure": f"CAST({measure} AS double)",
        "sample": f"CASE WHEN {failing} THEN CAST(slice({rule.sample}, 1, {SAMPLES}) AS array<string>) END" if rule.sample != "NULL" else "CAST(NULL AS array<string>)",
        "error": f"CASE WHEN {applies} THEN {said}.error END" if rule.python else "CAST(NULL AS string)",
        "finds": f"CASE WHEN {failing} THEN {said}.finds END" if rule.finds else f"CAST(NULL AS {FINDS})",
    }


def _verdicts(rules: list[Rule], min_words: int, fields: dict[str, str]) -> str:
    """An array with one struct a rule; ``fields`` names the rule's further expressions and their types."""
    parts = []
    for n, r in enumerate(rules):
        own = "".join(f", '{name}', {sql}" for name, sql in _sql(r, min_words, n).items())
        rest = "".join(f", '{name}', CAST({getattr(r, name) or 'NULL'} AS {kind})" for name, kind in fields.items())
        parts.append(f"named_struct('rule_id', '{r.id}'{own}{rest})")
    empty = ",".join(["rule_id:string", "applies:boolean", "fails:boolean", "measure:double", "sample:array<string>", "error:string", f"finds:{FINDS}", *(f"{name}:{kind}" for name, kind in fields.items())])
    return f"array({', '.join(parts)})" if parts else f"CAST(array() AS array<struct<{empty}>>)"


def _called(rule: Rule) -> Callable[[pd.DataFrame], list[tuple]]:
    """What a rule in Python says of the rows of a frame: ``(fails, measure, error, finds)`` each; an error is a row, not the end of the audit."""

    def told(said: object) -> tuple:
        return (said is not None and said is not False, None if said is None or isinstance(said, bool) else float(said), None, None)

    def failed(e: Exception) -> tuple:
        return (False, None, f"{type(e).__name__}: {e}", None)

    def one(row: dict) -> tuple:
        try:
            if rule.finds is None:
                return told(rule.check(row))
            found = [{"message": f.get("message"), "measure": None if f.get("measure") is None else float(f["measure"]), "sample": [str(x) for x in f.get("sample", ())]} for f in rule.finds(row)]
            return (bool(found), float(len(found)), None, found)
        except Exception as e:
            return failed(e)

    def frame(part: pd.DataFrame) -> list[tuple]:
        try:
            return [told(None if x is None or x != x else bool(x) if isinstance(x, (bool, np.bool_)) else x) for x in rule.check(part).tolist()]
        except Exception as e:
            return [failed(e)] * len(part)

    return frame if rule.by_frame else lambda part: [one(row) for row in part.to_dict("records")]


def _checks(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with ``_check{n}`` for each rule in Python: what it says of the row, or what it raises."""

    def column(rule: Rule) -> F.Column:
        call = _called(rule)

        @F.pandas_udf(f"fails boolean, measure double, error string, finds {FINDS}")
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield pd.DataFrame(call(part), columns=["fails", "measure", "error", "finds"]).astype({"measure": "float64"})

        return run(F.struct(*rule.reads))

    return rows.withColumns({f"_check{n}": column(r) for n, r in enumerate(rules) if r.python})


def sound(rows: DataFrame, rules: list[Rule], min_words: int = 300) -> tuple[list[Rule], dict[str, str]]:
    """The rules whose expressions the columns of ``rows`` can answer, and what is wrong with each of the others."""
    empty = rows.sparkSession.createDataFrame([], rows.schema)

    def problem(some: list[Rule]) -> str | None:
        try:
            columns = [F.expr(sql) for r in some if not r.python for name, sql in _sql(r, min_words).items() if name not in ("error", "finds")]
            columns += [F.expr(f"CAST({r.pages} AS array<string>)") for r in some] + [F.expr(f"CAST({r.page} AS string)") for r in some]
            columns += [F.expr(r.applies) for r in some if r.python] + [F.col(c) for r in some for c in r.reads]
            empty.select(*columns).schema  # noqa: B018
        except (AnalysisException, ParseException) as e:
            return str(e).splitlines()[0]
        return None

    if problem(rules) is None:
        return rules, {}
    wrong = {r.id: said for r in rules if (said := problem([r])) is not None}
    return [r for r in rules if r.id not in wrong], wrong


def evaluate(facts: DataFrame, sites: DataFrame, rules: list[Rule], min_words: int = 300, groups: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(findings, applicability, errors)``; every facts row is evaluated once, and kept as an array of verdicts.

    Counting adds up booleans of the array; only failed verdicts become rows. A rule that the facts cannot answer is left
    out and has an error, and so has a row on which a rule in Python raised one.
    """
    page_rules, unfit = sound(facts, [r for r in rules if r.scope == "page"], min_words)
    site_rules, more = sound(sites, [r for r in rules if r.scope == "site"], min_words)
    pages = _checks(facts, page_rules).select("site_id", "seq", "normalized_url", F.expr(_verdicts(page_rules, min_words, {})).alias("verdicts"))
    whole = _checks(sites, site_rules).select("site_id", F.inline(F.expr(_verdicts(site_rules, min_words, {"page": "string", "pages": "array<string>"}))))
    pages = cut(pages)
    if any(r.python for r in site_rules):  # a check in Python is called once a site
        whole = cut(whole)
    counts = pages.groupBy("site_id").agg(
        *[F.count_if(F.col("verdicts")[i]["applies"]).alias(f"a{i}") for i in range(len(page_rules))], *[F.count_if(F.col("verdicts")[i]["fails"]).alias(f"f{i}") for i in range(len(page_rules))]
    )
    each = ", ".join(f"named_struct('rule_id', '{r.id}', 'applicable', a{i}, 'failed', f{i})" for i, r in enumerate(page_rules))
    each = f"array({each})" if each else "CAST(array() AS array<struct<rule_id:string,applicable:bigint,failed:bigint>>)"
    page_counts = counts.select("site_id", F.inline(F.expr(each)))
    site_counts = whole.select("site_id", "rule_id", F.col("applies").cast("bigint").alias("applicable"), F.col("fails").cast("bigint").alias("failed"))
    none, one = F.lit(None).cast("array<string>"), F.lit(1).cast("bigint")
    columns = ["site_id", "rule_id", "scope", "page", "pages", "affected", "measure", "sample", "seq", "own_message"]

    def each_found(rows: DataFrame) -> DataFrame:
        """A row for each finding of the rules that may have several."""
        if not any(r.finds for r in [*page_rules, *site_rules]):
            return rows.withColumn("own_message", F.lit(None).cast("string"))
        rows = rows.withColumn("_one", F.explode_outer("finds"))
        sample = F.when(F.size(F.col("_one.sample")) > 0, F.slice("_one.sample", 1, SAMPLES)).otherwise(F.col("sample"))
        return rows.withColumns({"own_message": F.col("_one.message"), "measure": F.when(F.col("_one").isNull(), F.col("measure")).otherwise(F.col("_one.measure")), "sample": sample}).drop("_one")

    failed_pages = each_found(pages.select("site_id", "seq", "normalized_url", F.inline(F.filter("verdicts", lambda v: v["fails"]))))
    found = failed_pages.withColumns({"scope": F.lit("page"), "page": F.col("normalized_url"), "pages": none, "affected": one}).select(columns)
    failed = each_found(whole.where("fails")).withColumns({"scope": F.lit("site"), "seq": F.lit(0).cast("bigint")})
    grouped = [r for r in site_rules if r.groups]
    single = failed.where(~F.col("rule_id").isin([r.id for r in grouped])) if grouped else failed
    affected = F.when(F.col("pages").isNull(), one).otherwise(F.coalesce(F.col("measure"), F.size("pages")).cast("bigint"))
    found = found.unionByName(single.withColumn("affected", affected).select(columns))
    for r in grouped:
        own = (groups or {})[r.groups].select("site_id", "pages", F.col("n").alias("affected"), F.col("n").cast("double").alias("measure"), F.array(F.col("key")).alias("sample"), F.col("first").alias("seq"))
        own = own.join(failed.where(F.col("rule_id") == r.id).select("site_id"), "site_id", "left_semi")
        found = found.unionByName(own.withColumns({"rule_id": F.lit(r.id), "scope": F.lit("site"), "page": F.lit(None).cast("string"), "own_message": F.lit(None).cast("string")}).select(columns))
    errors = pages.select("site_id", F.col("normalized_url").alias("page"), F.inline(F.filter("verdicts", lambda v: v["error"].isNotNull()))).select("site_id", "rule_id", "page", "error")
    errors = errors.unionByName(whole.where("error IS NOT NULL").select("site_id", "rule_id", F.lit(None).cast("string").alias("page"), "error"))
    if wrong := unfit | more:
        listed = F.array(*[F.struct(F.lit(k).alias("rule_id"), F.lit(None).cast("string").alias("page"), F.lit(v).alias("error")) for k, v in wrong.items()])
        errors = errors.unionByName(sites.select("site_id", F.inline(listed)))
    return found, page_counts.unionByName(site_counts), errors


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_dim(spark, rules: list[Rule] = RULES) -> DataFrame:
    """Scalar metadata of the rules; a table of their number."""
    rows = ", ".join(
        f"('{r.id}', '{r.category}', '{r.severity}', {r.weight}, {r.impact}, '{r.effort}', '{r.scope}', {SEVERITIES.index(r.severity)}, "
        f"{SEVERITY_MULTIPLIER[r.severity]}D, {SEVERITY_BOOST[r.severity]}D, {EFFORT_FACTOR[r.effort]}D, {str(r.id in CONTENT_DEPENDENT).lower()}, {_quoted(r.says)}, {_quoted(r.mend)})"
        for r in rules
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule_id, category, severity, weight, impact, effort, scope, rank, multiplier, boost, effort_factor, content_dependent, says, fix)")


def with_metadata(findings: DataFrame, sites: DataFrame, partial: DataFrame | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """Findings with the rule's metadata, message, fix, evidence as JSON and confidence.

    Confidence is low for content-dependent rules on a client-rendered site, else medium where the crawl was partial.
    """
    dim = F.broadcast(rule_dim(findings.sparkSession, rules).drop("scope", "multiplier", "boost", "effort_factor"))
    spa = sites.select("site_id", (F.col("spa_share") >= 0.5).alias("spa_site"))
    joined = findings.join(dim, "rule_id").join(spa, "site_id", "left")
    joined = joined.withColumn("partial", F.lit(False)) if partial is None else _left(joined, partial.select("site_id", "partial"), {"partial": "false"}, ["site_id"])
    confidence = F.when(F.col("spa_site") & F.col("content_dependent"), F.lit("low")).when(F.col("partial"), F.lit("medium")).otherwise(F.lit("high"))
    count = F.when(F.col("pages").isNotNull(), F.col("affected"))
    evidence = F.to_json(F.struct(F.col("measure").alias("value"), count.alias("pages"), "sample"))
    number = F.when(F.col("measure") == F.floor("measure"), F.col("measure").cast("bigint").cast("string")).otherwise(F.round("measure", 2).cast("string"))
    message = F.replace(F.replace(F.coalesce("own_message", "says"), F.lit("{value}"), F.coalesce(number, F.lit("no"))), F.lit("{pages}"), F.coalesce(count, F.lit(0)).cast("string"))
    return joined.withColumns({"confidence": confidence, "evidence": evidence, "message": message}).drop("spa_site", "content_dependent", "partial", "says", "own_message", "sample")


def js_round(x, digits: int = 0):
    """Rounding half up at the given digits."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def category_scores(applicability: DataFrame, findings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Penalty, maximum and score of each category of a site; a null score where nothing could be evaluated."""
    spark = applicability.sparkSession
    damping = F.when(F.col("confidence") == "low", 0.4).when(F.col("confidence") == "medium", 0.7).otherwise(1.0)
    damp = findings.groupBy("site_id", "rule_id").agg(F.min(damping).alias("damping"), F.count("*").alias("found"))
    rows = applicability.join(F.broadcast(rule_dim(spark, rules)), "rule_id").join(damp, ["site_id", "rule_id"], "left")
    counted = F.col("applicable") > 0
    scored = counted & (F.col("severity") != "info")
    full = F.col("weight") * F.col("multiplier")
    penalty = F.when(scored & (F.col("failed") > 0), full * (0.30 + 0.70 * F.col("failed") / F.col("applicable")) * F.coalesce("damping", F.lit(1.0))).otherwise(0.0)
    sums = rows.groupBy("site_id", "category").agg(
        F.sum(penalty).alias("penalty"),
        F.sum(F.when(scored, full).otherwise(0.0)).alias("max_penalty"),
        F.count_if(counted).cast("int").alias("evaluated_rules"),
        F.count("*").cast("int").alias("listed_rules"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("findings"),
    )
    score = F.when(F.col("max_penalty") > 0, F.greatest(F.lit(0), js_round(100 * (1 - F.col("penalty") / F.col("max_penalty")))).cast("int"))
    return sums.withColumn("score", score)


def site_scores(scores: DataFrame, findings: DataFrame, sites: DataFrame) -> DataFrame:
    """Overall score (weights renormalised over scored categories), verdict and the separate security score."""
    weight = F.create_map(*[F.lit(x) for pair in CATEGORY_WEIGHT.items() for x in pair])[F.col("category")]
    used = F.col("score").isNotNull() & (F.col("category") != "security")
    sums = scores.groupBy("site_id").agg(
        F.sum(F.when(used, weight * F.col("score"))).alias("s"),
        F.sum(F.when(used, weight)).alias("w"),
        F.max(F.when(F.col("category") == "security", F.col("score"))).alias("security"),
    )
    critical = findings.where("severity = 'critical' AND category <> 'security'").select("site_id").distinct().withColumn("critical", F.lit(True))
    rows = _left(sites.select("site_id").join(sums, "site_id", "left"), critical, {"critical": "false"}, ["site_id"])
    overall = F.when(F.col("w") > 0, js_round(F.col("s") / F.col("w")).cast("int"))
    verdict = (
        F.when(F.col("critical"), F.lit("critical"))
        .when(F.col("overall").isNull(), F.lit("not-evaluated"))
        .when(F.col("overall") >= 90, F.lit("excellent"))
        .when(F.col("overall") >= 75, F.lit("good"))
        .when(F.col("overall") >= 60, F.lit("fair"))
        .when(F.col("overall") >= 40, F.lit("weak"))
        .otherwise(F.lit("poor"))
    )
    return rows.withColumn("overall", overall).select("site_id", "overall", verdict.alias("verdict"), "security")


def actions(findings: DataFrame, applicability: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One action a failed rule and site: what it says first and how to mend it, count, prevalence, priority score and bucket, up to five sample pages.

    Only the first five findings of a rule and site are gathered.
    """
    dim = F.broadcast(rule_dim(findings.sparkSession, rules).select("rule_id", "boost", "effort_factor", "fix"))
    own = findings.groupBy("site_id", "rule_id", "category", "severity", "impact", "effort").agg(F.sum("affected").alias("count"))
    shown = F.coalesce(F.slice("pages", 1, 5), F.array("page"))
    first = findings.select("site_id", "rule_id", "seq", shown.alias("p"), "message")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("site_id", "rule_id").orderBy("seq", "p"))).where("n <= 5")
    listed = F.array_sort(F.collect_list(F.struct("n", "p")))["p"]
    first = first.groupBy("site_id", "rule_id").agg(F.slice(F.flatten(listed), 1, 5).alias("samples"), F.min_by("message", "n").alias("message"))
    own = own.join(first, ["site_id", "rule_id"])
    rows = own.join(applicability, ["site_id", "rule_id"], "left").join(dim, "rule_id")
    prevalence = F.when(F.col("applicable") > 0, F.col("failed") / F.col("applicable")).otherwise(1.0)
    rows = rows.withColumn("p", prevalence)
    score = F.col("impact") * F.col("effort_factor") * (0.5 + 0.5 * F.col("p")) * F.col("boost")
    rows = rows.withColumn("s", F.when(F.col("severity") == "critical", F.greatest(score, F.lit(5.0))).otherwise(score))
    bucket = F.when(F.col("s") >= 5, "P0").when(F.col("s") >= 3, "P1").when(F.col("s") >= 1.5, "P2").otherwise("P3")
    samples = F.filter("samples", lambda x: x.isNotNull())
    return rows.select("site_id", "rule_id", "category", "severity", "count", js_round(F.col("p"), 2).alias("prevalence"), js_round(F.col("s"), 2).alias("priority_score"), bucket.alias("priority"), samples.alias("samples"), "message", "fix")


def worst_pages(findings: DataFrame, most: int = 10) -> DataFrame:
    """The pages of a site with the most findings, severe ones (critical, error) first."""
    counts = findings.where("page IS NOT NULL").groupBy("site_id", "page").agg(F.count_if(F.expr("rank <= 1")).alias("severe"), F.count("*").alias("total"))
    order = Window.partitionBy("site_id").orderBy(F.desc("severe"), F.desc("total"), "page")
    return counts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def audit(
    raw: DataFrame, side: SideInputs | None = None, caps: Capabilities | None = None, min_words: int = 300, single_page: bool = False, now=None, crawl: DataFrame | None = None, rules: list[Rule] | None = None,
    options: dict | None = None, listed: int | None = None, mappings: DataFrame | None = None,
) -> Audit:
    """The whole audit; lists of pages in a finding have the first ``listed`` of them (1000 unless told otherwise), counts are of all.

    Pages, site facts and verdicts are read by several frames, so each is written once to the shared checkpoint folder
    before this returns; that also keeps the plans behind them short, and lost executors cost no second parse. Facts that
    no chosen rule names are not made. ``crawl`` has a row a site with
    the ``status`` of its crawl and its counters; confidence is lower where it is not ok. Pages that cannot be parsed are
    judged by no rule and listed in ``unread``. ``mappings`` (see ``url_mappings``) are listed among a run's errors.
    """
    side, caps = side or SideInputs(), caps or Capabilities()
    every_rule = rules or RULES
    chosen = evaluated(every_rule, caps)
    every = cut(derived(page_models(raw)))
    pages, unread = every.where("parse_error IS NULL"), every.where("parse_error IS NOT NULL").select("site_id", F.col("normalized_url").alias("page"), F.col("parse_error").alias("error"))
    of_page, of_site = named(chosen, "page"), named(chosen, "site")
    groups = shared_values(pages, [*chosen, *(r for r in RULES if f"{r.groups}_groups" in of_site)], listed)
    facts, sites = page_facts(pages, side, of_page), cut(site_facts(pages, side, caps, single_page, now, groups, of_site, listed))
    found, applicable, errors = evaluate(facts, sites, chosen, min_words, groups)
    partial = None if crawl is None else crawl.select("site_id", (F.col("status") != "ok").alias("partial"))
    found = with_metadata(found, sites, partial, every_rule)
    scores = category_scores(applicable, found, every_rule)
    return Audit(pages, facts, sites, found, applicable, scores, site_scores(scores, found, sites), actions(found, applicable, every_rule), chosen, errors, unread, side, caps, crawl, options or {}, mappings)
