"""Sinks: one JSON document a site, Markdown and HTML reports, all written on the executors, and reading a JSON document back."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelumen.plans.audit import Audit, worst_pages
from sitelumen.plans.files import write_files
from sitelumen.plans.catalog import BY_ID, CATEGORY_WEIGHT, RULES, SEVERITIES, catalog_digest

#: Errors of a run that a document lists of each kind.
ERRORS = 100
LABELS = {"P0": "Now", "P1": "Next", "P2": "Soon", "P3": "Later"}


def md_safe(text: object) -> str:
    """Text that cannot open markup, links, tables or html in Markdown."""
    one = re.sub(r"[\r\n]+", " ", str("" if text is None else text))
    return re.sub(r"([\\`*_{}\[\]()#+!|<>~])", r"\\\1", one)


def esc(text: object) -> str:
    return html.escape(str("" if text is None else text), quote=True)


def page_rows(audit: Audit) -> DataFrame:
    """The pages of the document: identity, verdict-relevant facts and counts."""
    return audit.pages.select(
        "site_id", "seq", F.col("normalized_url").alias("url"), "status", "depth", "title", "title_px", "meta_description", "canonical", "lang", F.col("robots_index").alias("index"), "wc", "mw", "h1_count",
        F.size("links").alias("links"), F.size(F.filter("links", lambda x: x["internal"])).alias("internal_links"), F.size("images").alias("images"),
        F.size(F.filter("images", lambda i: i["alt"].isNull())).alias("images_without_alt"), F.size("jsonld").alias("jsonld_blocks"), "html_bytes", "spa", "soft404",
    )


def site_rows(audit: Audit) -> DataFrame:
    """``(site_id, run_status, counters, errors, site)``: what a document says of a site and its run."""
    facts, side = audit.site_facts, audit.side
    client = F.when(F.col("spa_share") >= 0.5, F.lit("client")).otherwise(F.lit("server"))
    robots = F.struct(F.col("robots_found").alias("found"), F.col("ai_blocked").alias("blocked_ai_agents"))
    rows = facts.select("site_id", F.col("pages").alias("page_count"), F.array_sort("hosts").alias("hosts"), F.array_sort("locales").alias("locales"), client.alias("rendering"), robots.alias("robots"), F.col("llms_found").alias("llms_txt"))
    maps = F.array_sort(F.collect_list(F.struct("url", "ok")))
    if side.sitemaps is None:
        rows = rows.withColumn("sitemaps", F.expr("CAST(array() AS array<struct<url:string,ok:boolean>>)"))
    else:
        rows = rows.join(side.sitemaps.groupBy("site_id").agg(maps.alias("sitemaps")), "site_id", "left")
    if audit.crawl is None:
        rows = rows.withColumns({"status": F.lit("ok"), "counters": F.lit(None).cast("struct<requested:bigint>"), "errors": F.expr("CAST(array() AS array<struct<url:string,kind:string>>)")})
    else:
        counters = F.struct("requested", "fetched", "failed", "skipped_by_robots").alias("counters")
        rows = rows.join(audit.crawl.select("site_id", "status", counters, "errors"), "site_id", "left")
    if audit.mappings is not None:
        first = audit.mappings.withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy("url", "mapped"))).where(F.col("n") <= ERRORS)
        mapped = first.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("url", F.concat(F.lit("url-mapping: "), "mapped").alias("kind")))).alias("mapped"))
        rows = rows.join(mapped, "site_id", "left").withColumn("errors", F.concat(F.coalesce("errors", F.array().cast("array<struct<url:string,kind:string>>")), F.coalesce("mapped", F.array().cast("array<struct<url:string,kind:string>>"))))
    site = F.struct("site_id", "status", "page_count", "hosts", "locales", "rendering", "robots", "sitemaps", "llms_txt")
    return rows.select("site_id", "counters", "errors", site.alias("site"))


def _rank() -> F.Column:
    return F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)])


#: The columns of the entries of a document's lists.
CATEGORY = ["category", "score", "penalty", "max_penalty", "evaluated_rules", "findings"]
ACTION = ["rule_id", "category", "severity", "count", "prevalence", "priority_score", "priority", "message", "fix", "samples"]
FINDING = ["rule_id", "category", "severity", "weight", "scope", "page", "pages", "confidence", "message", "fix", "evidence"]
APPLICABLE = ["rule_id", "applicable", "failed"]


def _listed(rows: DataFrame, name: str, order: list, columns: list[str]) -> DataFrame:
    one = F.struct(*order, F.struct(*columns).alias("x"))
    sorted_rows = rows.groupBy("site_id").agg(F.array_sort(F.collect_list(one)).alias("r"))
    return sorted_rows.select("site_id", F.transform("r", lambda r: r["x"]).alias(name))


def _site_frame(audit: Audit) -> DataFrame:
    """``(site_id, overall, verdict, security, counters, errors, site, summary, categories, actions, applicability)``: what a document says besides its pages and findings; as long as there are rules."""
    counts = audit.findings.groupBy("site_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.struct(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORY_WEIGHT]).alias("by_category")
    )
    counts = counts.select("site_id", F.struct(F.col("n").alias("findings"), *SEVERITIES, "by_category").alias("summary"))
    out = audit.site_scores.join(site_rows(audit), "site_id").join(counts, "site_id", "left")
    out = out.join(_listed(audit.category_scores, "categories", ["category"], CATEGORY), "site_id", "left")
    out = out.join(_listed(audit.actions, "actions", [(-F.col("priority_score")).alias("o"), "rule_id"], ACTION), "site_id", "left")
    return out.join(_listed(audit.applicability, "applicability", ["rule_id"], APPLICABLE), "site_id", "left")


def _run(audit: Audit, more: list[str]) -> F.Column:
    known = F.struct(F.lit(audit.caps.headers).alias("headers"), F.lit(audit.caps.net).alias("net"))
    options = F.lit(json.dumps(audit.options, sort_keys=True, default=str)).alias("options")
    return F.struct(F.lit("sitelumen").alias("tool"), F.lit(len(RULES)).alias("rules"), F.lit(len(audit.rules)).alias("evaluated_rules"), F.lit(catalog_digest()).alias("catalog"), F.col("site.status").alias("status"), known.alias("capabilities"), options, "counters", "errors", *more)


_SCORES = ("overall", "verdict", "security", "categories")


def _finding_order() -> list:
    return [_rank().alias("k"), "rule_id", F.collate(F.coalesce("page", F.lit("null")), "UNICODE").alias("o"), "seq"]


def documents(audit: Audit) -> DataFrame:
    """``(site_id, document)``: the audit of each site as one JSON text, in a fixed order of keys and entries.

    The lists of a document are those of one site, and sites are built in parallel. For a site of more pages than one text
    should hold there is ``write_documents``, which writes the same document as a stream of rows.
    """
    pages = page_rows(audit).drop("seq")
    lists = [
        _listed(pages, "pages", ["url"], [c for c in pages.columns if c != "site_id"]),
        _listed(audit.findings, "findings", _finding_order(), FINDING),
        _listed(audit.rule_errors, "rule_errors", ["rule_id", F.coalesce("page", F.lit("")).alias("o")], ["rule_id", "page", "error"]),
        _listed(audit.unread, "unread_pages", ["page"], ["page", "error"]),
    ]
    out = _site_frame(audit)
    for rows in lists:
        out = out.join(rows, "site_id", "left")
    whole = F.struct(_run(audit, ["rule_errors", "unread_pages"]).alias("run"), "site", F.struct(*_SCORES).alias("scores"), "summary", "actions", "pages", "findings", "applicability")
    return out.select("site_id", F.to_json(whole).alias("document"))


def summaries(audit: Audit) -> DataFrame:
    """``(site_id, document)``: of each document what reports show; the pages with most findings stand for its pages and findings, and errors and unread pages are counted."""
    worst = worst_pages(audit.findings)
    count = lambda rows, name: rows.groupBy("site_id").agg(F.count("*").alias(name))
    out = _site_frame(audit).join(_listed(worst, "worst", ["n"], ["page", "severe", "total"]), "site_id", "left")
    out = out.join(count(audit.rule_errors, "rule_error_count"), "site_id", "left").join(count(audit.unread, "unread_count"), "site_id", "left").fillna(0, ["rule_error_count", "unread_count"])
    whole = F.struct(_run(audit, ["rule_error_count", "unread_count"]).alias("run"), "site", F.struct(*_SCORES).alias("scores"), "summary", "actions", "worst", "applicability")
    return out.select("site_id", F.to_json(whole).alias("document"))


def document_rows(audit: Audit) -> DataFrame:
    """The documents as rows ``(file, part, text, item, o1, o2, o3)`` in the order in which they make up the text; no row holds more than one page or finding, or what there is once a rule."""
    name = F.concat(F.regexp_replace("site_id", "[/\\\\]", "_"), F.lit(".json")).alias("file")
    base = _site_frame(audit).select("site_id", F.to_json(_run(audit, [])).alias("run"), *[F.to_json(c).alias(c) for c in ("site", "summary", "actions", "applicability")], F.to_json(F.struct(*_SCORES)).alias("scores"))
    key = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f',"{k}":'), F.col(k))).otherwise(F.lit(""))
    head = F.concat(F.lit('{"run":'), F.expr("left(run, length(run) - 1)"), F.lit(',"rule_errors":['))
    fixed = [(0, head), (2, F.lit('],"unread_pages":[')), (4, F.concat(F.lit("]}"), *[key(k) for k in ("site", "scores", "summary", "actions")], F.lit(',"pages":['))), (6, F.lit('],"findings":[')), (8, F.concat(F.lit("]"), key("applicability"), F.lit("}\n")))]
    none = [F.lit(None).cast("string").alias(f"o{i}") for i in (1, 2, 3)]
    rows = base.select(name, F.explode(F.array(*[F.struct(F.lit(i).alias("part"), t.alias("text")) for i, t in fixed])).alias("x"), F.lit(False).alias("item"), *none).select("file", "x.part", "x.text", "item", "o1", "o2", "o3")
    pages = page_rows(audit).drop("seq")
    listed = [
        (1, audit.rule_errors, ["rule_id", F.coalesce("page", F.lit("")), F.lit("")], ["rule_id", "page", "error"]),
        (3, audit.unread, ["page", F.lit(""), F.lit("")], ["page", "error"]),
        (5, pages, ["url", F.lit(""), F.lit("")], [c for c in pages.columns if c != "site_id"]),
        (7, audit.findings, [F.concat(_rank().cast("string"), F.col("rule_id")), F.coalesce("page", F.lit("null")), F.lpad(F.col("seq").cast("string"), 20, "0")], FINDING),
    ]
    for part, frame, order, columns in listed:
        keys = [(F.col(k) if isinstance(k, str) else k).cast("string").alias(f"o{i}") for i, k in enumerate(order, 1)]
        rows = rows.unionByName(frame.select(name, F.lit(part).alias("part"), F.to_json(F.struct(*columns)).alias("text"), F.lit(True).alias("item"), *keys))
    return rows


def write_tables(audit: Audit, folder: str) -> None:
    """Every frame as Parquet, partitioned by nothing but its rows."""
    for name in ("findings", "applicability", "category_scores", "site_scores", "actions", "rule_errors", "unread", "mappings"):
        if getattr(audit, name) is not None:
            getattr(audit, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_documents(audit: Audit, folder: str) -> None:
    """A JSON file a site, of one line; rows stream into it on the executors, so a site may have any number of pages."""
    ordered = document_rows(audit).withColumn("o2", F.collate("o2", "UNICODE"))
    write_files(ordered, folder, ["o1", "o2", "o3"])


def write_reports(documents: DataFrame, folder: str, formats: list[str]) -> None:
    """A Markdown or HTML file for each of ``documents(site_id, document)``, rendered and written on the executors."""
    makers = {k: f for k, f in (("md", markdown), ("html", html_report)) if k in formats}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(f"{re.sub(r'[/\\\\]', '_', site)}.{kind}", make(json.loads(text))) for site, text in zip(part["site_id"], part["document"], strict=True) for kind, make in makers.items()]
            yield pd.DataFrame(rows, columns=["file", "text"])

    made = documents.mapInPandas(run, "file string, text string").withColumns({"part": F.lit(0), "item": F.lit(False)})
    if makers:
        write_files(made, folder, [])


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(site_id, document)`` of the documents of one report run, for rendering again; rules are not run again."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.get_json_object("value", "$.site.site_id").alias("site_id"), F.col("value").alias("document"))


def read_documents(spark: SparkSession, path: str) -> list[dict]:
    """The documents of ``stored_documents`` in memory; for a few sites."""
    return [json.loads(r["document"]) for r in stored_documents(spark, path).toLocalIterator()]


def _count(run: dict, counted: str, listed: str) -> int:
    return run[counted] if counted in run else len(run.get(listed) or [])


def warnings(document: dict) -> list[str]:
    """What limits the reading of a document."""
    out = []
    if document["site"].get("status") == "blocked":
        out.append("The site answered with challenge pages; the crawl stopped.")
    if document["site"].get("status") == "partial":
        out.append("Part of the pages could not be fetched.")
    if any(a["rule_id"] == "client-side-rendering" and a["failed"] for a in document.get("applicability") or []):
        out.append("Most pages are rendered in the browser; findings about content have low confidence.")
    if _count(document["run"], "rule_error_count", "rule_errors"):
        out.append("Some rules could not be evaluated everywhere; the document lists their errors.")
    if _count(document["run"], "unread_count", "unread_pages"):
        out.append("Some pages could not be parsed and were judged by no rule.")
    if not any(BY_ID[a["rule_id"]].needs and not BY_ID[a["rule_id"]].offline for a in document.get("applicability") or [] if a["rule_id"] in BY_ID):
        out.append("Offline run: rules that need response headers or network data were left out.")
    return out


def _worst(document: dict, most: int = 10) -> list[tuple[str, int, int]]:
    if "worst" in document:
        return [(w["page"], w["severe"], w["total"]) for w in document["worst"][:most]]
    counts: dict[str, list[int]] = {}
    for f in document.get("findings") or []:
        if f.get("page"):
            own = counts.setdefault(f["page"], [0, 0])
            own[0] += f["severity"] in ("critical", "error")
            own[1] += 1
    return [(u, s, t) for u, (s, t) in sorted(counts.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:most]]


def _facts(document: dict) -> list[tuple[str, object]]:
    """What a report says of the site's files and of the run."""
    site, run = document["site"], document["run"]
    maps, counters, robots = site.get("sitemaps") or [], run.get("counters") or {}, site.get("robots") or {}
    offline = not (run.get("capabilities") or {}).get("net")
    return [
        ("robots.txt", "not looked for" if offline else f"found, {robots.get('blocked_ai_agents', 0)} AI agents barred" if robots.get("found") else "missing"),
        ("sitemaps", "not looked for" if offline else f"{sum(bool(m['ok']) for m in maps)} of {len(maps)} readable"),
        ("llms.txt", "not looked for" if offline else "found" if site.get("llms_txt") else "missing"),
        ("rendering", site.get("rendering")),
        ("hosts", ", ".join(site.get("hosts") or [])),
        ("languages", ", ".join(site.get("locales") or []) or "none declared"),
        ("crawl", f"{site.get('status')}" + (f"; {counters['requested']} asked, {counters['fetched']} read, {counters['failed']} failed, {counters['skipped_by_robots']} barred by robots.txt" if counters else "")),
        ("rules", f"{run.get('evaluated_rules', run['rules'])} of {run['rules']} evaluated, catalogue {run['catalog']}, {_count(run, 'rule_error_count', 'rule_errors')} errors of rules, {_count(run, 'unread_count', 'unread_pages')} pages unread"),
    ]


METHOD = (
    "Each rule is counted on the pages that it applies to. A failed rule costs its weight times its severity, more the more pages fail; a category's score is what is left of 100. "
    "Categories without an evaluated rule have no score, and the overall score weighs the others. Security is scored apart."
)


def markdown(document: dict) -> str:
    """A site's report in Markdown; every value from a page is escaped."""
    s = document["scores"]
    lines = [f"# Audit of {md_safe(document['site']['site_id'])}", "", f"Overall: {s.get('overall', 'n/a')} ({md_safe(s.get('verdict'))}), security: {s.get('security', 'n/a')}, pages: {document['site']['page_count']}", ""]
    lines += [f"> {w}" for w in warnings(document)]
    lines += ["", "| category | score | rules evaluated | findings |", "|-|-|-|-|"]
    lines += [f"| {md_safe(c['category'])} | {c.get('score', 'n/a')} | {c['evaluated_rules']} | {c['findings']} |" for c in s.get("categories") or []]
    for bucket, label in LABELS.items():
        own = [a for a in document.get("actions") or [] if a["priority"] == bucket]
        if own:
            lines += ["", f"## {bucket}: {label}", ""]
            for a in own:
                lines.append(f"- {md_safe(a.get('message') or a['rule_id'])} ({md_safe(a['rule_id'])}, {a['severity']}, {a['count']} found, score {a['priority_score']})")
                lines += [f"  - To do: {md_safe(a['fix'])}"] if a.get("fix") else []
                lines += [f"  - {md_safe(u)}" for u in a.get("samples") or []]
    lines += ["", "## Pages with most findings", ""] + [f"- {md_safe(u)}: {n} severe, {t} in all" for u, n, t in _worst(document)]
    lines += ["", "## Site and run", ""] + [f"- {k}: {md_safe(v)}" for k, v in _facts(document)]
    lines += ["", "## Method", "", METHOD]
    return "\n".join(lines) + "\n"


def html_report(document: dict) -> str:
    """A self-contained page; every value from a page is escaped."""
    s = document["scores"]
    rows = "".join(f"<tr><td>{esc(c['category'])}</td><td>{esc(c.get('score', 'n/a'))}</td><td>{esc(c['evaluated_rules'])}</td><td>{esc(c['findings'])}</td></tr>" for c in s.get("categories") or [])
    acts = "".join(
        f"<li><b>{esc(a['priority'])}</b> {esc(a.get('message') or a['rule_id'])} <small>{esc(a['rule_id'])}, {esc(a['severity'])}, {esc(a['count'])} found</small><p>{esc(a.get('fix'))}</p><ul>{''.join(f'<li>{esc(u)}</li>' for u in a.get('samples') or [])}</ul></li>"
        for a in document.get("actions") or []
    )
    notes = "".join(f"<p class=note>{esc(w)}</p>" for w in warnings(document))
    worst = "".join(f"<li>{esc(u)}: {n} severe, {t} in all</li>" for u, n, t in _worst(document))
    facts = "".join(f"<tr><th>{esc(k)}</th><td>{esc(v)}</td></tr>" for k, v in _facts(document))
    title = f"Audit of {esc(document['site']['site_id'])}"
    return (
        f"<!doctype html><html lang=en><head><meta charset=utf-8><title>{title}</title><style>body{{font:16px sans-serif;max-width:60em;margin:auto}}td,th{{padding:.2em 1em;text-align:left}}.note{{background:#fec}}</style></head>"
        f"<body><h1>{title}</h1><p>Overall {esc(s.get('overall', 'n/a'))} ({esc(s.get('verdict'))})</p>{notes}<table><tr><th>category<th>score<th>rules evaluated<th>findings</tr>{rows}</table>"
        f"<h2>Actions</h2><ol>{acts}</ol><h2>Pages with most findings</h2><ul>{worst}</ul><h2>Site and run</h2><table>{facts}</table><h2>Method</h2><p>{esc(METHOD)}</p></body></html>"
    )


def top_pages(audit: Audit, most: int = 10) -> DataFrame:
    return worst_pages(audit.findings, most)
