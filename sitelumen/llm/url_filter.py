"""URL filtering with pattern rules indexed by their rarest literal token, with DataFrame functions only.

A pattern is ``||host/path``: it fits the host and all its subdomains where the path starts with the given one; ``*``
stands for anything, ``^`` for a character that is no letter or digit or for the end. A pattern without ``||`` fits
anywhere in host and path, one that begins with ``|`` only at their beginning, one that ends with ``|`` only at their end.
``listed_rules`` reads such patterns from the lines of a public filter list, with its exceptions. Each pattern becomes one regular expression, and its index key is, of the tokens (runs of
letters and digits) that it can only match whole, the one that the fewest URLs have. A URL's tokens fetch the rules of
those keys, and only their regular expressions run. Rules without a whole token are filed under the empty token, which
every URL has. Of the rules that fit, given ones win over the method's own, exceptions over others, and then the longest
pattern.

Defined results: a null URL or one without ``://`` has an empty host and path and gets the default verdict unless a
rule fits the empty address; equal URLs are judged once and each row gets its verdict, so a hot URL costs one; an empty
rule table allows everything; URLs of any length are matched whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.llm.common import table

#: The contract's rules (pattern, action, name), which win over the method's own.
RULES = (
    ("||org/", "allow"),
    ("||example.org/es/", "block"),
    ("||example.org/en/1", "block"),
    ("||com/fr/", "allow"),
    ("||com/de/", "block"),
)
#: The method's own patterns.
OWN_PATTERNS = (
    ("^adult^", "block"),
    ("^casino^", "block"),
    ("^porn^", "block"),
    ("^xxx^", "block"),
    ("^spam^", "block"),
    ("^warez^", "block"),
    ("^phishing^", "block"),
    ("^malware^", "block"),
    ("^torrent^", "block"),
)
TOKEN = "[a-z0-9]+"


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules, own: bool) -> DataFrame:
    rows = ", ".join(f"('{p}', '{a}', {str(own).lower()}, false)" for p, a in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(pattern, action, own, exception)" if rows else "SELECT '' pattern, '' action, false own, false exception WHERE false")


def listed_rules(lines: DataFrame, own: bool = True) -> DataFrame:
    """Rules of the lines ``value`` of a public filter list, one a line.

    ``@@`` before a pattern makes it an exception, which allows. Comments, headers and rules on parts of pages are no rules
    on URLs, and a rule with options is one only if they name whole pages (``document``, ``popup``, ``all``); scheme and
    repeated rules count for nothing.
    """
    text = F.trim(F.regexp_replace("value", r"[\r\n\t]", " "))
    rows = lines.select(text.alias("text")).where((F.col("text") != "") & ~F.col("text").rlike(r"^[!\[]|#[@?$%]*#"))
    exception = F.col("text").startswith("@@")
    plain = F.when(exception, F.substr("text", F.lit(3))).otherwise(F.col("text"))
    options = F.regexp_extract(plain, r"\$([A-Za-z0-9_~,=|.*-]+)$", 1)
    pattern = F.regexp_replace(F.regexp_replace(plain, r"\$[A-Za-z0-9_~,=|.*-]+$", ""), r"^\|https?://", "|")
    rows = rows.select(pattern.alias("pattern"), F.when(exception, F.lit("allow")).otherwise(F.lit("block")).alias("action"), F.lit(own).alias("own"), exception.alias("exception"), options.alias("options"))
    whole = (F.col("options") == "") | F.arrays_overlap(F.split("options", ","), F.array(*[F.lit(x) for x in ("document", "popup", "all")]))
    return rows.where(whole & ~F.col("pattern").rlike(r"^[*|^]*$")).drop("options").distinct()


def compiled(rules: DataFrame) -> DataFrame:
    """``(pattern, action, own, exception, regex, tokens)``; tokens are those the pattern can only match whole."""
    if "exception" not in rules.columns:
        rules = rules.withColumn("exception", F.lit(False))
    anchored = F.col("pattern").startswith("||")
    first, last = F.col("pattern").startswith("|") & ~anchored, F.col("pattern").endswith("|")
    body = F.when(anchored, F.substr("pattern", F.lit(3))).when(first, F.substr("pattern", F.lit(2))).otherwise(F.col("pattern"))
    body = F.when(last, F.regexp_replace(body, r"\|$", "")).otherwise(body)
    quoted = F.regexp_replace(body, r"([\\.+?$(){}\[\]|])", r"\\$1")
    regex = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^A-Za-z0-9]|$|^)"))
    regex = F.concat(F.when(anchored, F.lit(r"(?s)^(?:[^/]*\.)?")).when(first, F.lit("(?s)^")).otherwise(F.lit("(?s)")), regex, F.when(last, F.lit(r"\z")).otherwise(F.lit("")))
    # A token is whole if a literal that is no letter or digit, ``^`` or the anchor bounds it on both sides.
    bounded = F.concat(F.when(anchored | first, F.lit("/")).otherwise(F.lit("*")), F.lower(body), F.when(last, F.lit("/")).otherwise(F.lit("*")))
    tokens = F.regexp_extract_all(bounded, F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), 1)
    return rules.select("pattern", "action", "own", "exception", regex.alias("regex"), F.array_distinct(tokens).alias("tokens"))


def indexed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(token, pattern, action, own, exception, regex)``: each rule under its rarest token among all URLs' ``token`` rows."""
    made = compiled(rules)
    own = made.select("pattern", "own", F.explode("tokens").alias("token"))
    seen = tokens.join(own.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    best = own.join(seen, "token", "left").groupBy("pattern", "own").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    filed = made.join(best, ["pattern", "own"], "left")
    return filed.select(F.coalesce("best.token", F.lit("")).alias("token"), "pattern", "action", "own", "exception", "regex")


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, host, path, rule, verdict)`` of every distinct URL; rule is the longest pattern that fits of those not ``own``."""
    urls = pages.select("url").distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    address = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(F.lower(address), F.lit(f"({TOKEN})"), 1), F.array(F.lit(""))))
    words = urls.select("url", address.alias("address"), F.explode(tokens).alias("token"))
    fits = words.join(indexed(rules, words.select("token")), "token").where(F.expr("address rlike regex"))
    rank = F.struct((~F.col("own")).alias("first"), "exception", F.length("pattern").alias("length"), "pattern", "action")
    best = fits.groupBy("url").agg(F.max(rank).alias("best"))
    rule = F.when(F.col("best.first"), F.regexp_replace("best.pattern", r"^\|\|", ""))
    both = urls.join(best.withColumnRenamed("url", "found"), F.col("url").eqNullSafe(F.col("found")), "left")
    return both.select("url", "host", "path", rule.alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row."""
    verdicts = judged(pages, rules).withColumnRenamed("url", "judged_url")
    rows = pages.select("page_id", "url")
    return rows.join(verdicts, rows["url"].eqNullSafe(verdicts["judged_url"])).select("page_id", "host", "path", "rule", "verdict")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL by the given rules, and by the method's own patterns where none of them fits."""
    rules = rules_frame(spark, RULES, False).union(rules_frame(spark, OWN_PATTERNS, True))
    return filter_urls(table(spark, sf_dir, "pages"), rules)


_OWN_WORDS = "|".join(p.strip("^") for p, _ in OWN_PATTERNS)
ORACLE = rf"""
WITH a AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rule, rule_host, rule_path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), m AS (
  SELECT a.page_id, a.host, a.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY a.page_id ORDER BY length(r.rule) DESC) AS n
  FROM a LEFT JOIN r ON (a.host = r.rule_host OR ends_with(a.host, '.' || r.rule_host)) AND starts_with(a.path, r.rule_path)
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])({_OWN_WORDS})([^A-Za-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE n = 1
"""
