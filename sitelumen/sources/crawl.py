"""Live crawl over a fetcher interface: a frontier loop whose every level is one distributed fetch."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelumen.functions import url as U
from sitelumen.session import cut
from sitelumen.sources import html_extract, robots, sitemap

# --- fixed values ---
CHALLENGE_MARKERS = (
    "cdn-cgi/challenge-platform", "just a moment", "checking your browser", "enable javascript and cookies to continue", "ddos protection by", "attention required! | cloudflare",
)
CHALLENGE_STATUS = (403, 429, 503)
# --- end of fixed values ---

AGENT = "AuditBot/0.1"
RESPONSE = "url string, status int, html string, headers map<string,string>, redirect_chain array<struct<url:string,status:int,to:string>>, final_url string, ttfb_ms bigint, error string, transfer_bytes bigint, challenge boolean, streak int"
FIELDS = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", RESPONSE)]
#: Challenge pages in a row that end a crawl.
STREAK = 3


@dataclass(frozen=True)
class CrawlConfig:
    max_pages: int = 150
    max_depth: int = 4
    delay_ms: int = 500
    timeout_ms: int = 15_000
    max_redirects: int = 5
    max_bytes: int = 5 * 1024 * 1024
    user_agent: str = AGENT
    respect_robots: bool = True
    check_external: bool = False
    probes: int = 500
    concurrency: int = 4
    sitemaps_a_level: int = sitemap.MOST_A_LEVEL
    sitemap_levels: int = sitemap.MOST_LEVELS


def classify_error(error: BaseException) -> str:
    """timeout, dns, tls, connection-refused or network."""
    text = f"{type(error).__name__} {error} {getattr(error, 'reason', '')}".lower()
    for kind, words in (("timeout", ("timed out", "timeout")), ("dns", ("name or service", "getaddrinfo", "nodename", "name resolution")), ("tls", ("ssl", "certificate", "tls")), ("connection-refused", ("refused",))):
        if any(w in text for w in words):
            return kind
    return "network"


def unpacked(body: bytes, most: int, encoding: str = "") -> bytes:
    """At most ``most`` bytes of the body, unpacked if it is gzip or is said to be deflate; a cut-off one as far as it can be read."""
    ways = [31] if body[:2] == b"\x1f\x8b" else [15, -15] if encoding.strip().lower() == "deflate" else []
    for way in ways:
        try:
            return zlib.decompressobj(way).decompress(body, most)
        except zlib.error:
            continue
    return body[:most]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def http_fetch(url: str, config: CrawlConfig, method: str = "GET") -> dict:
    """One request with its redirects followed by hand, so that the chain is known; the body is capped, as sent and as unpacked."""
    opener, chain, at, began = urllib.request.build_opener(_NoRedirect()), [], url, time.time()
    seen = {url}
    asked = {"User-Agent": config.user_agent, "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "tr,en;q=0.8", "Accept-Encoding": "gzip, deflate"}
    while True:
        try:
            answer = opener.open(urllib.request.Request(at, method=method, headers=asked), timeout=config.timeout_ms / 1000)
        except urllib.error.HTTPError as e:
            answer = e
        except Exception as e:  # any failure of the network is a row, not an end
            return {"url": url, "status": 0, "html": None, "headers": {}, "redirect_chain": chain, "final_url": at, "ttfb_ms": None, "error": classify_error(e), "transfer_bytes": 0}
        headers = {k.lower(): v for k, v in answer.headers.items()}
        to = U.parse(headers.get("location"), at) if answer.status in (301, 302, 303, 307, 308) and headers.get("location") else None
        if not to:
            sent = answer.read(config.max_bytes) if method == "GET" else b""
            body = unpacked(sent, config.max_bytes, headers.get("content-encoding", ""))
            return {"url": url, "status": answer.status, "html": body.decode("utf-8", "replace"), "headers": headers, "redirect_chain": chain, "final_url": at, "ttfb_ms": int((time.time() - began) * 1000), "error": None, "transfer_bytes": len(sent)}
        target = U.serialised(to)
        chain.append({"url": at, "status": answer.status, "to": target})
        if target in seen or len(chain) > config.max_redirects:
            return {"url": url, "status": 0, "html": None, "headers": headers, "redirect_chain": chain, "final_url": at, "ttfb_ms": None, "error": "redirect-loop" if target in seen else "too-many-redirects", "transfer_bytes": 0}
        seen.add(target)
        at = target


def challenged(answer: dict) -> bool:
    """Whether a response is a bot-protection page."""
    start = (answer["html"] or "")[:4000].lower()
    return bool((answer["headers"] or {}).get("cf-mitigated")) or (answer["status"] in CHALLENGE_STATUS and any(m in start for m in CHALLENGE_MARKERS))


def answers(urls: Iterable[str], fetch: Callable[[str], dict], config: CrawlConfig, streak: int = 0, state: tuple[dict, dict] | None = None) -> Iterator[dict]:
    """The responses of ``urls``, in order.

    Up to ``concurrency`` requests are under way at once, those of a host each begun ``delay_ms`` after the one before. After
    STREAK challenge pages in a row (``streak`` of them before) a host is asked for nothing more. ``state`` keeps the times
    and streaks of hosts from one call to the next.
    """
    last, streaks = ({}, {}) if state is None else state
    waiting: deque = deque()

    def finished() -> dict:
        name, answer = waiting.popleft()
        answer = dict(answer.result())
        answer["challenge"] = challenged(answer)
        answer["streak"] = streaks[name] = streaks.get(name, streak) + 1 if answer["challenge"] else 0
        return answer

    with ThreadPoolExecutor(max(1, config.concurrency)) as pool:
        for u in urls:
            name = U.host(u)
            while len(waiting) >= max(1, config.concurrency):
                yield finished()
            if streaks.get(name, streak) >= STREAK:
                continue
            wait = last.get(name, 0) + config.delay_ms / 1000 - time.time()
            if wait > 0:
                time.sleep(wait)
            last[name] = time.time()
            waiting.append((name, pool.submit(fetch, u)))
        while waiting:
            yield finished()


def fetched(urls: DataFrame, fetch: Callable[[str], dict], config: CrawlConfig, streak: int = 0, order: tuple[str, ...] = ("url",)) -> DataFrame:
    """Responses of ``urls(url)``; a host's URLs share a task, which asks for them in order (see ``answers``).

    A column ``before`` has the challenge pages in a row that a host has given until now.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple[dict, dict] = ({}, {})
        for part in batches:
            for url, before in zip(part["url"], part["before"], strict=True):
                state[1].setdefault(U.host(url), int(before))
            yield pd.DataFrame(list(answers(part["url"], fetch, config, streak, state)), columns=FIELDS)

    host = U.host_of("url")
    if "before" not in urls.columns:
        urls = urls.withColumn("before", F.lit(streak))
    return urls.repartition(host).sortWithinPartitions(*order).select("url", "before").mapInPandas(run, RESPONSE)


def robots_access(spark: SparkSession, rules: DataFrame, config: CrawlConfig) -> Callable[[DataFrame], DataFrame]:
    """A filter of ``url`` rows by the robots rules (site_id, raw) of their sites."""
    agents, lines = robots.robots_rules(rules)
    groups = robots.chosen_group(agents, spark.createDataFrame([(config.user_agent.split("/")[0],)], "token string"))

    def allowed(urls: DataFrame) -> DataFrame:
        if not config.respect_robots:
            return urls
        of = urls.select("url", U.registrable_domain("url").alias("site_id"), U.path_of("url").alias("path"))
        barred = robots.access(lines, groups, of.select("site_id", "path").distinct()).where("NOT allowed").select("site_id", "path")
        return urls.join(of.join(barred, ["site_id", "path"]).select("url").distinct(), "url", "left_anti")

    return allowed


def crawl(spark: SparkSession, start: str, config: CrawlConfig = CrawlConfig(), fetch: Callable[[str], dict] | None = None) -> dict[str, DataFrame | str]:
    """What ``crawl_sites`` gives for one start, with the crawl's ``status`` as text."""
    found = crawl_sites(spark, [start], config, fetch)
    return found | {"status": found["counters"].first()["status"]}


def crawl_sites(spark: SparkSession, starts: list[str] | DataFrame, config: CrawlConfig = CrawlConfig(), fetch: Callable[[str], dict] | None = None) -> dict[str, DataFrame]:
    """``raw`` pages, ``url_status``, ``robots``, ``sitemaps``, ``sitemap_entries``, ``llms_txt`` and ``counters`` of the sites of ``starts``.

    ``counters`` has a row a site, with its status (ok, partial, blocked or failed). A site's frontier is its start, then what
    its sitemaps list and its pages link to. Each depth is one fetch of all sites' distinct frontiers without the URLs seen
    before, every site within what is left of its ``max_pages``; hosts are fetched side by side, each at its own spacing.
    Frontier, seen URLs and what is known of sites are tables and never leave the cluster. STREAK challenge pages of a host
    in a row end its site's crawl as blocked, and no other's.
    """
    fetch = fetch or (lambda u: http_fetch(u, config))
    at_once = replace(config, delay_ms=0)
    if not isinstance(starts, DataFrame):
        starts = spark.createDataFrame([(u,) for u in starts], "url string")
    site_of = lambda c: U.registrable_domain(c).alias("site_id")
    starts = cut(starts.select(F.coalesce(U.normalize_url("url"), "url").alias("url"), F.regexp_extract("url", "^([^/]*//[^/?#]*)", 1).alias("origin"), site_of("url")))
    sites = starts.groupBy("site_id").agg(F.min("origin").alias("origin"))

    answered_ok, body = F.col("status").between(200, 299), F.coalesce("html", F.lit(""))
    is_text = answered_ok & ~body.rlike(r"(?i)^\s*<(!doctype|html)")  # a page served in place of robots.txt is none
    file = lambda name: sites.select(F.concat("origin", F.lit(name)).alias("url"))
    rules = cut(fetched(file("/robots.txt"), fetch, at_once).select(site_of("url"), F.when(is_text, F.col("html")).alias("raw")))
    allowed = robots_access(spark, rules, config)
    llms = cut(fetched(file("/llms.txt"), fetch, at_once).where(answered_ok).select(site_of("url"), body.alias("text")))

    def sitemap_bodies(urls: DataFrame) -> DataFrame:
        urls = cut(urls)
        got = cut(fetched(urls.select(F.col("sitemap_url").alias("url")).distinct(), fetch, config))
        return cut(urls.select("site_id", "sitemap_url").join(got.select(F.col("url").alias("sitemap_url"), F.when(answered_ok, F.col("html")).alias("xml")), "sitemap_url").select("site_id", "sitemap_url", "xml"))

    named = robots.robots_lines(rules).where("field = 'sitemap'").select("site_id", F.col("value").alias("sitemap_url")).distinct()
    usual = F.explode(F.array(*[F.concat("origin", F.lit(x)) for x in ("/sitemap.xml", "/sitemap_index.xml")])).alias("sitemap_url")
    named = cut(named.union(sites.join(named, "site_id", "left_anti").select("site_id", usual)))
    maps = cut(sitemap.collected(named, sitemap_bodies, config.sitemaps_a_level, config.sitemap_levels))
    entries = cut(sitemap.entries(maps.where("ok")).drop("sitemap_url"))
    listed = entries.select("site_id", U.normalize_url("loc").alias("url")).where(U.registrable_domain("url") == F.col("site_id")).distinct()

    frontier = cut(starts.select("site_id", "url", F.lit(0).alias("late")).distinct())
    seen, every, barred, order = None, None, None, Window.partitionBy("site_id").orderBy("late", "url")
    progress = cut(sites.select("site_id", F.lit(0).cast("bigint").alias("pages"), F.lit(False).alias("blocked")))
    streaks = None
    for depth in range(config.max_depth + 1):
        wanted = cut(frontier.where(~U.looks_non_html("url")))
        may = cut(allowed(wanted))
        lost = wanted.join(may.select("site_id", "url"), ["site_id", "url"], "left_anti").groupBy("site_id").agg(F.count("*").alias("skipped"))
        barred = lost if barred is None else barred.union(lost)
        seen = wanted.select("url") if seen is None else cut(seen.union(wanted.select("url")))
        room = progress.where("NOT blocked").select("site_id", (F.lit(config.max_pages) - F.col("pages")).alias("room"))
        asked = may.join(room, "site_id").withColumn("rank", F.row_number().over(order)).where("rank <= room").select("url", "late")
        host = U.host_of("url").alias("host")
        asked = asked.withColumn("before", F.lit(0)) if streaks is None else asked.select("*", host).join(streaks, "host", "left").select("url", "late", F.coalesce("before", F.lit(0)).alias("before"))
        got = cut(fetched(asked, fetch, config, order=("late", "url")).withColumn("depth", F.lit(depth)).withColumn("site_id", site_of("url")))
        every = got if every is None else every.unionByName(got)
        # A host whose responses of this depth are all challenges goes on with its run; another begins anew.
        run = got.groupBy(host).agg(F.max("streak").alias("longest"), F.count("*").alias("n"), F.count_if("challenge").alias("hit"))
        streaks = cut(run.select("host", F.when(F.col("n") == F.col("hit"), F.col("longest")).otherwise(0).alias("before")))
        facts = got.groupBy("site_id").agg(F.count_if(_is_page()).alias("more"), (F.max("streak") >= STREAK).alias("ended"))
        progress = cut(progress.join(facts, "site_id", "left").select("site_id", (F.col("pages") + F.coalesce("more", F.lit(0))).alias("pages"), (F.col("blocked") | F.coalesce("ended", F.lit(False))).alias("blocked")))
        if depth == config.max_depth:
            break
        models = html_extract.parsed_pages(got.where(_is_page()), ["site_id", "url"])
        links = models.select("site_id", F.explode("model.links").alias("l")).where("l.internal").select("site_id", F.col("l.normalized").alias("url"), F.lit(1).alias("late"))
        if depth == 0:
            links = listed.withColumn("late", F.lit(0)).union(links)
        going = progress.where((~F.col("blocked")) & (F.col("pages") < config.max_pages)).select("site_id")
        links = links.where("url IS NOT NULL").join(going, "site_id", "left_semi")
        frontier = cut(links.groupBy("site_id", "url").agg(F.min("late").alias("late")).join(seen, "url", "left_anti").select("site_id", "url", "late"))
        if frontier.isEmpty():
            break
    raw = every.where(_is_page()).withColumns({"source": F.lit("live"), "ingest_seq": F.col("depth") * (1 << 40) + F.pmod(F.xxhash64("url"), F.lit(1 << 40))}).drop("challenge", "streak")
    statuses = every.select("site_id", U.normalize_url("url").alias("url"), "status", F.size("redirect_chain").alias("redirects"), "error")
    failures = F.collect_list(F.when(F.col("error").isNotNull(), F.struct("url", F.col("error").alias("kind"))))
    counted = every.groupBy("site_id").agg(
        F.count("*").alias("requested"),
        F.count_if(F.expr("status > 0")).alias("answered"),
        F.count_if(_is_page()).alias("fetched"),
        F.count_if(~answered_ok | F.col("challenge")).alias("failed"),
        F.slice(failures, 1, 100).alias("errors"),  # a site is asked for max_pages URLs at most
    )
    skipped = barred.groupBy("site_id").agg(F.sum("skipped").alias("skipped_by_robots"))
    none = F.coalesce("answered", F.lit(0)) == 0
    status = F.when(F.col("blocked"), "blocked").when(none, "failed").when((F.col("requested") - F.col("answered")) / F.col("requested") > 0.2, "partial").otherwise("ok")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    counters = progress.join(counted, "site_id", "left").join(skipped, "site_id", "left").select(
        "site_id", status.alias("status"), *[zero(c) for c in ("requested", "fetched", "failed", "skipped_by_robots")], F.coalesce("errors", F.array().cast("array<struct<url:string,kind:string>>")).alias("errors")
    )
    return {
        "raw": raw, "url_status": statuses, "robots": rules.where("raw IS NOT NULL"), "llms_txt": llms, "counters": cut(counters),
        "sitemaps": maps.select("site_id", F.col("sitemap_url").alias("url"), "ok"), "sitemap_entries": entries,
    }


def _is_page() -> F.Column:
    """Whether a response is a page to audit: it succeeded, has a body, is HTML and no challenge."""
    html = F.coalesce(F.col("headers")["content-type"], F.lit("")).rlike("(?i)text/html|application/xhtml")
    return F.col("status").between(200, 299) & (F.coalesce("html", F.lit("")) != "") & html & ~F.col("challenge")


def probe(pages: DataFrame, url_status: DataFrame, config: CrawlConfig = CrawlConfig(), fetch: Callable[[str], dict] | None = None, robots_txt: DataFrame | None = None) -> DataFrame:
    """``url_status`` with the URLs that pages refer to; asked by HEAD, and by GET where a server does not know it.

    ``robots_txt`` (site_id, raw) keeps the probes off what it bars.
    """

    def head(url: str) -> dict:
        answer = http_fetch(url, config, "HEAD")
        return http_fetch(url, config) if answer["status"] in (405, 501) else answer

    targets = probe_targets(pages, url_status, config)
    if robots_txt is not None:
        targets = robots_access(pages.sparkSession, robots_txt, config)(targets)
    targets = cut(targets.orderBy("url").limit(config.probes))
    got = cut(fetched(targets.select("url").distinct(), fetch or head, config))
    asked = got.select(F.col("url").alias("target"), "status", F.size("redirect_chain").alias("redirects"), "error")
    return url_status.unionByName(targets.join(asked, targets["url"] == asked["target"]).select("site_id", "url", "status", "redirects", "error"))


def probe_targets(pages: DataFrame, url_status: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """``(site_id, url)``: distinct URLs that a site's pages refer to and whose status is unknown: canonicals, alternates, internal links."""
    wanted = pages.select("site_id", F.col("canonical_norm").alias("url")).union(pages.select("site_id", F.explode("hreflang.normalized")))
    kept = (lambda x: x["internal"]) if not config.check_external else (lambda x: F.lit(True))
    wanted = wanted.union(pages.select("site_id", F.explode(F.transform(F.filter("links", kept), lambda x: x["normalized"]))))
    return wanted.where("url IS NOT NULL").distinct().join(url_status.select("site_id", "url"), ["site_id", "url"], "left_anti")
