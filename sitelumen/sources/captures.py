"""Stored and live responses: a data source that reads either, and the status of crawls from the responses they left.

``spark.read.format("page_responses")`` gives the columns of ``crawl.fetched``. With the option ``urls``, a Parquet table of
addresses, they are asked for over HTTP, the hosts dealt out to ``partitions`` tasks, so that one task keeps one host's
spacing; the options ``delay_ms``, ``timeout_ms``, ``max_bytes``, ``max_redirects``, ``concurrency`` and ``user_agent`` are those of
``crawl.CrawlConfig``. With the option ``captures``, a folder of JSON lines with the same names, stored responses are read,
each file by a task of its own; a line that is no JSON object with an address is left out. Paths may be local or of a store
that PyArrow reads; elsewhere ``crawl.fetched`` takes any DataFrame of addresses.

``crawl_status`` finds blocked sites in responses as the live crawl does while it runs: runs of challenge responses by host,
in the order of requests. Runs are summed up in chunks first, so a host of any number of requests is no hot key.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sitelumen.functions import url as U
from sitelumen.sources import crawl as C

#: Requests of a host whose runs are summed up in one group.
CHUNK = 100_000
#: Rows of a batch that a reader sends on.
ROWS = 256
#: Share of unanswered requests beyond which a crawl is partial.
PARTIAL = 0.2

_ARROW = pa.schema(
    [
        ("url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
        ("redirect_chain", pa.list_(pa.struct([("url", pa.string()), ("status", pa.int32()), ("to", pa.string())]))), ("final_url", pa.string()),
        ("ttfb_ms", pa.int64()), ("error", pa.string()), ("transfer_bytes", pa.int64()), ("challenge", pa.bool_()), ("streak", pa.int32()),
    ]
)


@dataclass
class Share(InputPartition):
    """The hosts whose hash leaves ``number`` of ``of``, or one file of captures."""

    number: int
    of: int
    file: str = ""


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ResponseReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        if ("urls" in self.options) == ("captures" in self.options):
            raise ValueError("give the option urls or the option captures")

    def config(self) -> C.CrawlConfig:
        given = {k.lower(): v for k, v in self.options.items()}
        return C.CrawlConfig(**{f.name: type(f.default)(given[f.name]) for f in fields(C.CrawlConfig) if f.name in given and isinstance(f.default, (int, str)) and not isinstance(f.default, bool)})

    def partitions(self) -> list[InputPartition]:
        if "urls" in self.options:
            n = max(1, int(self.options.get("partitions", 8)))
            return [Share(i, n) for i in range(n)]
        store, path = _store(self.options["captures"])
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in files if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Share(i, len(names), name) for i, name in enumerate(names)] or [Share(0, 1)]

    def _asked(self, share: Share) -> Iterator[str]:
        """The addresses of the share's hosts, each once, in order by host."""
        store, path = _store(self.options["urls"])
        table = ds.dataset(path, filesystem=store, format="parquet")
        own: set[str] = set()
        for batch in table.to_batches(columns=["url"]):
            own.update(u for u in batch.column(0).to_pylist() if u and zlib.crc32((U.host(u) or "").encode()) % share.of == share.number)
        return iter(sorted(own, key=lambda u: (U.host(u) or "", u)))

    def _stored(self, share: Share) -> Iterator[dict]:
        if not share.file:
            return
        store, _ = _store(self.options["captures"])
        streaks: dict[str | None, int] = {}
        with store.open_input_stream(share.file) as lines:
            rest = b""
            while True:
                block = lines.read(1 << 20)
                *whole, rest = (rest + block).split(b"\n")
                for line in [*whole, rest] if not block else whole:
                    answer = _answer(line)
                    if answer is not None:
                        name = U.host(answer["url"])
                        answer["challenge"] = C.challenged(answer)
                        answer["streak"] = streaks[name] = streaks.get(name, 0) + 1 if answer["challenge"] else 0
                        yield answer
                if not block:
                    return

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        config, rows = self.config(), []
        found = self._stored(partition) if partition.file or "captures" in self.options else C.answers(self._asked(partition), lambda u: C.http_fetch(u, config), config)
        for answer in found:
            rows.append(answer)
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _answer(line: bytes) -> dict | None:
    """A response of a line of JSON, with what it leaves out; header names in lower case, the last value of a name counts."""
    try:
        given = json.loads(line)
    except ValueError:
        return None
    if not isinstance(given, dict) or not isinstance(given.get("url"), str):
        return None
    headers = {str(k).lower(): str(v) for k, v in (given.get("headers") or {}).items()}
    html = given.get("html")
    return {
        "url": given["url"], "status": int(given.get("status") or 0), "html": html, "headers": headers, "redirect_chain": given.get("redirect_chain") or [], "final_url": given.get("final_url") or given["url"],
        "ttfb_ms": given.get("ttfb_ms"), "error": given.get("error"), "transfer_bytes": given.get("transfer_bytes", len((html or "").encode("utf-8", "replace"))),
    }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    columns = [[list((r[f.name] or {}).items()) if f.name == "headers" else r[f.name] for r in rows] for f in _ARROW]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_responses"

    def schema(self) -> str:
        return C.RESPONSE

    def reader(self, schema) -> ResponseReader:
        return ResponseReader(self.options)


def read_responses(spark: SparkSession, **options) -> DataFrame:
    """The data source's rows (see the module's docstring for its options)."""
    spark.dataSource.register(Responses)
    return spark.read.format("page_responses").options(**{k: str(v) for k, v in options.items()}).load()


def challenge(status: Column, headers: Column, html: Column) -> Column:
    """Whether a response is a bot-protection page, as ``crawl.challenged`` has it."""
    start = F.lower(F.left(F.coalesce(html, F.lit("")), F.lit(4000)))
    marked = F.lit(False)
    for m in C.CHALLENGE_MARKERS:
        marked = marked | F.contains(start, F.lit(m))
    return (F.coalesce(headers["cf-mitigated"], F.lit("")) != "") | (F.coalesce(status, F.lit(0)).isin(*C.CHALLENGE_STATUS) & marked)


def longest_streaks(requests: DataFrame) -> DataFrame:
    """``(site_id, host, streak)``: the longest run of true ``hit`` of ``requests(site_id, host, ord, hit)`` in order.

    Each chunk of requests is reduced to its length, the runs at its ends and its longest run; runs that go on across chunks
    are put together from these.
    """
    host = ["site_id", "host"]
    own = requests.select(*host, "ord", "hit", F.floor(F.col("ord") / CHUNK).alias("chunk"))
    order = Window.partitionBy(*host, "chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = own.withColumn("run", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(order)).groupBy(*host, "chunk", "run").agg(F.count_if("hit").alias("n"))
    first = F.coalesce(F.max(F.when(F.col("run") == 0, F.col("n"))), F.lit(0))
    chunks = runs.groupBy(*host, "chunk").agg(first.alias("head"), F.max_by("n", "run").alias("tail"), F.max("n").alias("best"), (F.max("run") == 0).alias("whole"))
    along = Window.partitionBy(*host).orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = chunks.withColumn("part", F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(along))
    # A part is a chunk with a break and the unbroken ones after it: its last run goes on into the next part's first.
    parts = chunks.groupBy(*host, "part").agg(F.sum(F.when(F.col("whole"), F.col("head")).otherwise(F.col("tail"))).alias("open"), F.max(F.when(~F.col("whole"), F.col("head"))).alias("head"), F.max("best").alias("best"))
    after = F.coalesce(F.lead("head").over(Window.partitionBy(*host).orderBy("part")), F.lit(0))
    return parts.withColumn("across", F.col("open") + after).groupBy(*host).agg(F.max(F.greatest("best", "across")).alias("streak"))


def crawl_status(responses: DataFrame, streak: int = C.STREAK, partial: float = PARTIAL) -> DataFrame:
    """``(site_id, requested, answered, challenged, streak, status)`` of ``responses(site_id, url, ord, status, headers, html)``.

    ``blocked`` where a host has ``streak`` challenge responses in a row, ``failed`` where nothing answered, ``partial`` where
    more than that share did not, else ``ok``.
    """
    hit = F.coalesce(challenge(F.col("status"), F.col("headers"), F.col("html")), F.lit(False))
    rows = responses.select("site_id", F.coalesce(U.host_of("url"), F.lit("")).alias("host"), "ord", hit.alias("hit"), (F.coalesce("status", F.lit(0)) > 0).alias("answered"))
    counts = rows.groupBy("site_id").agg(F.count("*").alias("requested"), F.count_if("answered").alias("answered"), F.count_if("hit").alias("challenged"))
    longest = longest_streaks(rows).groupBy("site_id").agg(F.max("streak").alias("streak"))
    lost = (F.col("requested") - F.col("answered")) / F.col("requested")
    status = F.when(F.col("streak") >= streak, F.lit("blocked")).when(F.col("answered") == 0, F.lit("failed")).when(lost > partial, F.lit("partial")).otherwise(F.lit("ok"))
    return counts.join(longest, "site_id").withColumn("status", status)
