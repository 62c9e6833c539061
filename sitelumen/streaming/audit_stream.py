"""The audit of a stream of captures, kept up to date: a later capture of a page takes back what the earlier one said.

Every page is a key (site and normalised URL) of a stateful operator, whose state is the number of its last capture and what
the rules said of it. A capture that is newer emits the difference: rows that take back the old verdicts (``delta`` -1) and
rows that give the new ones (+1); an older one emits nothing. Adding up the differences by site and rule gives at any time
what one batch audit of all captures so far gives, however they were split into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sitelumen.plans import audit as A
from sitelumen.plans.catalog import RULES, Rule
from sitelumen.sources.pages import Capabilities, raw_pages

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "site_id string, page string, rule_id string, applies boolean, fails boolean, measure double, capture bigint, delta int"


def page_rules(caps: Capabilities | None = None) -> list[Rule]:
    """The rules that a page alone can answer."""
    return [r for r in A.evaluated(RULES, caps or Capabilities()) if r.scope == "page" and not {"site", "net"} & set(r.needs) and "inlinks" not in r.measure]


def verdicts(captures: DataFrame, caps: Capabilities | None = None, seq: str = "page_id", min_words: int = 300) -> DataFrame:
    """``(site_id, page, capture, verdicts)`` of every capture, by expressions that work on a stream; captures that cannot be parsed have none."""
    rules = page_rules(caps)
    facts = A.derived(A.page_models(raw_pages(captures, seq), dedupe=False)).withColumns({"nurl": F.col("normalized_url"), "site_pages": F.lit(0), "has_status": F.lit(False)})
    said = F.filter(F.expr(A._verdicts(rules, min_words, {})), lambda v: v["applies"])
    kept = F.transform(said, lambda v: F.struct(v["rule_id"].alias("rule_id"), v["fails"].alias("fails"), v["measure"].alias("measure")))
    kept = F.when(F.col("parse_error").isNull(), kept).otherwise(F.array().cast("array<struct<rule_id:string,fails:boolean,measure:double>>"))
    return facts.select("site_id", F.col("normalized_url").alias("page"), F.col("ingest_seq").alias("capture"), F.to_json(kept).alias("verdicts"))


class LastCapture(StatefulProcessor):
    """Keeps a page's last capture and emits what a newer one changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "capture bigint, verdicts string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best: tuple[int, str] | None = None
        for part in rows:
            for capture, said in zip(part["capture"], part["verdicts"], strict=True):
                if best is None or (capture, said) > best:
                    best = (int(capture), said)
        old = tuple(self.last.get()) if self.last.exists() else None
        if best is None or (old is not None and best <= old):
            return
        self.last.update(best)
        if old is not None:
            yield _changes(key, old, -1)
        yield _changes(key, best, 1)

    def close(self) -> None:
        pass


def _changes(key: tuple[str, str], state: tuple[int, str], delta: int) -> pd.DataFrame:
    import json

    said = json.loads(state[1])
    rows = [(key[0], key[1], None, False, False, None, state[0], delta)]  # the page itself
    rows += [(key[0], key[1], v["rule_id"], True, bool(v["fails"]), v.get("measure"), state[0], delta) for v in said]
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CHANGE.split(", ")]).astype({"measure": "float64"})


def changes(captures: DataFrame, caps: Capabilities | None = None, seq: str = "page_id") -> DataFrame:
    """The stream of changes (columns of CHANGE) of a stream of captures."""
    captures.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return verdicts(captures, caps, seq).groupBy("site_id", "page").transformWithStateInPandas(LastCapture(), CHANGE, "Append", "None")


def write_changes(captures: DataFrame, target: str, checkpoint: str, caps: Capabilities | None = None, seq: str = "page_id") -> DataStreamWriter:
    """A writer that appends the changes to a Parquet table, each micro-batch exactly once."""
    return changes(captures, caps, seq).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")


def read_changes(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(CHANGE).parquet(target)


def current_findings(changed: DataFrame) -> DataFrame:
    """``(site_id, rule_id, page, measure)`` that stand after all changes."""
    rows = changed.where("fails").groupBy("site_id", "rule_id", "page", "measure", "capture").agg(F.sum("delta").alias("n"))
    return rows.where("n > 0").select("site_id", "rule_id", "page", "measure")


def current_applicability(changed: DataFrame) -> DataFrame:
    """``(site_id, rule_id, applicable, failed)`` that stand after all changes; a rule that applies nowhere is left out."""
    sums = changed.where("rule_id IS NOT NULL").groupBy("site_id", "rule_id").agg(F.sum("delta").alias("applicable"), F.sum(F.when(F.col("fails"), F.col("delta")).otherwise(0)).alias("failed"))
    return sums.where("applicable > 0")


def current_sites(changed: DataFrame) -> DataFrame:
    """``(site_id, pages)`` after all changes."""
    return changed.where("rule_id IS NULL").groupBy("site_id").agg(F.sum("delta").alias("pages"))
