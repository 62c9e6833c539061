"""Captured pages as a stream: page-scope rules are stateless and run as they are on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sitelumen.plans import audit as A
from sitelumen.plans.catalog import RULES
from sitelumen.sources.pages import Capabilities, raw_pages


def read_pages(spark: SparkSession, folder: str, schema: str = "page_id bigint, url string, html string") -> DataFrame:
    """A stream of Parquet files with captured pages."""
    return spark.readStream.schema(schema).parquet(folder)


def page_findings(batch: DataFrame, caps: Capabilities | None = None, seq: str = "page_id") -> DataFrame:
    """``(site_id, rule_id, page, measure)`` of a batch by the page-scope rules that need nothing but the page."""
    alone = [r for r in A.evaluated(RULES, caps or Capabilities()) if r.scope == "page" and "site" not in r.needs and "net" not in r.needs]
    facts = A.derived(A.page_models(raw_pages(batch, seq)))
    facts = facts.withColumns({"nurl": F.col("normalized_url"), "site_pages": F.lit(0), "has_status": F.lit(False)})
    sites = facts.select("site_id").limit(0).withColumn("pages", F.lit(0))
    findings, _, _ = A.evaluate(facts, sites, alone)
    return findings.select("site_id", "rule_id", "page", "measure")


def write_findings(pages: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each micro-batch's findings to Parquet; a replayed batch overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        page_findings(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
