"""Sharding by extendible hashing, with DataFrame functions only.

Rows are hashed by doc_id and text; a shard is a prefix of the hash's bits. The directory starts with one bucket of no
bits, and only buckets over the byte limit split on another bit, until each fits. To do this without a pass for each
bit, bytes are summed once by a prefix of ``bits`` bits (some hundred cells to a shard, so the directory grows with the
shards, not with the rows), and the sums of all shorter prefixes are rolled up from the cells.

What no bit can split is defined: a cell still over the limit at ``bits`` is split by whole hashes (a repeated row, or
a text near the limit), each hash's rows taking numbered pages of as many rows as fit; a row over the limit is alone.

Defined results: null and empty texts weigh ROW_BYTES; repeated rows have one hash and, as long as they fit, one shard;
null doc_ids are hashed like any value; an empty table has no shards; extra columns, whatever their names, are kept by
``assign_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelumen.llm.common import cut, table

#: Bytes of a shard, and what a row weighs besides its text.
LIMIT_BYTES, ROW_BYTES = 16 * 1024 * 1024, 64
#: Cells a shard is counted in, as bits beyond the prefix a shard has on average.
SPARE_BITS, MOST_BITS = 8, 40
#: Digits of the hash that are used: 60 bits.
DIGITS = 15


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over doc_id and text, as a non-negative number."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def directory(cells: DataFrame, bits: int, limit: int) -> DataFrame:
    """``(cell, depth, shard, shard_bytes)`` of every cell: the shortest prefix whose bytes fit, or all bits."""
    rolled = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    level = F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("depth"))
    sums = rolled.groupBy("depth", level.alias("shard")).agg(F.sum("bytes").alias("shard_bytes"))
    # A bucket is a shard if it fits (or has all bits) and the bucket it was split from did not fit.
    parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"), F.col("shard_bytes").alias("parent_bytes"))
    shards = sums.withColumn("parent", F.call_function("shiftright", F.col("shard"), F.lit(1))).join(parents, ["depth", "parent"], "left")
    fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == bits)
    shards = shards.where(fits & (F.col("parent_bytes").isNull() | (F.col("parent_bytes") > limit))).select("depth", "shard", "shard_bytes")
    named = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("shard", level)
    return named.join(shards, ["depth", "shard"]).select("cell", "depth", "shard", "shard_bytes")


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``(row, depth, shard, page, bytes)``: all columns of docs as a struct, and each row's shard.

    A shard is one value of (depth, shard, page); shard is the prefix as a number, page is 0 but in cells that no bit
    can split.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash(F.col("doc_id"), F.col("text")).alias("hash"), row_bytes(F.col("text")).alias("bytes"))
    # Hashes and weights are made once and read again for the total, the cells and the pages.
    weighed = cut(rows.select("hash", "bytes"))
    total = weighed.agg(F.sum("bytes")).first()[0] or 0
    bits = min(MOST_BITS, max(1, (total // limit).bit_length()) + SPARE_BITS)
    cell = F.shiftright("hash", 4 * DIGITS - bits)
    own = cut(directory(cut(weighed.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"))), bits, limit))
    placed = rows.withColumn("cell", cell).join(own, "cell")
    fit = placed.where(F.col("shard_bytes") <= limit).select("row", "depth", "shard", F.lit(0).cast("long").alias("page"), "bytes")
    if own.where(F.col("shard_bytes") > limit).isEmpty():
        return fit
    over = placed.where(F.col("shard_bytes") > limit).select("row", "hash", "bytes")
    return fit.unionByName(_pages(over, limit))


#: Rows of a hash that are numbered in one task on average.
PAGED_ROWS = 100_000


def _pages(over: DataFrame, limit: int) -> DataFrame:
    """Rows of cells that no bit splits, by whole hashes and pages of a hash.

    Rows of a hash are numbered within salts and the salts' counts are added up, so a row repeated without end is never
    numbered in one task. The rows are written once, as the salt of equal rows is drawn at random.
    """
    counts = over.groupBy("hash").agg(F.count("*").alias("n"))
    salt = F.floor(F.rand(7) * F.ceil(F.col("n") / PAGED_ROWS)).cast("long")
    over = cut(over.hint("merge").join(counts, "hash").select("row", "hash", "bytes", salt.alias("salt")))
    order = Window.partitionBy("hash", "salt").orderBy("bytes")
    before = Window.partitionBy("hash").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = over.groupBy("hash", "salt").agg(F.count("*").alias("n"))
    counts = counts.select("hash", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = over.withColumn("place", F.row_number().over(order) - 1).join(counts, ["hash", "salt"])
    page = F.floor((F.col("before") + F.col("place")) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes"))))
    return ranked.select("row", F.lit(4 * DIGITS).alias("depth"), F.col("hash").alias("shard"), page.cast("long").alias("page"), "bytes")


def op6_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document under a limit of 16 MiB."""
    placed = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("row.doc_id", F.col("depth").cast("int").alias("depth"), "shard", "page", F.col("bytes").alias("row_bytes"))


def oracle(limit: int) -> str:
    """SQL of the same; cells of 20 bits are finer than any shard of what DuckDB holds gets, if no row repeats past the limit."""
    return f"""
WITH rows AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {DIGITS}))::BIGINT AS h,
         (coalesce(octet_length(encode(text)), 0) + {ROW_BYTES})::BIGINT AS row_bytes
  FROM documents
), levels AS (
  SELECT d::INTEGER AS depth, h >> (60 - d) AS shard, sum(row_bytes)::BIGINT AS bytes
  FROM rows, generate_series(0, 20) AS g(d) GROUP BY ALL
)
SELECT r.doc_id, l.depth, l.shard, 0::BIGINT AS page, r.row_bytes
FROM rows r JOIN levels l ON l.shard = r.h >> (60 - l.depth)
LEFT JOIN levels p ON p.depth = l.depth - 1 AND p.shard = l.shard >> 1
WHERE l.bytes <= {limit} AND (p.bytes IS NULL OR p.bytes > {limit})
"""


ORACLE = oracle(LIMIT_BYTES)
