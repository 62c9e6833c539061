"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.session import cut, ensure_checkpoint_dir

__all__ = ["bit_map", "cut", "cut_few", "ensure_checkpoint_dir", "fresh", "gram_hashes", "hex64", "in_map", "kept", "let_go", "mixed", "pieces_of", "remove", "shuffle_partitions", "stored", "table", "text_bytes"]

#: Bytes of text that a Python worker takes apart at once, unless one text alone is longer.
PIECE_BYTES = 2 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Parts for each core in which ``cut_few`` keeps a table at most, and rows of a part where their number is known.
PARTS_A_CORE, PART_ROWS = 4, 100_000


def cut_few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``cut`` in a few parts for each core, however many partitions the rows come in; in one a core where ``rows`` are few.

    Each part is a file to create and a task of the next step; on a local disk each file also starts processes that set its
    mode, for a moment as large as the one that starts them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = PARTS_A_CORE * cores
    return cut(df.coalesce(parts if rows is None else min(parts, max(cores, -(-rows // PART_ROWS)))))


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps over its tasks under a name; there is one at a time, and ``let_go`` frees it."""
    if name not in _kept:
        let_go()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """Free what the worker has kept for other work: Spark gives a worker to one stage after another, and caches would add up."""
    _kept.clear()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared checkpoint folder: smaller than ``cut`` leaves them, and read by column."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` or the pipeline has written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def pieces_of(batches: Iterator[pa.RecordBatch], at: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts (column ``at``) have at most so many bytes, or are one row; this bounds a worker's memory."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
        if not len(ends):
            yield batch


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def hex64(column: Column) -> Column:
    """16 lower-case hex digits of a 64-bit number."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


#: Words whose hashes a worker remembers.
WORDS = 500_000


class _Words(dict):
    """Hashes of the words that a worker has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _Words()


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, of the words' hashes; none where there are fewer."""
    if not 0 < n <= len(hashes):
        return np.empty(0, np.uint64)
    grams = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        grams += hashes[i : len(hashes) - n + 1 + i] * np.uint64((i + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1 | 1)
    return mixed(grams, 100)


def bit_map(numbers: DataFrame, column: str, bits: int) -> np.ndarray:
    """``bits`` bits, those set that a number of the column (not negative) falls on; that many reach the driver at most."""
    place = (F.lit(1) + F.pmod(F.col(column), F.lit(bits))).cast("long")
    parts = numbers.groupBy(F.call_function("bitmap_bucket_number", place).alias("part")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", place)).alias("bits"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in parts.collect():
        out[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def in_map(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each of the (signed) numbers falls on a bit that is set."""
    at = numbers % (len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
