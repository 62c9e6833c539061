"""SpotSigs document fingerprints.

Wherever a common word (an anchor) stands, the next two content words after it, each SPOT_DISTANCE content words apart,
form a chain: anchor, word, word. The beginning of a text is an anchor too, and so is a content word with DESERT other
content words before it since the last anchor, so that lists, menus and texts in languages without anchors have chains
as well, and the same ones wherever an edit leaves the words around them alone. The chains of a text are its
signatures, a set of 64-bit hashes; texts of too few content words for one
get their whole word sequence as the only signature, so that no text is without. Likeness is the Jaccard similarity of
two sets, skipped where their lengths alone rule it out.

Defined results: null and empty texts share one signature; texts of any length are used whole; equal texts have equal
fingerprints; rows are ordered by doc_id (nulls first) and then by text, so repeated rows are each other's neighbours;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelumen.llm.common import cut, pieces_of, shuffle_partitions, table, text_bytes

#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "aber als am an auch auf aus bei das dem den der des die durch ein eine einer er es für im in ist mit nicht sich sie sind und von war wie zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas plus pour que qui sa se son sur un une "
    "al como con de del el en es esta la las lo los más no para pero por que se si sin su un una y".split()
)
ANCHOR_BYTES = frozenset(w.encode() for w in ANCHORS)
CHAIN, SPOT_DISTANCE = 2, 1
#: Content words without an anchor among them after which content words are anchors themselves.
DESERT = 6
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def signatures(text: bytes, chain: int = CHAIN, distance: int = SPOT_DISTANCE) -> np.ndarray:
    """Sorted distinct hashes of the text's chains."""
    words = [b"", *text.translate(TABLE).split()]  # the beginning is an anchor
    anchors = ANCHOR_BYTES
    common = np.fromiter((not w or w in anchors for w in words), bool, len(words))
    content = [w for w, a in zip(words, common.tolist(), strict=True) if not a]
    # Content words after place i begin at content[after[i]].
    after = np.cumsum(~common)
    since = after - np.maximum.accumulate(np.where(common, after, 0))
    places = np.flatnonzero(common | (since > DESERT)).tolist()
    reach = chain * distance
    most = len(content) - reach + 1
    hashed, join, after = xxhash.xxh64_intdigest, b" ".join, after.tolist()
    first = distance - 1
    made = {hashed(join((words[i], *content[after[i] + first : after[i] + reach : distance]))) for i in places if after[i] < most}
    if not made:
        made = {hashed(b"\x00" + join(words[1:]))}
    return np.sort(np.fromiter(made, np.uint64, len(made)))


def likeness(x: np.ndarray, y: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity of two sorted signature sets; 0 without counting where their lengths rule ``at_least`` out."""
    if not len(x) or not len(y) or min(len(x), len(y)) < at_least * max(len(x), len(y)):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def digest(signature: np.ndarray) -> str:
    """Number of signatures and 128-bit hash of the set."""
    return f"{len(signature)}-{xxhash.xxh3_128_hexdigest(signature.tobytes())}"


def spot_signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, signatures array<long>)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signatures(x).view(np.int64) for x in text_bytes(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
            values = np.concatenate(made) if made else np.empty(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, signatures array<long>")


def similar_texts(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``(set_a, set_b, similarity)``: signature sets (by digest) at least this similar, each pair once.

    Sets are collapsed first, so copies cost one row. Lengths are partitioned so that sets that can be similar fall in
    the same or in neighbouring partitions; a set is filed under the rarest signatures that any similar set must share
    (its prefix in the corpus-wide order of frequency), and candidates that share one are verified by exact Jaccard.
    """
    name = F.sha2(F.array_join("signatures", ","), 256)
    sets = spot_signatures(docs).select(name.alias("id"), "signatures").dropDuplicates(["id"])
    words = sets.select("id", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    frequency = words.groupBy("s").agg(F.count("*").alias("f"))
    ordered = words.join(frequency.where("f > 1"), "s", "left").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "s"))).alias("o"))
    prefix = F.col("n") - F.ceil(F.col("n") * similarity).cast("int") + 1
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(similarity))).cast("int")
    filed = ordered.select("id", "n", part.alias("part"), F.explode(F.slice("o", F.lit(1), prefix)).alias("p")).where("p.f > 1").select("id", "n", "part", F.col("p.s").alias("s"))
    near = filed.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    x, y = filed.alias("x"), near.alias("y")
    both = (F.col("x.s") == F.col("y.s")) & (F.col("x.part") == F.col("y.part"))
    fits = (F.col("x.n") * similarity <= F.col("y.n")) & (F.col("y.n") * similarity <= F.col("x.n"))
    once = (F.col("x.id") != F.col("y.id")) & fits
    pairs = x.join(y, both & once).select(F.least("x.id", "y.id").alias("set_a"), F.greatest("x.id", "y.id").alias("set_b")).distinct()
    a = sets.select(F.col("id").alias("set_a"), F.col("signatures").alias("sa"))
    b = sets.select(F.col("id").alias("set_b"), F.col("signatures").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = pairs.join(a, "set_a").join(b, "set_b").withColumn("similarity", shared / (F.size("sa") + F.size("sb") - shared))
    return scored.where(F.col("similarity") >= similarity).select("set_a", "set_b", "similarity")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [x.strip().split(" ")[0] for x in RESULT.split(",")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Bytes of text in one range of documents, and code points of a text that rank it where doc_ids are equal.
RANGE_BYTES, RANK_CHARS = 32 * 1024 * 1024, 32


def compared(doc: int | None, text: str, own: np.ndarray, following: str, next_signature: np.ndarray) -> tuple:
    """A document's result row, given the text that follows it."""
    other = edited(text, following)
    data = other.encode()
    changed = signatures(data)
    return (doc, len(text), hashlib.sha256(data).hexdigest(), digest(own), digest(changed), likeness(own, changed), likeness(own, next_signature))


def arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(KINDS), KINDS, strict=True)]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    Documents are dealt out once, in ranges of doc_id whose number follows the bytes of text, and each range is streamed
    in order. A range's last document waits for the first one of the next range: each range hands on these two texts,
    and a join of ranges finishes them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, shuffle_partitions(spark), -(-size // RANGE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, waiting = TaskContext.get().partitionId(), None, None
        names = [*COLUMNS, "part", "head", "tail"]
        for batch in pieces_of(batches, 1):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = signatures(text.encode())
                if waiting is None:
                    head = text
                else:
                    out.append(compared(*waiting, text, own))
                waiting = (doc, text, own)
            nothing = pa.nulls(len(out), pa.string())
            yield pa.record_batch([*arrays(out), pa.nulls(len(out), pa.int32()), nothing, nothing], names)
        if waiting is not None:
            last = [pa.nulls(1, k) for k in KINDS[1:]]
            yield pa.record_batch([pa.array([waiting[0]], pa.int64()), *last, pa.array([part], pa.int32()), pa.array([head]), pa.array([waiting[1]])], names)

    dealt = rows.repartitionByRange(ranges, "doc_id", F.substring("text", 1, RANK_CHARS)).sortWithinPartitions("doc_id", "text")
    made = cut(dealt.mapInArrow(run, f"{RESULT}, part int, head string, tail string"))
    ends = made.where("part IS NOT NULL").select("doc_id", "part", "head", "tail")
    # Only the numbers of the ranges are put in order by one task.
    order = ends.select("part", F.lead("part").over(Window.orderBy("part")).alias("following"))
    order = order.select("part", F.coalesce("following", F.min("part").over(Window.partitionBy())).alias("following"))
    heads = ends.select(F.col("part").alias("following"), F.col("head").alias("next_text"))
    open_rows = ends.join(order, "part").join(heads, "following").select("doc_id", "tail", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            out = [compared(doc, text, signatures(text.encode()), following, signatures(following.encode())) for doc, text, following in zip(*columns, strict=True)]
            yield pa.record_batch(arrays(out), COLUMNS)

    return made.where("part IS NULL").select(COLUMNS).union(open_rows.mapInArrow(finish, RESULT))


def op3_spotsigs_fingerprints(spark, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
