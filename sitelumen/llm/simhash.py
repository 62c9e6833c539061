"""SimHash near-duplicate detection over pigeonhole blocks.

Two users of one idea. ``components_by_fingerprint`` links 64-bit fingerprints that differ in at most two bits: of four
16-bit blocks two at least are untouched, so each fingerprint is filed under its six pairs of blocks and only
fingerprints of one bucket are compared. ``near_duplicate_groups`` works at a similarity (0.8 of five-word shingles
unless told otherwise): texts meet by the same pairs of blocks of their 64-bit fingerprints. There some forty of 256 bits may
differ and blocks short enough to stay untouched would be shared by chance, so texts also meet by keys of least shingle
hashes, which depend on the similarity alone and not on where the texts differ; 256 shingle bits spare comparisons, and the
exact Jaccard similarity of the shingle sets decides. A key
that too many texts share for one task is compared in three steps that together leave no pair of different groups out
(see ``near_duplicate_groups``).

Defined results: null and empty texts have no words and fingerprint zero; texts of fewer words than a shingle are one
shingle; rows with equal texts share one fingerprint and are collapsed before any join; a null doc_id takes part and
ranks last; extra columns, whatever their names, are ignored by the fingerprint functions and kept by
``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelumen.llm.common import cut, cut_few, fresh, hex64, let_go, pieces_of, table, text_bytes
from sitelumen.llm.components import connected_components

SEED = 42
#: Buckets with more fingerprints are not compared pair by pair.
BUCKET_PAIRS = 1024
#: Weight of the texts compared in one task before they are dealt out again: one a text, and one for each so many shingles.
#: Up to it all texts that hang together by keys are compared; beyond it those that share a key, which 0.999 of pairs at 0.8 do.
HOT_BUCKET, WEIGHT_SHINGLES = 2000, 8192
#: Rows of hashes handled at once, which bounds memory for very long texts.
CHUNK = 1 << 17


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, A-Z lower-cased, joined by single spaces."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """64-bit words (one per column of ``hashes``) whose bits are set in over half the rows."""
    hashes = hashes.reshape(len(hashes), -1)
    columns, ones = hashes.shape[1], np.zeros(hashes.shape[1] * 64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i : i + CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), columns * 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def hashed_fingerprint(hashes: np.ndarray) -> int:
    return int(majority_bits(hashes).view(np.int64)[0]) if len(hashes) else 0


def fingerprint(text: bytes, size: int = 3) -> int:
    """The text's 64-bit fingerprint as a signed number."""
    return hashed_fingerprint(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1):
            fps = [fingerprint(x, size) for x in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: str) -> Column:
    """The six keys of a fingerprint: its pairs of 16-bit blocks, of which fingerprints at two bits or fewer share one."""
    blocks = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    block = lambda i: F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
    return F.array(*[F.lit(n << 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for n, (i, j) in enumerate(blocks)])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: links by which the distinct ``fp`` that differ in one or two bits hang together.

    Within a bucket of up to BUCKET_PAIRS every such pair is returned. In a larger one two fingerprints link exactly if
    they share a value that is at most one flip away from both, so all that meet at a value are tied to its smallest:
    linear in the bucket, with the same components.
    """
    keyed = fps.select("fp", F.explode(block_keys("fp")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, "key")
    few, many = keyed.where(F.col("n") <= BUCKET_PAIRS), keyed.where(F.col("n") > BUCKET_PAIRS)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    probes = many.select("key", "fp", F.explode(flips).alias("flip")).select("key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    hubs = probes.groupBy("key", "value").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    tied = probes.join(hubs, ["key", "value"]).where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.union(tied).distinct()


def components_by_fingerprint(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``; component_id is the smallest doc_id whose fingerprint can be reached."""
    fps = cut(fingerprints(docs, size))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = connected_components(fingerprint_links(nodes.select("fp")))
    nodes = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "component").select("fp", "component_id")
    return fps.join(nodes, "fp").select("doc_id", "fp", "component_id")


# --- at a similarity -------------------------------------------------------------------------------------------------

VERIFY_BITS = 256
#: Keys of a text, and least shingle hashes that make up one: at Jaccard s two texts share a key with 1 - (1 - s^6)^24, 0.999 at 0.8.
BANDS, ROWS = 24, 6
#: Deviations of slack of the bits, which only save exact comparisons: 3 in 100,000 pairs at the similarity lie beyond.
SLACK = 4.0
_RANDOM = np.random.default_rng(SEED)
MULTIPLIERS, ADDENDS = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
MULTIPLIERS |= np.uint64(1)


def most_bits_apart(similarity: float, bits: int = VERIFY_BITS) -> int:
    """Differing bits up to which shingle sets are compared exactly at this Jaccard similarity."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def mixed(hashes: np.ndarray, columns: int) -> np.ndarray:
    """``columns`` independent 64-bit hashes of each hash (the splitmix64 finaliser)."""
    x = hashes[:, None] + np.arange(1, columns + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_majority(hashes: np.ndarray, columns: int) -> np.ndarray:
    ones = np.zeros(columns * 64, np.int64)
    for i in range(0, len(hashes), CHUNK // columns):
        part = np.ascontiguousarray(mixed(hashes[i : i + CHUNK // columns], columns))
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), columns * 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set, each a hash of ROWS minima and the band's number."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(shingles), CHUNK // len(least)):
        np.minimum(least, (shingles[i : i + CHUNK // len(least), None] * MULTIPLIERS + ADDENDS).min(axis=0), out=least)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def text_digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


def signed_texts(docs: DataFrame, size: int) -> DataFrame:
    """``(digest, weight, fp, bits, keys)`` of every row of docs; a text without words has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in pieces_of(batches, 0):
            digests, weights, fps, bits, keys = [], [], [], [], []
            for text in text_bytes(batch.column(0)):
                hashes = shingle_hashes(text, size)
                fps.append(hashed_fingerprint(hashes))
                shingles = np.unique(hashes)
                digests.append(text_digest(text))
                weights.append(1 + len(shingles) // WEIGHT_SHINGLES)
                bits.append(wide_majority(shingles, VERIFY_BITS // 64).tobytes())
                keys.append(band_keys(shingles) if len(shingles) else np.empty(0, np.int64))
            columns = [pa.array(digests, pa.binary()), pa.array(weights, pa.int64()), pa.array(fps, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["digest", "weight", "fp", "bits", "keys"])

    return docs.select("text").mapInArrow(run, "digest binary, weight long, fp long, bits binary, keys array<long>")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, without repeats) have this Jaccard similarity or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common >= similarity * (len(a) + len(b) - common)


class Unit:
    """Texts compared with one another: ``add`` gives a text's links to groups that it joins, by exact Jaccard similarity."""

    def __init__(self, size: int, similarity: float):
        self.size, self.similarity, self.apart = size, similarity, most_bits_apart(similarity)
        self.names: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.bits, self.groups = np.empty((64, VERIFY_BITS // 64), np.uint64), np.empty(64, np.int64)

    def add(self, name: bytes, text: bytes) -> list[bytes]:
        n = len(self.names)
        own = np.unique(shingle_hashes(text, self.size))
        if n == len(self.bits):
            self.bits, self.groups = np.concatenate([self.bits, self.bits]), np.concatenate([self.groups, self.groups])
        self.bits[n], self.groups[n] = wide_majority(own, VERIFY_BITS // 64), n
        self.names.append(name)
        self.sets.append(own)
        far = np.bitwise_count(self.bits[:n] ^ self.bits[n]).sum(axis=1)
        near = np.flatnonzero(far <= self.apart)
        near, found = near[np.argsort(far[near], kind="stable")], []
        while len(near):
            at = int(near[0])
            if alike(self.sets[at], own, self.similarity):
                found.append(self.names[at])
                known = self.groups[: n + 1]
                known[known == known[at]] = n
                near = near[self.groups[near] != n]  # one link ties the whole group
            else:
                near = near[1:]
        return found


def unit_links(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(a, b)``: links that tie the near-duplicates of each unit of ``(unit, salt, digest, text)`` together.

    ``(unit, a)`` without b: the first text of each group of a salted unit, to be compared across salts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        last, own = None, None
        for batch in pieces_of(batches, 3):
            out: list[tuple] = []
            for unit, salt, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(3)), strict=True):
                if (unit, salt) != last:
                    last, own = (unit, salt), Unit(size, similarity)
                found = own.add(name, text)
                out += [(None, other, name) for other in found]
                if salt >= 0 and not found:
                    out.append((unit, name, None))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["unit", "a", "b"])

    dealt = rows.select("unit", "salt", "digest", "text").repartition("unit", "salt").sortWithinPartitions("unit", "salt", "digest")
    return dealt.mapInArrow(run, "unit long, a binary, b binary")


def stray_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: a stray and a member of another component whose bits may be near, of ``(key, block, salt, stray, digest, bits, component)``.

    The strays of a (key, block, salt) come first and are held; members stream past them. Of the members of one
    component all are given, as any of them may hold the link.
    """
    apart = most_bits_apart(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, bits, components = None, [], np.empty((0, VERIFY_BITS // 64), np.uint64), np.empty(0, object)
        held: list[tuple[bytes, bytes, bytes]] = []
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for key, block, salt, member, name, own, component in zip(*columns, strict=True):
                if (key, block, salt) != last:
                    last, held, names = (key, block, salt), [], []
                if not member:
                    held.append((name, own, component))
                    continue
                if not held:
                    continue
                if not names:
                    names = [x[0] for x in held]
                    bits = np.frombuffer(b"".join(x[1] for x in held), np.uint64).reshape(len(held), -1)
                    components = np.array([x[2] for x in held], object)
                far = np.bitwise_count(bits ^ np.frombuffer(own, np.uint64)).sum(axis=1)
                out += [(names[i], name) for i in np.flatnonzero(far <= apart) if components[i] != component]
            pairs = list(zip(*out, strict=True)) or [(), ()]
            yield pa.record_batch([pa.array(pairs[0], pa.binary()), pa.array(pairs[1], pa.binary())], ["a", "b"])

    dealt = rows.repartition("key", "block", "salt").sortWithinPartitions("key", "block", "salt", "member", "digest")
    return dealt.select("key", "block", "salt", "member", "digest", "bits", "component").mapInArrow(run, "a binary, b binary")


def exact_links(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts have this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)), strict=True)
            keep = [alike(np.unique(shingle_hashes(x, size)), np.unique(shingle_hashes(y, size)), similarity) for x, y in both]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (texts.select(F.col("digest").alias(n), F.col("text").alias(f"{n}_text")) for n in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "a_text", "b_text").mapInArrow(run, "a binary, b binary")


def near_duplicate_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(digest, component)``: for each distinct normalised text with a near-duplicate, the smallest digest of its group.

    Keys are a text's pairs of SimHash blocks and its least hashes. Texts that share a key, directly or by others, are one unit, in which every pair is compared, so each text is sent
    once. A unit heavier than HOT_BUCKET is compared key by key instead. A key heavier than that is dealt out by salt:
    first every pair of a salt is compared, then the first texts of the salts' groups, and then the strays, the texts
    outside the key's largest component, are compared in blocks with all texts of the key in other components. So a
    large group of near copies is settled in the first two steps, and no link between two components is left out.
    """
    texts = docs.select("text")
    signed = cut_few(signed_texts(texts, size).dropDuplicates(["digest"]))
    # Texts meet by the blocks of their SimHash, and by keys of least hashes where more bits differ than blocks allow for.
    meets = F.when(F.size("keys") > 0, F.concat("keys", block_keys("fp"))).otherwise(F.col("keys"))
    keyed = signed.select(F.explode(meets).alias("key"), "digest", "weight")
    heads = keyed.groupBy("key").agg(F.min("digest").alias("head"), F.count("*").alias("n"), F.sum("weight").alias("key_weight")).where("n > 1").drop("n")
    shared = cut_few(keyed.join(heads, "key"))
    members = connected_components(shared.select(F.col("head").alias("a"), F.col("digest").alias("b"))).withColumnRenamed("node", "digest")
    members = members.join(signed.select("digest", "weight"), "digest")
    members = cut_few(members.join(members.groupBy("component").agg(F.sum("weight").alias("unit_weight")), "component"))
    whole = members.where(F.col("unit_weight") <= HOT_BUCKET).select("digest", F.xxhash64("component").alias("unit"), F.lit(-1).cast("long").alias("salt"))
    salts = F.ceil(F.col("key_weight") / HOT_BUCKET)
    salt = F.when(F.col("key_weight") > HOT_BUCKET, F.pmod(F.xxhash64("digest"), salts)).otherwise(F.lit(-1)).cast("long")
    dealt = shared.join(members.where(F.col("unit_weight") > HOT_BUCKET).select("digest"), "digest").select("digest", F.col("key").alias("unit"), salt.alias("salt"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 0):
            yield pa.record_batch([pa.array([text_digest(x) for x in text_bytes(batch.column(0))], pa.binary()), batch.column(0)], ["digest", "text"])

    # Copies are dropped where they are read, before anything is dealt out by digest.
    texts = cut_few(texts.mapInArrow(digests, "digest binary, text string").dropDuplicates(["digest"]).join(members.select("digest"), "digest", "left_semi"))
    first = cut_few(unit_links(whole.union(dealt).join(texts, "digest"), size, similarity))
    again = first.where("b IS NULL").select(F.col("a").alias("digest"), "unit", F.lit(-1).cast("long").alias("salt"))
    second = unit_links(again.join(texts, "digest"), size, similarity)
    links = first.where("b IS NOT NULL").select("a", "b").union(second.where("b IS NOT NULL").select("a", "b"))
    groups = cut_few(connected_components(links).select(F.col("node").alias("digest"), "component"))
    hot = shared.where(F.col("key_weight") > HOT_BUCKET).select("key", "digest", salts.alias("salts"))
    if hot.isEmpty():
        return groups
    hot = cut_few(hot.join(groups, "digest", "left").withColumn("component", F.coalesce("component", "digest")))
    parts = hot.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).where("most.n < n")
    blocks = F.ceil((F.col("n") - F.col("most.n")) / HOT_BUCKET)
    open_keys = cut_few(largest.select("key", F.col("most.component").alias("settled"), blocks.alias("blocks")))
    if open_keys.isEmpty():
        return groups
    left = cut_few(hot.join(open_keys, "key").join(signed.select("digest", "bits"), "digest"))
    strays = left.where("component <> settled").withColumns({"block": F.pmod(F.xxhash64("digest"), F.col("blocks")), "salt": F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)), "member": F.lit(False)})
    passing = left.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "salt": F.pmod(F.xxhash64("digest"), F.col("salts")), "member": F.lit(True)})
    columns = ["key", "block", "salt", "member", "digest", "bits", "component"]
    pairs = stray_pairs(strays.select(columns).union(passing.select(columns)), similarity)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    late = cut_few(exact_links(pairs, texts, size, similarity))
    # What the late links tie are whole components, so only their names have to meet.
    of = groups.select(F.col("digest").alias("a"), F.col("component").alias("c"))
    ties = late.join(of, "a", "left").select("b", F.coalesce("c", "a").alias("u")).join(of.select(F.col("a").alias("b"), F.col("c").alias("d")), "b", "left").select("u", F.coalesce("d", "b").alias("v"))
    tied = connected_components(ties, "u", "v").select(F.col("node").alias("component"), F.col("component").alias("root"))
    alone = ties.select(F.explode(F.array("u", "v")).alias("digest")).distinct().join(groups, "digest", "left_anti").withColumn("component", F.col("digest"))
    return groups.union(alone).join(tied, "component", "left").select("digest", F.coalesce("root", "component").alias("component"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest doc_id stays (nulls last).

    Of repeated rows one stays. All columns are kept, whatever their names.
    """
    names, row_key = [F.col(f"`{c}`") for c in docs.columns], fresh(docs, "row_key")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1):
            made = [text_digest(x) for x in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(made, pa.binary())], ["doc_id", "row_key", "digest"])

    key = F.struct(F.xxhash64("doc_id", "text").alias("x"), F.xxhash64(F.lit(1), "doc_id", "text").alias("y"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("row_key")).mapInArrow(digests, "doc_id long, row_key struct<x:long,y:long>, digest binary")
    # Copies are reduced to their first row before they meet, so a text repeated without end is no hot key.
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    firsts = ids.groupBy("digest").agg(F.min(rank).alias("first"))
    grouped = firsts.join(near_duplicate_groups(docs, size, similarity), "digest", "left")
    stay = grouped.groupBy(F.coalesce("component", "digest")).agg(F.min("first").alias("first")).select(F.col("first.row_key").alias(row_key))
    kept = docs.select(*names, key.alias(row_key)).join(stay, row_key, "left_semi")
    return kept.dropDuplicates([row_key]).select(*names)


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (three-word shingles, links at two bits or fewer)."""
    found = components_by_fingerprint(table(spark, sf_dir, "documents"), 3)
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
