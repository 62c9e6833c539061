"""N-gram Jaccard join: exact links between distinct word n-gram sets, by a size-aware heavy-light join.

Two sets of a and b elements are alike at p per cent only if they share ``least_overlap(a, b)`` elements. So

* small sets enumerate their subsets of that fixed size, for every size that a partner can have: alike sets share one;
* large sets are filed in inverted lists and the lists are scanned. A list is kept for the content of a block: elements are
  dealt by hash to blocks, one more than elements that can differ within a class of sizes, so alike sets have a block in
  common (lists of single elements would be as long as the corpus for a line that many documents have). Blocks without
  elements say nothing, so there are a few more blocks than needed, and a set with too many empty ones is filed again under
  another hash, as must be any partner with which it shares empty ones alone;
* the size that divides small from large is the one with the fewest entries over the corpus' sizes.

Both only propose: sets that meet, directly or through others, are one unit, in which pairs are compared exactly. Entries of
one key are reduced to one in each task before the shuffle, so a large group of near copies is no hot key. A unit too heavy
for one task is dealt out by keys of its sets' least hashes, which bring most alike sets together: pairs of a task first, then
the first sets of each task's groups, and then, in the keys that sets of different groups still share, every set outside the
key's largest group against those of other groups. No link between different groups
is left out, and sets already tied are not compared again.

Sets are of 64-bit hashes of n-grams, made of their words' hashes (XXH64); two n-grams of a pair of documents clash with
less than one in 10^12.

Defined results: words are runs without blanks, A-Z lower-cased; a text of fewer words than n is one n-gram; null, empty
and blank texts have empty sets and link with nothing; texts of any length are read whole; equal sets are collapsed before
anything is compared; repeated rows and ids are rows of their own; a null id takes part and is never a component's smallest,
so a component of null ids alone has a null one; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelumen.llm.common import bit_map, cut, gram_hashes, in_map, mixed, pieces_of, stored, table, text_bytes, word_hashes
from sitelumen.llm.components import connected_components

#: Largest size for which enumerating subsets is weighed at all: beyond it a set has thousands.
SMALL = 40
#: A class of sizes ends at this many times its start; hashes tried for a set with too many empty blocks.
SPREAD, TRIES = 1.4, 6
#: Entries that a task reduces at once.
HELD = 1 << 21
#: Weight of the sets compared in one task: one a set, and one for each so many n-grams.
HOT, WEIGHT = 512, 8192
#: Counters of a set by which pairs are ruled out: what they differ by, the sets differ by at least.
COUNTERS = 64
#: Bits of the map of the keys that several sets of heavy units have, and bytes of it that are put together at once.
KEY_BITS, SLICE = 1 << 26, 1 << 16
#: Keys by which the members of a heavy unit are dealt out first.
BANDS = 4
#: Words of 64 parity bits of a set, which do the same for pairs of a heavy unit.
PARITY = 8
#: Bits of the map by which rows of no unit are left out early.
MAP_BITS = 1 << 25


class Sizes:
    """What sizes say at a similarity of ``percent``, and where small sets end."""

    def __init__(self, percent: int, small: int = 0):
        self.percent, self.small, self.starts = percent, small, [1]

    def least_overlap(self, a: int, b: int) -> int:
        return -(-self.percent * (a + b) // (100 + self.percent))

    def most_apart(self, a, b):
        """Elements by which alike sets of these sizes can differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def largest_partner(self, a: int) -> int:
        return 100 * a // self.percent

    def smallest_partner(self, a: int) -> int:
        return -(-self.percent * a // 100)

    def start(self, j: int) -> int:
        while len(self.starts) <= j:
            last = self.starts[-1]
            self.starts.append(max(int(last * SPREAD), self.largest_partner(last)) + 1)
        return self.starts[j]

    def class_of(self, a: int) -> int:
        while self.starts[-1] <= a:
            self.start(len(self.starts))
        return int(np.searchsorted(self.starts, a, side="right")) - 1

    def blocks(self, j: int) -> tuple[int, int]:
        """Blocks of class j, and how many of them may be empty."""
        end = self.start(j + 1) - 1
        need = self.most_apart(end, end) + 1
        empty = need * (1 - 1 / need) ** self.smallest_partner(self.start(j))
        spare = ceil(empty + 2 * sqrt(empty)) if need > 1 else 0
        return need + spare, spare

    def schemes(self, a: int) -> list[int]:
        """Classes under which a set of this size is filed in lists: its own, and the next one's where a partner can be."""
        if self.largest_partner(a) <= self.small:
            return []
        j = self.class_of(a)
        return [i for i in (j, j + 1) if self.start(i + 1) - 1 > self.small and (i == j or self.largest_partner(a) >= self.start(i))]

    def partners(self, a: int) -> list[tuple[int, int, int]]:
        """``(smaller, larger, subset)`` of the pairs of small sets that one of this size can be in."""
        sizes = range(self.smallest_partner(a), min(self.largest_partner(a), self.small) + 1) if a <= self.small else ()
        return [(min(a, b), max(a, b), c) for b in sizes if (c := self.least_overlap(a, b)) <= min(a, b)]

    def entries(self, a: int) -> int:
        return sum(comb(a, c) for _, _, c in self.partners(a)) + sum(self.blocks(j)[0] for j in self.schemes(a))


def cheapest_small(percent: int, counts: dict[int, int]) -> int:
    """The size up to which subsets are enumerated: that with the fewest entries in all, of ``counts`` sets by size."""
    return min(range(SMALL + 1), key=lambda x: sum(n * Sizes(percent, x).entries(a) for a, n in counts.items()))


@lru_cache(maxsize=4096)
def _left_out(size: int, n: int) -> np.ndarray:
    return np.array(list(combinations(range(size), n)), np.int64).reshape(comb(size, n), n)


def _tag(*of: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(repr(of)))


def subset_keys(elements: np.ndarray, sizes: Sizes) -> list[np.ndarray]:
    """A key of every subset of a size by which small sets meet."""
    content, out = mixed(elements, 101), []
    total = content.sum(keepdims=True)
    for small, large, c in sizes.partners(len(elements)):
        rest = total - content[_left_out(len(elements), len(elements) - c)].sum(axis=1)
        out.append(mixed(rest + _tag(1, small, large), 102))
    return out


def block_keys(elements: np.ndarray, j: int, sizes: Sizes) -> list[np.ndarray]:
    """A key of the content of every block of class j."""
    (blocks, spare), out = sizes.blocks(j), []
    number = np.arange(blocks, dtype=np.uint64)
    for attempt in range(TRIES):
        hashed = mixed(elements, attempt)
        at = ((hashed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(blocks, np.uint64)
        np.add.at(content, at, mixed(hashed, 103))
        full = np.bincount(at, minlength=blocks) > 0
        out.append(mixed(content[full] + mixed(number[full], 104) + _tag(2, j, attempt), 105))
        if blocks - int(full.sum()) <= spare:
            return out
    return [*out, mixed(mixed(number[~full], 104) + _tag(3, j), 105)]


def keys_of(elements: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The keys under which a set is filed; alike sets share one at least."""
    if not len(elements):
        return np.empty(0, np.int64)
    parts = subset_keys(elements, sizes)
    for j in sizes.schemes(len(elements)):
        parts += block_keys(elements, j, sizes)
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.empty(0, np.int64)


def set_of(text: bytes, size: int) -> np.ndarray:
    """The text's n-gram hashes, sorted, without repeats."""
    words = text.lower().split()
    return np.unique(gram_hashes(word_hashes(words), min(size, len(words))))


def digest_of(elements: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None


def short(digest: bytes) -> int:
    """64 bits of a digest, by which sets are proposed; sets that share them are compared."""
    return int.from_bytes(digest[:8], "little", signed=True)


def row_key() -> Column:
    """128 bits by which a row's text is found again."""
    of = (F.col("doc_id").cast("long"), F.col("text"))
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit(1), *of).alias("b"))


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, row, n, digest, set)`` of every row; an empty set has no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 2):
            sets = [set_of(x, size) for x in text_bytes(batch.column(2))]
            digests = [digest_of(x) for x in sets]
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([None if x is None else short(x) for x in digests], pa.int64())]
            yield pa.record_batch(columns, ["doc_id", "row", "n", "digest", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(run, "doc_id long, row struct<a:long,b:long>, n long, digest binary, set long")


def filed(docs: DataFrame, size: int, sizes: Sizes) -> DataFrame:
    """``(key, set)``: the entries of all sets. Sets that hang together by keys within a task are filed as one, and each of the others is tied to it by a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owners: list[int] = []

        def out() -> pa.RecordBatch:
            names, of = np.unique(np.array(owners, np.int64), return_inverse=True)
            every, by = np.concatenate([*keys, np.empty(0, np.int64)]), np.repeat(of, [len(x) for x in keys])
            order = np.lexsort((by, every))
            every, by = every[order], by[order]
            new = np.ones(len(every), bool)
            new[1:] = every[1:] != every[:-1]
            first = by[new][np.cumsum(new) - 1]
            root = names[roots(len(names), np.unique(np.stack([by, first], axis=1)[by != first], axis=0))] if len(names) else names
            tied = root != names
            tie = mixed(mixed(names[tied].view(np.uint64), 106) + root[tied].view(np.uint64), 107).view(np.int64)
            made = [np.concatenate([every[new], tie, tie]), np.concatenate([root[by[new]], names[tied], root[tied]])]
            keys.clear()
            owners.clear()
            return pa.record_batch([pa.array(x, pa.int64()) for x in made], ["key", "set"])

        held = 0
        for batch in pieces_of(batches, 0):
            for text in text_bytes(batch.column(0)):
                elements = set_of(text, size)
                if len(elements):
                    keys.append(keys_of(elements, sizes))
                    owners.append(short(digest_of(elements)))
                    held += len(keys[-1])
                if held > HELD:
                    yield out()
                    held = 0
        yield out()

    return docs.select("text").mapInArrow(run, "key long, set long")


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of the numbers below n the smallest that pairs reach."""
    up = list(range(n))
    for a, b in pairs.tolist():
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        up[max(a, b)] = min(a, b)
    for i in range(n):
        up[i] = up[up[i]]
    return np.array(up, np.int64)


class Unit:
    """Sets compared with one another: ``add`` gives the sets that tie a set to groups that it is alike to."""

    def __init__(self, sizes: Sizes):
        self.rule = sizes
        self.names: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.counts, self.sizes, self.groups = np.empty((64, COUNTERS), np.int32), np.empty(64, np.int64), np.empty(64, np.int64)

    def room(self, n: int) -> None:
        if n == len(self.sizes):
            self.counts, self.sizes, self.groups = (np.concatenate([x, x]) for x in (self.counts, self.sizes, self.groups))

    def add(self, name: bytes, own: np.ndarray) -> list[bytes]:
        n = len(self.names)
        self.room(n)
        self.counts[n], self.sizes[n], self.groups[n] = counters(own), len(own), n
        self.names.append(name)
        self.sets.append(own)
        apart = np.abs(self.counts[:n] - self.counts[n]).sum(axis=1)
        near = np.flatnonzero(apart <= self.rule.most_apart(self.sizes[:n], len(own)))
        near, found = near[np.argsort(apart[near], kind="stable")], []
        while len(near):
            at = int(near[0])
            if alike(self.sets[at], own, self.rule.percent):
                found.append(self.names[at])
                known = self.groups[: n + 1]
                known[known == known[at]] = n
                near = near[self.groups[near] != n]  # one link ties the whole group
            else:
                near = near[1:]
        return found


def counters(elements: np.ndarray) -> np.ndarray:
    return np.bincount((mixed(elements, 108) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def unit_links(rows: DataFrame, size: int, sizes: Sizes) -> DataFrame:
    """``(unit, a, b)``: links that tie the alike sets of each (unit, salt) of ``(unit, salt, digest, text)`` together; without b, the first set of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in pieces_of(batches, 3):
            out: list[tuple] = []
            for unit, salt, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(3)), strict=True):
                if (unit, salt) != last:
                    last, own = (unit, salt), Unit(sizes)
                if own.names and own.names[-1] == name:
                    continue  # one text, read from several rows
                found = own.add(name, set_of(text, size))
                out += [(unit, other, name) for other in found] or [(unit, name, None)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["unit", "a", "b"])

    dealt = rows.select("unit", "salt", "digest", "text").repartition("unit", "salt").sortWithinPartitions("unit", "salt", "digest")
    return dealt.mapInArrow(run, "unit long, a binary, b binary")


def placed_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with the texts of their ``row``; rows of none are left out by a map of fixed size before anything is dealt out."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(members, "row.a", MAP_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_map(sent.value, batch.column(0).field("a").to_numpy())))

    some = docs.select(row_key().alias("row"), "text").mapInArrow(run, "row struct<a:long,b:long>, text string")
    return some.join(members, "row").drop("row")


def salted(rows: DataFrame) -> DataFrame:
    """``rows(unit, digest, load, ...)`` with a salt, of as many as the unit's load takes."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.ceil(F.col("load") / HOT)).cast("long"))


def band_keys(elements: np.ndarray) -> np.ndarray:
    """BANDS keys of least hashes: most alike sets share one, most others none. They only bring alike sets of a heavy unit together early."""
    least = np.array([mixed(elements, 200 + i).min() for i in range(2 * BANDS)], np.uint64)
    return mixed(least[::2] + mixed(least[1::2], 110) + np.arange(BANDS, dtype=np.uint64), 111).view(np.int64)


def banded(heavy: DataFrame, size: int) -> DataFrame:
    """``(unit, digest, text, weight, load)`` of heavy units' members, dealt out by the keys of their least hashes; load is a key's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 2):
            bands = [band_keys(set_of(x, size)) for x in text_bytes(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array(bands, pa.list_(pa.int64()))], ["unit", "digest", "weight", "bands"])

    keyed = heavy.select("unit", "digest", "text", "weight").mapInArrow(run, "unit long, digest binary, weight long, bands array<long>")
    keyed = cut(keyed.select("unit", F.explode("bands").alias("band"), "digest", "weight").select(F.xxhash64("unit", "band").alias("band"), "digest", "weight"))
    loads = keyed.groupBy("band").agg(F.sum("weight").alias("load"), F.count("*").alias("n")).where("n > 1").drop("n")
    texts = heavy.select("digest", "text").dropDuplicates(["digest"])
    return keyed.join(loads, "band").withColumnRenamed("band", "unit").join(texts, "digest")


def parity(elements: np.ndarray) -> np.ndarray:
    """PARITY * 64 bits, each flipped by the elements that fall on it: two sets differ in as many elements at least as their bits."""
    at = mixed(elements, 109) & np.uint64(PARITY * 64 - 1)
    odd = np.bincount(at.astype(np.int64), minlength=PARITY * 64) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def repeated_keys(own: DataFrame) -> np.ndarray:
    """KEY_BITS bits of which those are set that the keys of two rows or more of ``own(keys)`` fall on.

    Each task marks the bits that it has seen once and twice; slices of the tasks' marks are put together on the executors.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(KEY_BITS // 8, np.uint8), np.zeros(KEY_BITS // 8, np.uint8)
        for batch in batches:
            at, counts = np.unique(batch.column(0).flatten().to_numpy() % KEY_BITS, return_counts=True)
            again = at[(counts > 1) | in_map(once, at)]
            for marked, cells in ((once, at), (twice, again)):
                np.bitwise_or.at(marked, cells >> 3, np.left_shift(1, cells & 7).astype(np.uint8))
        for i in range(0, len(once), SLICE):
            if once[i : i + SLICE].any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([once[i : i + SLICE].tobytes()], pa.binary()), pa.array([twice[i : i + SLICE].tobytes()], pa.binary())], ["at", "once", "twice"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, once, twice = None, None, None

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([last], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["at", "twice"])

        for batch in batches:
            for at, *both in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own_once, own_twice = (np.frombuffer(x, np.uint8) for x in both)
                if at == last:
                    twice, once = twice | own_twice | (once & own_once), once | own_once
                    continue
                if last is not None:
                    yield out()
                last, once, twice = at, own_once, own_twice
        if last is not None:
            yield out()

    few = own.select("keys").coalesce(own.sparkSession.sparkContext.defaultParallelism)  # as many maps as tasks run at once, not one a partition
    parts = few.mapInArrow(marks, "at int, once binary, twice binary").repartition(KEY_BITS // 8 // SLICE, "at").sortWithinPartitions("at")
    bits = np.zeros(KEY_BITS // 8, np.uint8)
    for r in parts.mapInArrow(merged, "at int, twice binary").collect():  # KEY_BITS / 8 bytes at most
        bits[r["at"] : r["at"] + SLICE] = np.frombuffer(r["twice"], np.uint8)
    return bits


def late_links(rows: DataFrame, size: int, sizes: Sizes) -> DataFrame:
    """``(a, b)``: links between different groups of heavy units ``(digest, text, group)``, found in the keys that their sets share.

    Of a key's sets those outside its largest group meet those of other groups; sizes and parity bits rule out most pairs
    within the join, and the texts of the others are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1):
            sets = [set_of(x, size) for x in text_bytes(batch.column(1))]
            bits = np.array([parity(x) for x in sets], np.int64).reshape(-1, PARITY)
            columns = [batch.column(0), batch.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array([keys_of(x, sizes) for x in sets], pa.list_(pa.int64())), *[pa.array(bits[:, i]) for i in range(PARITY)]]
            yield pa.record_batch(columns, ["digest", "group", "n", "keys", *names])

    names = [f"bits{i}" for i in range(PARITY)]
    own = rows.select("digest", "text", F.xxhash64("group").alias("group")).dropDuplicates(["digest"])
    own = stored(own.mapInArrow(run, "digest binary, group long, n long, keys array<long>, " + ", ".join(f"{x} long" for x in names)))
    sent = rows.sparkSession.sparkContext.broadcast(repeated_keys(own))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [k[in_map(sent.value, k)] for k in (x.values.to_numpy() for x in batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.int64()))], ["digest", "group", "keys"])

    # Keys that one set alone has are left out before anything is dealt out.
    some = own.select("digest", "group", "keys").mapInArrow(repeated, "digest binary, group long, keys array<long>")
    keyed = some.select(F.explode("keys").alias("key"), "digest", "group")
    parts = keyed.groupBy("key", "group").agg(F.count("*").alias("m"))
    mixed_keys = parts.groupBy("key").agg(F.max(F.struct("m", "group")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    met = keyed.join(mixed_keys.select("key", F.col("most.group").alias("settled")), "key").drop("group")
    met = stored(met.join(own.drop("keys"), "digest"))
    x, y = met.where("group <> settled").alias("x"), met.alias("y")
    differ = F.lit(0)
    for name in names:
        differ = differ + F.bit_count(F.col(f"x.{name}").bitwiseXOR(F.col(f"y.{name}")))
    near = (F.col("x.group") != F.col("y.group")) & ((100 + sizes.percent) * differ <= (100 - sizes.percent) * (F.col("x.n") + F.col("y.n")))
    near = near & (100 * F.least("x.n", "y.n") >= sizes.percent * F.greatest("x.n", "y.n"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & near).select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b")).distinct()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 2):
            both = zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)), strict=True)
            keep = [alike(set_of(a, size), set_of(b, size), sizes.percent) for a, b in both]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = rows.select("digest", "text").dropDuplicates(["digest"])
    left, right = (texts.select(F.col("digest").alias(n), F.col("text").alias(f"{n}_text")) for n in ("a", "b"))
    return cut(pairs).join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text").mapInArrow(exact, "a binary, b binary")


def set_groups(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """``(digest, component)`` of the sets that are alike to another: the smallest digest that links reach."""
    counts = {r["n"]: r["count"] for r in sets.where(F.col("n").between(1, SMALL)).groupBy("n").count().collect()}  # SMALL rows
    sizes = Sizes(percent, cheapest_small(percent, counts))
    by_key = Window.partitionBy("key").orderBy("set").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = filed(docs, size, sizes).withColumn("head", F.first("set").over(by_key)).where(F.col("set") != F.col("head")).select("set", "head").distinct()
    units = connected_components(ties, "set", "head").select(F.col("node").alias("set"), F.col("component").alias("unit"))
    firsts = sets.where("digest IS NOT NULL").groupBy("digest", "set", "n").agg(F.min("row").alias("row"))
    members = cut(firsts.join(units, "set").select("digest", "unit", "row", (F.lit(1) + F.floor(F.col("n") / WEIGHT)).alias("weight")))
    loads = members.groupBy("unit").agg(F.sum("weight").alias("load"))
    texts = stored(salted(placed_texts(docs, members.join(loads, "unit"))))
    links = cut(unit_links(texts.where(F.col("load") <= HOT), size, sizes).where("b IS NOT NULL").select("a", "b"))
    heavy = texts.where(F.col("load") > HOT).drop("load", "salt")
    if heavy.isEmpty():
        return connected_components(links).select(F.col("node").alias("digest"), "component")
    dealt = stored(salted(banded(heavy, size)))
    first = cut(unit_links(dealt, size, sizes))
    heads = dealt.where(F.col("load") > HOT).join(first.where("b IS NULL").select("unit", F.col("a").alias("digest")), ["unit", "digest"], "left_semi").drop("load", "salt")
    heads = salted(heads.join(heads.groupBy("unit").agg(F.sum("weight").alias("load")), "unit"))
    links = links.union(first.where("b IS NOT NULL").select("a", "b"))
    links = cut(links.union(unit_links(heads, size, sizes).where("b IS NOT NULL").select("a", "b")))
    groups = cut(connected_components(links).select(F.col("node").alias("digest"), "component"))
    grouped = heavy.join(groups, "digest", "left").select("unit", "digest", "text", F.coalesce("component", "digest").alias("group"))
    several = grouped.groupBy("unit").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("unit")
    late = cut(late_links(grouped.join(several, "unit", "left_semi"), size, sizes))
    if late.isEmpty():
        return groups
    return connected_components(links.union(late)).select(F.col("node").alias("digest"), "component")


def ngram_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row; component_id is the smallest doc_id that links of ``percent`` reach."""
    sets = stored(sets_of(docs, size))
    groups = set_groups(docs, sets, size, percent)
    full = sets.where("digest IS NOT NULL")
    least = full.groupBy("digest").agg(F.min("doc_id").alias("least")).join(groups, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    of = cut(least.join(smallest, "component").select("digest", "component_id"))
    empty = sets.where("digest IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.join(of, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def op12_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document (four-word shingles, Jaccard 0.85 or more)."""
    return ngram_components(table(spark, sf_dir, "documents"))


ORACLE = r"""WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(reach.other) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n"""
