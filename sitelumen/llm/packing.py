"""Best-fit packing of documents into fixed-length token sequences.

Documents are tokenised, closed with an end id and cut into pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths (at most ``capacity`` rows) reaches the driver. There, patterns of up to three lengths that fill a
sequence are enumerated on a coarse grid, their repeat counts are fitted to the histogram by non-negative least squares
and rounded down, each pattern is filled with exact lengths (the last one best-fit), and the residual is packed by
best-fit decreasing, all in whole groups of equal sequences: the plan is a list of recipes with repeat counts whose size
depends on ``capacity``, not on the corpus. Pieces of a length are then numbered without gaps and look up their place.

Defined results: a null text is empty, and an empty text is the end id alone; a text of any length is cut, never
truncated; repeated rows are packed each; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelumen.llm.common import cut, kept, pieces_of, shuffle_partitions, table, text_bytes

CAPACITY, END_ID, GRID = 4096, 1, 128
#: Entries of each of the two generations of a worker's cache of encoded words, which bounds its memory.
CACHE_WORDS = 400_000
STOPS = b".,;:!?"
#: Bytes of Latin-1 texts that are cut into the tokenizer's own pieces here: printable ASCII, blanks, and letters from À on.
SIMPLE = bytes([9, 10, 13, *range(32, 127), *(b for b in range(192, 256) if b not in b"\xd7\xf7")])
LOWER = bytes(b + 32 if b in SIMPLE and (65 <= b <= 90 or 192 <= b <= 222) else b for b in range(256))
#: The tokenizer's pre-tokenizer for them, in lower case: words, single digits, contractions and runs of other signs.
PIECES = re.compile(rb"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-z\xdf-\xf6\xf8-\xff]+")


def byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE has for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return dict(zip(printable, printable, strict=True)) | {b: 256 + i for i, b in enumerate(hidden)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceCache(dict):
    """Ids (little-endian unsigned 32-bit) of each piece of simple Latin-1 text, by the tokenizer's model on first sight."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.old = tokenizer.model, {}
        self.letters = byte_letters()

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            letters = piece.decode("latin-1")
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(self.letters)
            ids = packed_ids([t.id for t in self.model.tokenize(letters)])
        self[piece] = ids
        return ids


class WordCache(dict):
    """Ids (little-endian unsigned 32-bit) of each blank-separated chunk, by the tokenizer itself on first sight.

    The tokenizer drops white space and never joins across it, nor across an ASCII letter and a stop after it, so the
    ids of a text are those of its chunks in a row. Texts of simple characters are cut into the tokenizer's pieces at
    once, which are fewer than chunks: capitals and stops make no new ones.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        self.pieces = PieceCache(self.tokenizer)

    def encoded(self, chunk: bytes) -> bytes:
        return packed_ids(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            core, low = chunk.rstrip(STOPS), self.simple(chunk)
            if low is not None:
                ids = self.in_pieces(low)
            elif b"<" not in chunk and 0 < len(core) < len(chunk) and core[-1] < 128 and chr(core[-1]).isalpha():
                ids = self[core] + self[chunk[len(core) :]]
            else:
                ids = self.encoded(chunk)
        self[chunk] = ids
        return ids

    def simple(self, text: bytes) -> bytes | None:
        """The text in lower-case Latin-1, if it has simple characters only and no special token."""
        if b"<|" in text:
            return None
        if not text.isascii():
            try:
                text = text.decode().encode("latin-1")
            except UnicodeEncodeError:
                return None
        return None if text.translate(None, SIMPLE) else text.translate(LOWER)

    def in_pieces(self, low: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(low)))

    def ids(self, text: bytes) -> bytes:
        low = self.simple(text)
        out = b"".join(map(self.__getitem__, text.split())) if low is None else self.in_pieces(low)
        if len(self) + len(self.pieces) > CACHE_WORDS:  # what is used again comes back from the old generation
            for own in (self, self.pieces):
                own.old = dict(own)
                own.clear()
        return out


def cache_of(path: str) -> WordCache:
    """One cache a Python worker, kept over its tasks until other work begins."""
    return kept(f"words of {path}", lambda: WordCache(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = cache_of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in pieces_of(batches, 1):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids = cache.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by active sets: columns enter by gradient and leave where they would turn negative."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-8 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        enter = int(gradient.argmax())
        if gradient[enter] <= slack:
            break
        passive[enter] = True
        while True:
            on = np.flatnonzero(passive)
            fit = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if fit.min() > 0:
                x[:] = 0
                x[on] = fit
                break
            low = fit <= 0
            step = (x[on][low] / np.maximum(x[on][low] - fit[low], 1e-300)).min()
            x[on] += step * (fit - x[on])
            passive[on[(x[on] <= 1e-12) & low]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(bins: list[int], full: int) -> list[tuple[int, ...]]:
    """Up to three bins that fill a sequence, largest first."""
    have, out = set(bins), []
    for a in bins:
        if a == full:
            out.append((a,))
        for b in bins:
            if b <= a:
                if a + b == full:
                    out.append((a, b))
                c = full - a - b
                if 0 < c <= b and c in have:
                    out.append((a, b, c))
    return out


class Plan:
    """Recipes (lengths, repeat count) for a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.left)
        self.open: dict[int, list[list]] = {}
        self.rooms: list[int] = []
        self.recipes: list[tuple[tuple[int, ...], int]] = []
        if n := self.left.get(capacity, 0):
            self.take(capacity, n)
            self.recipes.append(((capacity,), n))
        self.fit()
        self.rest()
        self.recipes += [(tuple(lengths), n) for groups in self.open.values() for lengths, n in groups]

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def keep(self, lengths: list[int], n: int) -> None:
        room = self.capacity - sum(lengths)
        if not room:
            self.recipes.append((tuple(lengths), n))
            return
        if room not in self.open:
            bisect.insort(self.rooms, room)
        self.open.setdefault(room, []).append([lengths, n])

    def largest(self, low: int, high: int) -> int | None:
        """The largest length left in (low, high]."""
        i = bisect.bisect_right(self.lengths, high) - 1
        return self.lengths[i] if i >= 0 and self.lengths[i] > low else None

    def fit(self) -> None:
        unit = max(1, self.capacity // GRID)
        full = self.capacity // unit
        counts: dict[int, int] = {}
        for n, c in self.left.items():
            counts[-(-n // unit)] = counts.get(-(-n // unit), 0) + c
        bins = sorted(counts)
        made = patterns(bins, full)
        if not made:
            return
        a = np.zeros((len(bins), len(made)))
        for k, pattern in enumerate(made):
            for b in pattern:
                a[bisect.bisect_left(bins, b), k] += 1
        times = np.floor(nnls(a, np.array([counts[b] for b in bins], float)) + 1e-9).astype(int)
        for k in np.argsort(-times, kind="stable").tolist():
            todo = int(times[k])
            while todo > 0:
                lengths: list[int] = []
                for i, b in enumerate(made[k]):
                    room = self.capacity - sum(lengths)
                    final = i == len(made[k]) - 1
                    self_used = {n: lengths.count(n) for n in lengths}
                    high = room if final else min(b * unit, room)
                    low = 0 if final else (b - 1) * unit
                    found = self.largest(low, high)
                    while found is not None and self.left[found] <= self_used.get(found, 0):
                        found = self.largest(low, found - 1)
                    if found is None:
                        break
                    lengths.append(found)
                if len(lengths) < len(made[k]):
                    break
                n = min(todo, *(self.left[x] // lengths.count(x) for x in lengths))
                for x in lengths:
                    self.take(x, n)
                self.keep(lengths, n)
                todo -= n

    def rest(self) -> None:
        """Best-fit decreasing of what is left, a whole length at a time."""
        while self.lengths:
            length = self.lengths[-1]
            n = self.left[length]
            i = bisect.bisect_left(self.rooms, length)
            if i < len(self.rooms):
                room = self.rooms[i]
                group = self.open[room][-1]
                k = min(n, group[1])
                group[1] -= k
                if not group[1]:
                    self.open[room].pop()
                    if not self.open[room]:
                        del self.open[room]
                        self.rooms.pop(i)
                self.take(length, k)
                self.keep([*group[0], length], k)
            else:
                per = self.capacity // length
                whole, over = divmod(n, per)
                self.take(length, n)
                if whole:
                    self.keep([length] * per, whole)
                if over:
                    self.keep([length] * over, 1)


def places(recipes: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank), and the sequence of that rank and the offset there."""
    rows, next_rank, base = [], {}, 0
    for lengths, n in recipes:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            rows.append(((length << 40) + rank, base, offset))
            next_rank[length] = rank + n
            offset += length
        base += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)`` of every piece."""
    spark = docs.sparkSession
    made = cut(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, with_ids))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(Plan(histogram, capacity).recipes))
    # Ranks in two steps, so that a length that many pieces share is not numbered in one task.
    buckets = shuffle_partitions(spark)
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = made.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = made.withColumn("rank", F.row_number().over(own) - 1).join(sizes, ["length", "bucket"])
    names = [c for c in made.columns if c != "bucket"]
    ranked = ranked.select(*names, (F.shiftleft(F.col("length"), 40) + F.col("first") + F.col("rank")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bases, offsets = shared.value
        for batch in batches:
            key = batch.column(len(names)).to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.record_batch([*(batch.column(i) for i in range(len(names))), pa.array(bases[at] + key - keys[at]), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields if f.name != "bucket")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(sequence_id, n_tokens, ids, pieces)``: each sequence's ids (little-endian unsigned 32-bit) and where they are from."""
    rows = pack(docs, tokenizer, capacity, end_id, with_ids=True)
    rows = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("rows"))
    ids = F.aggregate("rows", F.lit(b""), lambda acc, r: F.concat(acc, r["ids"]))
    own = F.transform("rows", lambda r: F.struct(r["offset"].alias("offset"), r["doc_id"].alias("doc_id"), r["piece"].alias("piece"), r["length"].alias("length")))
    return rows.select("sequence_id", (F.octet_length(ids) / 4).cast("int").alias("n_tokens"), ids.alias("ids"), own.alias("pieces"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
