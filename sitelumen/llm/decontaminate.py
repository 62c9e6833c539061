"""Benchmark decontamination with a generalised suffix automaton over words.

Test items are normalised to words (A-Z lower-cased; runs of digits, letters and non-ASCII characters), and all items
of a block form one suffix automaton. Training words stream through it while the longest matching length is tracked: a
match of ``window`` words or more marks those words as hit, and the state that holds the last ``window`` words knows
the items it occurs in. An item shorter than the window, but not empty, is one window of its own length.

The benchmark is dealt out into blocks of at most BLOCK_WORDS words, and a worker holds one block's automaton at a time. One
block is broadcast and the documents pass it once. Of more blocks the driver makes one automaton after the other, and only
documents that can have a hit pass them: those with a window whose hash is in a map, of fixed size, of all windows of the
benchmark. So the documents are read once, and memory does not grow with the benchmark.

Defined results: null texts have no words; empty items match nothing; items with equal texts are all reported; a null
item_id is skipped in ids but its words still count as hits; repeated document rows each get their row.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelumen.llm.common import bit_map, cut, ensure_checkpoint_dir, fresh, gram_hashes, in_map, stored, table, text_bytes, word_hashes

WINDOW = 10
#: Words of one automaton; about 300 bytes a word on the driver and in each Python worker.
BLOCK_WORDS = 200_000
#: Bits of the map of the benchmark's windows.
MAP_BITS = 1 << 27
#: Separators become blanks and A-Z lower case; what is left are 0-9, a-z and the bytes of non-ASCII characters.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences; transitions are keyed by word number."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("l", [-1]), array("l", [0])
        self.names: list[object] = [name for name, _ in items]
        lists = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for item in lists:
            last = 0
            for w in item:
                last = self._extend(last, w)
        found: list[set[int]] = [set() for _ in self.next]
        for k, item in enumerate(lists):
            state = 0
            for w in item:
                state = self.next[state][w]
                found[state].add(k)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for s in order:
            found[self.link[s]] |= found[s]
        # The state of the last ``window`` words, and the short items that end here.
        self.items: dict[int, frozenset[int]] = {}
        self.top = array("l", [0] * len(self.next))
        self.short: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(lists):
            if 0 < len(item) < window:
                state = 0
                for w in item:
                    state = self.next[state][w]
                ends.setdefault(state, []).append((len(item), k))
        for s in reversed(order):
            up = self.link[s]
            self.top[s] = s if self.length[s] >= window > self.length[up] else self.top[up]
            if self.top[s] == s:
                self.items[s] = frozenset(k for k in found[s] if len(lists[k]) >= window)
            if s in ends or up in self.short:
                self.short[s] = [*ends.get(s, ()), *self.short.get(up, ())]
        self.least = min([window, *(len(i) for i in lists if i)], default=window)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # an item before this one has come here
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word spans (start, end), merged, and the numbers of the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, (-1 for _ in words)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        nexts, link, lengths, top, short, window = self.next, self.link, self.length, self.top, self.short, self.window
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s < self.least:
                continue
            state = matched = 0
            for i, w in enumerate(ids[s:e].tolist(), s):
                step = nexts[state].get(w)
                if step is None:
                    while state and step is None:
                        state = link[state]
                        step = nexts[state].get(w)
                    matched = lengths[state]
                    if step is None:
                        continue
                state, matched = step, matched + 1
                longest = 0
                if matched >= window:
                    longest = window
                    items |= self.items[top[state]]
                if short and state in short:
                    for n, k in short[state]:
                        if n <= matched:
                            items.add(k)
                            longest = max(longest, n)
                if longest:
                    start = i + 1 - longest
                    if spans and start <= spans[-1][1]:
                        while spans and start <= spans[-1][0]:
                            spans.pop()
                        if spans and start <= spans[-1][1]:
                            start = spans.pop()[0]
                    spans.append((start, i + 1))
        return spans, items


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of at most about block_words words; longer items are cut with window - 1 words of overlap."""
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = words_of((row["text"] or "").encode())
        for at in range(0, max(1, len(words) - window + 1), block_words):
            part = words[at : at + block_words + window - 1]
            if block and size + len(part) > block_words:
                yield Automaton(block, window)
                block, size = [], 0
            block.append((row["item_id"], part))
            size += len(part)
    yield Automaton(block, window)


_SPANS = "array<struct<start:int,end:int>>"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, n_words, hits, items)`` of every row; hits are merged word spans, items the ids as strings."""
    blocks = blocks_of(benchmark, window, block_words)
    first, second = next(blocks), next(blocks, None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if second is None:
        return rows.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast(first)), f"doc_id long, text string, n_words long, hits {_SPANS}, items array<string>").drop("text")
    marked = stored(_marked(rows.withColumn("row_key", row_key()), benchmark, window))
    found = _by_block(marked.where("text IS NOT NULL"), chain([first, second], blocks))
    met = marked.select("row_key", "doc_id", "n_words").join(found, "row_key", "left")
    return met.select("doc_id", "n_words", F.coalesce("hits", F.array().cast(_SPANS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def row_key() -> Column:
    """128 bits of a row's doc_id and text."""
    of = (F.col("doc_id").cast("long"), F.col("text"))
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit(1), *of).alias("b"))


def _marked(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``(row_key, doc_id, n_words, text)`` of ``rows(doc_id, text, row_key)``; without the text where no window can be one of the benchmark's."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                words = words_of(text)
                n = min(window, len(words))
                made = gram_hashes(word_hashes(words), n)
                yield pa.record_batch([pa.array(made.view(np.int64)), pa.array([n] * len(made), pa.int32())], ["hash", "n"])

    windows = cut(benchmark.select("text").mapInArrow(of_items, "hash long, n int"))
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # window of them at most
    sent = rows.sparkSession.sparkContext.broadcast(bit_map(windows, "hash", MAP_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept = [], []
            for text, raw in zip(text_bytes(batch.column(1)), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                hashes = word_hashes(words)
                counts.append(len(words))
                kept.append(raw if any(in_map(sent.value, gram_hashes(hashes, n).view(np.int64)).any() for n in lengths) else None)
            yield pa.record_batch([batch.column(2), batch.column(0), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], ["row_key", "doc_id", "n_words", "text"])

    return rows.mapInArrow(run, "row_key struct<a:long,b:long>, doc_id long, n_words long, text string")


def _by_block(rows: DataFrame, blocks: Iterable[Automaton]) -> DataFrame:
    """``(row_key, hits, items)`` of the rows that any block hits, spans merged; each block is a job of its own, which adds to one table."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/hits-{uuid.uuid4().hex}"
    schema = f"row_key struct<a:long,b:long>, hits {_SPANS}, items array<string>"
    for automaton in blocks:
        shared = spark.sparkContext.broadcast(automaton)
        scanned = rows.mapInArrow(_scanner(shared, "row_key"), f"row_key struct<a:long,b:long>, text string, n_words long, hits {_SPANS}, items array<string>")
        scanned.where("size(hits) > 0").select("row_key", "hits", "items").dropDuplicates(["row_key"]).write.mode("append").parquet(path)
        shared.destroy()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged_spans([(h["start"], h["end"]) for h in own]) for own in batch.column(1).to_pylist()]
            spans_of = pa.array([[{"start": s, "end": e} for s, e in own] for own in spans], _SPAN)
            yield pa.record_batch([batch.column(0), spans_of, batch.column(2)], ["row_key", "hits", "items"])

    every = spark.read.schema(schema).parquet(path).groupBy("row_key").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return every.mapInArrow(merge, schema)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scanner(shared: Broadcast, name: str = "doc_id"):
    """A function that adds to rows (name, text) their number of words, hit spans and items by a broadcast automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Automaton = shared.value
        for batch in batches:
            counts, all_spans, all_items = [], [], []
            rows, texts = batch.column(batch.schema.get_field_index(name)), batch.column(batch.schema.get_field_index("text"))
            for text in text_bytes(texts):
                words = words_of(text)
                spans, items = own.scan(words)
                counts.append(len(words))
                all_spans.append([{"start": s, "end": e} for s, e in spans])
                all_items.append(sorted({own.names[k] for k in items if own.names[k] is not None}))
            columns = [rows, texts, pa.array(counts, pa.int64()), pa.array(all_spans, _SPAN), pa.array(all_items, pa.list_(pa.string()))]
            yield pa.record_batch(columns, [name, "text", "n_words", "hits", "items"])

    return run


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word spans and the separators up to the next word."""
    plain = text.translate(TABLE)
    starts = [i for i in range(len(plain)) if plain[i] != 32 and (i == 0 or plain[i - 1] == 32)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : starts[s]])
        at = starts[e] if e < len(starts) else len(text)
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without the hit spans; a row of which more than max_coverage is hit goes as a whole.

    Texts without a hit come back unchanged, and so do null texts. ``n_chars`` is renewed if there is one. Spans of all
    blocks of the benchmark are those of the original text; it is judged and cut once.
    """
    names, at, known = docs.columns, docs.columns.index("text"), fresh(docs, "hits")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    blocks = blocks_of(benchmark, window, block_words)
    first, second = next(blocks), next(blocks, None)
    rows, shared = docs, None
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)
    else:
        key = fresh(docs, "row_key")
        keyed = docs.select("*", row_key().alias(key))
        marked = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key")), benchmark, window)
        found = _by_block(stored(marked.where("text IS NOT NULL")), chain([first, second], blocks)).select(F.col("row_key").alias(key), F.col("hits").alias(known))
        rows = keyed.join(found, key, "left").select(*[F.col(f"`{c}`") for c in names], F.col(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            given = batch.column(len(names)).to_pylist() if shared is None else [None] * len(texts)
            for i, (raw, spans) in enumerate(zip(texts, given, strict=True)):
                if raw is None or (shared is None and not spans):
                    keep.append(i)
                    continue
                text = raw.encode()
                words = words_of(text)
                spans = [(h["start"], h["end"]) for h in spans] if shared is None else shared.value.scan(words)[0]
                if spans and sum(e - s for s, e in spans) > max_coverage * len(words):
                    continue
                keep.append(i)
                if spans:
                    texts[i] = remove_words(text, spans).decode()
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.record_batch(columns, names).take(pa.array(keep, pa.int64()))

    out = rows.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document the words hit by windows of ten benchmark words, and the items they come from."""
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]).cast("long"))
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def brute_force(words: list[bytes], items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> tuple[int, str]:
    """``(n_hit, items_sha256)`` the plain way, for tests."""
    hit, names = set(), set()
    for name, own in items:
        n = min(window, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(name)
    return len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, s.n, unnest(generate_series(1, len(w) - s.n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= s.n)
), h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
