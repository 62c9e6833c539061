"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are a text's distinct words (A-Z lower-cased) and the distinct beginnings of its longer words (four to seven
bytes, so that inflected forms share what they have learnt). Terms are those
that the labelled sample ties to toxicity (z score of their document frequencies). Severity grades are 0 for a row
labelled not toxic and, for a toxic one, 1, 2 or 3 by how many of the toxic terms it has (up to 1, up to 3, more). One
weight a term is shared by all ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k) with t_1 <= t_2 <= t_3. The
expected severity of a text is the sum of the three; it is rejected where P(grade >= 1) is at least one half.

The labelled sample is bounded by SAMPLE rows a class (smallest hash of doc_id) and the model by TERMS terms.

Defined results: null and empty texts have no features, and so the base severity; texts are used whole; without labels
of both classes, or where no term tells them apart, nothing is toxic; rows are scored one by one, so repeats and ties do not matter; ``drop_toxic`` keeps
all columns of the rows that stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelumen.llm.common import cut, let_go, pieces_of, table, text_bytes

SAMPLE, TERMS, LEAST_ROWS, LEAST_Z, GRADES = 8000, 20_000, 3, 4.0, 3
BEGINNINGS = (4, 5, 6, 7)
#: Words whose terms a worker remembers.
CACHE_WORDS = 300_000
RIDGE, ROUNDS, RATE = 1e-4, 500, 0.1
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(word: bytes) -> tuple[bytes, ...]:
    return (word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) > n))


def distinct_words(text: bytes) -> set[bytes]:
    return {*text.translate(TABLE).split()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights of at most TERMS terms and the thresholds."""

    def __init__(self, terms: list[bytes], weights: np.ndarray, thresholds: np.ndarray):
        self.weights = dict(zip(terms, weights.tolist(), strict=True))
        self.thresholds = thresholds
        self._words: dict[bytes, tuple[bytes, ...]] = {}
        self._none: set[bytes] = set()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": {}, "_none": set()}

    def score(self, text: bytes) -> float:
        """w.x of a text; words seen before are kept with their terms, those without any apart."""
        known, none, weights = self._words, self._none, self.weights
        if len(known) + len(none) > CACHE_WORDS:
            known.clear()
            none.clear()
        found: set[bytes] = set()
        for w in distinct_words(text) - none:
            terms = known.get(w)
            if terms is None:
                terms = tuple(t for t in terms_of(w) if t in weights)
                if not terms:
                    none.add(w)
                    continue
                known[w] = terms
            found.update(terms)
        return sum(weights[t] for t in sorted(found))

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return sigmoid(np.asarray(scores, float)[:, None] - self.thresholds[None, :])


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, k: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the ridge-penalised cumulative-link likelihood."""
    n = max(1, len(grades))
    w, raw = np.zeros(width), np.concatenate([[2.0], np.zeros(k - 1)])
    m, v = np.zeros(width + k), np.zeros(width + k)
    at = np.arange(len(grades))
    for step in range(1, ROUNDS + 1):
        t = np.cumsum(np.concatenate([[raw[0]], np.logaddexp(0, raw[1:])]))
        s = np.bincount(rows, values * w[columns], minlength=len(grades))
        above = sigmoid(s[:, None] - t[None, :])  # P(grade >= 1..k)
        full = np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1)
        upper, lower = full[at, grades], full[at, grades + 1]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        ds = -(du - dl) / p / n
        dt = np.zeros(k)
        np.add.at(dt, np.maximum(grades - 1, 0), np.where(grades > 0, du / p, 0) / n)
        np.add.at(dt, np.minimum(grades, k - 1), np.where(grades < k, -dl / p, 0) / n)
        tail = np.cumsum(dt[::-1])[::-1]
        graw = np.concatenate([[tail[0]], tail[1:] * sigmoid(raw[1:])])
        gw = np.bincount(columns, values * ds[rows], minlength=width) + RIDGE * w
        g = np.concatenate([gw, graw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, raw = w - move[:width], raw - move[width:]
    return w, np.cumsum(np.concatenate([[raw[0]], np.logaddexp(0, raw[1:])]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled rows of each class."""
    nothing = Model([], np.zeros(0), np.full(GRADES, 20.0))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = {}
    for y in (0, 1):
        chosen |= {r["doc_id"]: y for r in usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if len({*chosen.values()}) < 2:
        return nothing
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isin([*chosen]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total: dict[bytes, list[int]] = {}
        rows = [0, 0]
        for batch in pieces_of(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                y = shared.value[doc]
                rows[y] += 1
                for t in {t for w in distinct_words(text) for t in terms_of(w)}:
                    total.setdefault(t, [0, 0])[y] += 1
        total[b""] = rows
        yield pa.record_batch([pa.array([*total], pa.binary()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1] for x in total.values()], pa.int64())], ["term", "clean", "toxic"])

    counts = own.mapInArrow(counted, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    empty = F.col("term") == F.lit(b"")
    counts = cut(counts.where(empty | (F.col("clean") + F.col("toxic") >= LEAST_ROWS)))  # read twice, counted once
    n0, n1 = counts.where(empty).select("clean", "toxic").first()
    if not n0 or not n1:
        return nothing
    share = (F.col("clean") + F.col("toxic") + 1) / (n0 + n1 + 2)
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    tied = counts.where(~empty).withColumn("z", z).where(F.abs("z") >= LEAST_Z)
    found = tied.orderBy(F.abs("z").desc(), "term").limit(TERMS).collect()
    if not found:
        return nothing
    terms = [bytes(r["term"]) for r in found]
    marks = {bytes(r["term"]) for r in found if r["z"] > 0 and not bytes(r["term"]).startswith(b"^") and r["toxic"] * n0 > 10 * r["clean"] * n1}
    place = docs.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(terms)}, marks))

    def designed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, toxic = place.value
        for batch in batches:
            grades, cells = [], []
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                words = distinct_words(text)
                hits = len(words & toxic)
                grades.append(shared.value[doc] * (1 if hits <= 1 else 2 if hits <= 3 else 3))
                cells.append([*{index[t] for w in words for t in terms_of(w) if t in index}])
            yield pa.record_batch([batch.column(0), pa.array(grades, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["doc_id", "grade", "cells"])

    design = sorted((r["doc_id"], r["grade"], sorted(r["cells"])) for r in own.mapInArrow(designed, "doc_id long, grade int, cells array<int>").toLocalIterator())
    rows = np.repeat(np.arange(len(design)), [len(c) for _, _, c in design])
    columns = np.array([x for _, _, c in design for x in c], np.int64)
    weights, thresholds = fit_ordinal(rows, columns, np.ones(len(columns)), np.array([g for _, g, _ in design]), len(terms))
    return Model(terms, weights, thresholds)


def _scores(docs: DataFrame, model: Model) -> tuple:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> np.ndarray:
        own: Model = shared.value
        return own.chances(np.array([own.score(x) for x in text_bytes(texts)]))

    return of


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, severity, toxic_probability)`` of every row."""
    chances = _scores(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in pieces_of(batches, 1):
            p = chances(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0])], ["doc_id", "severity", "toxic_probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, toxic_probability double")


def drop_toxic(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """The rows of docs with P(grade >= 1) below ``at_least``."""
    chances, names, at = _scores(docs, model), docs.columns, docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in pieces_of(batches, at):
            keep = chances(batch.column(at))[:, 0] < at_least
            yield pa.record_batch([batch.column(i) for i in range(len(names))], names).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Expected severity (0 to 3) of every document, and whether it is rejected."""
    docs = table(spark, sf_dir, "documents")
    found = severity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "severity", "toxic_probability", (F.col("toxic_probability") >= 0.5).cast("int").alias("toxic"))
