"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A document is a vector of hashed byte trigrams (log counts times inverse document frequency) and of shape terms (shares
of upper case, of marks, of adjacent repeats and of repeated words, in steps). The labelled sample's truncated singular
vectors span the latent space; the labelled vectors there are broadcast, every document is projected, its exact cosines
to all of them are computed block by block, and its NEIGHBOURS nearest vote with their similarity as weight.

The sample is bounded by SAMPLE rows a class (those with the smallest hash of their doc_id), which bounds the broadcast;
labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts have a zero vector and get the sample's share of label 1; texts are used whole;
without any label every score is 0.5; rows are scored one by one, so repeats and ties do not matter; extra columns are
ignored; a null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelumen.llm.common import table, text_bytes

HASHED, RATIOS, STEPS = 4096, 5, 8
WIDTH = HASHED + RATIOS * STEPS
RANK, NEIGHBOURS, SAMPLE = 64, 15, 2048
SHAPE_WEIGHT, SHARPNESS, BLOCK = 0.35, 4, 512
THRESHOLD = 0.3
#: Bytes of a text handled at once.
CHUNK = 1 << 20

_MARKS = np.array([33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in range(256)])
_COMMON = np.array([chr(c) in ".,;:'\"-?()" for c in range(256)])


def term_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed trigrams, then the shape terms (0 or 1)."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), CHUNK):
        a = raw[at : at + CHUNK + 2].astype(np.uint32)
        if len(a) > 2:
            code = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA6B)) ^ (a[2:] * np.uint32(0xC2B2AE35))
            code *= np.uint32(0x27D4EB2F)
            out[:HASHED] += np.bincount(code >> np.uint32(20), minlength=HASHED)
    kinds = np.bincount(raw, minlength=256)
    words = text.split()
    upper, lower = int(kinds[65:91].sum()), int(kinds[97:123].sum())
    letters = max(1, upper + lower)
    total = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ratios = (
        upper / letters,
        int(kinds[_MARKS & ~_COMMON].sum()) / len(raw) * 5,
        sum(map(bytes.__eq__, words, words[1:])) / total,
        1 - len(set(words)) / total,
        1 - len(set(lines)) / max(1, len(lines)),
    )
    for i, x in enumerate(ratios):
        out[HASHED + i * STEPS : HASHED + i * STEPS + min(STEPS, round(x * STEPS))] = 1
    return out


class Model:
    """Latent space and labelled vectors; at most 2 * SAMPLE rows of RANK numbers and a WIDTH by RANK projection."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.labels = labels.astype(np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        n = max(1, len(counts))
        self.idf = np.log((1 + n) / (1 + (counts[:, :HASHED] > 0).sum(axis=0))).astype(np.float32) + 1 if len(counts) else np.ones(HASHED, np.float32)
        x = self.weighted(counts)
        rng = np.random.default_rng(0)
        basis = rng.standard_normal((len(x), min(rank + 16, max(1, len(x))))).astype(np.float32)
        for _ in range(4):
            basis, _ = np.linalg.qr(x @ (x.T @ basis)) if len(x) else (basis, None)
        _, _, rows = np.linalg.svd(basis.T @ x, full_matrices=False) if len(x) else (None, None, np.zeros((0, WIDTH), np.float32))
        self.projection = np.ascontiguousarray(rows[:rank].T.astype(np.float32))
        self.vectors = self.latent(x)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = counts.astype(np.float32)
        x[:, :HASHED] = np.log1p(x[:, :HASHED]) * self.idf
        x[:, :HASHED] /= np.maximum(np.linalg.norm(x[:, :HASHED], axis=1, keepdims=True), 1e-9)
        x[:, HASHED:] *= SHAPE_WEIGHT
        return x

    def latent(self, weighted: np.ndarray) -> np.ndarray:
        z = weighted @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        out = np.empty(len(counts))
        for at in range(0, len(counts), BLOCK):
            part = counts[at : at + BLOCK]
            cosine = self.latent(self.weighted(part)) @ self.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            last = np.partition(cosine, -k, axis=1)[:, -k]
            rows, near = np.nonzero(cosine >= last[:, None])  # all that tie with the last neighbour vote
            weight = np.maximum(cosine[rows, near], 0).astype(np.float64) ** SHARPNESS
            total = np.bincount(rows, weight, len(part))
            vote = np.bincount(rows, weight * self.labels[near], len(part)) / np.maximum(total, 1e-12)
            empty = (part.sum(axis=1) == 0) | (total <= 1e-12)
            out[at : at + BLOCK] = np.clip(np.where(empty, self.prior, vote), 0, 1)
        return out


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled rows of each class, none of them held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = {}
    for y in (0, 1):
        chosen |= {r["doc_id"]: y for r in usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [term_counts(x).tobytes() for x in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "counts"])

    if not chosen:
        return Model(np.zeros((0, WIDTH), np.float32), np.zeros(0))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isin([*chosen]))
    rows = sorted((r["doc_id"], bytes(r["counts"])) for r in own.mapInArrow(run, "doc_id long, counts binary").toLocalIterator())
    counts = np.array([np.frombuffer(c, np.float32) for _, c in rows]).reshape(-1, WIDTH)
    return Model(counts, np.array([chosen[d] for d, _ in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in batches:
            texts, scores = text_bytes(batch.column(1)), []
            for at in range(0, len(texts), BLOCK):
                scores.append(own.scores(np.stack([term_counts(x) for x in texts[at : at + BLOCK]])))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
