"""Document scoring by cross-entropy difference of two n-gram models.

Target and background are bigram models over one vocabulary (the ids of a public tokenizer) with the same order and
smoothing. The target's training text are the documents labelled of good quality, the background's all others. Both are
matched in size: the counts of the larger side are scaled down to as many tokens as the smaller one has, so smoothing
weighs the same in both, and still every document counts. A document's score is its loss a token under the target model
minus that under the background model, so lower means closer to the target.

P(w | h) = (c(h, w) + MASS * P(w)) / (c(h) + MASS) and P(w) = (c(w) + ADDED) / (N + ADDED * tokens), with scaled counts c;
both sum to one. Each document is tokenised once and kept as ids. Bigram counts are exact: each partition counts its own
and a group-by sums them. The table of counts stays distributed and grows with the corpus: only its frequent bigrams,
those of more than one in HEAVY of all tokens and so fewer than HEAVY, are broadcast, with the counts of single tokens.
A document's other bigrams are joined to the table; as none of them is frequent, no key of that join is hot.

Defined results: null and empty texts are the end token alone; texts are scored whole; without target documents (or
without others) both models are of all documents; repeated rows count and are scored each; a null doc_id is no target;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelumen.llm.common import cut, pieces_of, table, text_bytes
from sitelumen.llm.packing import cache_of, default_tokenizer

VOCABULARY = 49_408
#: Id that opens and closes a document; all ids fit 16 bits.
EDGE = VOCABULARY
#: Tokens' worth of the single-token estimate in each context, and what is added to each token's count.
MASS, ADDED = 4.0, 0.5
#: Tokens handled at once.
CHUNK = 1 << 20
#: Codes from here on are single tokens.
TOKENS = (VOCABULARY + 1) ** 2
#: Distinct codes that a partition holds before it emits them.
HELD = 1 << 22
#: A bigram of more than one in so many tokens is broadcast.
HEAVY = 1 << 20


def codes_of(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A number of each bigram, and of no other."""
    return before * (VOCABULARY + 1) + after


def tokenised(docs: DataFrame, tokenizer: str, target: DataFrame | None = None) -> DataFrame:
    """``(row, doc_id, is_target, ids)`` of every row, written once; ids are 16-bit numbers that end with EDGE.

    ``target`` has the doc_id of the target documents.
    """
    edge = np.array([EDGE], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(tokenizer)
        for batch in pieces_of(batches, 1):
            ids = [np.frombuffer(cache.ids(x), "<u4").astype("<u2").tobytes() + edge for x in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")
    if target is None:
        rows = rows.withColumn("is_target", F.lit(False))
    else:
        # Rows without an id are dealt out by their text and match none. Merged at every size, as targets grow with the corpus.
        good = target.select(F.col("doc_id").cast("long").alias("good")).where("good IS NOT NULL").distinct()
        rows = rows.withColumn("own", F.coalesce("doc_id", F.xxhash64("ids")))
        rows = rows.hint("merge").join(good, (F.col("own") == F.col("good")) & F.col("doc_id").isNotNull(), "left").withColumn("is_target", F.col("good").isNotNull())
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "is_target", "ids"))


def token_groups(ids: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of whole documents as (token before, token, place of each document's first token)."""
    group, size = [], 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) // 2 for x in group])
        after = np.frombuffer(b"".join(group), "<u2").astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[starts] = EDGE
        return before, after, starts

    for x in ids:
        group.append(x)
        size += len(x) // 2
        if size >= CHUNK:
            yield made()
            group, size = [], 0
    if group:
        yield made()


def counted(tokens: DataFrame) -> DataFrame:
    """``(code, background, target)``; codes below TOKENS are bigrams, then single tokens."""

    def summed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return codes, *(np.bincount(at, np.concatenate([x[k] for x in held]), len(codes)).astype(np.int64) for k in (1, 2))

    def rows(held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(held[0]), 100_000):
            yield pa.record_batch([pa.array(x[i : i + 100_000]) for x in held], ["code", "background", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            ids, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in (False, True):
                for before, after, _ in token_groups([x for x, t in zip(ids, own, strict=True) if t == k]):
                    for codes in (codes_of(before, after), after + TOKENS):
                        codes, n = np.unique(codes, return_counts=True)
                        held.append((codes, n * (not k), n * k))
                        waiting += len(codes)
            if waiting > HELD:
                held = [summed(held)]
                waiting = len(held[0][0])
                if waiting > HELD // 2:
                    yield from rows(held[0])
                    held, waiting = [], 0
        if held:
            yield from rows(summed(held))

    parts = tokens.select("ids", "is_target").mapInArrow(run, "code long, background long, target long")
    return parts.groupBy("code").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class Side:
    """One model's counts of single tokens and the scale of its counts."""

    def __init__(self, tokens: np.ndarray, size: float):
        self.scale = size / max(1.0, float(tokens.sum()))
        self.tokens = tokens * self.scale
        self.single = (self.tokens + ADDED) / (self.tokens.sum() + ADDED * len(tokens))

    def losses(self, before: np.ndarray, after: np.ndarray, pairs: np.ndarray | float = 0.0) -> np.ndarray:
        """-log P(after | before) where the bigram was counted ``pairs`` times."""
        return np.log(self.tokens[before] + MASS) - np.log(self.scale * pairs + MASS * self.single[after])


@dataclass
class Model:
    """Both sides, and ``gains(code, target, background)``: how much less a counted bigram's losses are than an uncounted one's.

    ``heavy`` has the same of the frequent bigrams, sorted by code.
    """

    target: Side
    background: Side
    gains: DataFrame
    heavy: tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(tokens: DataFrame) -> Model:
    """The model of the rows of ``tokenised``."""
    counts = cut(counted(tokens))
    single = counts.where(F.col("code") >= TOKENS).toArrow()  # one row a token of the vocabulary at most
    sides = {}
    for name in ("target", "background"):
        sides[name] = np.zeros(VOCABULARY + 1)
        sides[name][single.column("code").to_numpy() - TOKENS] = single.column(name).to_numpy()
    total = sum(float(x.sum()) for x in sides.values())
    mixed = not sides["target"].any() or not sides["background"].any()
    if mixed:
        sides = dict.fromkeys(sides, sides["target"] + sides["background"])
    size = min(x.sum() for x in sides.values())
    target, background = (Side(sides[name], size) for name in ("target", "background"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, of = batch.column(0).to_numpy(), {"background": batch.column(1).to_numpy(), "target": batch.column(2).to_numpy()}
            if mixed:
                of = dict.fromkeys(of, of["background"] + of["target"])
            before, after = codes // (VOCABULARY + 1), codes % (VOCABULARY + 1)
            gained = [side.losses(before, after) - side.losses(before, after, of[name]) for name, side in (("target", target), ("background", background))]
            yield pa.record_batch([batch.column(0), pa.array(sum((batch.column(1).to_numpy(), batch.column(2).to_numpy()))), *map(pa.array, gained)], ["code", "n", "target", "background"])

    gains = cut(counts.where(F.col("code") < TOKENS).mapInArrow(run, "code long, n long, target double, background double"))
    frequent = F.col("n") * HEAVY > total
    heavy = gains.where(frequent).select("code", "target", "background").toArrow()  # fewer than HEAVY rows
    order = np.argsort(heavy.column("code").to_numpy())
    return Model(target, background, gains.where(~frequent).drop("n"), tuple(heavy.column(c).to_numpy()[order] for c in ("code", "target", "background")))


def score(tokens: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)`` of every row of ``tokenised``."""
    shared = tokens.sparkSession.sparkContext.broadcast((model.target, model.background, model.heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, background, (heavy, *gains) = shared.value
        names = ["row", "doc_id", "code", "n", "target", "background"]
        for batch in batches:
            at = 0
            for before, after, starts in token_groups(batch.column(2).to_pylist()):
                codes = codes_of(before, after)
                places = np.minimum(np.searchsorted(heavy, codes), max(0, len(heavy) - 1))
                known = heavy[places] == codes if len(heavy) else np.zeros(len(codes), bool)
                own = [side.losses(before, after) for side in (target, background)]
                for losses, gain in zip(own, gains, strict=True):
                    losses[known] -= gain[places[known]]
                rows, ids = batch.column(0).slice(at, len(starts)), batch.column(1).slice(at, len(starts))
                at += len(starts)
                # A document's own row has a code of its own, so that it meets nothing and is dealt out evenly.
                whole = [pa.array(np.add.reduceat(x, starts)) for x in own]
                yield pa.record_batch([rows, ids, pa.array(-1 - rows.to_numpy()), pa.array(np.diff(np.append(starts, len(after)))), *whole], names)
                doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(after))))[~known]
                rest = codes[~known]
                order = np.lexsort((rest, doc))
                doc, rest = doc[order], rest[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1])]) if len(doc) else np.empty(0, np.int64)
                zero = pa.array(np.zeros(len(first)))
                yield pa.record_batch([pa.array(rows.to_numpy()[doc[first]]), pa.nulls(len(first), pa.int64()), pa.array(rest[first]), pa.array(np.diff(np.append(first, len(doc)))), zero, zero], names)

    parts = tokens.select("row", "doc_id", "ids").mapInArrow(run, "row long, doc_id long, code long, n long, target double, background double")
    gains = model.gains.select(F.col("code").alias("known"), F.col("target").alias("less_target"), F.col("background").alias("less_background"))
    met = parts.hint("merge").join(gains, F.col("code") == F.col("known"), "left")
    sums = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum(F.when(F.col("code") < 0, F.col("n"))).alias("n_tokens"),
        *[F.sum(F.col(x) - F.col("n") * F.coalesce(f"less_{x}", F.lit(0.0))).alias(x) for x in ("target", "background")],
    )
    losses = sums.select("doc_id", "n_tokens", *[(F.col(x) / F.col("n_tokens")).alias(f"{x}_loss") for x in ("target", "background")])
    return losses.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document: the documents labelled of good quality against all others."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    tokens = tokenised(table(spark, sf_dir, "documents"), default_tokenizer(), good)
    return score(tokens, fit(tokens))
