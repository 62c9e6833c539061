"""Source divergence audit: sketch-prefiltered exact term counts, then sparse joins of pairs of sources.

1. Every task adds the document frequencies of its (language, term) pairs to a count-min sketch; the tasks' sketches are
   merged by slices of cells. A sketch never says less than the truth, so a term with a cell below the least number of
   documents cannot be kept and is not counted at all. What goes to the tasks is one bit a cell, whatever the table.
2. The terms that are left are counted exactly by language, source and term, added up in each task first.
3. Pairs of sources are compared over the terms that occur in either: those of one source alone by how many have each
   count, those of both by a join on the term, and the terms of neither, which all have one value, by their number.

The sketch's width changes only how many terms are counted in vain, never a row of the result.

Defined results: null text, language and source are read as ``''``; a text without terms adds its group and a document
without terms; texts of any length are read whole, in slices; repeated rows are documents of their own; groups without
kept terms have pairs but no terms; a language with one source has no pairs; ties are ordered by the item's UTF-8 bytes; an
empty table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelumen.llm.common import cut, pieces_of, stored, table, text_bytes

#: Bytes of a term: letters and everything that is not ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Rows and cells a row of the sketch, and cells that are merged in one group.
DEPTH, WIDTH, SLICE = 2, 1 << 22, 1 << 16
#: Entries that a task holds before it sends them on (twice as many counts, which have no second table), and bytes of a text that are taken apart at once.
HELD, TEXT_BYTES = 200_000, 1 << 22
UNIT = 1_000_000_000


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The text's lower-cased terms, in order, some at a time."""
    start = 0
    while len(text) - start > TEXT_BYTES:
        inside = TERM.match(text, start + TEXT_BYTES - 1)  # never cut inside a term
        end = inside.end() if inside else start + TEXT_BYTES
        yield TERM.findall(text[start:end].lower())
        start = end
    yield TERM.findall(text[start:].lower())


def cells(lang: bytes, terms: list[bytes], width: int) -> np.ndarray:
    """The cell of each term in each row of the sketch."""
    seed = xxhash.xxh64_intdigest(lang)
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in terms), np.uint64, len(terms))
    rows = [hashes, (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)]
    return np.stack([((x >> np.uint64(32)) % np.uint64(width)).astype(np.int64) for x in rows])


def task_sketches(docs: DataFrame, least: int, width: int) -> DataFrame:
    """``(part, counts)``: slices of each task's sketch that are not empty; counts stop at ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held = np.zeros((DEPTH, width), np.uint8), defaultdict(Counter)
        full: dict[bytes, set[bytes]] = defaultdict(set)  # terms whose cells have all stopped, which would add nothing

        def add() -> None:
            if sum(map(len, full.values())) > HELD:
                full.clear()
            for lang, found in held.items():
                terms, counts = list(found), np.fromiter(found.values(), np.int64, len(found))
                at = cells(lang, terms, width)
                for row, own in zip(sketch, at, strict=True):
                    used, of = np.unique(own, return_inverse=True)
                    row[used] = np.minimum(least, row[used] + np.bincount(of, np.minimum(counts, least)).astype(np.int64))
                stopped = np.logical_and.reduce([row[own] >= least for row, own in zip(sketch, at, strict=True)])
                full[lang].update(terms[i] for i in np.flatnonzero(stopped).tolist())
            held.clear()

        most = HELD // 8  # the first terms are the common ones, which need not be held any longer
        for batch in pieces_of(batches, 0):
            for text, lang in zip(text_bytes(batch.column(0)), text_bytes(batch.column(1)), strict=True):
                terms = set()
                for some in term_lists(text):
                    terms.update(some)
                held[lang].update(terms - full[lang])
            if sum(map(len, held.values())) > most:
                add()
                most = HELD
        add()
        slices = sketch.reshape(-1, min(SLICE, width))
        full = np.flatnonzero(slices.any(axis=1))
        for i in full.tolist():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([slices[i].tobytes()], pa.binary())], ["part", "counts"])

    return docs.select("text", "lang").mapInArrow(run, "part int, counts binary")


def merged_sketch(docs: DataFrame, least: int, width: int = WIDTH) -> np.ndarray:
    """``DEPTH`` rows of ``width`` booleans: whether a cell has ``least`` documents or more.

    Slices are added up on the executors; a bit a cell reaches the driver, ``DEPTH * width / 8`` bytes for any table.
    """
    size = min(SLICE, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(size, np.int64)

        def bits() -> pa.RecordBatch:
            return pa.record_batch([pa.array([last], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != last:
                    if last is not None:
                        yield bits()
                    last, total = part, np.zeros(size, np.int64)
                total += np.frombuffer(counts.as_buffer(), np.uint8)
        if last is not None:
            yield bits()

    parts = DEPTH * width // size
    dealt = task_sketches(docs, least, width).repartition(parts, "part").sortWithinPartitions("part")
    passing = np.zeros((parts, size), bool)
    for r in dealt.mapInArrow(run, "part int, bits binary").collect():
        passing[r["part"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=size).astype(bool)
    return passing.reshape(DEPTH, width)


def candidate_counts(docs: DataFrame, passing: np.ndarray) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of the terms that the sketch lets pass, by task; a null term stands for the group itself.

    ``docs`` adds up to a term's documents over all rows of its language, whatever their sources.
    """
    width = passing.shape[1]
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(passing, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.unpackbits(x, count=width).astype(bool) for x in sent.value]
        held: dict[tuple[bytes, bytes], Counter] = {}
        seen: dict[bytes, Counter] = defaultdict(Counter)
        verdicts: dict[bytes, dict[bytes, bool]] = defaultdict(dict)

        def passes(lang: bytes, found: Counter) -> list[bytes]:
            known = verdicts[lang]
            new = [x for x in found if x not in known]
            if new:
                at = cells(lang, new, width)
                known.update(zip(new, np.logical_and.reduce([row[x] for row, x in zip(rows, at, strict=True)]).tolist(), strict=True))
            return [x for x in found if known[x]]

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                kept, documents = passes(lang, found), seen[lang]
                n = len(kept) + 1
                columns = [pa.array([lang] * n, pa.binary()), pa.array([source] * n, pa.binary()), pa.array([None, *kept], pa.binary())]
                columns = [x.cast(pa.string()) for x in columns]
                yield pa.record_batch([*columns, pa.array([0, *(found[x] for x in kept)], pa.int64()), pa.array([0, *(documents.pop(x, 0) for x in kept)], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()
            seen.clear()
            if sum(map(len, verdicts.values())) > HELD:
                verdicts.clear()

        for batch in pieces_of(batches, 0):
            for text, lang, source in zip(*map(text_bytes, batch.columns), strict=True):
                found = held.setdefault((lang, source), Counter())
                terms = set()
                for some in term_lists(text):
                    found.update(some)
                    terms.update(some)
                seen[lang].update(terms)
            if sum(map(len, held.values())) > 2 * HELD:
                yield from out()
        yield from out()

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), by decimals, whose whole division is exact."""
    wide = lambda x: x.cast("decimal(28,0)")
    return F.lit(1) + F.call_function("div", wide(n + 2) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + 2 * terms))


def unlike(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_values(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """``(lang, source, other, value)`` of every ordered pair of a language's sources.

    ``groups(lang, source, total, terms, used, floor)``: occurrences, kept terms of the language, those that the source has,
    and the share of a term that it doesn't have. ``counts(lang, source, term, n, p)``.
    """
    pair = groups.alias("x").join(groups.alias("y"), (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") != F.col("y.source")))
    pairs = pair.select("x.lang", "x.source", F.col("y.source").alias("other"), F.col("x.terms").alias("terms"), (F.col("x.used") + F.col("y.used")).alias("used"), F.col("x.floor").alias("xf"), F.col("y.floor").alias("yf"))
    # A source's own terms against what the other has for a term that it lacks: as many sums as there are distinct counts.
    spread = counts.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    lone = spread.join(groups.select("lang", F.col("source").alias("other"), "floor"), "lang").where("source <> other")
    lone = lone.groupBy("lang", "source", "other").agg(F.sum(F.col("m") * unlike(F.col("p"), F.col("floor"))).alias("own"))
    own = counts.join(groups.select("lang", "source", "floor"), ["lang", "source"]).select("lang", "term", "source", "p", "floor")
    both = own.alias("x").join(own.alias("y"), (F.col("x.lang") == F.col("y.lang")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.source") < F.col("y.source")))
    more = unlike(F.col("x.p"), F.col("y.p")) - unlike(F.col("x.p"), F.col("y.floor")) - unlike(F.col("y.p"), F.col("x.floor"))
    both = both.groupBy(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(more).alias("shared"), F.count("*").alias("common"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("other")), F.struct(F.col("b").alias("source"), F.col("a").alias("other")))
    both = both.select("lang", F.inline(ways), "shared", "common")
    key = ["lang", "source", "other"]
    back = lone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("own").alias("theirs"))
    met = pairs.join(lone, key, "left").join(back, key, "left").join(both, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    neither = F.col("terms") - F.col("used") + zero("common")
    value = zero("own") + zero("theirs") + zero("shared") + neither * unlike(F.col("xf"), F.col("yf"))
    return met.select(*key, F.when(F.col("terms") == 0, F.lit(0)).otherwise(value).cast("long").alias("value"))


def divergence(docs: DataFrame, least: int = 10, top: int = 10, width: int = WIDTH) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source's use of terms lies from the other sources' and from its language's."""
    named = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    tasks = candidate_counts(named, merged_sketch(named, least, width))
    counts = cut(tasks.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least).drop("docs")
    terms = cut(terms)
    sums = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    kept = counts.where("term IS NOT NULL AND n > 0").join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "all")
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    groups = counts.where("term IS NULL").select("lang", "source").join(used, ["lang", "source"], "left").join(sums, "lang", "left").fillna(0)
    groups = cut(groups.withColumn("floor", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1)).cast("long")))
    sized = stored(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms")).cast("long").alias("p"), share(F.col("all"), F.col("lang_total"), F.col("terms")).cast("long").alias("q")))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, sized).withColumnRenamed("other", "item").withColumn("rank", F.row_number().over(place))
    single = sized.where("p > q").select("lang", "source", F.col("term").alias("item"), unlike(F.col("p"), F.col("q")).cast("long").alias("value")).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(single.withColumn("part", F.lit("term")).select(columns))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Pair and term values of every (lang, source) group of documents."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS MATERIALIZED (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 10),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
    SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * v.v)::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.total + 2 * v.v)::HUGEINT AS q
    FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
