"""Substring dedup by hashing units of lines.

A unit is a line, cut further after ``.``, ``!`` or ``?`` and before a capitalised word, so that a passage pasted into
the middle of a line still gives the same units. Neighbouring units that are too short to be hashed are joined, also over
line ends, to one that ends where the hash of its last part says so, so that lists, menus and Title Case give the same
units wherever they stand. Units are normalised (A-Z lower-cased, white space collapsed) and
hashed to 128 bits. The earliest occurrence stays: the document with the smallest doc_id, and its first place there.
A later occurrence goes if it stands in an unbroken run of repeated units of ``run_words`` words or more; so whole
passages go and a stray "All rights reserved." stays. With ``lines`` (the
registered query) every later occurrence of a whole line, and so of a paragraph, goes too. Spans are code-point offsets into the original text.

Defined results: null and empty texts have no units and come back as they were; a null doc_id ranks after all others;
rows of one doc_id rank alike, so none of them is removed in favour of another; repeated units inside a text go as any
other; extra columns, whatever their names, are kept by ``dedup`` and ``dedup_documents``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelumen.llm.common import fresh, let_go, pieces_of, stored, table, text_bytes
from sitelumen.llm.decontaminate import merged_spans

#: Words of a run of repeated units from which it is removed.
RUN_WORDS = 20
#: Shorter units are not hashed by themselves but joined; what is left of them goes with the run that it stands in.
UNIT_WORDS = 3
#: A joined unit ends at one in so many of its parts, and with so many words at the latest.
JOIN_ENDS, JOIN_WORDS = 4, 16
LAST = (1 << 63) - 1


def capitals() -> bytes:
    """A pattern of one capital letter in UTF-8, up to Cyrillic and Armenian."""
    trails: dict[int, bytes] = {}
    for lead, trail in (chr(c).encode() for c in range(0xC0, 0x588) if chr(c).isupper()):
        trails[lead] = trails.get(lead, b"") + b"\\x%02x" % trail
    return b"|".join([b"[A-Z]", *(b"\\x%02x[%s]" % x for x in trails.items())])


CUT = re.compile(rb"(?<=[.!?])[ \t]+|[ \t]+(?=(?:" + capitals() + rb")[a-z\xc3-\xd6])")


def cut_lines(text: bytes) -> list[tuple[int, int, list[tuple[int, int, bytes]]]]:
    """``(start, end, units)`` of each line with a word in it; a unit is ``(start, end, normalised)``. Offsets are of bytes."""
    lines, start = [], 0
    for line in text.split(b"\n"):
        found, at = [], start
        for cut in CUT.finditer(line):
            if words := line[at - start : cut.start()].lower().split():
                found.append((at, start + cut.start(), b" ".join(words)))
            at = start + cut.end()
        if words := line[at - start :].lower().split():
            found.append((at, start + len(line), b" ".join(words)))
        if found:
            lines.append((start, start + len(line), found))
        start += len(line) + 1
    return lines


def units(text: bytes) -> list[tuple[int, int, bytes]]:
    """``(start, end, normalised)`` of each unit with a word in it, as byte offsets."""
    return joined([unit for _, _, found in cut_lines(text) for unit in found])


def whole_lines(lines: list[tuple[int, int, list[tuple[int, int, bytes]]]]) -> list[tuple[int, int, bytes]]:
    """``(start, end, normalised)`` of each line."""
    return [(s, e, b" ".join([unit for _, _, unit in found])) for s, e, found in lines]


def joined(found: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """The units with neighbouring ones of fewer than UNIT_WORDS words joined."""
    out, parts, n = [], [], 0

    def close() -> None:
        nonlocal n
        if parts:
            out.append((parts[0][0], parts[-1][1], b" ".join([x for _, _, x in parts])))
        parts.clear()
        n = 0

    for unit in found:
        words = unit[2].count(b" ") + 1
        if words >= UNIT_WORDS:
            close()
            out.append(unit)
            continue
        parts.append(unit)
        n += words
        if n >= JOIN_WORDS or (n >= UNIT_WORDS and xxhash.xxh3_64_intdigest(unit[2]) % JOIN_ENDS == 0):
            close()
    close()
    return out


def hashed_units(docs: DataFrame, lines: bool = False) -> DataFrame:
    """``(d1, d2, doc, row_key, pos)``: units of UNIT_WORDS words or more, once per text, and whole lines at -1, -2, ... if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        digest = xxhash.xxh3_128_digest
        for batch in pieces_of(batches, 2):
            ids, keys, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), text_bytes(batch.column(2))
            made, counts, places = [], [], []
            for text in texts:
                seen: dict[bytes, int] = {}
                own = cut_lines(text)
                for pos, (_, _, unit) in enumerate(joined([unit for _, _, found in own for unit in found])):
                    if unit.count(b" ") + 1 >= UNIT_WORDS:
                        seen.setdefault(unit, pos)
                for pos, (_, _, line) in enumerate(whole_lines(own) if lines else ()):
                    seen.setdefault(b"\n" + line, -1 - pos)
                made += map(digest, seen)
                places += seen.values()
                counts.append(len(seen))
            pairs = np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.repeat(ids, counts)), pa.array(np.repeat(keys, counts)), pa.array(places, pa.int32())], ["d1", "d2", "doc", "row_key", "pos"])

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")
    return docs.select(doc, F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, "d1 long, d2 long, doc long, row_key long, pos int")


def repeated_units(docs: DataFrame, lines: bool = False) -> DataFrame:
    """``(row_key, places)``: the units of a text that an earlier document has too.

    Units are hashed once and written. The first document of each digest comes from a partially aggregated group-by; units
    are then joined to the digests of two documents or more. A line in a third of all documents is one aggregated row,
    and on the side of the units a skewed join that Spark splits.
    """
    made = stored(hashed_units(docs, lines))
    first = made.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    later = made.join(first, ["d1", "d2"]).where("doc > first")
    return later.groupBy("row_key").agg(F.collect_set("pos").alias("places"))


def removed_spans(text: bytes, places: set[int], run_words: int = RUN_WORDS, lines: bool = False) -> tuple[list[tuple[int, int]], int]:
    """Byte spans of the runs (and repeated whole lines if asked) to remove, and the number of units in them."""
    own_lines = cut_lines(text)
    found, spans, count = joined([unit for _, _, own in own_lines for unit in own]), [], 0
    seen: set[bytes] = set()
    run: list[tuple[int, int]] = []  # of (unit, words)
    pending: list[tuple[int, int]] = []  # short units that go only if the run goes on

    def close() -> None:
        nonlocal count
        if sum(w for _, w in run) >= run_words:
            spans.append((found[run[0][0]][0], found[run[-1][0]][1]))
            count += len(run)
        run.clear()
        pending.clear()

    repeated_text = {found[p][2] for p in places if 0 <= p < len(found)}
    for pos, (_, _, unit) in enumerate(found):
        words = unit.count(b" ") + 1
        if words < UNIT_WORDS:
            if run:
                pending.append((pos, words))
            continue
        if unit in repeated_text or unit in seen:
            run += [*pending, (pos, words)]
            pending.clear()
        else:
            close()
        seen.add(unit)
    close()
    if lines:
        own, met = whole_lines(own_lines), set()
        repeated = {own[-1 - p][2] for p in places if -len(own) <= p < 0}
        for s, e, line in own:
            if line in repeated or line in met:
                spans.append((s, e))
            met.add(line)
        spans = merged_spans(spans)
        starts, ends = [s for s, _, _ in found], [e for _, e, _ in found]
        count = sum(bisect_left(starts, e) - bisect_right(ends, s) for s, e in spans)
    return spans, count


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans and the blanks or line end after each."""
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
        while at < len(text) and text[at : at + 1] in b" \t":
            at += 1
        if text[at : at + 1] == b"\n" and (s == 0 or text[s - 1 : s] == b"\n"):
            at += 1
    return b"".join([*out, text[at:]])


def code_points(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans, in order and apart, as spans of code points; the text is decoded once."""
    out, at, n = [], 0, 0
    for s, e in spans:
        start = n + len(text[at:s].decode())
        at, n = e, start + len(text[s:e].decode())
        out.append((start, n))
    return out


def dedup(docs: DataFrame, run_words: int = RUN_WORDS, lines: bool = False) -> DataFrame:
    """All columns of docs (``text`` without repeated passages, ``n_chars`` renewed if there is one), ``removed_spans`` and ``removed_units``.

    Where docs has columns of the last two names, the new ones get underscores in front.
    """
    names, at, spans, count = docs.columns, docs.columns.index("text"), fresh(docs, "removed_spans"), fresh(docs, "removed_units")
    own, row_key, known = [F.col(f"`{c}`") for c in names], fresh(docs, "row_key"), fresh(docs, "places")
    places = repeated_units(docs.select("doc_id", "text"), lines).select(F.col("row_key").alias(row_key), F.col("places").alias(known))
    whole = docs.select(*own, F.xxhash64("doc_id", "text").alias(row_key)).join(places, row_key, "left").select(*own, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, at):
            texts = batch.column(at)
            out, all_spans, counts = [], [], []
            for raw, text, places in zip(texts, text_bytes(texts), batch.column(len(names)).to_pylist(), strict=True):
                found, n = removed_spans(text, set(places or ()), run_words, lines)
                out.append((None if not raw.is_valid else without(text, found).decode() if found else raw.as_py()))
                all_spans.append([{"start": s, "end": e} for s, e in code_points(text, found)])
                counts.append(n)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, texts.type)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([*columns, pa.array(all_spans, span), pa.array(counts, pa.int32())], [*names, spans, count])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    made = whole.mapInArrow(run, f"{schema}, `{spans}` array<struct<start:bigint,end:bigint>>, `{count}` int")
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else made


def dedup_documents(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """The rows of docs, each text without the passages that an earlier document has."""
    return dedup(docs, run_words).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's text after dedup of whole lines and of runs of units, with the removed spans as ``start-end`` in the original text."""
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), lines=True)
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), "removed_units", spans.alias("removed_spans"))
