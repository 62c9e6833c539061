"""Each operator against brute force, and on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitelumen.llm import decontaminate as D
from sitelumen.llm import lm_scoring as L
from sitelumen.llm import packing as K
from sitelumen.llm import quality as Q
from sitelumen.llm import sharding as X
from sitelumen.llm import simhash as H
from sitelumen.llm import spotsigs as S
from sitelumen.llm import substring_dedup as B
from sitelumen.llm import toxicity as T
from sitelumen.llm import url_filter as U
from sitelumen.llm.components import connected_components

#: Columns that operators could use inside.
CLASHES = "start bucket part cell fp row_key __row_key digest keys key places __places spans __spans __units hash __hash bytes __bytes __depth __shard __page __cell row ids code own good is_target __hits hits weight bits".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ra se ti vo nu lm pa qe xi zo".split()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(("", "", "n", "st"))
        out.append(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w)
    return " ".join(out)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in rows], SCHEMA)


LONG = prose(99, 60_000)
EDGES = [(1, prose(1, 120)), (2, prose(1, 120)), (2, prose(1, 120)), (3, None), (None, prose(3, 80)), (4, ""), (5, "\n \t"), (6, LONG), (7, "One"), (8, prose(8, 40) + "\n" + prose(8, 40)), (None, None)]


@pytest.fixture(scope="module")
def edges(spark):
    return docs_of(spark, EDGES).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs_of(spark, []).repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (99, 1, 1), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")


# --- 1 ---


def test_substring_dedup_removes_passages_and_keeps_offsets(spark):
    passage = prose(50, 60).replace(prose(50, 60).split()[0], "Passage", 1) + "."
    a, b, c = prose(10, 50) + " " + passage + " " + prose(11, 50), prose(12, 30) + "\n" + passage + "\n" + prose(13, 30), prose(14, 70)
    rows = {r["doc_id"]: r for r in B.dedup(docs_of(spark, [(3, b), (1, a), (2, c)])).collect()}
    assert rows[1]["text"] == a and rows[2]["text"] == c and not rows[2]["removed_spans"]
    (span,) = rows[3]["removed_spans"]
    assert set(passage.split()[10:50]) <= set(b[span["start"] : span["end"]].split()) and passage not in rows[3]["text"]
    assert rows[3]["n_chars"] == len(rows[3]["text"])


@pytest.mark.parametrize("lines", [False, True])
def test_substring_dedup_against_brute_force(spark, lines):
    """The rule written anew on str: units are lines cut after a stop and before a capital, here all of three words or more."""
    parts = [prose(200 + i, 30).capitalize() + "." for i in range(12)] + ["All rights reserved here.", "Visit our pages again today"]
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(parts) if rng.random() < 0.5 else prose(1000 + i * 7 + k, 12) for k in range(5))) for i in range(30)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["removed_spans"]] for r in B.dedup(docs_of(spark, rows), lines=lines).collect()}
    known: set[str] = set()
    known_lines: set[str] = set()
    for i, text in rows:
        gone, units, at = [False] * len(text), [], 0
        for line in text.split("\n"):
            starts = [0, *(m.end() for m in re.finditer(r"(?<=[.!?]) +| +(?=[A-Z][a-z])", line)), len(line) + 1]
            units += [(at + s, at + s + len(line[s : e - 1].rstrip())) for s, e in zip(starts, starts[1:], strict=False) if line[s : e - 1].strip()]
            at += len(line) + 1
        words = [text[s:e].lower().split() for s, e in units]
        assert all(len(w) >= 3 for w in words)
        repeated = [" ".join(w) in known or w in words[:k] for k, w in enumerate(words)]
        k = 0
        while k < len(units):
            end = k
            while end < len(units) and repeated[end]:
                end += 1
            if sum(map(len, words[k:end])) >= 20:
                gone[units[k][0] : units[end - 1][1]] = [True] * (units[end - 1][1] - units[k][0])
            k = max(end, k + 1)
        own_lines, at = [" ".join(x.lower().split()) for x in text.split("\n")], 0
        for n, line in enumerate(text.split("\n")):
            if lines and (own_lines[n] in known_lines or own_lines[n] in own_lines[:n]):
                gone[at : at + len(line)] = [True] * len(line)
            at += len(line) + 1
        known |= {" ".join(w) for w in words}
        known_lines |= set(own_lines)
        want = [m.span() for m in re.finditer("x+", "".join("x" if g else "." for g in gone))]
        assert got[i] == want, i
    assert any(got.values())


def test_substring_dedup_finds_passages_of_short_units(spark):
    rng = random.Random(8)
    words = [rng.choice(WORDS) + rng.choice(("", "n", "st")) for _ in range(80)]
    shapes = ["\n".join(words), " ".join(w.capitalize() for w in words), " ".join(w + "!!" for w in words), "\n".join(f"{a} {b}" for a, b in zip(words[::2], words[1::2], strict=True))]
    for passage in shapes:
        after = "Xy Ab Cd " + passage + "\n" + prose(71, 40)
        rows = [(1, passage), (2, passage), (3, after), (4, prose(72, 40) + "\n" + passage)]
        got = {r["doc_id"]: r["text"] for r in B.dedup(docs_of(spark, rows)).collect()}
        assert got[1] == passage and got[2] == ""
        assert all(len(set(re.findall(r"\w+", got[i].lower())) & set(words) - set(re.findall(r"\w+", prose(70 + n, 40).lower()))) < 24 for i, n in ((3, 1), (4, 2)))


def test_substring_dedup_query_removes_every_repeated_line(spark, tmp_path):
    line, licence = "All rights reserved here.", "See LICENSE"
    rows = [(1, f"{prose(61, 30)}\n{line}\n{licence}"), (2, f"{line}\n{prose(62, 30)}\n{licence}\n{prose(63, 30)}"), (3, f"{prose(64, 30)} {line}\nx\n{prose(65, 30)}\nx"), (4, None)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in B.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[1]["text"] == rows[0][1] and got[4]["text"] is None
    assert got[2]["text"] == f"{prose(62, 30)}\n{prose(63, 30)}"
    assert got[3]["text"].rstrip("\n") == rows[2][1][:-2]  # a repeat inside a line is no whole line
    assert got[2]["removed_spans"].startswith(f"0-{len(line)},") and got[1]["removed_units"] == 0


def test_substring_dedup_offsets_of_a_long_text_with_many_spans():
    text = "çığ ok. \U0001f600 ".encode() * 200_000
    step = len(text) // 200_000
    spans = [(k * step, k * step + 7) for k in range(200_000)]
    got = B.code_points(text, spans)
    assert got[:2] == [(0, 4), (10, 14)] and got[-1] == (1_999_990, 1_999_994) and len(text.decode()) == 2_000_000
    assert B.code_points(text, []) == []


def test_substring_dedup_edges(edges, nothing):
    rows = B.dedup_documents(edges).collect()
    assert len(rows) == len(EDGES) and {r["text"] for r in rows if r["doc_id"] == 3} == {None}
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [prose(1, 120)] and all(r["text"] == "" for r in rows if r["doc_id"] == 2)
    assert [r["text"] for r in rows if r["doc_id"] == 8] != [EDGES[9][1]]  # a passage repeated in one text goes too
    assert B.dedup_documents(nothing).count() == 0 and B.dedup_documents(edges).columns == edges.columns


# --- 2 ---


def test_packing_exact(spark, edges, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(K.default_tokenizer())
    rows = K.pack(edges).collect()
    want = []
    for i, t in EDGES:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((str(i), k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert K.pack(nothing).count() == 0
    sequences = K.packed_sequences(edges).collect()
    assert sum(s["n_tokens"] for s in sequences) == sum(r["length"] for r in rows) and all(s["n_tokens"] * 4 == len(s["ids"]) for s in sequences)


def test_plan_places_every_length_once():
    rng = random.Random(0)
    for capacity in (7, 64, 300):
        for _ in range(20):
            histogram = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 40))}
            plan = K.Plan(histogram, capacity)
            got: dict[int, int] = {}
            for lengths, n in plan.recipes:
                assert n > 0 and sum(lengths) <= capacity
                for x in lengths:
                    got[x] = got.get(x, 0) + n
            assert got == histogram


def test_nnls_recovers_counts():
    a = np.array([[1.0, 0, 2], [0, 1, 1], [3, 0, 0]])
    assert np.allclose(K.nnls(a, a @ np.array([2.0, 0, 3])), [2, 0, 3], atol=1e-6) and (K.nnls(a, np.array([-1.0, -1, -1])) == 0).all()


def test_word_cache_is_the_tokenizer():
    cache = K.WordCache(K.default_tokenizer())
    rng = random.Random(1)
    letters = "abcXYZ .,;!?'’é É́ßİIΣσς \t\n<|>12½中#$%&*"
    for text in ["<|endoftext|>x DON'T we'll", "", LONG[:2000], *("".join(rng.choices(letters, k=60)) for _ in range(300))]:
        assert cache.ids(text.encode()) == cache.encoded(text.encode())


def test_simple_texts_are_cut_into_pieces_without_the_tokenizer():
    cache, whole = K.WordCache(K.default_tokenizer()), K.WordCache(K.default_tokenizer())
    cache.encoded = None
    rng = random.Random(2)
    letters = "abcstXYZ .,;!?'éÀÖßÿÞ \t\n<>12%#$&*"
    for text in ["DON'T we'll ''s O'Re", "12% of a.b,c", *("".join(rng.choices(letters, k=60)) for _ in range(300))]:
        assert cache.ids(text.encode()) == whole.encoded(text.encode())
    before = len(cache.pieces)
    cache.ids(b"zebra Zebra ZEBRA, zebra. (zebra")
    assert len(cache.pieces) <= before + 4


def test_capitals_whose_mark_composes_in_lower_case_only():
    cache = K.WordCache(K.default_tokenizer())
    for text in ["T\u0308a", "H\u0331a, x\u2014y", "W\u030aa. W\u030aa", "J\u030cA\u0301b!", "a\u00a0b\u0085c", "x\u00b2 \u00bd \u00aa\u00b5", "I\u0307a", "\u201cDon\u2019t\u201d Stop. stop"]:
        assert cache.ids(text.encode()) == cache.encoded(text.encode()), text


# --- 3 ---


def test_spotsigs_edits_and_edges(spark, edges, nothing):
    rows = S.fingerprint_edits(edges).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in EDGES))
    texts = [t for _, _, t in order]
    want = sorted((len(t), hashlib.sha256(S.edited(t, texts[(k + 1) % len(texts)]).encode()).hexdigest()) for k, t in enumerate(texts))
    assert sorted((r["n_chars"], r["edited_sha256"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert by[1] == by[2] and by[3] == by[4] == by[5] and by[7] != by[4]
    assert S.fingerprint_edits(nothing).count() == 0


def test_spotsigs_likeness():
    a, b = S.signatures(b"the cat sat on the old mat and the dog ran home"), S.signatures(b"the cat sat on the old mat and the dog ran off")
    shared = set(a.tolist()) & set(b.tolist())
    assert S.likeness(a, b) == len(shared) / len(set(a.tolist()) | set(b.tolist())) and S.likeness(a, a) == 1 and S.likeness(a, a[:1], 0.8) == 0


def chains_plainly(text: str, chain: int, distance: int) -> set[tuple[str, ...]]:
    """The rule of chains, word by word."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    content, found, since = [w for w in words if w not in S.ANCHORS], set(), 0
    for at, word in [(-1, ""), *enumerate(words)]:
        if word and word not in S.ANCHORS:
            since += 1
        else:
            since = 0
        if at < 0 or word in S.ANCHORS or since > S.DESERT:
            later = [w for w in words[at + 1 :] if w not in S.ANCHORS][distance - 1 :: distance][:chain]
            if len(later) == chain:
                found.add((word, *later))
    return found or {("\0", *words)}


@pytest.mark.parametrize(("chain", "distance"), [(2, 1), (1, 1), (2, 2), (3, 2)])
def test_spotsigs_signatures_are_the_chains(chain, distance):
    rng = random.Random(31)
    vocabulary = [*sorted(S.ANCHORS)[:12], *WORDS, "Éa", "x9", "DAS"]
    texts = ["", "the", "one two", "a b " * 3, "word | " * 20, *(" ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))) for _ in range(60)), *(", ".join(f"w{rng.randrange(30)}" for _ in range(30)) for _ in range(10))]
    for text in texts:
        got = S.signatures(text.encode(), chain, distance)
        want = {xxhash.xxh64_intdigest(" ".join(x).encode() if x[0] != "\0" else b"\0" + " ".join(x[1:]).encode()) for x in chains_plainly(text, chain, distance)}
        assert set(got.tolist()) == want and len(got) == len(want) and (np.sort(got) == got).all(), text


def test_spotsigs_of_texts_without_anchors_survive_an_edit():
    menu = " | ".join(f"entry{i}" for i in range(60))
    changed = S.edited(menu, "the next document has the words of a text and is no menu " * 9)
    own = S.signatures(menu.encode())
    assert len(own) > 50 and S.likeness(own, S.signatures(changed.encode())) > 0.5
    short = S.signatures("Only seven words stand here, none common".encode())
    assert S.likeness(short, S.signatures(b"Only seven words stand here, yes yes")) > 0.3


def test_spotsigs_pairs_equal_brute_force(spark):
    base = " the ".join(prose(300, 80).split())
    rows = [(i, base if i < 3 else base.replace(base.split()[i * 3], "zzz", 1) if i < 9 else " the ".join(prose(300 + i, 60).split())) for i in range(16)]
    got = {(r["set_a"], r["set_b"]) for r in S.similar_texts(docs_of(spark, rows)).collect()}
    sets = {hashlib.sha256(",".join(map(str, (s := np.sort(S.signatures(t.encode()))).view(np.int64).tolist())).encode()).hexdigest(): s for _, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and S.likeness(sets[a], sets[b]) >= 0.8}
    assert got == want and want


# --- 4 ---


def test_quality_learns_and_edges(spark, edges, nothing, labels):
    rows = [(i, prose(i, 60) if i % 2 else " ".join(w + "###" for w in prose(i, 60).split())) for i in range(200)]
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, rows)
    scored = {r["doc_id"]: r["score"] for r in Q.score(docs, Q.fit(docs, known)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((scored[i] >= 0.3) == bool(i % 2) for i in held)
    model = Q.fit(edges, labels)
    assert Q.score(edges, model).count() == len(EDGES) and all(0 <= r["score"] <= 1 for r in Q.score(edges, model).collect())
    assert Q.score(nothing, Q.fit(nothing, labels.limit(0))).count() == 0
    assert {r["score"] for r in Q.score(edges, Q.fit(edges, labels.limit(0))).collect()} == {0.5}


def test_quality_votes_are_exact():
    rng = np.random.default_rng(0)
    counts = np.stack([Q.term_counts(prose(i, 30).encode()) for i in range(60)])
    model = Q.Model(counts, rng.integers(0, 2, 60))
    z = model.latent(model.weighted(counts))
    for i in range(10):
        cosine = z[i] @ model.vectors.T
        near = np.flatnonzero(cosine >= np.sort(cosine)[-Q.NEIGHBOURS])
        weight = np.maximum(cosine[near], 0) ** Q.SHARPNESS
        assert abs(model.scores(counts[i : i + 1])[0] - (weight * model.labels[near]).sum() / weight.sum()) < 1e-4


# --- 5 ---


def plain_fingerprint(text: str, k: int = 3) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows: list[tuple]) -> dict:
    fps = [(i, plain_fingerprint(t or "")) for i, t in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least: dict[int, int | None] = {}
    for a, (i, _) in enumerate(fps):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return {(i, f): least.get(find(a)) for a, (i, f) in enumerate(fps)}


@pytest.mark.parametrize("bucket_pairs", [1024, 2])
def test_simhash_components_equal_brute_force(spark, monkeypatch, bucket_pairs):
    monkeypatch.setattr(H, "BUCKET_PAIRS", bucket_pairs)
    base = prose(400, 300).split()
    rows = [(i, " ".join([*base[: i * 3], "x", *base[i * 3 + 1 :]])) for i in range(40)] + [(100 + i, prose(500 + i, 12)) for i in range(20)] + EDGES
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1): r["component_id"] for r in H.components_by_fingerprint(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_texts_meet_by_blocks_of_their_simhash(spark, monkeypatch):
    """Near-dedup finds texts whose fingerprints are two bits apart or fewer by the fingerprints alone, without keys of least hashes."""
    monkeypatch.setattr(H, "band_keys", lambda shingles: np.empty(0, np.int64) if len(shingles) == 0 else np.array([H.xxhash.xxh64_intdigest(shingles.tobytes()) >> 1], np.int64))
    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(6)]
    pairs = [(t, t + " end" * n) for t in texts for n in (1, 2, 3) if bin((H.fingerprint(t.encode(), 5) ^ H.fingerprint((t + " end" * n).encode(), 5)) & (1 << 64) - 1).count("1") <= 2]
    assert len(pairs) >= 3
    rows = [(i, x) for i, x in enumerate(dict.fromkeys(x for p in pairs for x in p))]
    groups = {r["digest"]: r["component"] for r in H.near_duplicate_groups(docs_of(spark, rows)).collect()}
    digest = lambda x: H.text_digest(x.encode())
    assert all(bytes(groups[digest(x)]) == bytes(groups[digest(y)]) for x, y in pairs)


def test_components_of_few_links_are_kept_in_a_part_a_core(spark, monkeypatch):
    from sitelumen.llm import common

    parts = []
    monkeypatch.setattr(common, "cut", lambda df, cut=common.cut: parts.append((made := cut(df)).rdd.getNumPartitions()) or made)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert connected_components(spark.range(0, 300).selectExpr("id AS a", "id - id % 3 AS b")).count() == 300
        cores = spark.sparkContext.defaultParallelism
        assert len(parts) > 1 and all(n <= cores for n in parts[1:])
        monkeypatch.setattr(common, "PART_ROWS", 1)
        assert common.cut_few(spark.range(0, 300).repartition(97, "id"), 300).rdd.getNumPartitions() == min(97, common.PARTS_A_CORE * cores)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_workers_let_go_of_what_other_work_kept():
    from sitelumen.llm import common, simhash

    first = K.cache_of(K.default_tokenizer())
    assert K.cache_of(K.default_tokenizer()) is first
    seen = []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            seen.append(run)

    simhash.signed_texts(Docs(), 5)
    list(seen[0](iter([])))
    assert not common._kept and K.cache_of(K.default_tokenizer()) is not first


def test_components_keep_links_in_few_parts(spark):
    """Each round's links are kept in a few parts a core and not in as many as the shuffle has."""
    from sitelumen.llm import common

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = connected_components(spark.range(0, 300).selectExpr("id AS a", "id - id % 3 AS b"))
        assert found.count() == 300 and found.groupBy("component").count().count() == 100
        most = common.PARTS_A_CORE * spark.sparkContext.defaultParallelism
        assert found.where("node <> component").select("node").rdd.getNumPartitions() <= most + 97
        cut_off = common.cut_few(spark.range(0, 300).repartition(97, "id"))
        assert cut_off.rdd.getNumPartitions() == min(most, 97) and cut_off.count() == 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)



def test_simhash_empty_table(nothing):
    assert H.components_by_fingerprint(nothing).count() == 0 and H.drop_near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3])
def test_near_duplicates_go_and_clean_texts_stay(spark, monkeypatch, hot):
    monkeypatch.setattr(H, "HOT_BUCKET", hot)
    rows = [(i, prose(600 + i, 200)) for i in range(30)]
    copies = []
    for i in range(10):
        words = rows[i][1].split()
        words[i * 7] = "changed"
        copies += [(1000 + i, " ".join(words)), (2000 + i, rows[i][1])]
    kept = H.drop_near_duplicates(docs_of(spark, rows + copies))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30)) and kept.columns == docs_of(spark, []).columns


def shingle_likeness(a: str, b: str, size: int = 5) -> float:
    x, y = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def edited(kind: str, i: int, likeness: float) -> tuple[str, str]:
    """A text and a copy of it that differs in one part, of this likeness or a little more."""
    base, other = prose(20_000 + i, 200).split(), prose(40_000 + i, 200).split()
    made = {"added": lambda k: [*base, *other[:k]], "cut": lambda k: base[: len(base) - k], "replaced": lambda k: [*base[: len(base) - k], *other[:k]]}[kind]
    k = max(k for k in range(1, 80) if shingle_likeness(" ".join(base), " ".join(made(k))) >= likeness)
    return " ".join(base), " ".join(made(k))


def test_near_duplicates_with_one_part_changed_are_found(spark):
    rows = []
    for n, (kind, likeness) in enumerate((k, s) for k in ("added", "cut", "replaced") for s in (0.8, 0.85, 0.9)):
        for i in range(20):
            a, b = edited(kind, 100 * n + i, likeness)
            rows += [(2 * (100 * n + i), a), (2 * (100 * n + i) + 1, b)]
    kept = {r["doc_id"] for r in H.drop_near_duplicates(docs_of(spark, rows)).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept and sum(i % 2 for i in kept) <= 2  # of 180


@pytest.mark.parametrize("hot", [2000, 15])
def test_near_duplicates_are_those_of_exact_jaccard(spark, monkeypatch, hot):
    monkeypatch.setattr(H, "HOT_BUCKET", hot)
    rng, rows = random.Random(9), []
    for i in range(12):  # copies with one to nine words changed: similarities of about 0.6 to 1
        base = prose(80_000 + i, 150).split()
        for k in range(9):
            words = list(base)
            for at in rng.sample(range(150), k % 9):
                words[at] = f"other{rng.random()}"
            rows.append((100 * i + k, " ".join(words)))
    group = {i: i for i, _ in rows}
    for a, x in rows:
        for b, y in rows:
            if a < b and a // 100 == b // 100 and shingle_likeness(x, y) >= 0.8 and group[a] != group[b]:
                one, two = sorted((group[a], group[b]))
                group = {i: one if g == two else g for i, g in group.items()}
    kept = sorted(r["doc_id"] for r in H.drop_near_duplicates(docs_of(spark, rows)).collect())
    assert kept == sorted(set(group.values())) and len(kept) > 15


def test_near_duplicates_of_hot_keys_lose_no_link(spark, monkeypatch):
    rows = []
    for c in range(8):  # chains: each text is near the next ones only; two chains of a start share keys, but are not near
        words = prose(90_000 + c // 2, 150).split()
        words[: 25 * (c % 2)] = prose(95_000 + c, 25 * (c % 2)).split()
        for k in range(20):
            words = list(words)
            words[40 + (k * 41) % 110] = f"step{c}x{k}"
            rows.append((1000 * (c // 2) + 20 * (c % 2) + (k * 17) % 20, " ".join(words)))
    near = [(a, b) for a, x in rows for b, y in rows if a < b and a // 1000 == b // 1000 and shingle_likeness(x, y) >= 0.8]
    group = {i: i for i, _ in rows}
    for a, b in near:
        one, two = sorted((group[a], group[b]))
        group = {i: one if g == two else g for i, g in group.items()}
    asked = []
    plain = H.stray_pairs
    monkeypatch.setattr(H, "stray_pairs", lambda *x: asked.append(1) or plain(*x))
    for hot in (2000, 3):
        monkeypatch.setattr(H, "HOT_BUCKET", hot)
        assert sorted(r["doc_id"] for r in H.drop_near_duplicates(docs_of(spark, rows)).collect()) == sorted(set(group.values()))
    assert asked


def test_stray_pairs_are_all_near_pairs_of_different_components(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 4, np.uint64)
    bits = [base ^ np.array([0, 0, 0, (1 << int(rng.integers(0, 60))) - 1], np.uint64) for _ in range(30)]
    rows = [(1, block, salt, False, bytes([i]), bits[i].tobytes(), bytes([i % 3])) for i in range(10) for block, salt in ((i % 2, s) for s in range(2))]
    rows += [(1, block, i % 2, True, bytes([i]), bits[i].tobytes(), bytes([i % 3])) for i in range(30) for block in range(2)]
    frame = spark.createDataFrame(rows, "key long, block long, salt long, member boolean, digest binary, bits binary, component binary").repartition(3)
    got = {(bytes(r["a"]), bytes(r["b"])) for r in H.stray_pairs(frame, 0.8).collect()}
    far = lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j]).sum())
    assert got == {(bytes([i]), bytes([j])) for i in range(10) for j in range(30) if i % 3 != j % 3 and far(i, j) <= H.most_bits_apart(0.8)} and got


def test_near_duplicates_edges(edges):
    kept = [r["doc_id"] for r in H.drop_near_duplicates(edges).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 6, 7, 8] and kept.count(None) == 1


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(pairs).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# --- 6 ---


@pytest.mark.parametrize("limit", [500, 3000, 10**9])
def test_shards_fit_and_split_only_where_needed(spark, limit):
    rows = [(i, prose(i, i % 20 + 1)) for i in range(300)] + [(7, "same")] * 40
    got = X.assign_shards(docs_of(spark, rows).repartition(5), limit).collect()
    assert sorted((r["row"]["doc_id"], r["row"]["text"], r["row"]["bytes"]) for r in got) == sorted((i, t, "x") for i, t in rows)
    size: dict[tuple, int] = {}
    for r in got:
        key = (r["depth"], r["shard"], r["page"])
        size[key] = size.get(key, 0) + r["bytes"]
    rows_of = {k: sum((r["depth"], r["shard"], r["page"]) == k for r in got) for k in size}
    assert all(b <= limit or rows_of[k] == 1 for k, b in size.items())
    for depth, shard, page in size:  # what a bucket was split from was over the limit
        if 0 < depth < 60 and page == 0:
            parent = sum(b for (d, s, _), b in size.items() if d >= depth - 1 and s >> (d - depth + 1) == shard >> 1)
            assert parent > limit


def test_pages_of_a_repeated_row_are_full_whatever_the_salts(spark, monkeypatch):
    monkeypatch.setattr(X, "PAGED_ROWS", 30)
    got = X.assign_shards(docs_of(spark, [(7, "same")] * 1000).repartition(7), 100 * (4 + X.ROW_BYTES)).groupBy("depth", "shard", "page").count().collect()
    assert sorted((r["depth"], r["page"], r["count"]) for r in got) == [(60, k, 100) for k in range(10)]


def test_shards_equal_sql_at_a_small_limit(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = X.assign_shards(spark.read.parquet(f"{folder}/documents.parquet"), 8192).select("row.doc_id", F.col("depth").cast("int"), "shard", "page", "bytes").collect()
    want = duckdb.sql(X.oracle(8192).replace("FROM documents", f"FROM '{folder}/documents.parquet'")).fetchall()
    one = {tuple(r) for r in got if r["depth"] <= 20}
    assert one == set(want) and len({r[:2] for r in ((x[1], x[2]) for x in want)}) > 30 and max(x[1] for x in want) > 4
    assert all(r["bytes"] > 8192 for r in got if r["depth"] > 20)  # a row over the limit is alone


def test_shards_edges(edges, nothing):
    assert X.assign_shards(edges).count() == len(EDGES) and X.assign_shards(nothing).count() == 0
    assert X.assign_shards(edges).select("row.*").columns == edges.columns


# --- 7 ---


def test_lm_scores_prefer_the_target(spark, edges, nothing):
    tokenizer = K.default_tokenizer()
    good, bad = [(i, prose(i, 60)) for i in range(40)], [(100 + i, "zq xv " * 40 + prose(i, 5)) for i in range(40)]
    tokens = L.tokenised(docs_of(spark, good + bad), tokenizer, spark.createDataFrame([(i, "x") for i in (*range(20), 3, 999, None)], "doc_id long, good string"))
    scores = {r["doc_id"]: r["score"] for r in L.score(tokens, L.fit(tokens)).collect()}
    assert max(scores[i] for i, _ in good) < min(scores[i] for i, _ in bad)
    for target in (None, edges.limit(0), edges):  # no target, or nothing else but rows without an id
        tokens = L.tokenised(edges, tokenizer, target)
        rows = L.score(tokens, L.fit(tokens)).collect()
        assert len(rows) == len(EDGES) and [r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
        assert target is edges or all(r["score"] == 0 for r in rows)
    tokens = L.tokenised(nothing, tokenizer)
    assert L.score(tokens, L.fit(tokens)).count() == 0


def test_lm_codes_are_of_one_bigram_each():
    rng = np.random.default_rng(0)
    pairs = np.unique(np.stack(rng.integers(0, L.VOCABULARY + 1, (2, 3_000_000))), axis=1)
    codes = np.unique(L.codes_of(*pairs))
    assert len(codes) == pairs.shape[1] and codes[-1] < L.TOKENS  # no two share a count


@pytest.mark.parametrize("heavy", [1 << 20, 40, 1])
def test_lm_losses_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(L, "HEAVY", heavy)
    tokenizer = K.default_tokenizer()
    rows = [(i, prose(i % 50, 5 + i % 60)) for i in range(80)] + [(7, "a b a"), (None, "a b"), (200, None)]
    target = {i for i in range(0, 200, 7)}
    tokens = L.tokenised(docs_of(spark, rows).repartition(3), tokenizer, spark.createDataFrame([(i,) for i in target], "doc_id long"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["target_loss"], 6), round(r["background_loss"], 6), round(r["score"], 6)) for r in L.score(tokens, L.fit(tokens)).collect())
    ids = [[*np.frombuffer(K.cache_of(tokenizer).ids((t or "").encode()), "<u4").tolist(), L.EDGE] for _, t in rows]
    sides = {k: [x for (i, _), x in zip(rows, ids, strict=True) if (i in target) == k] for k in (True, False)}
    size = min(sum(map(len, x)) for x in sides.values())
    chance = {}
    for k, own in sides.items():
        scale = size / sum(map(len, own))
        single, pairs = Counter(w for x in own for w in x), Counter(p for x in own for p in zip([L.EDGE, *x], x, strict=False))

        def of(h, w, scale=scale, single=single, pairs=pairs):
            alone = (scale * single[w] + L.ADDED) / (size + L.ADDED * (L.VOCABULARY + 1))
            return (scale * pairs[h, w] + L.MASS * alone) / (scale * single[h] + L.MASS)

        chance[k] = of
        for h in (L.EDGE, ids[0][0], 17):
            assert abs(sum(of(h, w) for w in range(L.VOCABULARY + 1)) - 1) < 1e-9
    want = []
    for (i, _), x in zip(rows, ids, strict=True):
        t, b = (-sum(np.log(chance[k](h, w)) for h, w in zip([L.EDGE, *x], x, strict=False)) / len(x) for k in (True, False))
        want.append((i is None, i or 0, len(x), round(t, 6), round(b, 6), round(t - b, 6)))
    for one, two in zip(got, sorted(want), strict=True):
        assert one[:3] == two[:3] and np.allclose(one[3:], two[3:], atol=3e-6)


# --- 8 ---


def test_toxicity_learns_grades_and_edges(spark, edges, nothing, labels):
    rng = random.Random(2)
    bad = ["vilewort", "grimling", "foulmouth"]
    rows = [(i, prose(i, 40) + (" " + " ".join(rng.choices(bad, k=1 + i % 4)) if i % 3 == 0 else "")) for i in range(300)]
    docs = docs_of(spark, rows)
    known = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int")
    model = T.fit(docs, known)
    got = {r["doc_id"]: r for r in T.severity(docs, model).collect()}
    assert all((got[i]["toxic_probability"] >= 0.5) == (i % 3 == 0) for i in range(200, 300))
    assert (np.diff(model.thresholds) >= 0).all() and all(0 <= r["severity"] <= T.GRADES for r in got.values())
    assert sorted(r["doc_id"] for r in T.drop_toxic(docs, model).collect()) == [i for i in range(300) if i % 3]
    for m in (T.fit(edges, labels), T.fit(edges, labels.limit(0))):
        assert T.severity(edges, m).count() == len(EDGES)
    assert T.drop_toxic(edges, T.fit(edges, labels.limit(0))).count() == len(EDGES) and T.drop_toxic(nothing, model).count() == 0


def test_ordinal_gradient_orders_grades():
    grades = np.array([0, 0, 1, 1, 2, 2, 3, 3])
    weights, thresholds = T.fit_ordinal(np.repeat(np.arange(8), grades), np.zeros(grades.sum(), int), np.ones(grades.sum()), grades, 1)
    assert weights[0] > 0 and (np.diff(thresholds) > 0).all()


def test_ordinal_fit_is_the_most_likely(spark):
    rng = np.random.default_rng(5)
    n, width = 400, 6
    x = (rng.random((n, width)) < 0.4).astype(float)
    grades = np.minimum(3, np.maximum(0, np.round(x @ np.array([1.5, 1, 0.5, 0, -0.5, -1]) + rng.logistic(size=n)))).astype(int)
    at, columns = np.nonzero(x)
    weights, thresholds = T.fit_ordinal(at, columns, np.ones(len(at)), grades, width)

    def loss(w, t):  # P(grade = k) = P(grade >= k) - P(grade >= k + 1), written out
        above = [np.ones(n), *(1 / (1 + np.exp(-(x @ w - c))) for c in t), np.zeros(n)]
        return -np.mean([np.log(above[g][i] - above[g + 1][i]) for i, g in enumerate(grades)]) + T.RIDGE / 2 * (w @ w)

    best = loss(weights, thresholds)
    for i in range(width + 3):
        for step in (-0.05, 0.05):
            w, t = weights.copy(), thresholds.copy()
            (w if i < width else t)[i % width if i < width else i - width] += step
            assert loss(w, t) > best - 1e-6


# --- 9 ---


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices(WORDS[:6], k=n))) for i, n in enumerate((3, 9, 10, 11, 25, 40, 1, 0, 25))] + [(9, None)]
    items[8] = (8, items[4][1])
    rows = []
    for i in range(60):
        words = rng.choices(WORDS[:7], k=rng.randint(0, 60))
        if i % 3 == 0:
            own = (items[rng.randrange(9)][1] or "").split()
            at = rng.randint(0, len(words))
            words[at:at] = own[rng.randint(0, 3) :]
        rows.append((i, ", ".join(words).upper() if i % 2 else " ".join(words)))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, n_words int")
    want = {}
    plain = [(str(i), D.words_of((t or "").encode())) for i, t in items]
    for i, t in rows:
        want[i] = D.brute_force(D.words_of(t.encode()), plain)
    for block in (200_000, 15):
        found = D.hits(docs_of(spark, rows), bench, block_words=block).collect()
        got = {r["doc_id"]: (sum(e - s for s, e in D.merged_spans([(h["start"], h["end"]) for h in r["hits"]])), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in found}
        assert got == want


def test_decontamination_removes_spans(spark, edges, nothing):
    item = prose(800, 30)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(1, prose(801, 60) + " " + item + " " + prose(802, 60)), (2, prose(803, 50)), (3, item), (4, None)]
    got = {r["doc_id"]: r["text"] for r in D.decontaminate(docs_of(spark, rows), bench).collect()}
    assert got == {1: prose(801, 60) + " " + prose(802, 60), 2: prose(803, 50), 4: None}
    for b in (bench, bench.limit(0)):
        assert D.decontaminate(edges, b).count() == len(EDGES) and D.hits(edges, b).count() == len(EDGES)
    assert D.decontaminate(nothing, bench).count() == 0


def test_decontamination_does_not_depend_on_blocks(spark):
    one, two = prose(810, 41), prose(811, 41)
    across = one.split()[20:] + two.split()[:20]  # overlaps both items where they stand side by side
    bench = spark.createDataFrame([(1, one), (2, two), (3, " ".join(across))], "item_id bigint, text string")
    rows = [(1, f"{one} {prose(812, 18)} {two}"), (2, f"{prose(813, 90)} {one} {two} {prose(814, 90)}"), (3, prose(815, 50)), (4, None)]
    for block in (200_000, 45, 15):
        got = {r["doc_id"]: r["text"] for r in D.decontaminate(docs_of(spark, rows), bench, block_words=block).collect()}
        assert got == {2: f"{prose(813, 90)} {prose(814, 90)}", 3: rows[2][1], 4: None}


# --- 10 ---


def test_url_filter_by_hand(spark):
    rows = [
        (1, "https://a.example.org/es/1", "example.org/es/", "block"), (2, "https://EXAMPLE.org/en/196#t", "example.org/en/1", "block"), (3, "http://x.org/", "org/", "allow"),
        (4, "http://x.org", None, "allow"), (5, "http://b.com/de/?q", "com/de/", "block"), (6, "http://notexample.org/es/", "org/", "allow"), (7, None, None, "allow"),
        (8, "no scheme", None, "allow"), (9, "https://m.casino-x.example.net/en/1", None, "block"), (10, "https://casinos.example.net/", None, "allow"), (10, "https://casinos.example.net/", None, "allow"),
        (None, "http://b.com/fr/" + "y" * 50_000, "com/fr/", "allow"), (11, "ftp://q.org/a?://b.com/de/", "org/", "allow"), (12, "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "", "x", "x") for i, u, _, _ in rows], "page_id bigint, url string, html string, host string, token string")
    rules = U.rules_frame(spark, U.RULES, False).union(U.rules_frame(spark, U.OWN_PATTERNS, True))
    got = U.filter_urls(pages, rules).collect()
    assert sorted(((r["page_id"] or 0, r["rule"] or "", r["verdict"]) for r in got)) == sorted(((i or 0, r or "", v) for i, _, r, v in rows))
    assert {r["host"] for r in got if r["page_id"] == 2} == {"example.org"} and {r["path"] for r in got if r["page_id"] == 7} == {""}
    assert U.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in U.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_thousands_of_rules_equal_brute_force(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in WORDS for b in ("", "x", "7")]
    kinds = (lambda w: f"||{w[0]}.test/", lambda w: f"||{w[0]}.test/{w[1]}*{w[2]}", lambda w: f"^{w[0]}^{w[1]}^", lambda w: f"/{w[0]}-{w[1]}.", lambda w: f"{w[0]}*/{w[1]}^", lambda w: f"||{w[0]}.{w[1]}.test^", lambda w: f"*{w[0]}_{w[1]}")
    patterns = sorted({rng.choice(kinds)(rng.choices(words, k=3)) for _ in range(4000)})
    rules = spark.createDataFrame([(p, "block" if zlib.crc32(p.encode()) % 3 else "allow", False) for p in patterns], "pattern string, action string, own boolean")
    urls = []
    for i in range(1500):
        a, b, c, d = rng.choices(words, k=4)
        urls.append(rng.choice([f"http://{a}.test/{b}/{c}-{d}.html", f"https://{a}.{b}.test/{c}_{d}", f"http://www.{a}.test/{b}q{c}", f"https://{a}.test:80/{b}/{c}/{d}?x={a}", f"http://q.org/{a}/{b}/{a}-{c}.x/{d}_{b}"]))
    for p in rng.sample(patterns, 400):  # addresses made to fit
        tail = p.replace("||", "").replace("*", "m/").replace("^", "/")
        urls.append("http://" + tail if p.startswith("||") else f"http://q.org/z/{tail}")

    def plain(p: str) -> re.Pattern:
        anchored, body = p.startswith("||"), p.removeprefix("||")
        text = "".join(".*" if c == "*" else "(?:[^A-Za-z0-9]|$|^)" if c == "^" else re.escape(c) for c in body)
        return re.compile(("^(?:[^/]*\\.)?" if anchored else "") + text, re.S)

    made = [(p, plain(p)) for p in patterns]
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        address = host + re.match(r"[^?#]*", rest[len(host) :])[0]
        best = max(((len(p), p) for p, x in made if x.search(address)), default=None)
        want.append((i, best and best[1].removeprefix("||"), "allow" if best is None or not zlib.crc32(best[1].encode()) % 3 else "block"))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in U.filter_urls(pages, rules).collect())
    assert got == want and sum(r is not None for _, r, _ in want) > 400


def test_rules_are_filed_under_their_rarest_whole_token(spark):
    rules = U.rules_frame(spark, (("||example.org/en/1", "block"), ("ads*", "block"), ("||com/", "allow")), False)
    tokens = spark.createDataFrame([("example",)] * 3 + [("org",)] * 2 + [("en",)] * 5 + [("",)], "token string")
    assert {r["pattern"]: r["token"] for r in U.indexed(rules, tokens).collect()} == {"||example.org/en/1": "org", "ads*": "", "||com/": "com"}


def test_rounds_of_few_links_take_few_tasks(spark):
    """However many shuffle partitions there are, the driver hears of a few tasks a round."""
    conf = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old, context = {k: spark.conf.get(k) for k in conf}, spark.sparkContext
    for k, v in conf.items():
        spark.conf.set(k, v)
    context.setJobGroup("few-links", "")
    try:
        found = connected_components(spark.range(0, 60).selectExpr("id AS a", "id + 1 AS b"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few-links") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < max(s.numTasks for s in stages if s and s.numCompletedTasks) < 96
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 61
