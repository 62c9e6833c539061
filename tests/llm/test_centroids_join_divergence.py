"""Centroid clustering, n-gram join and source divergence against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelumen.llm import centroids as C
from sitelumen.llm import divergence as V
from sitelumen.llm import ngram_join as J
from tests.llm.test_operators import prose

# --- centroids -------------------------------------------------------------------------------------------------------

CLASHES = "id v n key cluster distance sums c at part a b total inertia".split()
VECTORS = "vec_id bigint, embedding array<float>, " + ", ".join(f"{c} string" for c in CLASHES)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * len(CLASHES)) for i, v in rows], VECTORS)


def lloyd(rows, k, rounds, size, scale=256, label="2"):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(max(-C.MOST, min(C.MOST, float(np.float32(x)) * scale))) for x in v)))
    starts = sorted((hashlib.sha256(f"{label}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    now = [v for _, v in starts]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        now = [tuple(sum(x) // len(own[j]) for x in zip(*own[j], strict=True)) if own[j] else c for j, c in enumerate(now)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    spread = Counter()
    for _, c, d in placed:
        spread[c] += d
    return sorted(((i, c, d, spread[c], sum(spread.values())) for i, c, d in placed), key=str), now


@pytest.mark.parametrize("large", [1, 3000, 10**7])
def test_clusters_equal_brute_force(spark, large):
    rng = random.Random(large)
    rows = [(i, [rng.choice((-1, 1)) * large * rng.random() for _ in range(5)]) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(40)] + [(7, rows[3][1]), (None, rows[4][1]), (7, rows[3][1])]
    rows += [(200, None), (201, [1.0] * 4), (202, [1.0] * 6), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [float("nan")] * 5), (205, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (206, [])]
    got, centres = C.centroid_clusters(vectors_of(spark, rows).repartition(3), k=6, rounds=4, size=5)
    want, want_centres = lloyd(rows, 6, 4, 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert centres.tolist() == [list(c) for c in want_centres]


def test_fewer_rows_than_centroids_equal_starts_and_nothing(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.5, 0.25])]
    got, centres = C.centroid_clusters(vectors_of(spark, rows), k=40, rounds=2, size=2)
    want, _ = lloyd(rows, 40, 2, 2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(centres) == 3
    empty, _ = C.centroid_clusters(vectors_of(spark, []), size=2)
    assert empty.collect() == [] and empty.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia"]
    unnamed, _ = C.centroid_clusters(vectors_of(spark, [(None, [1.0, 2.0])]), size=2)
    assert [tuple(r) for r in unnamed.collect()] == [(None, 0, 0, 0, 0)]


def test_sums_beyond_64_bits_are_exact():
    vectors, weights = np.array([[C.MOST, -C.MOST], [C.MOST, 1]], np.int64), np.array([1 << 40, 1 << 41])
    assert C.weighted_sums(vectors, weights) == [3 * (1 << 67), -(1 << 67) + (1 << 41)]


# --- n-gram join -----------------------------------------------------------------------------------------------------

DOC_CLASHES = "row set digest key unit salt n head component group rank part least a b".split()
DOCS = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} string" for c in DOC_CLASHES)


def docs_of(spark, rows):
    rows = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(*r, *["x"] * len(DOC_CLASHES)) for r in rows], DOCS)


def joined(rows, size=4, percent=85):
    """``(doc_id, n, component)`` the plain way."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((doc, len(s), least.get(top(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(text, rng, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"neu{rng.randrange(999)}"
    return " ".join(words)


def near_copies(seed):
    rng, rows = random.Random(seed), []
    for n in (1, 2, 4, 5, 6, 9, 12, 16, 18, 22, 25, 30, 40, 60, 90, 200, 500):
        base = prose(seed * 1000 + n, n)
        rows += [base, base.upper(), edited(base, rng, 1), edited(base, rng, max(1, n // 30)), base + " und noch mehr", " ".join(base.split(" ")[: max(1, n * 9 // 10)])]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_alike_sets_share_a_key_whatever_divides_small_from_large(percent):
    rng = np.random.default_rng(percent)
    for small in (0, 6, 14):
        rule, alike = J.Sizes(percent, small), 0
        for _ in range(1500):
            n = int(rng.integers(1, 18 if percent < 60 else 40)) if rng.random() < 0.8 else int(rng.integers(40, 600))
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            lose = int(rng.integers(0, max(2, n * (100 - percent) // 100 + 2)))
            b = np.unique(np.concatenate([rng.permutation(a)[min(lose, n - 1) :], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1)), np.uint64)]))
            if percent < 60 and small and max(len(a), len(b)) > 16 and min(len(a), len(b)) <= small:
                continue
            if J.alike(a, b, percent):
                alike += 1
                assert np.intersect1d(J.keys_of(a, rule), J.keys_of(b, rule)).size, (len(a), len(b), small)
        assert alike > 200


def test_cheapest_division_weighs_the_sizes_of_the_corpus():
    assert J.cheapest_small(85, {}) == 0 and 5 <= J.cheapest_small(85, dict.fromkeys(range(1, 41), 10)) < 30
    rule = J.Sizes(85, 12)
    assert rule.partners(12) and not rule.partners(13) and not rule.schemes(10) and rule.schemes(12)
    assert all(len(np.unique(J.subset_keys(np.arange(n, dtype=np.uint64), J.Sizes(85, 20))[0])) for n in range(1, 20))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    got = J.ngram_components(docs_of(spark, rows).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == joined(rows)


def test_heavy_units_are_dealt_out_without_losing_a_link(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 4)  # read by the driver alone
    rng = random.Random(5)
    base, chain, rows = prose(50, 150), prose(51, 150), []
    rows += [edited(base, rng, rng.randrange(3)) for _ in range(40)]
    for i in range(30):  # each like its neighbours, the ends unlike
        rows.append(chain)
        chain = edited(chain, rng, 1) + f" w{i} x{i}"
    rows += [" ".join(base.split(" ")[:110]) + " " + prose(60 + i, 50) for i in range(20)]  # share keys, are not alike
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = J.ngram_components(docs_of(spark, rows).repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == joined(rows)


def test_join_on_edges(spark):
    long = prose(99, 60_000)
    rows = [(1, prose(1, 120)), (2, prose(1, 120)), (2, prose(1, 120)), (3, None), (None, prose(3, 80)), (4, ""), (5, "\n \t"), (6, long), (7, long + " ende"), (8, "One"), (9, "one"), (None, None), (None, "allein hier"), (None, "allein  HIER")]
    got = J.ngram_components(docs_of(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == joined(rows)
    empty = J.ngram_components(docs_of(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id"]
    lone = J.ngram_components(docs_of(spark, [(1, None), (2, "")]))
    assert sorted(map(tuple, lone.collect())) == [(1, 0, 1), (2, 0, 2)]


# --- divergence ------------------------------------------------------------------------------------------------------


def divergence(rows, least, top):
    """The rows the plain way."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        own = [(s, t) for x, s, t in docs if x == lang]
        seen = Counter(t for _, terms in own for t in set(terms))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {s: Counter() for s, _ in own}
        for s, terms in own:
            counts[s].update(t for t in terms if seen[t] >= least)
        every = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (every[t] + 2) // (sum(every.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def spoken(seed):
    rng, rows = random.Random(seed), []
    for i in range(150):
        lang, source = rng.choice(("en", "de", None, "")), rng.choice(("a", "b", "hot", "hot", "hot", None, "Ü", "z"))
        text = prose(rng.randrange(40), rng.randrange(60)) + rng.choice((" Straße, Ünlü ÇA", " don't 4711 x_y", ""))
        rows.append((rng.choice((i, i, None)), rng.choice((text, text, text, None, "", "12 34")), lang, source))
    rows += [(500, "only here once", "fr", "solo"), (501, "a", "it", "x"), (502, None, "it", "y")]
    return rows


@pytest.mark.parametrize("width", [64, 1 << 16, V.WIDTH])
def test_divergence_equals_brute_force_at_any_width(spark, width):
    rows = spoken(7)
    got = V.divergence(docs_of(spark, rows).repartition(4), least=3, top=4, width=width).collect()
    assert sorted((*tuple(r)[:4], r["value"], r["rank"]) for r in got) == divergence(rows, 3, 4)


def test_sketch_never_says_less(spark):
    rows, least = spoken(3), 5
    named = docs_of(spark, rows).select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    passing = V.merged_sketch(named.repartition(6), least, 1 << 16)
    seen = Counter((lang or "", t) for _, text, lang, _ in rows for t in {x for some in V.term_lists((text or "").encode()) for x in some})
    for (lang, term), n in seen.items():
        at = V.cells(lang.encode(), [term], 1 << 16)[:, 0]
        if n >= least:
            assert passing[0, at[0]] and passing[1, at[1]]
    assert passing.sum() < 2.2 * sum(n >= least for n in seen.values())


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Äpfel und-Birnen, " * 50 + "x" * 90 + " 1 ende").encode()
    whole = V.TERM.findall(text.lower())
    for size in (1, 2, 7, 64, 10_000):
        monkeypatch.setattr(V, "TEXT_BYTES", size)
        assert [t for some in V.term_lists(text) for t in some] == whole


def test_counts_of_a_task_are_sent_once_and_its_sketch_stops(spark, monkeypatch):
    """Documents of a term are counted by language and not again by source, and a sketch that skips full terms is the same."""
    rows = [(i, f"common Word{i % 7} rare{i}", "ab"[i % 2], f"s{i % 5}") for i in range(400)]
    docs = docs_of(spark, rows).select("text", "lang", "source").coalesce(1)
    whole = V.merged_sketch(docs, 10, 1 << 16)
    monkeypatch.setattr(V, "HELD", 16)
    assert (V.merged_sketch(docs, 10, 1 << 16) == whole).all()
    monkeypatch.undo()
    got = V.candidate_counts(docs, whole).where("term = 'common'").collect()
    assert len(got) == 10 and sum(r["n"] for r in got) == 400
    assert {x: sorted(r["docs"] for r in got if r["lang"] == x) for x in "ab"} == {x: [0, 0, 0, 0, 200] for x in "ab"}



def test_divergence_on_nothing(spark):
    got = V.divergence(docs_of(spark, []))
    assert got.collect() == [] and got.columns == ["lang", "source", "part", "item", "value", "rank"]
    bare = V.divergence(docs_of(spark, [(1, None, None, None), (2, "", "", "x")]))
    assert sorted(tuple(r) for r in bare.collect()) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


# --- decontamination by a benchmark of many blocks ---------------------------------------------------------------------


def test_many_blocks_take_one_worker_each_and_give_what_one_does(spark, monkeypatch):
    from sitelumen.llm import decontaminate as D

    monkeypatch.setattr(D, "MAP_BITS", 1 << 18)
    rng = random.Random(9)
    items = [(f"i{k}", prose(700 + k, rng.choice((3, 9, 10, 25, 60)))) for k in range(120)] + [(None, prose(900, 30)), ("none", None), ("i0", prose(1000, 12))]
    rows = []
    for i in range(80):
        text = [prose(3000 + i, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            words = (rng.choice(items)[1] or "").split()
            at = rng.randrange(max(1, len(words) - 8))
            text.append(" ".join(words[at : at + rng.randint(5, 40)]))
        rows.append((rng.choice((i, i, None)), rng.choice(("\n".join(text), "\n".join(text), None))))
    rows += rows[:5]
    docs, bench = docs_of(spark, rows).repartition(3), spark.createDataFrame(items, "item_id string, text string")
    jobs = []
    monkeypatch.setattr(D, "_scanner", lambda *a, f=D._scanner: jobs.append(1) or f(*a))
    key = lambda r: (str(r["doc_id"]), r["n_words"], str(r["hits"]), str(r["items"]))
    whole = sorted(map(key, D.hits(docs, bench).collect()))
    assert len(jobs) == 1
    dealt = D.hits(docs, bench, block_words=60)
    assert len(jobs) > 45 and dealt._jdf.queryExecution().toString().count("MapInArrow") <= 4  # of the merge, in each form of the plan
    assert sorted(map(key, dealt.collect())) == whole and sum("start" in x[2] for x in whole) > 20
    plain = sorted(map(str, D.decontaminate(docs, bench).collect()))
    assert sorted(map(str, D.decontaminate(docs, bench, block_words=60).collect())) == plain


# --- public filter lists -----------------------------------------------------------------------------------------------


def judged_plainly(host, path, lines):
    """The verdict of the lines' rules, each tried as a regular expression."""
    best = (False, -1, "", "allow")
    for line in lines:
        line = line.strip()
        if not line or line[0] in "![" or re.search("#[@?$%]*#", line):
            continue
        exception, line = line.startswith("@@"), line.removeprefix("@@")
        option = re.search(r"\$([A-Za-z0-9_~,=|.*-]+)$", line)
        line = line[: option.start()] if option else line
        if (option and not {"document", "popup", "all"} & set(option[1].split(","))) or not line.strip("*|^"):
            continue
        line = re.sub(r"^\|https?://", "|", line)
        body, head, tail = line, "", ""
        if body.startswith("||"):
            body, head = body[2:], r"^(?:[^/]*\.)?"
        elif body.startswith("|"):
            body, head = body[1:], "^"
        if body.endswith("|"):
            body, tail = body[:-1], r"\Z"
        quoted = "".join(".*" if c == "*" else "(?:[^A-Za-z0-9]|$|^)" if c == "^" else re.escape(c) for c in body)
        if re.search("(?s)" + head + quoted + tail, host + path):
            best = max(best, (exception, len(line), line, "allow" if exception else "block"))
    return best[3]


def test_thousands_of_listed_rules_equal_brute_force(spark):
    from sitelumen.llm import url_filter as U

    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ad", "track", "shop", "news", "img", "play") for b in ("", "s", "er", "1", "x9")]
    hosts = [f"{rng.choice(words)}.{rng.choice(words)}.{rng.choice(('com', 'org', 'co.uk'))}" for _ in range(200)]
    lines = ["! comment", "[Adblock Plus 2.0]", "", "example.com##.banner", "example.com#@#.x", "*", "||", "^", "||hot.test^$third-party", "||doc.test^$document", "@@||doc.test/ok^", "|https://start.test/a", "/end.html|", "ad?x=1", "a(b)+c"]
    for _ in range(2500):
        host, word = rng.choice(hosts), rng.choice(words)
        rule = rng.choice((f"||{host}^", f"||{host}/{word}/", f"/{word}/*/{rng.choice(words)}^", f"{word}-{rng.choice(words)}", f"^{word}_{rng.randrange(40)}^", f"|{host}/", f"/{word}{rng.randrange(60)}.html|"))
        lines.append(("@@" if rng.random() < 0.2 else "") + rule + rng.choice(("", "", "", "$image", "$popup,third-party")))
    urls = ["https://doc.test/ok/", "https://doc.test/no", "https://hot.test/", "https://start.test/a/b", "https://x.start.test/a", "http://q.test/end.html", "http://q.test/end.html2", "http://q.test/A(b)+c", "nothing", None]
    urls += [f"https://{rng.choice(hosts)}/" + "/".join(rng.choice((rng.choice(words), f"{rng.choice(words)}-{rng.choice(words)}", f"{rng.choice(words)}_{rng.randrange(40)}", f"{rng.choice(words)}{rng.randrange(60)}.html")) for _ in range(rng.randrange(4))) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = U.listed_rules(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r["page_id"]: (r["host"], r["path"], r["verdict"], r["rule"]) for r in U.filter_urls(pages, rules).collect()}
    assert len(got) == len(urls)
    want = {i: judged_plainly(h, p, lines) for i, (h, p, _, _) in got.items()}
    assert {i: v for i, (_, _, v, _) in got.items()} == want and 40 < sum(v == "block" for v in want.values()) < 370
    assert [got[i][2] for i in range(8)] == ["allow", "block", "allow", "block", "allow", "block", "allow", "allow"] and {r for *_, r in got.values()} == {None}
    over = U.filter_urls(pages, rules.union(U.rules_frame(spark, [("||test/", "allow")], False)))
    assert {r["verdict"] for r in over.where("host LIKE '%.test' OR host = 'test'").collect()} == {"allow"}
