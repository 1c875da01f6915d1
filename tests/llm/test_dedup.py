"""Exact dedup, n-gram join and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from laminar.llm import common, exact_dedup, graph, ngram_join, repeats

DOCS = "doc_id long, text string, digest string, rep string"


def normal(t):
    return "".join(c for c in (t or "") if c not in " \t\n\x0b\f\r")


def test_perfect_hash_is_minimal_and_rejects_strangers():
    words = np.random.default_rng(1).integers(0, 2**64, (3000, 4), dtype=np.uint64)
    made = exact_dedup.PerfectHash.load(exact_dedup.PerfectHash.build(words[:2000]).dump())
    assert sorted(made.slots(words[:2000]).tolist()) == list(range(2000))
    strangers = made.slots(words[2000:])
    assert strangers.max() < 2000
    assert exact_dedup.PerfectHash.build(words[:1]).slots(words[:1]).tolist() == [0]
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.build(np.concatenate([words[:1], words[:1]]))


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_verdicts_equal_brute_force(spark, batches):
    rng = random.Random(batches)
    texts = [None, "", " \n", "a b", "ab", "a  b ", "é é", "éé", "x" * 3000] + ["".join(rng.choice("ab \t") for _ in range(rng.randint(0, 4))) for _ in range(150)]
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in exact_dedup.dedup(spark.createDataFrame(rows, DOCS), batches).collect()}
    groups = {}
    for k, t, *_ in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), k))
    assert len(got) == len(rows)
    for key, members in groups.items():
        keep = min(members)[1]
        for _, k in members:
            r = got[k]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), k == keep)
            assert r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()


def test_history_grows_and_updates_its_winners(spark):
    one = exact_dedup.digests(spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string"))
    two = exact_dedup.digests(spark.createDataFrame([(1, "a  b"), (2, "d")], "doc_id long, text string"))
    history = exact_dedup.absorb(two, exact_dedup.absorb(one))
    assert {(r["doc_id"], r["chars"], r["size"]) for r in history.collect()} == {(1, 4, 2), (6, 1, 1), (2, 1, 1)}


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.dedup(none).count() == 0 and ngram_join.link(none).count() == 0 and repeats.removed_digests(none).count() == 0
    same = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "a b c")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(same).collect()} == {(1, 1, 4, True), (None, 1, 4, False)}
    assert {r["component_id"] for r in ngram_join.link(same).collect()} == {1}


def brute_components(rows, width, num, den):
    sets = {}
    for k, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = low.encode().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    ids, parent = sorted(sets), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["new", "other", "more", f"w{rng.randrange(999)}"])
    return " ".join(words)


@pytest.mark.parametrize(("width", "num", "den", "cap", "block"), [(3, 90, 100, 64, 256), (5, 4, 5, 64, 256), (3, 90, 100, 3, 4), (2, 1, 2, 2, 3), (5, 4, 5, 4, 8)])
def test_components_equal_brute_force(spark, monkeypatch, width, num, den, cap, block):
    """Small caps and blocks send the same data through crowded regions, cells and pivots."""
    monkeypatch.setattr(ngram_join, "CAP", cap)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEAST", 8)
    rng = random.Random(width + cap)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(5, 90))] for _ in range(6)]
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [None, "", " \n\t", "One", "one", "a b", "A  b", "a b c"]
    for _ in range(110):
        t = mutated(rng, rng.choice(bases), rng.randint(0, 6))
        texts.append(t + " " + passage if rng.random() < 0.3 else t.upper() if rng.random() < 0.2 else t)
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, "c", "c") for k, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df, width, num, den).collect()}
    assert got == brute_components(rows, width, num, den)


def test_regions_recurse_to_the_third_shingle(spark, monkeypatch):
    """With few rows allowed to a region, near copies are still apart only at level three; the result is the same."""
    for name, value in (("CAP", 3), ("SPLIT", 4), ("LEAST", 8), ("BLOCK", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    seen, places = [], ngram_join._places
    monkeypatch.setattr(ngram_join, "_places", lambda rows, level, part="all": seen.append(level) or places(rows, level, part))
    rng = random.Random(6)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, mutated(rng, base, rng.randint(0, 5))) for k in range(60)]
    df = spark.createDataFrame([(k, t, "c", "c") for k, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df, 2, 4, 5).collect()}
    assert got == brute_components(rows, 2, 4, 5) and max(seen) == 3


def test_cells_of_document_pivots_recurse(spark, monkeypatch):
    """A chain of documents is one family without a dense middle: its cells are divided until they fit."""
    for name, value in (("BLOCK", 6), ("CAP", 64)):
        monkeypatch.setattr(ngram_join, name, value)
    levels, pivoted = [], ngram_join._pivoted
    monkeypatch.setattr(ngram_join, "_pivoted", lambda members, sizes, level, num, den: levels.append(level) or pivoted(members, sizes, level, num, den))
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k : k + 60])) for k in range(120)]
    df = spark.createDataFrame([(k, t, "c", "c") for k, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df, 2, 19, 20).collect()}
    assert got == brute_components(rows, 2, 19, 20) and max(levels) >= 2


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (5, a), (5, b), (7, b), (7, ""), (8, ""), (None, b + " more"), (None, "alone of all"), (9, None)]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 4, 5).collect())
    assert got == sorted([(1, 28, 1), (5, 28, 1), (5, 28, 1), (7, 28, 1), (7, 0, 1), (8, 0, 8), (-1, 29, 1), (-1, 1, None), (9, 0, 9)])


def test_long_texts_are_hashed_in_parts(monkeypatch):
    raw = ("word another " * 400 + "x" * 900 + " tail\ttail\x0bend").encode()
    whole = ngram_join.shingles(raw, 3)
    monkeypatch.setattr(ngram_join, "PART", 256)
    assert np.array_equal(whole, ngram_join.shingles(raw, 3))


def test_signatures_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**64, rng.integers(0, 9), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 5 * both >= 4 * (len(a) + len(b) - both):
            assert ngram_join.may_link(ngram_join.signature(a), ngram_join.signature(b), len(a), len(b), 4, 5)


def test_scratch_tables_can_be_cleared(spark):
    df = common.stash(spark.range(3), "t")
    assert df.count() == 3 and df._laminar_path in common.scratch(spark)
    common.discard(df)
    common.stash(spark.range(3), "t")
    common.clear_scratch(spark)
    assert common.scratch(spark) == []


def test_graph_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    want, nodes = {}, {x for e in edges for x in e if e[0] != e[1]}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for a, b in edges:
                for y in ((b,) if a == x else (a,) if b == x else ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        want[n] = min(seen)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def brute_removed(rows):
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    out = {}
    for d, t in rows:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                m[i : i + 50] = True
        kept = np.frombuffer(t, np.uint8)[~m].tobytes()
        out[d] = (len(t), int(m.sum()), int((np.diff(m.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc dé\n🙂\0") for _ in range(rng.randint(0, 260))) for _ in range(10)]
    texts = []
    for _ in range(70):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            i = rng.randint(0, len(b))
            t += b[i : rng.randint(i, len(b))] + rng.choice(["", "x", "ab" * 40, "Pf " * rng.randint(0, 60), "\0" * 70])
        texts.append(t)
    return texts


@pytest.mark.parametrize("part", [1 << 19, 64])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(repeats, "PART", part)
    texts = passages(part)
    df = spark.createDataFrame([(k, t, "c", "c") for k, t in enumerate(texts)] + [(900, None, "c", "c")], DOCS)
    if part == 64:  # the workers don't see the patch: the local functions do
        for t in texts:
            raw = t.encode()
            a, ends = np.frombuffer(raw, np.uint8), np.array([len(raw)])
            seen = np.concatenate([np.arange(f, e + 1) for _, fs, es in repeats.runs_of(a, ends) for f, e in zip(fs, es, strict=True)] or [np.zeros(0, int)])
            assert np.array_equal(seen, np.arange(max(0, len(raw) - 49)))
        return
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removed_digests(df).collect()}
    assert got == brute_removed([(k, t.encode()) for k, t in enumerate(texts)] + [(900, b"")])


@pytest.mark.parametrize(("phrase", "hot"), [(40, 20), (62, 20)])
def test_hot_anchors_are_dealt_by_what_stands_around(spark, monkeypatch, phrase, hot):
    """A phrase in every document, with other text around it each time: no bucket stays hot, and the result is the same."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BUCKET", 10**9)
    seen, cooled = [], repeats._cooled

    def spy(runs):
        out = cooled(runs)
        sizes = lambda rows: [r[0] for r in rows.groupBy("bucket").agg({"n": "sum"}).select("sum(n)").collect()]
        seen.append((max(sizes(runs)), max(sizes(out[0]), default=0), out[1] is not None))
        return out

    monkeypatch.setattr(repeats, "_cooled", spy)
    rng = random.Random(phrase)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common = word(phrase)
    texts = [word(60) + word(rng.randint(0, 9)) + common + word(rng.randint(0, 70)) for _ in range(90)]
    texts += [texts[k][: rng.randint(40, 120)] + word(30) for k in range(20)] + [common, common[5:], "x" * 80, common * 2]
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removed_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removed([(k, t.encode()) for k, t in rows])
    before, after, whole = seen[0]
    assert before > 60 and after <= hot and (whole or phrase < 50)


def test_removal_keeps_other_columns_and_whole_characters(spark):
    shared = "é" * 40
    rows = [(1, shared + "a", 7, "n"), (2, "ù" + shared + "b", 8, None), (2, "own", 9, "x"), (None, shared, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _at int, grp string")
    got = {(r["doc_id"], r["_at"]): (r["text"], r["grp"], r["_lost"]) for r in repeats.remove_repeats(df).collect()}
    assert got == {(1, 7): (shared + "a", "n", 0), (2, 8): ("ùb", None, 80), (2, 9): ("own", "x", 0), (None, 1): ("", "z", 80)}


@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_maximal_repeats_equal_brute_force(texts):
    least = 3
    at = {}
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for n in range(least, len(t) - i + 1):
                at.setdefault(t[i : i + n], []).append((k, i))
    want = set()
    for s, where in at.items():
        left = {texts[k][i - 1] if i else (k, "start") for k, i in where}
        right = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else (k, "end") for k, i in where}
        if len(where) > 1 and len(left) > 1 and len(right) > 1:
            want.add((len(s), tuple(sorted(where))))
    got = {(n, tuple(where)) for n, where in repeats.repeat_groups(texts, least)}
    assert got == want


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        s = rng.integers(0, 3, n)
        order = repeats.suffix_array(s).tolist()
        assert order == sorted(range(n), key=lambda i: s[i:].tolist())
        lcp = repeats.lcp_array(s, np.array(order, dtype=np.int64))
        for i in range(1, n):
            a, b = s[order[i - 1] :], s[order[i] :]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            assert lcp[i] == (differ[0] if len(differ) else m)
