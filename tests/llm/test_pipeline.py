"""The corpus pipeline, stage by stage and whole."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from laminar.llm.common import stash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, upper string, _grp int, _id string, _same string, _lost long, _stat_words double, `a.b` string, same string"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "u", 1, "i", "d", 5, 0.5, "x", "y") for k, t in rows], COLUMNS)


def staged(spark, docs, sf_dir):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, sf_dir), "test")
        out.append((name, docs))
    return out


def prose(rng, n):
    return " ".join(rng.choice(["and", "the", "of"]) + rng.choice(["thing", "nder", "tion", "hand"]) + str(rng.randrange(9999)) * (rng.random() < 0.2) + rng.choice("abcdefgh") * 2 for _ in range(n))


def test_stages_in_order_and_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.fixture
def taught(spark, tmp_path):
    """A folder with labels: ids up to 29 are good, 200 to 259 are not."""
    rows = [(k, 1, 0) for k in range(30)] + [(k, 0, 0) for k in range(200, 260)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_each_copy_goes_and_clean_documents_stay(spark, taught):
    rng = random.Random(1)
    noisy = lambda: " ".join(w + rng.choice(["&&&", "%%%", "###", "$$$"]) for w in prose(rng, 80).split())
    clean = [prose(rng, 120) for _ in range(30)]
    words = clean[3].split()
    words[50] = "changed"
    passage = " ".join(f"passage{k}" for k in range(60))
    rows = list(enumerate(clean))
    rows += [(100, clean[2].replace(" ", "  ", 3)), (101, " ".join(words)), (102, clean[4] + "\n" + passage), (103, prose(rng, 150) + "\n" + passage), (104, noisy())]
    rows += [(k, noisy()) for k in range(200, 260)]
    got = dict(staged(spark, documents(spark, rows), taught))
    ids = {n: {r["doc_id"] for r in d.select("doc_id").distinct().collect()} for n, d in got.items()}
    keep = set(range(30))
    assert 104 not in ids["quality"] and keep <= ids["quality"]
    # the longer of two equal texts stays: it is the one with more white space
    assert 2 not in ids["exact_dedup"] and 100 in ids["exact_dedup"]
    assert 101 not in ids["near_dedup"] and 3 in ids["near_dedup"]
    kept = {r["doc_id"]: r for r in got["suffix_dedup"].collect()}
    assert passage in kept[102]["text"] and passage not in kept[103]["text"]
    assert all(kept[k]["text"] == clean[k] and kept[k]["n_chars"] == len(clean[k]) for k in keep - {2, 4})
    assert all(d.columns == got["quality"].columns for n, d in got.items() if n != "packing")
    assert ids["packing"] == set(kept)


def test_odd_documents_and_clashing_columns(spark, taught):
    rows = [(1, None), (2, ""), (2, ""), (3, " \n"), (None, "a b"), (5, "é" * 30_000), (6, "<|endoftext|>")]
    for name, docs in staged(spark, documents(spark, rows), taught):
        if name != "packing":
            assert docs.columns == [c.split()[0].strip("`") for c in COLUMNS.split(", ")]
            assert docs.filter("_grp <> 1 OR _id <> 'i' OR _same <> 'd' OR _lost <> 5 OR _stat_words <> 0.5 OR same <> 'y'").count() == 0
    for _, docs in staged(spark, documents(spark, []), taught):
        assert docs.count() == 0


def test_near_copies_without_an_id_go(spark, taught):
    rng = random.Random(4)
    words = prose(rng, 200).split()
    near = lambda k: " ".join([*words[:k], "other", *words[k + 1 :]])
    rows = [(None, near(10)), (None, near(60)), (9, near(120)), (None, prose(rng, 100)), (4, "own words only")]
    kept = corpus_pipeline.drop_near_copies(spark, stash(documents(spark, rows), "test"), taught).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted([(9, near(120)), (-1, rows[3][1]), (4, "own words only")])
    # without any id one of them stays
    kept = corpus_pipeline.drop_near_copies(spark, stash(documents(spark, rows[:2]), "test"), taught).collect()
    assert len(kept) == 1


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_run_packs_what_is_left(spark, sf):
    rows = corpus_pipeline.run(spark, f"/root/testdata/{sf}").collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert 0 < len({r["doc_id"] for r in rows}) < 200
