"""Orders in several runs of their key: the same results as SQL, and what is dealt out at a time is a run."""

from functools import reduce
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar import oracles, queries
from laminar.operators import survive
from laminar.sources import adapters
from tests.test_catalogue import canonical, duck  # noqa: F401


@pytest.fixture(scope="module")
def cut(spark, sf_dir):
    x = queries.Layers(spark, sf_dir)
    x.slices = lambda: 3
    assert len(x.pieces("orders")) > 3  # three runs of keys, and the rows without one
    return x


def test_small_tables_are_one_run_and_larger_ones_are_cut(spark, sf_dir, monkeypatch):
    x = queries.Layers(spark, sf_dir)
    assert x.slices() == 1
    monkeypatch.setattr(queries, "SLICE", 100_000)
    assert x.slices() > 1


def test_a_key_lies_in_one_run(cut):
    seen = [{r[0] for r in rows.select("order_id").distinct().collect()} for rows in cut.pieces("orders")]
    assert sum(map(len, seen)) == len(set().union(*seen)) and {None} in seen


@pytest.mark.parametrize(
    "name",
    ["delivery_rank", "survivorship_rank", "split_failed", "split_passed", "split_superseded", "upsert_actions", "upsert_result", "qualifying_orders", "recon_full_outer_diff", "dash_filter_segment", "gold_customer_segmentation", "gold_input_breakdown", "wave_change_feed", "wave_silver_orders"],
)
def test_cut_orders_agree_with_sql(cut, duck, name):  # noqa: F811
    df = queries.QUERIES[name](cut)
    made = duck.execute(oracles.oracle_sql()[name])
    assert canonical(df.columns, df.collect()) == canonical([c[0] for c in made.description], made.fetchall())


def test_orders_are_not_kept_landed(spark, sf_dir):
    """A run of landed orders goes before the next one is made; what they leave is the rows that are asked for."""
    x = queries.Layers(spark, sf_dir)
    x.slices = lambda: 3
    files, n, seen = [], 0, 0
    for rows in x.runs("orders"):
        assert not any(f.exists() for f in files), "the run before is still there"
        files += [Path(urlparse(f).path) for f in rows.inputFiles()]
        n, seen = n + 1, seen + rows.count()
    assert n > 3 and seen == x.raw("orders").count() and "landing" not in x.made
    assert files and not any(f.exists() for f in files)


@pytest.fixture(scope="module")
def unkept(spark, sf_dir):
    x = queries.Layers(spark, sf_dir)
    x.slices = lambda: 2
    return x


@pytest.mark.parametrize("name", ["upsert_result", "upsert_actions", "split_failed", "split_passed", "recon_full_outer_diff", "gold_customer_segmentation", "dash_filter_segment"])
def test_runs_that_are_not_kept_agree_with_sql(unkept, duck, name):  # noqa: F811
    df = queries.QUERIES[name](unkept)
    made = duck.execute(oracles.oracle_sql()[name])
    assert canonical(df.columns, df.collect()) == canonical([c[0] for c in made.description], made.fetchall())
    assert "landing" not in unkept.made


def test_every_row_lies_in_one_run(spark, sf_dir, tmp_path):
    """Lines without a number, too: their rows come without a key and belong to no range of keys."""
    for t in adapters.TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t == "lineitem":
            df = df.withColumn("l_linenumber", F.when(F.col("l_orderkey") % 50 != 0, F.col("l_linenumber")))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    whole = adapters.entity(spark, str(tmp_path), "orders")
    runs = list(adapters.order_slices(spark, str(tmp_path), 4))
    made = reduce(DataFrame.unionAll, runs)
    assert whole.exceptAll(made).isEmpty() and made.exceptAll(whole).isEmpty()
    assert whole.filter("order_id IS NULL").count() > 20 and len(runs) == 5


def test_a_row_comes_when_its_delivery_does(spark, sf_dir):
    rows = adapters.entity(spark, sf_dir, "orders")
    assert survive.delivered(rows, survive.arrivals(rows)).exceptAll(adapters.dated(rows)).isEmpty()


def test_results_keep_neither_rows_they_dont_show_nor_hashes(cut):
    failed = cut.fate("orders", "failed")
    assert failed.count() == cut._once(("pieces", "failed"), None).count() < cut.raw("orders").count() / 2
    cut.fate("orders", "passed"), queries.upsert_result(cut)
    for key in ("failed", "passed", "upsert_result"):
        assert "_row_hash" not in cut.made["pieces", key].columns
