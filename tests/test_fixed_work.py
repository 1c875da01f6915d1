"""What a wave does at any size: nothing is run for what is known already."""

from pyspark.sql import functions as F

from laminar.functions.rules import annotate, violation
from laminar.operators import checks
from laminar.sources.store import Store
from laminar.specs import Rule
from laminar.streaming.pipeline import Pipeline


def jobs(spark, work):
    """What work gives, and the jobs it ran."""
    spark.sparkContext.setJobGroup(name := f"counted-{id(work)}", "")
    try:
        return work(), list(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_written_files_tell_whether_there_are_rows(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}"), spark.range(10).repartition(3)
    store.create("t", rows.schema)
    for df, bare in ((rows, False), (rows.filter("id > 5"), False), (rows.filter("id > 10"), True)):
        path = store._written("t", df)
        assert jobs(spark, lambda path=path: store._bare("t", path)) == (bare, [])


def test_children_without_rows_are_not_refreshed(spark, tmp_path):
    p = Pipeline(spark, f"file://{tmp_path}")
    p.bootstrap()
    assert jobs(spark, lambda: p.refresh_orphans("customers", "products")) == (0, [])


def test_a_new_table_takes_its_first_rows_without_comparing(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}"), spark.range(10).selectExpr("id", "cast(id AS string) AS v")
    store.create("t", rows.schema, "id", 3)

    def never(*_):
        raise AssertionError("compared")

    assert store.amend("t", never, never, "MERGE", first=(rows, {"insert": 0})) == {"insert": 0} and store.current_version("t") is None
    assert store.amend("t", never, never, "MERGE", "tag", first=(rows, {"insert": 10})) == {"insert": 10}
    assert [(c.version, c.operation, c.user_metadata, c.metrics) for c in store.commits("t")] == [(0, "MERGE", "tag", {"insert": "10"})]
    assert sorted(map(tuple, store.read("t").collect())) == sorted(map(tuple, rows.collect()))
    # once there are rows, they are compared as ever
    assert store.amend("t", lambda t: t.filter("id = 3").selectExpr("id", "'update' AS action"), lambda t, within: t.withColumn("v", F.lit("x")), "MERGE", first=(rows, {"insert": 10})) == {"update": 1}
    assert store.read("t").count() == 10 and store.read("t").filter("id = 3").first()["v"] == "x"


def test_rows_without_violations_keep_their_list_as_it_is(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 5), (2, -1), (CAST(NULL AS INT), 5), (4, CAST(NULL AS INT)) AS t(k, n)")
    made = checks.append_violation(annotate(rows, [Rule("n", "integer", minimum=0)]), violation("completeness", "not_null", "k", F.col("k").isNull()))
    assert {(r["k"], r["n"]): [v["rule"] for v in r["_violations"]] for r in made.collect()} == {(1, 5): [], (2, -1): ["minimum"], (None, 5): ["not_null"], (4, None): []}
    assert "ELSE _violations" in made._jdf.queryExecution().analyzed().toString()  # a list is made only where there is something to list
