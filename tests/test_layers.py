"""Store, files, generator and two whole waves."""

import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from laminar.plans import reconcile
from laminar.plans.manifest import latest_manifest
from laminar.sources import adapters, files, generator
from laminar.sources.store import ConflictError, NullInRequiredColumn, Store, with_retry
from laminar.specs import CUSTOMERS, ENTITIES, ORDERS, PRODUCTS, Rule, constraints, rules_json, with_rules
from laminar.streaming.pipeline import Pipeline, post_images


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}")


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def test_append_replace_and_time_travel(spark, store):
    store.create("t", frame(spark, []).schema)
    assert store.current_version("t") is None and store.read("t").count() == 0
    assert store.append("t", frame(spark, [])) is None
    assert store.append("t", frame(spark, [(1, "a")]), tag="x", once=True) == 0
    assert store.append("t", frame(spark, [(1, "a")]), tag="x", once=True) is None
    assert store.append("t", frame(spark, [(2, "b")])) == 1
    assert store.replace("t", frame(spark, [(9, "z")]), 1) == 2
    assert [r["k"] for r in store.read("t").collect()] == [9]
    assert sorted(r["k"] for r in store.read("t", version=1).collect()) == [1, 2]
    assert [r["operation"] for r in store.history("t").collect()] == ["REPLACE", "APPEND", "APPEND"]
    assert store.history("t", user_metadata="x").count() == 1
    feed = store.changes("t", after=0)
    assert {(r["k"], r["_change_type"], r["_commit_version"]) for r in feed.collect()} == {(2, "insert", 1), (9, "insert", 2)}
    assert post_images(feed).count() == 2 and post_images(frame(spark, [(1, "a")])).count() == 1


def test_conflicts_are_seen_and_retried(spark, store):
    store.create("t", frame(spark, []).schema)
    store.append("t", frame(spark, [(1, "a")]))
    with pytest.raises(ConflictError):
        store.replace("t", frame(spark, [(2, "b")]), None)
    calls = []

    def make(old):
        calls.append(1)
        if len(calls) == 1:
            store.append("t", frame(spark, [(5, "e")]))
        return old.withColumn("v", F.lit("new")), {"rows": 1}

    store.change("t", make, "MERGE", wait_s=0)
    assert len(calls) == 2 and sorted((r["k"], r["v"]) for r in store.read("t").collect()) == [(1, "new"), (5, "new")]
    waits = []

    def never():
        raise ConflictError("t")

    with pytest.raises(ConflictError):
        with_retry(never, wait_s=5, sleep=waits.append)
    assert waits == [5, 10]


def test_appends_side_by_side_all_land(spark, store):
    store.create("t", frame(spark, []).schema)
    threads = [threading.Thread(target=lambda k=k: store.append("t", frame(spark, [(k, "x")]))) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["k"] for r in store.read("t").collect()) == [0, 1, 2, 3]


def test_required_columns_config_rows_and_new_columns(spark, store):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("v", T.StringType())])
    store.create("t", schema)
    with pytest.raises(NullInRequiredColumn):
        store.append("t", frame(spark, [(None, "a")]))
    store.append("t", frame(spark, [(1, "mine")]))
    store.insert_if_absent("t", frame(spark, [(1, "seed"), (2, "seed")]), "k")
    assert {(r["k"], r["v"]) for r in store.read("t").collect()} == {(1, "mine"), (2, "seed")}
    store.update_if_present("t", frame(spark, [(2, "new"), (3, "no")]), "k", ["v"])
    assert {(r["k"], r["v"]) for r in store.read("t").collect()} == {(1, "mine"), (2, "new")}
    assert store.one("t", "k", 1)["v"] == "mine"
    with pytest.raises(LookupError):
        store.one("t", "k", 7)
    store.create("t", T.StructType([*schema.fields, T.StructField("more", T.StringType())]))
    assert {r["more"] for r in store.read("t").collect()} == {None}


def test_csv_keeps_every_row_and_rescues_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("product_id,product_name,category,price,cost,stock_quantity,reorder_level\n1,,Toys,1.00,0.50,3,1\nx,Ball,Toys,bad,0.50,3,1\n")
    rows = {r["category"]: r for r in files.read_csv(spark, str(tmp_path / "a.csv"), PRODUCTS.schema).filter(F.col("product_id").isNotNull()).collect()}
    assert rows["Toys"]["product_name"] is None and rows["Toys"]["_rescued_data"] is None
    lost = files.read_csv(spark, str(tmp_path / "a.csv"), PRODUCTS.schema).filter(F.col("product_id").isNull()).collect()
    assert [(r["product_name"], r["price"]) for r in lost] == [("Ball", None)] and "bad" in lost[0]["_rescued_data"]


def test_generator_counts_and_determinism(spark):
    small = {"customers": 800, "products": 120, "orders": 2000}
    one, two = generator.seed_delivery(spark, 1, small), generator.seed_delivery(spark, 1, small)
    assert generator.summary(one) == {"customers": 815, "products": 128, "orders": 2025}
    for name in one:
        assert one[name].exceptAll(two[name]).isEmpty()
    c = one["customers"]
    assert c.filter("email IS NULL").count() == 50 and c.filter("customer_id IS NULL").count() == 5
    assert one["orders"].filter("customer_id >= 900001").count() == 50
    assert one["orders"].filter("product_id IS NULL").count() == 200


def deliver(p, delivery, stamp):
    for name, df in delivery.items():
        files.write_csv(df, f"{p.root}/tmp/{name}_{stamp}", 1)
        import glob
        import os
        import shutil

        os.makedirs(f"{p.root.removeprefix('file://')}/landing/{name}", exist_ok=True)
        for k, f in enumerate(glob.glob(f"{p.root.removeprefix('file://')}/tmp/{name}_{stamp}/part-*.csv")):
            shutil.copy(f, f"{p.root.removeprefix('file://')}/landing/{name}/{name}_{stamp}_{k}.csv")


def test_two_waves(spark, tmp_path):
    p = Pipeline(spark, f"file://{tmp_path}")
    p.bootstrap()
    p.bootstrap()
    small = {"customers": 800, "products": 120, "orders": 2000}
    deliver(p, generator.seed_delivery(spark, 7, small), "1")
    first = p.run_wave()
    assert [first[f"bronze.{n}"]["rows_written"] for n in ENTITIES] == [815, 128, 2025]
    quarantine = p.store.read("ops/quarantine").cache()
    for e in (CUSTOMERS, PRODUCTS, ORDERS):
        rows = p.store.read(f"silver/{e.name}")
        assert reconcile.duplicate_keys(rows, e.key).first()[0] == 0
        assert reconcile.unaccounted_keys(p.store.read(f"bronze/{e.name}"), rows, quarantine, e).first()[0] == 0
    parents = {n: p.parent(n) for n in ("customers", "products")}
    orders = p.parent("orders")
    waiting = orders.filter("_is_orphan AND customer_id BETWEEN 900001 AND 900010").count()
    assert waiting > 0
    for flag in (True, False):
        assert reconcile.orphans_wrongly(orders, parents, ORDERS, flag).first()[0] == 0
    # nothing new: nothing is read again, and no row is written
    again = p.run_wave()
    assert again["bronze.orders"]["rows_written"] == 0 and again["silver.orders"]["rows_written"] == 0
    before = p.parent("customers").select("customer_id").cache()
    known = before.count()
    deliver(p, generator.delta_delivery(spark, 7, small), "2")
    second = p.run_wave()
    assert second["bronze.orders"]["rows_written"] == 500
    customers = p.parent("customers")
    assert customers.filter("customer_id >= 900001").count() == 10
    changed = customers.join(before, "customer_id").filter("customer_id <= 20").count()
    fresh = customers.count() - known
    restated = second["silver.customers"]["rows_written"] - fresh
    assert changed <= restated <= changed + 200
    assert p.parent("products").filter("_is_deleted AND product_id > 117 AND product_id <= 120").count() >= 1
    orders = p.parent("orders")
    assert orders.filter("_is_orphan AND customer_id BETWEEN 900001 AND 900010 AND NOT product_id >= 910001").count() == 0
    for flag in (True, False):
        assert reconcile.orphans_wrongly(orders, {n: p.parent(n) for n in ("customers", "products")}, ORDERS, flag).first()[0] == 0
    g = {n: p.store.read(f"gold/{n}") for n in ("sales_by_product", "revenue_by_customer", "daily_weekly_trends", "customer_segmentation")}
    seg, rev = g["customer_segmentation"], g["revenue_by_customer"]
    assert seg.agg(F.sum("customer_count")).first()[0] == rev.count()
    assert seg.agg(F.sum("total_revenue")).first()[0] == rev.agg(F.sum("total_revenue")).first()[0]
    last = {(r["layer"], r["entity_name"]): r["status"] for r in latest_manifest(p.store.read("ops/manifest")).collect()}
    assert set(last.values()) == {"success"} and ("gold", None) in last and len(last) == 7


def test_repeated_epochs_add_nothing(spark, tmp_path):
    """The stream's last commit marker is lost, as after a crash between a write and its marker: the epoch is run again."""
    p = Pipeline(spark, f"file://{tmp_path}")
    p.bootstrap()
    deliver(p, generator.seed_delivery(spark, 3, {"customers": 800, "products": 120, "orders": 2000}), "1")
    p.run_wave()
    tables = [*(f"{x}/{n}" for x in ("bronze", "silver") for n in ENTITIES), "ops/quarantine", "ops/dq_metrics"]
    before = {t: p.store.read(t).count() for t in tables}
    for mark in tmp_path.glob("checkpoints/*/commits/*"):
        mark.unlink()
    p.run_wave()
    assert {t: p.store.read(t).count() for t in tables} == before and before["bronze/orders"] == 2025 and min(before.values()) > 0
    # files that come later are new to the same stream
    deliver(p, generator.delta_delivery(spark, 3, {"customers": 800, "products": 120, "orders": 2000}), "2")
    assert p.ingest("orders")["rows_written"] > 0


def test_rules_come_from_configuration(spark, tmp_path):
    p = Pipeline(spark, f"file://{tmp_path}")
    p.bootstrap()
    assert p.configured("orders") == ORDERS and sum(len(constraints(p.configured(n))) for n in ENTITIES) == 30
    strict = replace(PRODUCTS, rules=(*PRODUCTS.rules, Rule("cost", "number", maximum=1)))
    rows = spark.createDataFrame([("products", rules_json(strict))], "source_name string, r string").select("source_name", F.parse_json("r").alias("dq_rules"))
    p.store.update_if_present("ops/source_config", rows, "source_name", ["dq_rules"])
    deliver(p, generator.seed_delivery(spark, 3, {"customers": 800, "products": 120, "orders": 2000}), "1")
    p.ingest("products")
    p.conform("products")
    assert p.store.read("silver/products").filter("cost > 1").count() == 0
    p.reseed_rules()
    assert p.configured("products") == PRODUCTS
    p.store.update_if_present("ops/source_config", rows.withColumn("dq_rules", F.lit(None).cast("variant")), "source_name", ["dq_rules"])
    with pytest.raises(ValueError, match="no rules"):
        p.configured("products")
    p.store.append("ops/source_config", p.store.read("ops/source_config").filter("source_name = 'orders'"))
    with pytest.raises(LookupError, match="2 rows"):
        p.configured("orders")
    with pytest.raises(LookupError, match="no rows"):
        p.store.one("ops/source_config", "source_name", "none")
    for bad in ('{"rules": []}', "[]", '{"rules": [{"column": "a", "kind": "string", "odd": 1}], "checks": []}'):
        with pytest.raises(ValueError):
            with_rules(PRODUCTS, bad)


def test_long_logs_are_summarised(spark, store, monkeypatch):
    monkeypatch.setattr("laminar.sources.store.EVERY", 4)
    store.create("t", frame(spark, []).schema)
    for k in range(10):
        store.append("t", frame(spark, [(k, "x")]))
    opened, text = [], store._text
    monkeypatch.setattr(store, "_text", lambda path: opened.append(path) or text(path))
    assert [c.version for c in store.commits("t")] == list(range(10)) and len(opened) == 3
    opened.clear()
    assert store.current_version("t") == 9 and opened == []
    assert store.read("t").count() == 10 and store.read("t", version=4).count() == 5


def test_two_writers_never_make_one_version(spark, store):
    store.create("t", frame(spark, []).schema)
    path = f"{store.commits_dir('t')}/{0:020d}.json"
    store._create(path, "{}")
    with pytest.raises(ConflictError):
        store._create(path, "other")
    assert store._text(path) == "{}"
    won = []

    def race(k):
        try:
            store._create(f"{store.commits_dir('t')}/{7:020d}.json", str(k))
            won.append(k)
        except ConflictError:
            pass

    threads = [threading.Thread(target=race, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and store._text(f"{store.commits_dir('t')}/{7:020d}.json") == str(won[0])


def test_changed_tables_are_read_again(spark, sf_dir, tmp_path):
    import shutil

    from laminar import queries

    for t in adapters.TABLES:
        shutil.copy(f"{sf_dir}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    one = queries.layers(spark, str(tmp_path))
    assert queries.layers(spark, str(tmp_path)) is one
    shutil.copy("/root/testdata/sf0.01/part.parquet", f"{tmp_path}/part.parquet")
    assert queries.layers(spark, str(tmp_path)) is not one


def test_failed_runs_leave_a_manifest_row(spark, tmp_path):
    p = Pipeline(spark, f"file://{tmp_path}")
    p.bootstrap()
    with pytest.raises(Exception):  # noqa: B017
        p.ingest("orders")  # no landing folder
    row = p.store.read("ops/manifest").collect()[0]
    assert row["status"] == "failed" and row["rows_written"] == 0 and row["error_message"]


def test_no_row_loops_or_rdds_in_the_engine():
    from pathlib import Path

    import laminar

    for f in Path(laminar.__file__).parent.rglob("*.py"):
        if "llm" not in f.parts:
            text = f.read_text()
            assert ".rdd" not in text and "parallelize" not in text and "import laminar.llm" not in text and "from laminar.llm" not in text, f


def test_merges_leave_other_parts_alone(spark, store):
    """A change of a few keys of a dealt table writes their parts; the files of all others stay in place, and earlier versions can be read."""
    store.create("t", frame(spark, []).schema, "k", 8)

    def amend(rows, operation="MERGE"):
        new = frame(spark, rows)
        plan = lambda old: new.join(old.select("k", F.col("v").alias("was")), "k", "left").filter("was IS NULL OR was <> v").select("k", F.expr("if(was IS NULL, 'insert', 'update')").alias("action"))
        make = lambda old, within: within(new).unionByName(old.join(new, "k", "left_anti"))
        return store.amend("t", plan, make, operation)

    assert amend([(k, "a") for k in range(100)]) == {"insert": 100}
    first = {path for path, _ in store._live("t")}
    assert len(first) == 8
    assert amend([(5, "b"), (6, "a")]) == {"update": 1}
    second = {path for path, _ in store._live("t")}
    assert len(second - first) == 1 and len(first & second) == 7
    assert {r["k"]: r["v"] for r in store.read("t").collect()} == {k: "b" if k == 5 else "a" for k in range(100)}
    assert store.read("t", version=0).filter("v = 'b'").isEmpty()
    assert amend([(5, "b")]) == {} and store.current_version("t") == 1
    assert amend([(200, "n")]) == {"insert": 1} and store.read("t").count() == 101
    touched = store.commits("t")[1]
    assert touched.parts == touched.scope and len(touched.parts) == 1 and touched.metrics == {"update": "1"}
    assert store.changes("t", after=0).columns == ["k", "v", "_change_type", "_commit_version", "_commit_timestamp"]
    store.replace("t", frame(spark, [(1, "z")]), 2)
    assert [tuple(r) for r in store.read("t").collect()] == [(1, "z")]
    store.create("whole", frame(spark, []).schema)
    with pytest.raises(ValueError, match="dealt"):
        store.amend("whole", None, None, "MERGE")


def test_appends_compute_their_rows_once(spark, store):
    """Whether there is a row is seen in what was written; hashes are written with a codec that halves them."""
    import glob

    store.create("t", frame(spark, []).schema)
    seen = spark.sparkContext.accumulator(0)
    rows = frame(spark, [(k, "a") for k in range(8)]).coalesce(1).filter(F.udf(lambda k: (seen.add(1), True)[1], "boolean")("k"))
    assert store.append("t", rows) == 0 and seen.value == 8
    assert store.append("t", rows.filter("k > 100")) is None and store.current_version("t") == 0
    files_ = glob.glob(f"{store.root.removeprefix('file://')}/t/data/*/*.parquet")
    assert files_ and all(f.endswith(".zstd.parquet") for f in files_)


def test_shuffle_files_go_when_a_table_is_written(spark, store):
    from laminar.sources import store as module

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with module.tidy(spark), module.tidy(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before and not module._HELD


def test_waves_run_what_a_query_reads(spark, sf_dir):
    """Bronze alone for its feed, all of it for gold; flags of children are refreshed once for all their parents."""
    from laminar import queries

    x = queries.Layers(spark, sf_dir)
    feed = queries.QUERIES["wave_change_feed"](x)
    p = x.waves[0][1]
    assert feed.count() == p.store.changes("bronze/orders", after=0).count() > 0
    assert p.store.current_version("bronze/customers") is None and p.store.current_version("silver/orders") is None
    full = x.wave()
    assert full is not p and x.wave(queries.SILVER) is full and full.store.exists("gold/sales_by_product")
    assert x.wave(queries.BRONZE, ("orders",)) is p
    assert [c.user_metadata for c in full.store.commits("silver/orders") if c.operation == "REFRESH ORPHANS"] == ["after customers, products"]


def test_a_failed_refresh_of_flags_is_an_error(spark, tmp_path, monkeypatch):
    """Another writer keeps a wave from refreshing the flags: the wave fails, gold isn't built of stale flags, and the manifest says so. A repeated wave makes it good."""
    p = Pipeline(spark, f"file://{tmp_path}")
    p.bootstrap()
    small = {"customers": 800, "products": 120, "orders": 2000}
    deliver(p, generator.seed_delivery(spark, 7, small), "1")
    p.run_wave(layers=("bronze", "silver"))
    deliver(p, generator.delta_delivery(spark, 7, small), "2")
    amend = Store.amend

    def conflicting(self, table, plan, make, operation, *rest, **more):
        if operation == "REFRESH ORPHANS":
            raise ConflictError(table)
        return amend(self, table, plan, make, operation, *rest, **more)

    def told():
        return {r["entity_name"]: r["status"] for r in latest_manifest(p.store.read("ops/manifest").filter("layer = 'silver'")).collect()}

    monkeypatch.setattr(Store, "amend", conflicting)
    with pytest.raises(ConflictError, match="silver/orders"):
        p.run_wave()
    with pytest.raises(ConflictError, match="silver/orders"):
        p.conform("customers")
    monkeypatch.undo()
    assert told() == {"customers": "failed", "products": "failed", "orders": "success"} and not p.store.exists("gold/sales_by_product")
    assert p.run_wave()["silver.products"]["healed"] > 0 and {*told().values()} == {"success"}
    for flag in (True, False):
        assert reconcile.orphans_wrongly(p.parent("orders"), {n: p.parent(n) for n in ("customers", "products")}, ORDERS, flag).first()[0] == 0
    assert p.store.exists("gold/sales_by_product")


def test_a_failed_wave_is_no_result(spark, sf_dir, monkeypatch):
    from laminar import queries

    def failing(self, *changed):
        raise RuntimeError("no flags")

    x = queries.Layers(spark, sf_dir)
    monkeypatch.setattr(Pipeline, "refresh_orphans", failing)
    with pytest.raises(RuntimeError, match="no flags"):
        queries.QUERIES["wave_silver_orders"](x)
    assert x.waves == []
