"""Small hand-made cases for rules, checks, survivorship and state."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from laminar.functions.rules import annotate
from laminar.operators import checks, quality_report, state, survive
from laminar.plans import gold, reconcile
from laminar.specs import CUSTOMERS, ORDERS, PRODUCTS, Check, Entity, Rule

D = dt.date


def order(order_id, customer_id=1, product_id=1, quantity=1, amount="10.00", status="Completed", day=D(2024, 1, 1), batch="b1", at="2024-01-01"):
    return (order_id, customer_id, day, product_id, quantity, Decimal("10.00"), Decimal(amount), status, None, batch, dt.datetime.fromisoformat(at))


SCHEMA = ORDERS.schema.simpleString()[7:-1].replace(":", " ").replace(",payment", ", payment")


def orders(spark, rows):
    from pyspark.sql import types as T

    schema = T.StructType([*ORDERS.schema.fields, T.StructField("_batch_id", T.StringType()), T.StructField("_ingest_timestamp", T.TimestampType())])
    return spark.createDataFrame(rows, schema)


def parents(spark, customers=(1,), products=(1,), gone=()):
    c = spark.createDataFrame([(k, k in gone) for k in customers], "customer_id int, _is_deleted boolean")
    p = spark.createDataFrame([(k, False) for k in products], "product_id int, _is_deleted boolean")
    return {"customers": c, "products": p}


def annotated(spark, df, up):
    return checks.apply_checks(annotate(df, ORDERS.rules), ORDERS.checks, up.__getitem__)


def test_null_passes_all_but_not_null(spark):
    df = spark.createDataFrame([(None, None)], "s string, n int")
    rules = [Rule("s", "string", min_length=2, pattern="x", enum=("a",), format="email"), Rule("n", "integer", minimum=1, multiple_of=2)]
    assert annotate(df, rules).first()["_violations"] == []
    assert [v["rule"] for v in annotate(df, [Rule("s", "string", nullable=False)]).first()["_violations"]] == ["not_null"]


def test_rules_on_missing_columns_are_skipped_and_no_rules_give_an_empty_list(spark):
    df = spark.createDataFrame([(1,)], "n int")
    assert annotate(df, [Rule("absent", "string", min_length=1)]).first()["_violations"] == []
    assert annotate(df, []).first()["_violations"] == []


def test_text_that_is_no_number_or_date_passes(spark):
    df = spark.createDataFrame([("x", "y"), ("5", "2024-13-45"), ("50", "2030-01-01")], "n string, d string")
    rules = [Rule("n", "integer", minimum=10), Rule("d", "date", max_date="2025-01-01")]
    assert [[v["rule"] for v in r["_violations"]] for r in annotate(df, rules).collect()] == [[], ["minimum"], ["max_date"]]


def test_multiple_of_is_decimal(spark):
    df = spark.createDataFrame([(Decimal("0.30"),), (Decimal("0.35"),)], "n decimal(18,2)")
    assert [len(r["_violations"]) for r in annotate(df, [Rule("n", "number", multiple_of="0.1")]).collect()] == [0, 1]


def test_specs_reject_what_they_cannot_mean():
    with pytest.raises(ValueError):
        Check("foreign", ("a",))
    with pytest.raises(ValueError):
        Check("fk_exists", ("a",))
    with pytest.raises(ValueError):
        Rule("a", "text")
    with pytest.raises(ValueError):
        Entity("e", "k", ORDERS.schema, "sometimes")


def test_metrics_count_each_check_apart(spark):
    rows = [order(1), order(2, customer_id=None), order(3, quantity=0), order(4), order(4)]
    got = {r["check_category"]: r["rows_quarantined"] for r in quality_report.quality_metrics(annotated(spark, orders(spark, rows), parents(spark)), ORDERS).collect()}
    assert got == {"completeness": 1, "type_logic": 1, "uniqueness": 2, "referential": 0}
    empty = quality_report.quality_metrics(annotated(spark, orders(spark, []), parents(spark)), ORDERS).collect()
    assert [(r["rows_evaluated"], r["pass_pct"]) for r in empty] == [(0, 0.0)] * 4


def test_copies_in_one_delivery_keep_one_and_reject_one(spark):
    parts = survive.split(annotated(spark, orders(spark, [order(1), order(1)]), parents(spark)), ORDERS)
    assert (parts.passed.count(), parts.failed.count()) == (1, 1)


def test_later_delivery_supersedes_by_time_not_by_batch_id(spark):
    rows = [order(1, amount="1.00", batch="zz", at="2024-01-01"), order(1, amount="2.00", batch="aa", at="2024-01-02")]
    parts = survive.split(annotated(spark, orders(spark, rows), parents(spark)), ORDERS)
    assert [r["total_amount"] for r in parts.passed.collect()] == [Decimal("2.00")]
    assert (parts.failed.count(), parts.superseded.count()) == (0, 1)


def test_defective_newest_row_shadows_the_good_one(spark):
    rows = [order(1, batch="b1", at="2024-01-01"), order(1, quantity=0, batch="b2", at="2024-01-02")]
    parts = survive.split(annotated(spark, orders(spark, rows), parents(spark)), ORDERS)
    assert (parts.survivors.count(), parts.passed.count(), parts.failed.count(), parts.superseded.count()) == (1, 0, 1, 1)


def test_orphans_pass_with_a_flag_and_null_keys_are_no_orphans(spark):
    tagged = annotated(spark, orders(spark, [order(1, customer_id=9)]), parents(spark))
    made = survive.prepared(survive.split(tagged, ORDERS).passed, ORDERS)
    assert [(r["_is_orphan"], r["quality_check_result"]) for r in made.collect()] == [(True, "PASS")]
    lone = checks.check_fk_exists(annotate(orders(spark, [order(1, customer_id=None)]), ()), "customer_id", parents(spark)["customers"], "customer_id")
    assert lone.first()["_violations"] == []


def test_null_keys_are_quarantined_under_one_name(spark):
    tagged = annotated(spark, orders(spark, [order(None), order(None)]), parents(spark))
    rows = quality_report.quarantine_rows(survive.split(tagged, ORDERS).failed, ORDERS, "r").collect()
    assert {r["primary_key"] for r in rows} == {"__NULL_PK__"} and len(rows) == 2
    assert all({v["category"] for v in r["violations"]} == {"completeness", "uniqueness"} for r in rows)


def silver(spark, rows, up=None):
    return survive.prepared(survive.split(annotated(spark, orders(spark, rows), up or parents(spark)), ORDERS).passed, ORDERS)


def test_upsert_is_gated_by_hash_and_revives(spark):
    target, same = silver(spark, [order(1), order(2), order(3)]), silver(spark, [order(1)])
    changed, new = silver(spark, [order(2, amount="99.00")]), silver(spark, [order(4)])
    act = lambda s, t=target: {r["order_id"]: r["action"] for r in state.upsert_actions(t, s, ORDERS).collect()}
    assert act(same)[1] == "keep" and act(changed)[2] == "update" and act(new)[4] == "insert"
    deleted = target.withColumn("_is_deleted", F.col("order_id") == 1)
    assert act(same, deleted)[1] == "update"
    after = state.upsert(deleted, same, ORDERS)
    assert {r["order_id"]: r["_is_deleted"] for r in after.collect()} == {1: False, 2: False, 3: False}
    assert act(same, target.withColumn("_row_hash", F.lit(None).cast("string")))[1] == "update"


def test_soft_delete_marks_and_is_idempotent_and_skips_increments(spark):
    t = spark.createDataFrame([(k, False) for k in (1, 2, 3)], "product_id int, _is_deleted boolean")
    snapshot = spark.createDataFrame([(1,), (3,)], "product_id int")
    once = state.soft_delete(t, snapshot, PRODUCTS)
    assert {r["product_id"] for r in once.filter("_is_deleted").collect()} == {2}
    assert state.missing_keys(once, snapshot, PRODUCTS).count() == 0
    assert state.soft_delete(once, t, PRODUCTS).filter("_is_deleted").count() == 1  # being delivered again doesn't revive here
    o = silver(spark, [order(1)])
    assert state.missing_keys(o, orders(spark, []), ORDERS).count() == 0


def test_orphans_heal_stay_and_appear(spark):
    child = silver(spark, [order(1, customer_id=7), order(2, customer_id=8), order(3)])
    up = parents(spark, customers=(1, 7), gone=(1,))
    got = {r["order_id"]: (r["was_orphan"], r["is_orphan"]) for r in state.orphan_changes(child, up, ORDERS).collect()}
    assert got == {1: (True, False), 3: (False, True)}
    healed = state.refresh_orphans(child, up, ORDERS)
    assert state.orphan_changes(healed, up, ORDERS).count() == 0
    assert reconcile.orphans_wrongly(child, up, ORDERS, True).first()[0] == 1


def test_qualifying_rule_and_gold(spark):
    rows = [(1, 1, 1, "50.00", "Completed", False, False), (2, 1, 1, "30.00", "Completed", False, False), (3, 1, 1, "9.00", "Pending", False, False), (4, 1, 1, "9.00", "Completed", True, False), (5, 1, 1, "9.00", "Completed", False, True)]
    o = spark.createDataFrame([(a, b, c, D(2024, 1, 3), Decimal(x), s, f, g) for a, b, c, x, s, f, g in rows], "order_id int, customer_id int, product_id int, order_date date, total_amount decimal(18,2), order_status string, _is_orphan boolean, _is_deleted boolean")
    c = spark.createDataFrame([(1, "a", "Basic", False), (2, "b", "Basic", False), (3, "c", "Basic", True)], "customer_id int, customer_name string, customer_segment string, _is_deleted boolean")
    q = gold.qualifying_orders(o)
    got = {r["customer_id"]: (r["total_revenue"], r["total_orders"], r["avg_order_value"]) for r in gold.revenue_by_customer(c, q).collect()}
    assert got == {1: (Decimal("80.00"), 2, Decimal("40.00")), 2: (Decimal("0.00"), 0, None)}
    assert gold.daily_weekly_trends(q).first()["week_start"] == D(2024, 1, 1)
    null_status = o.withColumn("order_status", F.lit(None).cast("string"))
    assert gold.qualifying_orders(null_status).count() == 0


@pytest.mark.parametrize(("days", "want"), [(90, "Repeat"), (91, "Inactive")])
def test_inactivity_is_strict(spark, days, want):
    last = D(2024, 6, 30)
    rows = [(1, 2, Decimal("10.00"), Decimal("10.00"), last), (2, 2, Decimal("10.00"), Decimal("10.00"), last - dt.timedelta(days)), (3, 9, Decimal("5000.00"), Decimal("5000.00"), last), (4, 1, Decimal("1.00"), Decimal("1.00"), last), (5, 0, Decimal("0.00"), Decimal("0.00"), None)]
    r = spark.createDataFrame(rows, "customer_id int, total_orders long, total_revenue decimal(18,2), lifetime_value_actual decimal(18,2), last_order_date date")
    got = {x["customer_id"]: x["segment_type"] for x in gold.segment_labels(r).collect()}
    assert got == {1: "Repeat", 2: want, 3: "High-Value", 4: "One-Time", 5: "Inactive"}


def test_full_outer_diff_sees_all_three_kinds(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k int, v int")
    b = spark.createDataFrame([(2, 5), (3, None), (4, 4)], "k int, v int")
    assert tuple(reconcile.full_outer_diff(a, b, "k", ["v"]).first()) == (1, 1, 1)


def test_row_hash_takes_null_for_empty_text(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string")
    a, b = (r[0] for r in df.select(survive.row_hash(["x", "y"])).collect())
    assert a == b


def test_ingest_hashes_customers_only(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    c = survive.ingested(spark.createDataFrame([], CUSTOMERS.schema), CUSTOMERS, "b", at)
    p = survive.ingested(spark.createDataFrame([], PRODUCTS.schema), PRODUCTS, "b", at)
    assert "_row_hash" in c.columns and "_row_hash" not in p.columns


def exchanges(df):
    """The rows' exchanges by hash in a plan, before any of it has run."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_keys_by_bit_and_by_join_say_the_same(spark, monkeypatch):
    keys = [None, 0, 1, -1, 63, 64, -64, -65, 2**31 - 1, -(2**31), 77]
    child = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    parent = spark.createDataFrame([(0, False), (-1, False), (64, False), (64, False), (-65, False), (2**31 - 1, False), (-(2**31), False), (77, True), (None, False)], "p int, _is_deleted boolean")
    want = {None: False, 0: False, 1: True, -1: False, 63: True, 64: False, -64: True, -65: False, 2**31 - 1: False, -(2**31): False, 77: True}
    by_bit = checks.with_lost(child, "k", parent, "p", "lost")
    assert {r["k"]: r["lost"] for r in by_bit.collect()} == want and by_bit.count() == len(keys)
    monkeypatch.setattr(checks, "WORDS", 1)
    assert {r["k"]: r["lost"] for r in checks.with_lost(child, "k", parent, "p", "lost").collect()} == want
    text = checks.with_lost(child.withColumn("k", F.col("k").cast("string")), "k", parent.withColumn("p", F.col("p").cast("string")), "p", "lost")
    assert {r["k"] and int(r["k"]): r["lost"] for r in text.collect()} == want


def test_rows_are_dealt_once_and_before_they_are_hashed(spark):
    """Checks, ranks and hash of a delivery: one exchange of its rows; the small one is the number of each delivery, the rest are words of keys."""
    tagged = annotated(spark, orders(spark, [order(1), order(2)]), parents(spark))
    plan = survive.split(tagged, ORDERS).failed._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in plan.splitlines() if "Exchange hashpartitioning(order_id" in x]
    below = plan[plan.index(rows[0]) :]
    assert len(rows) == 1 and "sha2" not in below and "Exchange hashpartitioning(customer_id" not in plan and "Exchange hashpartitioning(product_id" not in plan


def test_upserts_leave_rows_that_lie_by_their_key(spark):
    made = silver(spark, [order(1), order(2)])
    apart = exchanges(made)
    assert exchanges(state.upsert(made, made, ORDERS)) <= 2 * apart


def test_ranks_of_copies_within_and_over_deliveries(spark):
    rows = [order(1, batch="b1", at="2024-01-01"), order(1, batch="b1", at="2024-01-01"), order(1, batch="a2", at="2024-01-02"), order(1, batch="a2", at="2024-01-02"), order(2, batch=None, at="2024-01-03")]
    got = sorted((r["order_id"], r["_batch_id"] or "", r["_delivery_rank"], r["_pk_rank"]) for r in survive.ranked(orders(spark, rows), ORDERS).collect())
    assert got == [(1, "a2", 1, 1), (1, "a2", 2, 2), (1, "b1", 1, 3), (1, "b1", 2, 4), (2, "", 1, 1)]
