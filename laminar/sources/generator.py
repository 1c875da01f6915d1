"""A seeded generator of the three entities, with counted defects, and of a second delivery; all by hashes of row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.specs import CUSTOMERS, ORDERS, PRODUCTS, Entity

#: Rows of clean base data (fixed values).
BASE = {"customers": 10_000, "products": 500, "orders": 100_000}
#: Rows with each defect (fixed values).
DEFECTS = {
    "customers": {
        "null_emails": 50, "invalid_emails": 30, "invalid_customer_segment": 20, "future_signup_date": 15, "short_customer_name": 8,
        "overlong_customer_name": 8, "invalid_country": 12, "negative_lifetime_value": 10,
    },
    "products": {"negative_price": 15, "negative_cost": 8, "overlong_product_name": 6, "negative_stock_quantity": 6, "excessive_stock_quantity": 6},
    "orders": {
        "null_order_customer_id": 100, "null_order_product_id": 200, "orphan_customer_id": 50, "orphan_product_id": 30, "invalid_order_status": 20,
        "non_positive_quantity": 25, "excessive_quantity": 12, "zero_unit_price": 12, "negative_total_amount": 10, "pre_launch_order_date": 12, "future_order_date": 12,
    },
}
DUPLICATES = {"customers": 10, "products": 5, "orders": 20}
NULL_KEYS = {"customers": 5, "products": 3, "orders": 5}
#: The second delivery (fixed values).
CHANGED_CUSTOMERS, OMITTED_PRODUCTS, NEW_ORDERS, FIRST_NEW_ORDER, LATE_CUSTOMERS, LATE_PRODUCTS, UPLIFT = 20, 3, 500, 200_001, 10, 5, 1000
FIRST_ORPHAN, FIRST_ORPHAN_PRODUCT = 900_001, 910_001
SEGMENTS, STATUSES = ("Premium", "Standard", "Basic"), ("Pending", "Completed", "Cancelled")


def _draw(seed: int, what: str, n: int, key: str) -> Column:
    """A number from 0 to n - 1 that depends on the seed, what it is for and the key."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col(key)), F.lit(n))


def _pick(seed: int, what: str, among: tuple[str, ...], key: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in among]), (_draw(seed, what, len(among), key) + 1).cast("int"))


def _cents(c: Column) -> Column:
    return (c.cast("decimal(18,0)") / 100).cast("decimal(18,2)")


def base(spark: SparkSession, name: str, seed: int, rows: dict[str, int] | None = None) -> DataFrame:
    """Clean rows; rows: how many of each entity."""
    n = {**BASE, **(rows or {})}
    e = {"customers": CUSTOMERS, "products": PRODUCTS, "orders": ORDERS}[name]
    ids = spark.range(1, n[name] + 1).select(F.col("id").cast("int").alias(e.key))
    k, d = e.key, lambda what, m: _draw(seed, f"{name}.{what}", m, e.key)
    if name == "customers":
        return ids.select(
            k, F.concat(F.lit("Customer "), F.lpad(F.col(k).cast("string"), 6, "0")).alias("customer_name"), F.concat(F.lit("c"), F.col(k).cast("string"), F.lit("@example.com")).alias("email"),
            _pick(seed, "country", ("France", "Kenya", "Japan", "Brazil", "Canada"), k).alias("country"), F.date_add(F.lit("2020-01-01").cast("date"), d("signup", 1500).cast("int")).alias("signup_date"),
            _pick(seed, "segment", SEGMENTS, k).alias("customer_segment"), _cents(d("value", 490_000) + 10_000).alias("lifetime_value"),
        )
    if name == "products":
        cost = _cents(d("cost", 20_000) + 100)
        return ids.select(
            k, F.concat(F.lit("Product "), F.col(k).cast("string")).alias("product_name"), _pick(seed, "category", ("Tools", "Books", "Toys", "Garden"), k).alias("category"),
            (cost + _cents(d("margin", 10_000) + 50)).cast("decimal(18,2)").alias("price"), cost.alias("cost"), d("stock", 1000).cast("int").alias("stock_quantity"), (d("level", 50) + 1).cast("int").alias("reorder_level"),
        )
    quantity, price = (d("quantity", 10) + 1).cast("int"), _cents(d("price", 30_000) + 150)
    day, status = F.date_add(F.lit("2022-01-01").cast("date"), d("day", 1096).cast("int")), _pick(seed, "status", STATUSES, k)
    return ids.select(
        k, (d("customer", n["customers"]) + 1).cast("int").alias("customer_id"), day.alias("order_date"), (d("product", n["products"]) + 1).cast("int").alias("product_id"), quantity.alias("quantity"),
        price.alias("unit_price"), (price * quantity).cast("decimal(18,2)").alias("total_amount"), status.alias("order_status"), F.when(status == "Completed", F.date_add(day, 2)).alias("payment_date"),
    )


def _defects(name: str) -> dict[str, tuple[str, Column]]:
    """What each defect puts into which column; _n counts its rows from 0."""
    money = lambda x: F.lit(x).cast("decimal(18,2)")
    return {
        "customers": {
            "null_emails": ("email", F.lit(None).cast("string")), "invalid_emails": ("email", F.lit("not-an-email")), "invalid_customer_segment": ("customer_segment", F.lit("Invalid")),
            "future_signup_date": ("signup_date", F.lit("2100-01-01").cast("date")), "short_customer_name": ("customer_name", F.lit("A")), "overlong_customer_name": ("customer_name", F.repeat(F.lit("X"), 120)),
            "invalid_country": ("country", F.lit("X1!")), "negative_lifetime_value": ("lifetime_value", money("-1.00")),
        },
        "products": {
            "negative_price": ("price", money("-1.00")), "negative_cost": ("cost", money("-2.00")), "overlong_product_name": ("product_name", F.repeat(F.lit("P"), 220)),
            "negative_stock_quantity": ("stock_quantity", F.lit(-5)), "excessive_stock_quantity": ("stock_quantity", F.lit(101_000)),
        },
        "orders": {
            "null_order_customer_id": ("customer_id", F.lit(None).cast("int")), "null_order_product_id": ("product_id", F.lit(None).cast("int")),
            "orphan_customer_id": ("customer_id", (F.lit(FIRST_ORPHAN) + F.col("_n")).cast("int")), "orphan_product_id": ("product_id", (F.lit(FIRST_ORPHAN_PRODUCT) + F.col("_n")).cast("int")),
            "invalid_order_status": ("order_status", F.lit("Invalid")), "non_positive_quantity": ("quantity", F.lit(0)), "excessive_quantity": ("quantity", F.lit(1500)), "zero_unit_price": ("unit_price", money("0.00")),
            "negative_total_amount": ("total_amount", money("-10.00")), "pre_launch_order_date": ("order_date", F.lit("1990-06-15").cast("date")), "future_order_date": ("order_date", F.lit("2100-01-01").cast("date")),
        },
    }[name]


def _chosen(df: DataFrame, key: str, seed: int, what: str, n: int) -> DataFrame:
    """n keys by hash, numbered from 0 in _slot; n is a fixed, small number."""
    from pyspark.sql import Window

    few = df.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(F.lit(seed), F.lit(what), F.col(key)), key).limit(n)
    return few.withColumn("_slot", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), F.lit(what), F.col(key)), key)) - 1)


def with_defects(df: DataFrame, entity: Entity, seed: int, counts: dict[str, int] | None = None) -> DataFrame:
    """df with its defects in rows that differ from defect to defect, then exact copies of some keyed rows and rows that lost their key."""
    name, counts = entity.name, DEFECTS[entity.name] if counts is None else counts
    slots = _chosen(df, entity.key, seed, "defects", sum(counts.values()))
    out, at = df.join(F.broadcast(slots), entity.key, "left"), 0
    made = _defects(name)
    for defect, n in counts.items():
        column, value = made[defect]
        hit = F.col("_slot").between(at, at + n - 1)
        out = out.withColumn("_n", F.col("_slot") - at).withColumn(column, F.when(hit, value).otherwise(F.col(column)))
        at += n
    out = out.select(*df.columns)
    for what, n in (("copies", DUPLICATES[name]), ("keyless", NULL_KEYS[name])):
        rows = df.join(F.broadcast(_chosen(df.join(F.broadcast(slots), entity.key, "left_anti"), entity.key, seed, what, n).drop("_slot")), entity.key, "left_semi").select(*df.columns)
        if what == "keyless":
            rows = rows.withColumn(entity.key, F.lit(None).cast("int"))
        out = out.unionByName(rows)
    return out


def seed_delivery(spark: SparkSession, seed: int = 42, rows: dict[str, int] | None = None, counts: dict[str, dict[str, int]] | None = None) -> dict[str, DataFrame]:
    return {e.name: with_defects(base(spark, e.name, seed, rows), e, seed, (counts or {}).get(e.name)) for e in (CUSTOMERS, PRODUCTS, ORDERS)}


def delta_delivery(spark: SparkSession, seed: int = 42, rows: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """A clean second delivery: customers and products restated with changes and omissions, new orders alone, some late parents."""
    n = {**BASE, **(rows or {})}
    c, p, o = (base(spark, name, seed, rows) for name in ("customers", "products", "orders"))
    turned = F.element_at(F.array(*[F.lit(x) for x in SEGMENTS]), (F.array_position(F.array(*[F.lit(x) for x in SEGMENTS]), F.col("customer_segment")) % 3 + 1).cast("int"))
    few = F.col("customer_id") <= CHANGED_CUSTOMERS
    changed = c.withColumns({"lifetime_value": F.when(few, (F.col("lifetime_value") + UPLIFT).cast("decimal(18,2)")).otherwise(F.col("lifetime_value")), "customer_segment": F.when(few, turned).otherwise(F.col("customer_segment"))})
    late_c = c.filter(F.col("customer_id") <= LATE_CUSTOMERS).withColumns({"email": F.concat(F.lit("late"), F.col("customer_id").cast("string"), F.lit("@example.com"))})
    late_c = late_c.withColumn("customer_id", (F.col("customer_id") + FIRST_ORPHAN - 1).cast("int"))
    late_p = p.filter(F.col("product_id") <= LATE_PRODUCTS).withColumn("product_id", (F.col("product_id") + FIRST_ORPHAN_PRODUCT - 1).cast("int"))
    new = o.filter(F.col("order_id") <= NEW_ORDERS).withColumn("order_id", (F.col("order_id") + FIRST_NEW_ORDER - 1).cast("int"))
    return {"customers": changed.unionByName(late_c), "products": p.filter(F.col("product_id") <= n["products"] - OMITTED_PRODUCTS).unionByName(late_p), "orders": new}


def summary(delivery: dict[str, DataFrame]) -> dict[str, int]:
    return {name: df.count() for name, df in delivery.items()}
