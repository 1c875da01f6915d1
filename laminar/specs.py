"""What an entity is: its schema, key, delivery and quality rules. Everything else in the package is driven by these."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

#: Check categories, in report order (fixed values).
CATEGORIES = ("completeness", "type_logic", "uniqueness", "referential")
#: Violations of these don't reject a row: duplicates are settled by rank, orphans are admitted with a flag.
ADMITTING = ("uniqueness", "referential")
#: Pattern an e-mail address has to match, and the key that quarantine gives rows without one (fixed values).
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
NULL_KEY = "__NULL_PK__"

VIOLATION = T.StructType([T.StructField(c, T.StringType()) for c in ("category", "rule", "column", "value")])


@dataclass(frozen=True)
class Rule:
    """Constraints on one column; kind: string, integer, number or date."""

    column: str
    kind: str
    nullable: bool = True
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    format: str | None = None
    enum: tuple[str, ...] | None = None
    minimum: str | int | None = None
    maximum: str | int | None = None
    exclusive_minimum: str | int | None = None
    exclusive_maximum: str | int | None = None
    multiple_of: str | int | None = None
    min_date: str | None = None
    max_date: str | None = None
    date_format: str = "yyyy-MM-dd"

    def __post_init__(self):
        if self.kind not in ("string", "integer", "number", "date"):
            raise ValueError(f"unknown kind {self.kind!r} for {self.column}")


@dataclass(frozen=True)
class Check:
    """A check on a set of rows; kind: not_null, uniqueness or fk_exists."""

    kind: str
    columns: tuple[str, ...]
    parent: str | None = None
    parent_key: str | None = None

    def __post_init__(self):
        if self.kind not in ("not_null", "uniqueness", "fk_exists"):
            raise ValueError(f"unknown check {self.kind!r}")
        if self.kind == "fk_exists" and not (self.parent and self.parent_key):
            raise ValueError("fk_exists needs a parent and its key")


@dataclass(frozen=True)
class Entity:
    name: str
    key: str
    schema: T.StructType
    delivery: str
    event_time: str | None = None
    rules: tuple[Rule, ...] = ()
    checks: tuple[Check, ...] = ()
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)

    def __post_init__(self):
        if self.delivery not in ("full_snapshot", "incremental"):
            raise ValueError(f"unknown delivery {self.delivery!r}")

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


def rules_json(entity: Entity) -> str:
    """The entity's rules and checks as a document for configuration tables; only what is set is written."""
    said = lambda x: {k: v for k, v in asdict(x).items() if v is not None}
    return json.dumps({"rules": [said(r) for r in entity.rules], "checks": [said(c) for c in entity.checks]})


def with_rules(entity: Entity, document: str | None) -> Entity:
    """entity with the rules and checks of a configuration document; ValueError if there is none or it says something unknown."""
    if document is None:
        raise ValueError(f"no rules are configured for {entity.name}")
    held = json.loads(document)
    if not isinstance(held, dict) or set(held) != {"rules", "checks"}:
        raise ValueError(f"rules of {entity.name} need rules and checks")

    def made(kind: type, values: dict):
        if more := set(values) - {f.name for f in fields(kind)}:
            raise ValueError(f"unknown in a {kind.__name__.lower()} of {entity.name}: {sorted(more)}")
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    return replace(entity, rules=tuple(made(Rule, x) for x in held["rules"]), checks=tuple(made(Check, x) for x in held["checks"]))


def constraints(entity: Entity) -> list[tuple[str, str, str, str]]:
    """(entity, column, constraint, value) of every constraint that the rules and checks set."""
    plain = {"column", "kind", "nullable", "date_format"}
    out = [(entity.name, r.column, k, "|".join(v) if isinstance(v, tuple) else str(v)) for r in entity.rules for k, v in asdict(r).items() if k not in plain and v is not None]
    return out + [(entity.name, ",".join(c.columns), c.kind, f"{c.parent}.{c.parent_key}" if c.parent else "") for c in entity.checks]


def _schema(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in types.items()])


_I, _S, _D = T.IntegerType(), T.StringType(), T.DateType()

CUSTOMERS = Entity(
    "customers", "customer_id",
    _schema(customer_id=_I, customer_name=_S, email=_S, country=_S, signup_date=_D, customer_segment=_S, lifetime_value=MONEY),
    "full_snapshot", "signup_date",
    rules=(
        Rule("email", "string", format="email"),
        Rule("customer_name", "string", min_length=2, max_length=100),
        Rule("country", "string", pattern=r"^[A-Za-z .'-]{2,56}$"),
        Rule("customer_segment", "string", enum=("Premium", "Standard", "Basic")),
        Rule("signup_date", "date", max_date="today"),
        Rule("lifetime_value", "number", minimum=0),
    ),
    checks=(Check("not_null", ("customer_id",)), Check("uniqueness", ("customer_id",)), Check("not_null", ("email",))),
)

PRODUCTS = Entity(
    "products", "product_id",
    _schema(product_id=_I, product_name=_S, category=_S, price=MONEY, cost=MONEY, stock_quantity=_I, reorder_level=_I),
    "full_snapshot",
    rules=(
        Rule("price", "number", minimum=0),
        Rule("cost", "number", minimum=0),
        Rule("product_name", "string", max_length=200),
        Rule("stock_quantity", "integer", minimum=0, maximum=100000),
    ),
    checks=(Check("not_null", ("product_id",)), Check("uniqueness", ("product_id",))),
)


def orders_entity(first_day: str = "2020-01-01") -> Entity:
    """Order lines; first_day: the earliest order date that is accepted."""
    return Entity(
        "orders", "order_id",
        _schema(order_id=_I, customer_id=_I, order_date=_D, product_id=_I, quantity=_I, unit_price=MONEY, total_amount=MONEY, order_status=_S, payment_date=_D),
        "incremental", "order_date",
        rules=(
            Rule("quantity", "integer", minimum=1, maximum=1000),
            Rule("unit_price", "number", exclusive_minimum=0),
            Rule("order_date", "date", min_date=first_day, max_date="today"),
            Rule("total_amount", "number", minimum=0),
            Rule("order_status", "string", enum=("Pending", "Completed", "Cancelled")),
        ),
        checks=(
            Check("not_null", ("order_id",)), Check("not_null", ("customer_id",)), Check("not_null", ("product_id",)),
            Check("uniqueness", ("order_id",)),
            Check("fk_exists", ("customer_id",), "customers", "customer_id"),
            Check("fk_exists", ("product_id",), "products", "product_id"),
        ),
        foreign_keys={"customer_id": ("customers", "customer_id"), "product_id": ("products", "product_id")},
    )


ORDERS = orders_entity()
ENTITIES = {e.name: e for e in (CUSTOMERS, PRODUCTS, ORDERS)}

#: What ingest adds to a row, and what conforming adds.
BRONZE_COLUMNS = ("_ingest_timestamp", "_source_file", "_batch_id", "_delivery_pattern", "_rescued_data")
SILVER_COLUMNS = ("quality_check_result", "_row_hash", "_is_deleted", "_is_orphan", "_silver_updated_at", "_bronze_batch_id")
