"""Chat formatting, native: a fingerprint of a layout's nested field paths selects the mapping to canonical turns.

Canonical turns are rows (conv_id, turn, role, text). `canonical_turns` maps a whole DataFrame by the fingerprint of
its schema; `canonical_json` maps a column of JSON payloads of mixed layouts, each by the fingerprint of its own paths.
`format_turns` renders one row per conversation with its loss mask, and `read_back` parses the output again.

Template (control strings): `[INST]`user`[/INST]`, `<s>`assistant`</s>`, `<<SYS>>`system`<</SYS>>` and
`<<ROLE name>>`text`<</ROLE>>` for any other role. Inside texts and names `~` becomes `~0`, `<` `~1` and `[` `~2`
(in names also `>` `~3`), so that no control string can occur there; undoing it in reverse order is exact.

Cases: a null text or role is empty; a null conv_id is a conversation of its own; turns that tie are ordered by role,
then text; repeated rows are repeated turns; extra columns are ignored; an empty table gives an empty result; an
unknown layout raises ValueError (`canonical_turns`) or gives no turn and a null layout (`canonical_json`).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: layout name -> (field paths, kind, fields)
MAPPINGS: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = {
    "turn_rows": (("conv_id", "turn", "role", "text"), "rows", ("role", "text")),
    "messages": (("messages", "messages[].role", "messages[].content"), "list", ("messages", "role", "content")),
    "conversations": (("conversations", "conversations[].from", "conversations[].value"), "list", ("conversations", "from", "value")),
    "instruction_input": (("instruction", "input", "output"), "pair", ("instruction", "input", "output")),
    "instruction": (("instruction", "output"), "pair", ("instruction", None, "output")),
    "prompt_completion": (("prompt", "completion"), "pair", ("prompt", None, "completion")),
    "prompt_response": (("prompt", "response"), "pair", ("prompt", None, "response")),
}

#: Names that some layouts give to the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Every nested field path; `[]` stands for an array's element."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            here = f"{at}.{f.name}" if at else f.name
            out += [here, *field_paths(f.dataType, here)]
        return out
    return []


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


FINGERPRINTS = {fingerprint(paths): name for name, (paths, _, _) in MAPPINGS.items()}
_KNOWN = {p for paths, _, _ in MAPPINGS.values() for p in paths}


def layout_of(schema: T.StructType) -> str:
    """The mapping selected by the fingerprint of the paths that mappings know; else the widest mapping it contains."""
    there = {p for p in field_paths(schema) if p in _KNOWN}
    if name := FINGERPRINTS.get(fingerprint(there - {"conv_id", "turn"} if "role" not in there else there)):
        return name
    if fits := [n for n, (paths, _, _) in MAPPINGS.items() if set(paths) <= there]:
        return max(fits, key=lambda n: len(MAPPINGS[n][0]))
    raise ValueError(f"no mapping for the layout {sorted(field_paths(schema))}")


def _role(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in ROLE_NAMES.items()], c, F.lit(""))


def _pair(asked: Column, more: Column | None, answer: Column) -> Column:
    user = F.coalesce(asked, F.lit(""))
    if more is not None:
        user = F.when(F.coalesce(more, F.lit("")) == "", user).otherwise(F.concat(user, F.lit("\n\n"), more))
    return F.array(
        F.struct(F.lit("user").alias("role"), user.alias("text")),
        F.struct(F.lit("assistant").alias("role"), F.coalesce(answer, F.lit("")).alias("text")),
    )


def _listed(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda m: F.struct(_role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def _exploded(df: DataFrame, turns: Column) -> DataFrame:
    return df.select("conv_id", F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A DataFrame of any known layout as rows (conv_id, turn, role, text)."""
    _, kind, names = MAPPINGS[layout_of(df.schema)]
    if kind == "rows":
        return df.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if kind == "list":
        items, role, text = names
        turns = _listed(F.col(items), role, text)
    else:
        asked, more, answer = names
        turns = _pair(F.col(asked), F.col(more) if more else None, F.col(answer))
    return _exploded(df.select(F.col(id_col).alias("conv_id"), turns.alias("_turns")), F.col("_turns"))


def _there(payload: Column, path: str) -> Column:
    """Whether a JSON payload has a field path; a path within a list is there if any element has it."""
    outer, _, inner = path.partition("[].")
    if not inner:
        return F.try_variant_get(payload, f"$.{path}", "variant").isNotNull()
    return F.coalesce(F.exists(_items(payload, outer), lambda x: F.try_variant_get(x, f"$.{inner}", "variant").isNotNull()), F.lit(False))


def _items(payload: Column, path: str) -> Column:
    """The elements of a list; null where there is no list."""
    return F.try_variant_get(payload, f"$.{path}", "array<variant>")


def canonical_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """JSON payloads of mixed layouts as rows (conv_id, layout, turn, role, text); outer: an unknown payload keeps one row.

    A payload's fingerprint is the hash of those of its nested field paths that mappings know, so other fields don't matter; a
    payload whose fingerprint no mapping has takes the widest mapping whose paths it holds."""
    names = [n for n, (_, kind, _) in MAPPINGS.items() if kind != "rows"]
    known = sorted({p for n in names for p in MAPPINGS[n][0]})
    payload = F.col("_payload")
    parsed = df.select(F.col(id_col).alias("conv_id"), F.try_parse_json(F.col(json_col)).alias("_payload"))
    held = parsed.withColumn("_paths", F.array_compact(F.array(*[F.when(_there(payload, p), F.lit(p)) for p in known])))
    print_ = F.sha2(F.array_join("_paths", "\n"), 256)
    exact = [(print_ == fingerprint(MAPPINGS[n][0]), n) for n in names]
    wide = [(F.size(F.array_except(F.array(*map(F.lit, MAPPINGS[n][0])), "_paths")) == 0, n) for n in sorted(names, key=lambda n: -len(MAPPINGS[n][0]))]
    layout = F.coalesce(*[F.when(hit, F.lit(n)) for hit, n in exact + wide])

    def turns(n: str) -> Column:
        _, kind, fields = MAPPINGS[n]
        of = lambda x, f: F.try_variant_get(x, f"$.{f}", "string")
        if kind == "list":
            items, role, text = fields
            return F.transform(_items(payload, items), lambda m: F.struct(_role(of(m, role)).alias("role"), F.coalesce(of(m, text), F.lit("")).alias("text")))
        return _pair(of(payload, fields[0]), of(payload, fields[1]) if fields[1] else None, of(payload, fields[2]))

    out = held.withColumn("layout", layout).withColumn("_turns", F.coalesce(*[F.when(F.col("layout") == n, turns(n)) for n in names]))
    return out.select("conv_id", "layout", F.posexplode_outer("_turns").alias("turn", "t")).select("conv_id", "layout", F.col("turn").cast("long"), "t.role", "t.text")


def escape(c: Column, name: bool = False) -> Column:
    for plain, coded in (("~", "~0"), ("<", "~1"), ("[", "~2"), *(((">", "~3"),) if name else ())):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column, name: bool = False) -> Column:
    for coded, plain in (*((("~3", ">"),) if name else ()), ("~2", "["), ("~1", "<"), ("~0", "~")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def _marks(role: Column) -> tuple[Column, Column]:
    opened = F.when(role == "user", "[INST]").when(role == "assistant", "<s>").when(role == "system", "<<SYS>>").otherwise(F.concat(F.lit("<<ROLE "), escape(role, True), F.lit(">>")))
    closed = F.when(role == "user", "[/INST]").when(role == "assistant", "</s>").when(role == "system", "<</SYS>>").otherwise(F.lit("<</ROLE>>"))
    return opened, closed


#: One rendered turn: its opening mark, its escaped text, its closing mark.
TURN = r"(\[INST\]|<s>|<<SYS>>|<<ROLE [^>]*>>)([^<\[]*)(?:\[/INST\]|</s>|<</SYS>>|<</ROLE>>)"


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): loss_spans are (start, chars) of each assistant text, in code points."""
    opened, closed = _marks(F.col("role"))
    parts = turns.select("conv_id", "turn", "role", "text", opened.alias("o"), escape(F.col("text")).alias("b"), closed.alias("c"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("o") + F.length("b") + F.length("c")
    placed = parts.select(
        "conv_id",
        F.row_number().over(order).alias("k"),
        F.concat("o", "b", "c").alias("s"),
        (F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("o")).alias("start"),
        F.length("b").alias("chars"),
        (F.col("role") == "assistant").alias("learn"),
    )
    all_turns = F.array_sort(F.collect_list(F.struct("k", "s", "start", "chars", "learn")))
    return placed.groupBy("conv_id").agg(all_turns.alias("t")).select(
        "conv_id",
        F.array_join(F.col("t.s"), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("chars"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars), all parsed from the formatted text and its spans."""
    marks = F.regexp_extract_all("formatted", F.lit(TURN), 1)
    bodies = F.regexp_extract_all("formatted", F.lit(TURN), 2)

    def role(mark: Column) -> Column:
        named = unescape(mark.substr(F.lit(8), F.length(mark) - 9), True)
        return F.when(mark == "[INST]", "user").when(mark == "<s>", "assistant").when(mark == "<<SYS>>", "system").otherwise(named)

    turns = F.zip_with(marks, bodies, lambda m, b: F.struct(role(m).alias("role"), unescape(b).alias("text")))
    spans = F.transform("loss_spans", lambda x: unescape(F.col("formatted").substr((x["start"] + 1).cast("int"), x["chars"])))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(spans, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
