"""Chat formatting by schema fingerprints.

Every record's nested field paths are read off its variant and hashed.  A declarative
mapping, which turns a record into canonical turns (conversation, position, role,
text), names the paths it needs; a record's hashes select the first mapping all of
whose paths it has, whatever further fields it carries.  A template then marks turns,
escapes control characters reversibly and records the loss spans.

Template: ``### role: text</turn>\\n`` per turn.  In roles and texts a backslash
becomes ``\\b``, ``<`` becomes ``\\l`` and ``#`` becomes ``\\h`` (and ``:`` in
roles ``\\c``), so no mark can occur inside a text.

Defined results: null texts and roles are empty; content in parts is their texts one
after another, and a part without a text is its JSON; a conversation's turns go by
(turn, role, text), nulls first, repeated rows included; an empty list of messages is
a conversation of no turns, and so, with layout null, is a record that no mapping
fits or that is no JSON: ``unknown_layouts`` counts those by their paths.  Texts of tables
(``column_turns``) may be of any length; a JSON record of over ``LARGE`` bytes that can't
be parsed, as it is past Spark's limit or no JSON, is an error, never a lost conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StructType

_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
END = "</turn>\n"
#: Bytes of a JSON record from which one that isn't parsed is an error.
LARGE = 1 << 24


@dataclass(frozen=True)
class Layout:
    """A record layout: the field paths that it needs, and SQL for its array of (turn,
    role, text): over ``v``, the record as a variant, and over a table's columns."""

    name: str
    paths: tuple[str, ...]
    turns: str
    columns: str


def _get(path: str, kind: str = "string") -> str:
    return f"try_variant_get(v, '$.{path}', '{kind}')"


def _said(item: str, path: str) -> str:
    """SQL for a text that may be given in parts."""
    parts = f"try_variant_get({item}, '$.{path}', 'array<variant>')"
    return f"coalesce(array_join(transform({parts}, p -> coalesce(try_variant_get(p, '$.text', 'string'), try_variant_get(p, '$', 'string'), '')), ''), try_variant_get({item}, '$.{path}', 'string'))"


def _list(path: str, role: str, text: str) -> str:
    items = f"coalesce({_get(path, 'array<variant>')}, cast(array() as array<variant>))"
    return f"transform({items}, (m, i) -> named_struct('turn', cast(i as bigint), 'role', try_variant_get(m, '$.{role}', 'string'), 'text', {_said('m', text)}))"


def _list_column(path: str, role: str, text: str) -> str:
    return f"transform(coalesce({path}, array()), (m, i) -> named_struct('turn', cast(i as bigint), 'role', m.{role}, 'text', m.{text}))"


def _pair(first: str, second: str) -> str:
    turn = lambda i, role, text: f"named_struct('turn', {i}L, 'role', '{role}', 'text', {text})"
    return f"array({turn(0, 'user', first)}, {turn(1, 'assistant', second)})"


#: Declarative mappings; the first whose paths a record has is taken.
LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text"), f"array(named_struct('turn', {_get('turn', 'bigint')}, 'role', {_get('role')}, 'text', {_said('v', 'text')}))", "array(named_struct('turn', turn, 'role', role, 'text', text))"),
    Layout("messages", ("messages[].role", "messages[].content"), _list("messages", "role", "content"), _list_column("messages", "role", "content")),
    Layout("from-value list", ("conversations[].from", "conversations[].value"), _list("conversations", "from", "value"), _list_column("conversations", "`from`", "value")),
    Layout("prompt", ("prompt", "completion"), _pair(_said("v", "prompt"), _said("v", "completion")), _pair("prompt", "completion")),
    Layout("instruction", ("input", "instruction", "output"), _pair(f"concat_ws('\\n', nullif({_get('instruction')}, ''), nullif({_get('input')}, ''))", _said("v", "output")), _pair("concat_ws('\\n', nullif(instruction, ''), nullif(input, ''))", "output")),
    Layout("instruction", ("instruction", "output"), _pair(f"concat_ws('\\n', nullif({_get('instruction')}, ''), nullif({_get('input')}, ''))", _said("v", "output")), _pair("instruction", "output")),
    Layout("question", ("question", "answer"), _pair(_said("v", "question"), _said("v", "answer")), _pair("question", "answer")),
)
CONV_ID = f"coalesce({_get('conv_id', 'bigint')}, {_get('id', 'bigint')})"


def field_paths(variant: Column, lists: dict[str, list[str]]) -> Column:
    """Sorted field names of a variant object, and ``list[].field`` for the objects in
    its ``lists``; an empty list has all the fields that are looked for in it."""
    kind = "map<string,variant>"
    paths = [F.map_keys(F.try_variant_get(variant, "$", kind))]
    for name, fields in lists.items():
        items = F.try_variant_get(variant, f"$.{name}", "array<variant>")
        keys = F.flatten(F.transform(items, lambda m: F.coalesce(F.map_keys(F.try_variant_get(m, "$", kind)), F.array().cast("array<string>"))))
        prefix = F.lit(f"{name}[].")
        named = F.transform(keys, lambda k: F.concat(prefix, k))  # noqa: B023
        paths.append(F.when(F.size(items) == 0, F.array(*(F.lit(f"{name}[].{f}") for f in fields))).otherwise(named))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(p, none) for p in paths))))


def lists_of(layouts: tuple[Layout, ...]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for x in layouts:
        for name, _, field in (p.partition("[].") for p in x.paths):
            if field and field not in out.setdefault(name, []):
                out[name].append(field)
    return out


def fingerprints(paths: Column) -> Column:
    return F.transform(paths, lambda p: F.xxhash64(p))


def with_layout(records: DataFrame, record_col: str, layouts: tuple[Layout, ...]) -> DataFrame:
    """(v, paths, layout) of JSON records."""
    parsed = F.try_parse_json(F.col(record_col))
    size = F.octet_length(F.col(record_col))
    large = F.raise_error(F.concat(F.lit("a JSON record of "), size.cast("string"), F.lit(" bytes can't be parsed; give such records as columns, to column_turns")))
    rows = records.select(F.when(parsed.isNull() & (size > LARGE), large.cast("variant")).otherwise(parsed).alias("v"))
    rows = rows.withColumn("paths", field_paths(F.col("v"), lists_of(layouts))).withColumn("prints", fingerprints(F.col("paths")))
    layout = F.lit(None).cast("string")
    for x in reversed(layouts):
        fits = F.size(F.array_except(fingerprints(F.array(*map(F.lit, x.paths))), F.col("prints"))) == 0
        layout = F.when(fits, F.lit(x.name)).otherwise(layout)
    return rows.select("v", "paths", layout.alias("layout"))


def unknown_layouts(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(paths, n) of the records that no mapping fits."""
    rows = with_layout(records, record_col, layouts).where(F.col("layout").isNull())
    return rows.groupBy("paths").agg(F.count(F.lit(1)).alias("n"))


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, turn, role, text, is_turn) of JSON records; a record without
    turns gives one row whose turn is null."""
    kind = "array<struct<turn:bigint,role:string,text:string>>"
    turns = F.lit(None).cast(kind)
    for x in reversed(layouts):
        turns = F.when(F.col("layout") == x.name, F.expr(x.turns).cast(kind)).otherwise(turns)
    rows = with_layout(records, record_col, layouts).select(F.expr(CONV_ID).alias("conv_id"), "layout", turns.alias("turns"))
    return rows.select("conv_id", "layout", F.explode_outer("turns").alias("t")).select("conv_id", "layout", "t.turn", "t.role", "t.text", F.col("t").isNotNull().alias("is_turn"))


def schema_paths(schema: StructType) -> list[str]:
    """Field names of a table, and ``list[].field`` for its lists of structs."""
    paths = []
    for f in schema.fields:
        paths.append(f.name)
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            paths += [f"{f.name}[].{x.name}" for x in f.dataType.elementType.fields]
    return sorted(paths)


def column_turns(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``canonical_turns`` of a table's own columns: the schema's paths are hashed as those
    of a record are and select the mapping for all rows, and texts of any length stay
    columns, so no limit on parsed records holds.  A schema that no mapping fits is an
    error that names its paths."""
    paths = schema_paths(rows.schema)
    prints = {xxhash.xxh64_intdigest(p, 42) for p in paths}
    fits = [x for x in layouts if {xxhash.xxh64_intdigest(p, 42) for p in x.paths} <= prints]
    if not fits:
        raise ValueError(f"no layout for the fields {', '.join(paths)}")
    ids = [F.col(c).cast("bigint") for c in ("conv_id", "id") if c in paths]
    turns = F.expr(fits[0].columns).cast("array<struct<turn:bigint,role:string,text:string>>")
    out = rows.select(F.coalesce(*ids, F.lit(None).cast("bigint")).alias("conv_id"), F.lit(fits[0].name).alias("layout"), F.explode_outer(turns).alias("t"))
    return out.select("conv_id", "layout", "t.turn", "t.role", "t.text", F.col("t").isNotNull().alias("is_turn"))


def escape(text: Column) -> Column:
    for a, b in _ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(_ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss): loss holds [start, end) spans of code
    points of ``formatted``, one for each turn of ``loss_role``."""
    empty = F.lit("")
    role, text = F.coalesce("role", empty), F.coalesce("text", empty)
    head = F.concat(F.lit("### "), escape_role(role), F.lit(": "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), "is_turn").select("*", head.alias("head"), escape(F.col("text")).alias("body"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    size = F.when(F.col("is_turn"), F.length("head") + F.length("body") + len(END)).otherwise(0).cast("long")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("to", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)))
    start = F.col("to") - len(END) - F.length("body")
    span = F.struct(start.alias("start"), (F.col("to") - len(END)).alias("end"))
    piece = F.when(F.col("is_turn"), F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == loss_role, span).alias("span")))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return grouped.select(
        "conv_id",
        F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("p", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns, array of (role, text), of a formatted conversation."""
    parts = F.filter(F.split(formatted, END), lambda x: x != "")
    role = lambda x: F.substring_index(x, ": ", 1)
    return F.transform(parts, lambda x: F.struct(unescape_role(F.call_function("substring", role(x), F.lit(5))).alias("role"), unescape(F.call_function("substring", x, F.length(role(x)) + 3)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.call_function("substring", formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))
