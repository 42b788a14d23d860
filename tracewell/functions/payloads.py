"""Contracts for payloads: JSON text as VARIANT, its fields by name or alias, with types, ranges and defaults, and a list of reasons.

A payload is parsed once; every check is a column expression, so nothing leaves the engine. Reasons say what is wrong with the
payload or a field (``broken``, ``shape``, ``<field>:missing``, ``<field>:type``, ``<field>:blank``, ``<field>:value``, ``<field>:range``), repairs what was
mended (``<field>:alias``, ``<field>:default``). Rows with reasons go into quarantine, the others are typed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of a field, the types of VARIANT that they take, and the type that they are read as.
KINDS = {
    "text": ("STRING", "string"), "integer": ("BIGINT", "bigint"), "number": ("BIGINT|DECIMAL.*|DOUBLE|FLOAT", "double"), "flag": ("BOOLEAN", "boolean"), "texts": ("ARRAY<.*>", "array<variant>"), "items": ("ARRAY<.*>", "array<variant>"), "object": ("OBJECT<.*>", "variant"),
}


@dataclass(frozen=True)
class Field:
    """One field of a contract. A default stands for a missing field; without one a missing field is null, or a reason if it is required."""

    name: str
    kind: str
    aliases: tuple[str, ...] = ()
    required: bool = False
    default: object = None
    allowed: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None


def parsed(text: Column) -> Column:
    """VARIANT of a JSON text; null for null and for what is no JSON as a whole.

    The parser stops behind the first value and lets pass what follows. Within a list and within an object, what follows would
    have to close one and the other, so only a single value is read in both.
    """
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$[0]", "variant"))


def with_parsed(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``parsed`` of a text as a column; a text is parsed twice a row, however often that column is used."""
    return df.withColumn(name, parsed(F.col(text)))


def member(payload: Column, name: str) -> Column:
    """A field of an object; null where there is none or it is null itself."""
    value = F.try_variant_get(payload, f'$["{name}"]', "variant")
    return F.when(~F.is_variant_null(value), value)


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def texts(value: Column) -> Column:
    """The trimmed texts of a list that are not blank; anything else in it goes."""
    held = F.transform(value, lambda v: F.when(kind_of(v) == "STRING", F.btrim(F.try_variant_get(v, "$", "string"), F.lit(" \t\r\n"))))
    return F.filter(held, lambda x: x.isNotNull() & (x != ""))


def _read(field: Field, raw: Column) -> Column:
    """What a field holds as its contract's type."""
    value = raw if field.kind == "object" else F.try_variant_get(raw, "$", KINDS[field.kind][1])
    if field.kind == "text":
        return F.btrim(value, F.lit(" \t\r\n"))
    return texts(value) if field.kind == "texts" else value


def _judged(field: Field, raw: Column, right: Column, value: Column, alias: Column) -> tuple[Column, Column, Column]:
    """(value, reason, repair) of a field, by what it holds, whether that has the right type, its typed value, and whether an alias gave it."""
    reason = F.when(raw.isNull(), F.lit(f"{field.name}:missing") if field.required else F.lit(None)).when(~right, f"{field.name}:type")
    if field.kind == "text" and field.required:
        reason = reason.when(value == "", f"{field.name}:blank")
    if field.allowed:
        reason = reason.when(~value.isin(*field.allowed), f"{field.name}:value")
    if field.low is not None:
        reason = reason.when(value < field.low, f"{field.name}:range")
    if field.high is not None:
        reason = reason.when(value > field.high, f"{field.name}:range")
    repair = F.when(alias, f"{field.name}:alias")
    if field.default is not None:
        default = F.array(*[F.lit(x) for x in field.default]).cast("array<string>") if isinstance(field.default, (list, tuple)) else F.lit(field.default)
        value = F.when(raw.isNull(), default).otherwise(value)
        repair = repair.when(raw.isNull(), f"{field.name}:default")
    return value, reason, repair


def _own(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has."""
    own = "_payload"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    return own


def _step(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns in a projection of their own. Spark keeps it apart where a later one uses a column more than once, so that each is computed once a row."""
    return df.withColumns(columns)


def checked(df: DataFrame, payload: str, contract: Sequence[Field]) -> DataFrame:
    """Add ``fields`` (a struct, null fields where something is wrong), ``reasons`` and ``repairs``, both in the contract's order.

    ``payload`` is a column of JSON text or VARIANT. Null and broken texts are ``broken``, anything but an object has the wrong ``shape``.
    Input columns with the names of new ones are replaced.
    """
    own = _own(df)
    names = list(dict.fromkeys(n for f in contract for n in (f.name, *f.aliases)))
    at = {n: f"{own}_member{i}" for i, n in enumerate(names)}
    raw, right, value = ([f"{own}_{x}{i}" for i in range(len(contract))] for x in ("raw", "right", "value"))
    rows = df.withColumn(own, F.col(payload)) if df.schema[payload].dataType.typeName() == "variant" else with_parsed(df, payload, own)
    rows = rows.withColumn(f"{own}_shape", kind_of(F.col(own)).startswith("OBJECT<"))
    rows = _step(rows, {at[n]: F.try_variant_get(F.col(own), f'$["{n}"]', "variant") for n in names})
    rows = _step(rows, {at[n]: F.when(~F.is_variant_null(F.col(at[n])), F.col(at[n])) for n in names})
    rows = _step(rows, {raw[i]: F.coalesce(*[F.col(at[n]) for n in (f.name, *f.aliases)]) for i, f in enumerate(contract)})
    rows = _step(rows, {right[i]: F.coalesce(kind_of(F.col(raw[i])).rlike(f"^(?:{KINDS[f.kind][0]})$"), F.lit(False)) for i, f in enumerate(contract)})
    rows = _step(rows, {value[i]: F.when(F.col(right[i]), _read(f, F.col(raw[i]))) for i, f in enumerate(contract)})
    found = [(f.name, *_judged(f, F.col(raw[i]), F.col(right[i]), F.col(value[i]), F.col(at[f.name]).isNull() & F.col(raw[i]).isNotNull())) for i, f in enumerate(contract)]
    whole = F.when(F.col(own).isNull(), F.lit("broken")).when(~F.coalesce(F.col(f"{own}_shape"), F.lit(False)), F.lit("shape"))
    each = F.array_compact(F.array(*[reason for _, _, reason, _ in found]))
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "fields": F.struct(*[F.when(whole.isNull(), value).alias(name) for name, value, _, _ in found]),
            "reasons": F.when(whole.isNotNull(), F.array(whole)).otherwise(each),
            "repairs": F.when(whole.isNotNull(), none).otherwise(F.array_compact(F.array(*[repair for _, _, _, repair in found]))),
        }
    ).drop(own, f"{own}_shape", *at.values(), *raw, *right, *value)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("reasons") == 0)


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("reasons") > 0)


def items(df: DataFrame, payload: str, name: str, *aliases: str) -> DataFrame:
    """A row for each element of a list field, with ``place`` (from 0) and ``item``; no rows where there is no such list."""
    own = _own(df)
    at = [f"{own}_member{i}" for i in range(1 + len(aliases))]
    rows = with_parsed(df, payload, own)
    rows = _step(rows, {c: F.try_variant_get(F.col(own), f'$["{n}"]', "variant") for c, n in zip(at, (name, *aliases), strict=True)})
    rows = _step(rows, {c: F.when(~F.is_variant_null(F.col(c)), F.try_variant_get(F.col(c), "$", "array<variant>")) for c in at})
    # an inner explode makes Spark filter by the list's size first, which computes the list again for each term
    out = rows.select(*[c for c in df.columns if c not in ("place", "item")], F.posexplode_outer(F.coalesce(*[F.col(c) for c in at])).alias("place", "item"))
    return out.where("place is not null")


PLACEHOLDER = r"(?i)\.\.\.|\btodo\b|\btbd\b|placeholder|to be added|not recorded|<[a-z_]+ here>"
REQUEST = r"(?m)^(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) \S+ HTTP/\d"
HOST, RESPONSE, COMMAND = r"(?mi)^host:\s*\S+", r"(?m)^HTTP/\d(?:\.\d)? \d{3}", r"^\s*(?:curl|python3?) "


def complete_proof(payload: Column) -> Column:
    """Whether an object proves something: title, request, response and payload are there, nothing is a placeholder, and the request is a whole
    HTTP request (with host, and answered by an HTTP response) or a command. False for anything that is no object.
    """
    text = {n: F.btrim(F.coalesce(F.try_variant_get(payload, f'$["{n}"]', "string"), F.lit("")), F.lit(" \t\r\n")) for n in ("title", "request", "response", "payload", "note", "verification")}
    full = F.lit(True)
    for n in ("title", "request", "response", "payload"):
        full = full & (text[n] != "")
    http = text["request"].rlike(REQUEST)
    shape = F.when(http, text["request"].rlike(HOST) & text["response"].rlike(RESPONSE)).otherwise(text["request"].rlike(COMMAND))
    return F.coalesce(full & ~F.concat_ws("\n", *text.values()).rlike(PLACEHOLDER) & shape, F.lit(False))
