"""Predicates and projections whose parameters may be absent."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional_equal(column: str, value: Any) -> Column:
    """True for every row if ``value`` is None, else equality (null rows do not match)."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def excludes(*conditions: Column) -> Column:
    """Not all of the conditions. Three-valued: a null condition that decides keeps the row out, as in SQL."""
    both = conditions[0]
    for c in conditions[1:]:
        both = both & c
    return ~both


def with_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is among ``keys``, however many there are; repeated keys do not repeat rows, null keys match nothing."""
    return df.join(keys, on, "left_semi")


def either(**values: Any) -> Column:
    """One of several columns has its value; None leaves a column out, and without any value nothing matches."""
    out = F.lit(False)
    for name, value in values.items():
        if value is not None:
            out = out | F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return out


def mentions(columns: Iterable[str], needle: str) -> Column:
    """A column contains ``needle``, whatever the case; % and _ stand for themselves, and nulls contain nothing."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False))
    return out


def any_keyword(columns: Iterable[str], words: Iterable[str]) -> Column:
    """One of the words, in any case, in the columns taken together."""
    text = F.lower(F.concat_ws(" ", *columns))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w.lower()))
    return out


def blank(column: str) -> Column:
    """Null, or nothing but white space."""
    return F.col(column).isNull() | (F.trim(F.regexp_replace(column, r"\s+", " ")) == "")


def between_days(column: str, first: str | None, last: str | None) -> Column:
    """The day of a time lies between two days, both included; an absent one is no bound."""
    day, out = F.to_date(column), F.lit(True)
    if first:
        out = out & (day >= F.lit(first).cast("date"))
    if last:
        out = out & (day <= F.lit(last).cast("date"))
    return out


def page_of(df: DataFrame, columns: Sequence[str], order: Sequence[Column], limit: int, offset: int = 0, where: Column | str | None = None) -> DataFrame:
    """The named columns of the rows that pass, in order, a page at a time."""
    out = df if where is None else df.where(where)
    return out.orderBy(*order).offset(offset).limit(limit).select(*columns)


def found_or_fail(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The row with a key; running the result fails if there is none."""
    one = df.where(F.col(key) == F.lit(value)).limit(1)
    names = [F.col(f"row.{c}").alias(c) for c in df.columns]
    missing = F.raise_error(F.lit(f"no row has {key} = {value}"))
    return one.agg(F.first(F.struct(*df.columns)).alias("row")).select(F.when(F.col("row").isNull(), missing).otherwise(F.col("row")).alias("row")).select(*names)


def present(**columns: Column) -> Column:
    """A JSON object of the columns that are not null, in the order given."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "true"})


def unique_in_order(*lists: Column) -> Column:
    """The lists on end, each element where it first appears; null lists count as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
