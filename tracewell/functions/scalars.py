"""Column functions: ranks, text normalisation, routes and paths."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_of(column: str | Column, order: Sequence[str]) -> Column:
    """The place of a value in a fixed order; unknown and null values come last."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        out = F.when(c == value, i).otherwise(out)
    return out


def squeeze(c: Column) -> Column:
    """White-space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clip(c: Column, limit: int) -> Column:
    """Squeezed text of at most ``limit`` characters, with three dots where it was cut."""
    s = squeeze(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("...")))


def cost(prices: dict[str, int]) -> Column:
    """What the token counts in columns cost at prices for a million tokens; a null count makes it null."""
    return sum((F.col(name) * price for name, price in prices.items()), F.lit(0)).cast("double") / F.lit(1e6)


def path_key(c: Column) -> Column:
    """Slashes forward, leading dots and slashes off, lower case."""
    return F.lower(F.regexp_replace(F.translate(c, "\\", "/"), r"^[./]+", ""))


def route_key(c: Column) -> Column:
    """A URL's path without query and fragment, in lower case; numbers become a parameter."""
    path = F.regexp_extract(F.lower(c), r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(F.when(path == "", "/").otherwise(path), r"/\d+", "/:id")


def url_path(c: Column) -> Column:
    """The path of a URL without its slashes at both ends."""
    return F.btrim(F.regexp_extract(c, r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/"))


def feature_key(url: Column) -> Column:
    """The first path segment that says what a page is about: numbers, versions, parameters, languages and ``api`` do not; without one ``root``."""
    telling = F.filter(F.split(url_path(url), "/"), lambda x: (x != "") & ~x.rlike(r"^([0-9]+|v[0-9]+|api|de|en|es|fr|[{:].*)$"))
    return F.coalesce(F.regexp_replace(F.get(telling, 0), r"[.][a-z]+$", ""), F.lit("root"))


def route_join(prefix: Column, route: Column) -> Column:
    """A prefix and a route with one slash between them; anchors of patterns are taken off."""
    return F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"), F.ltrim(F.regexp_replace(route, r"^\^|\$$", ""), F.lit("/")))


def is_safe_path(path: Column) -> Column:
    """No segment climbs to the parent folder."""
    return ~F.array_contains(F.split(F.translate(path, "\\", "/"), "/"), "..")


def locator(c: Column) -> Column:
    """(path, line, note) of a reference ``path:line note``; nulls where it has no such form."""
    part = lambda i: F.regexp_extract(c, r"^(.+?):([0-9]+)(.*)$", i)
    known = part(2) != ""
    return F.struct(F.when(known, part(1)).alias("path"), F.when(known, part(2)).try_cast("long").alias("line"), F.when(known, F.trim(part(3))).alias("note"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """A content hash; a null part counts as empty, so that places keep their meaning."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16))


def ratio(top: Column, bottom: Column, digits: int = 4) -> Column:
    """A share; nothing out of nothing is 1."""
    return F.when(bottom == 0, 1.0).otherwise(F.round(top / bottom, digits))


def csv_cell(c: Column) -> Column:
    """A cell of a CSV line: quoted if it holds a comma, a quote or a line break, quotes doubled; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def block_ratio(a: str, b: str) -> Column:
    """How alike two texts are: twice the characters in matching blocks by both lengths; 0 where one is null."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        alike = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
        return pd.Series([0.0 if x is None or y is None else alike(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return ratio(F.col(a), F.col(b))
