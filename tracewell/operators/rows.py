"""Row selection: filters, first and latest rows, top n, quotas and interleaving, diffs and merges.

All windows end in a unique key, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def filtered(df: DataFrame, **values: Any) -> DataFrame:
    """AND of the filters that are given: a list is membership, None no filter."""
    for name, value in values.items():
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(name).isin(*value))
        elif value is not None:
            df = df.where(F.col(name) == value)
    return df


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark limits ranks before the shuffle."""
    place = free(df, "_n")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n).drop(place)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first rows of each group with their place ``n``."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= n)


def ties(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows that share the first place of their group."""
    place = free(df, "_n")
    return df.withColumn(place, F.rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) == 1).drop(place)


def fixed_domain(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """(value, n) for every value of a fixed domain, zeros kept."""
    spark = df.sparkSession
    values = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def quota_fill(df: DataFrame, category: str, order: Sequence[Column], quota: int, limit: int) -> DataFrame:
    """One row of each category first, then up to its quota, then the rest, until the limit."""
    own = free(df, "_n")
    place = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    turn = F.when(F.col(own) == 1, 1).when(F.col(own) <= quota, 2).otherwise(3)
    return df.withColumn(own, place).withColumn("pass", turn).orderBy("pass", *order).limit(limit).drop(own)


def round_robin(df: DataFrame, family: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Rows of all families in turn, the families in order."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(family).orderBy(*order))).orderBy("turn", family).limit(limit)


def diff(base: DataFrame, target: DataFrame, key: str, digest: str) -> DataFrame:
    """added, modified, deleted or unchanged for every key of two snapshots."""
    a, b = base.select(F.col(key), F.col(digest).alias("_a")), target.select(F.col(key), F.col(digest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, updated: Sequence[str]) -> DataFrame:
    """Insert new keys; of known ones only the named columns change."""
    new = incoming.select(*[F.col(c).alias(f"_new_{c}") for c in stored.columns])
    both = stored.join(new, stored[key] == new[f"_new_{key}"], "full_outer")
    pick = lambda c: F.when(F.col(f"_new_{key}").isNotNull() & F.lit(c in updated), F.col(f"_new_{c}")).when(stored[key].isNotNull(), stored[c]).otherwise(F.col(f"_new_{c}"))
    return both.select(*[pick(c).alias(c) for c in stored.columns])


def insert_missing(known: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows of ``incoming`` that an insert-or-ignore adds: the first of each key that ``known`` has not. Null keys equal nothing, so all their rows are added."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    first = first_rows(incoming.where(whole), keys, order).join(known.select(*keys), list(keys), "left_anti")
    return first.select(*incoming.columns).unionByName(incoming.where(~whole))


def cascade(tables: dict[str, DataFrame], keys: dict[str, str], references: Sequence[tuple[str, str, str, str]], doomed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` after some rows are deleted, with all that hangs on them.

    ``keys`` names each table's key, ``doomed`` has the keys to delete (a column of that name). A reference is (table, column, referenced table,
    action): ``cascade`` deletes rows that refer to deleted ones, round by round until no more go, whatever cycles there are;
    ``null`` empties the column. Null references refer to nothing. Every round joins only what was deleted in the last.
    """
    gone_now = {name: kept(tables[name].join(df.select(F.col(keys[name])).distinct(), keys[name], "left_semi").select(keys[name]).distinct(), "doomed") for name, df in doomed.items()}
    deleted = {name: [df] for name, df in gone_now.items()}

    def every(name: str) -> DataFrame:
        out = deleted[name][0]
        for more in deleted[name][1:]:
            out = out.unionByName(more)
        return out

    while gone_now:
        found: dict[str, DataFrame] = {}
        for name, column, parent, action in references:
            if action == "cascade" and parent in gone_now:
                hit = tables[name].join(gone_now[parent].select(F.col(keys[parent]).alias("_gone")), F.col(column) == F.col("_gone"), "left_semi").select(keys[name])
                found[name] = hit if name not in found else found[name].unionByName(hit)
        gone_now = {}
        for name, hit in found.items():
            fresh = hit.distinct()
            fresh = kept(fresh.join(every(name), keys[name], "left_anti") if name in deleted else fresh, "doomed")
            if not fresh.isEmpty():
                gone_now[name] = fresh
                deleted.setdefault(name, []).append(fresh)
    out = {name: df.join(every(name), keys[name], "left_anti").select(*df.columns) if name in deleted else df for name, df in tables.items()}
    for name, column, parent, action in references:
        if action == "null" and parent in deleted:
            lost = every(parent).select(F.col(keys[parent]).alias("_gone"))
            out[name] = out[name].join(lost, F.col(column) == F.col("_gone"), "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")
    return out


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Add ``name``: the total of ``value`` in each group up to and with the row, in order.

    Rows are dealt by ranges of keys and order, so a group of any size spreads over tasks: what a range adds to a group is one number, and
    the numbers before it are added to its own running total. The order should end in a unique column; ties in all are rows of one range.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, at, before, group = free(df, "_part"), free(df, "_at"), free(df, "_before"), [free(df, f"_key{i}") for i in range(len(keys))]
    line = [F.col(c) for c in (*keys, *order)]
    dealt = kept(df.repartitionByRange(n, *line).sortWithinPartitions(*line).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at)), "dealt")
    totals = dealt.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, group, strict=True)], part).agg(F.sum(value).alias(before))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a group lies in
    totals = totals.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0))).withColumnRenamed(part, f"{part}_of")
    own = Window.partitionBy(part, *keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(part) == F.col(f"{part}_of")
    for k, g in zip(keys, group, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(g))
    return dealt.withColumn(name, F.sum(value).over(own)).join(totals, same).withColumn(name, F.col(name) + F.col(before)).drop(part, at, f"{part}_of", before, *group)


def within_budget(df: DataFrame, key: str, order: Sequence[str], size: str, required: Column, soft: int, hard: int) -> DataFrame:
    """The rows of each group that its budget holds, with ``bytes_before`` and ``forced``.

    In order, rows are taken as long as their running total is within ``soft``; rows that are ``required`` come first and are taken up to
    ``hard`` (forced beyond ``soft``). What is left out leaves a gap for nothing behind it, as totals run over all rows.
    """
    first, total = free(df, "_first"), free(df, "_total")
    rows = running(df.withColumn(first, F.when(required, 0).otherwise(1)), [key], [first, *order], size, total)
    forced = (F.col(first) == 0) & (F.col(total) > soft)
    return rows.where((F.col(total) <= soft) | forced & (F.col(total) <= hard)).withColumns({"bytes_before": F.col(total) - F.col(size), "forced": forced}).drop(first, total)


def compare_and_set(state: DataFrame, claims: DataFrame, key: str, column: str, order: Sequence[str]) -> DataFrame:
    """Set ``column`` where it is null to the first claim of the row's key; ``updated`` says where.

    ``claims`` has (key, claimant, *order); equal places in the order fall to the smallest claimant, claims without key
    or claimant count for nothing. Rows that have a value keep it, whoever claims them. Claims are reduced to one a
    key before the join. Columns of ``state`` other than ``column`` stay; one named ``updated`` is replaced.
    """
    claimed, found = free(state, "_claimed"), free(state, "_first")
    first = claims.where(F.col(key).isNotNull() & F.col("claimant").isNotNull()).groupBy(F.col(key).alias(claimed)).agg(F.min(F.struct(*order, "claimant")).alias(found))
    taken = F.col(column).isNull() & F.col(found).isNotNull()
    joined = state.join(first, F.col(key) == F.col(claimed), "left")
    return joined.withColumns({column: F.coalesce(F.col(column), F.col(f"{found}.claimant")), "updated": taken}).drop(claimed, found)
