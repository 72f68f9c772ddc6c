"""Joins, first-per-key, pagination and set operations, written so that every join is an equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_rows(events: DataFrame, participants: DataFrame, places: DataFrame, event_key: str, place_key: str) -> DataFrame:
    """Events with their participants, and their place if they have one."""
    return events.join(participants, event_key).join(places, place_key, "left")


def with_match(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """EXISTS: rows that have a partner."""
    return df.join(other.select(*keys), list(keys), "left_semi")


def without_match(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NOT EXISTS. Null keys of ``df`` stay; null keys of ``other`` exclude nothing."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def count_children(df: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Every row with the number of its children. They are counted before the join, so no row is repeated."""
    n = children.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_k", "_n")


def groups_with_all(df: DataFrame, group: str, member: str, members: Sequence) -> DataFrame:
    """Groups that contain each of the given members."""
    found = df.where(F.col(member).isin(list(members))).groupBy(group).agg(F.count_distinct(member).alias("_n"))
    return found.where(F.col("_n") == len(set(members))).select(group)


def polymorphic(links: DataFrame, kind: str, key: str, targets: dict[str, tuple[DataFrame, str, Column]], out: str) -> DataFrame:
    """Links resolved by their kind: {kind: (table, key column, label)}; the branches are unioned."""
    parts = []
    for name, (target, target_key, label) in targets.items():
        side = target.select(F.col(target_key).alias("_k"), label.alias(out))
        parts.append(links.where(F.col(kind) == name).join(side, F.col(key) == F.col("_k")).drop("_k"))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def either_key(df: DataFrame, columns: Sequence[str], other: DataFrame, other_key: str, ids: Sequence[str]) -> DataFrame:
    """Join on any of several columns of ``df`` without an OR: the columns are unpivoted first.

    A pair that matches through several columns appears once.
    """
    long = df.select(*ids, F.explode(F.array_distinct(F.array(*columns))).alias("_v")).where(F.col("_v").isNotNull())
    return long.join(other, F.col("_v") == F.col(other_key)).drop("_v")


def canonical(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs in one order: the lesser id first."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def pick(df: DataFrame, keys: Sequence[str], value: Column, order: Column, where: Column | None = None) -> DataFrame:
    """The ``value`` with the least ``order`` of each key: an aggregate, so map-side combined, without a sort."""
    chosen = df if where is None else df.where(where)
    return chosen.groupBy(*keys).agg(F.min_by(value, order).alias("value"))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY ... LIMIT ... OFFSET ... as one top-k node."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def keyset_page(df: DataFrame, ts: str, key: str, after: tuple, limit: int) -> DataFrame:
    """Rows below the cursor, newest first, one more than the page so that the caller sees if there is another."""
    t, k = after
    below = (F.col(ts) < F.lit(t)) | ((F.col(ts) == F.lit(t)) & (F.col(key) < F.lit(k)))
    return df.where(below).orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit + 1)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def dangling(refs: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """References that point nowhere; null references are none."""
    side = targets.select(F.col(target_key).alias("_k"))
    return refs.where(F.col(key).isNotNull()).join(side, F.col(key) == F.col("_k"), "left_anti")


#: Parts that the rows of one key are dealt to in a join that expects hot keys.
SALTS = 8


def spread_join(rows: DataFrame, side: DataFrame, on: Sequence[str], by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` where one key may hold a third of ``rows``.

    The rows of a key are dealt to SALTS parts by the hash of column ``by``, and ``side`` is given to each part.
    """
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    # a side is larger by its parts than the plan knows: never broadcast unseen
    return dealt.join(side.withColumn("_salt", parts).hint("merge"), [*on, "_salt"], how).drop("_salt")
