"""Diffs, three-way merges, upserts, soft deletes and merges of people, as joins that return new tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], same: dict[str, Column] | None = None) -> DataFrame:
    """(keys, change, changed): removed, added and modified rows, with the names of the columns that differ.

    Columns compare null-safe; ``same`` overrides the test of a column (``l`` and ``r`` structs are in scope).
    One full outer join.
    """
    pack = lambda df, s: df.select(*keys, F.struct(*columns).alias(s))
    both = pack(left, "l").join(pack(right, "r"), list(keys), "full_outer")
    equal = {c: F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns} | (same or {})
    changed = F.array_compact(F.array(*[F.when(~equal[c], F.lit(c)) for c in columns]))
    change = F.when(F.col("r").isNull(), "removed").when(F.col("l").isNull(), "added").when(F.size(changed) > 0, "modified")
    names = F.when((F.col("l").isNotNull()) & F.col("r").isNotNull(), F.array_join(changed, ",")).otherwise("")
    return both.select(*keys, change.alias("change"), names.alias("changed")).where("change IS NOT NULL")


def merge(base: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], policy: str) -> DataFrame:
    """(keys, columns, conflict): rows changed on one side take that side; on both, unequally, the policy decides.

    Policies: ``left``, ``right``, ``skip`` (the base stays) and ``manual`` (the base stays and ``conflict``
    is true). Rows deleted on one side and unchanged on the other go.
    """
    def side(df, s):
        return df.select(*keys, F.struct(*columns).alias(s))

    rows = side(base, "o").join(side(left, "l"), list(keys), "full_outer").join(side(right, "r"), list(keys), "full_outer")
    # structs compare by text, as a missing row is a null struct and null fields must count
    text = {s: F.when(F.col(s).isNull(), F.lit("")).otherwise(F.to_json(s, {"ignoreNullFields": "false"})) for s in "olr"}
    moved_l, moved_r = ~text["l"].eqNullSafe(text["o"]), ~text["r"].eqNullSafe(text["o"])
    clash = moved_l & moved_r & ~text["l"].eqNullSafe(text["r"])
    kept = {"left": "l", "right": "r", "skip": "o", "manual": "o"}[policy]
    chosen = F.when(clash, F.col(kept)).when(moved_l, F.col("l")).when(moved_r, F.col("r")).otherwise(F.col("o"))
    rows = rows.select(*keys, chosen.alias("x"), (clash & F.lit(policy == "manual")).alias("conflict"))
    return rows.where(F.col("x").isNotNull()).select(*keys, "x.*", "conflict")


def apply_merge(base: DataFrame, merged: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table after a merge, and its counts (inserted, updated, deleted, conflicts) as one row.

    ``merged`` is the result of ``merge``; rows in conflict stay as they are in ``base``.
    """
    cols = base.columns
    rest = [c for c in cols if c not in keys]
    pack = lambda df, s, *more: df.select(*keys, F.struct(*rest, *more).alias(s))
    both = pack(base, "o").join(pack(merged, "m", "conflict"), list(keys), "full_outer")
    text = lambda s: F.to_json(F.struct(*[F.col(f"{s}.{c}") for c in rest]), {"ignoreNullFields": "false"})
    clash = F.coalesce(F.col("m.conflict"), F.lit(False))
    stays = clash & F.col("o").isNotNull()
    kind = F.when(clash, "conflict").when(F.col("o").isNull(), "insert").when(F.col("m").isNull(), "delete").when(text("o") != text("m"), "update")
    rows = both.withColumn("_kind", kind)
    count = lambda what, name: F.count_if(F.col("_kind") == what).alias(name)
    counts = rows.agg(count("insert", "inserted"), count("update", "updated"), count("delete", "deleted"), count("conflict", "conflicts"))
    value = lambda c: F.when(stays, F.col(f"o.{c}")).otherwise(F.col(f"m.{c}")).alias(c)
    kept = rows.where(F.coalesce(F.col("_kind") != "delete", F.lit(True))).where(F.col("m").isNotNull() | F.col("o").isNotNull())
    return kept.select(*keys, *(value(c) for c in rest)).select(*cols), counts


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), unchanged: Column | None = None) -> DataFrame:
    """The table after an upsert: new rows replace old ones of their key, except for the ``keep`` columns.

    Where ``unchanged`` (over ``o`` and ``n`` structs) holds, the old row stays as it is. The last of new
    rows with one key is not defined here: give distinct keys.
    """
    cols = old.columns
    rest = [c for c in cols if c not in keys]
    both = old.select(*keys, F.struct(*rest).alias("o")).join(new.select(*keys, F.struct(*rest).alias("n")), list(keys), "full_outer")
    stays = F.col("n").isNull() | (F.coalesce(unchanged, F.lit(False)) & F.col("o").isNotNull() if unchanged is not None else F.lit(False))
    value = lambda c: F.when(stays, F.col(f"o.{c}")).when(F.lit(c in keep) & F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*keys, *(value(c).alias(c) for c in rest)).select(*cols)


def replace_owned(old: DataFrame, new: DataFrame, keys: Sequence[str], owned: Column) -> DataFrame:
    """Re-import: rows owned by the source go, the source's rows come in; others stay unless replaced."""
    stay = old.where(~F.coalesce(owned, F.lit(False))).join(new.select(*keys), list(keys), "left_anti")
    return stay.unionByName(new)


def audit(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, before, after): one row for each changed value, as text; whole rows for inserts and deletes."""
    pack = lambda df, s: df.select(*keys, F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns])).alias(s))
    both = pack(old, "l").join(pack(new, "r"), list(keys), "full_outer")
    out = both.select(*keys, F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"), "l", "r")
    out = out.select(*keys, "column", F.col("l")[F.col("column")].alias("before"), F.col("r")[F.col("column")].alias("after"))
    return out.where(~F.col("before").eqNullSafe(F.col("after")))


def soft_delete(df: DataFrame, gone: DataFrame, key: str, now: Column, deleted: str = "deleted_at") -> DataFrame:
    """Rows whose key is in ``gone`` get the time, unless they were deleted before."""
    side = gone.select(F.col(key).alias("_k")).distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull() & F.col(deleted).isNull()
    return df.join(side, F.col(key) == F.col("_k"), "left").withColumn(deleted, F.when(hit, now).otherwise(F.col(deleted))).drop("_k", "_gone")


def hard_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """{name: (rows left, count of rows gone)} for tables given with their foreign key column."""
    out = {}
    for name, (df, column) in tables.items():
        side = gone.select(F.col(key).alias("_k"))
        on = F.col(column) == F.col("_k")
        out[name] = df.join(side, on, "left_anti"), df.join(side, on, "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return out


def rewrite_key(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column`` with merged ids replaced by their survivor. ``mapping``: (merged, survivor)."""
    side = mapping.select(F.col("merged").alias("_m"), F.col("survivor").alias("_s"))
    return df.join(side, F.col(column) == F.col("_m"), "left").withColumn(column, F.coalesce("_s", column)).drop("_m", "_s")


def merge_people(people: DataFrame, names: DataFrame, events: DataFrame, mapping: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """People, names and events after merges: the merged are marked deleted, their names follow (order + 1000).

    Their events move to the survivor, but for those that equal an event of the survivor in kind, custom
    kind, day and place, nulls included: these collapse into it and go. Nobody else's events change.
    ``events``: (event, person, kind, day, place) and, if there is one, custom; other columns stay.
    """
    gone = soft_delete(people, mapping.select(F.col("merged").alias("id")), "id", now)
    gone = gone.join(mapping.select(F.col("merged").alias("id"), F.col("survivor").alias("merged_into")), "id", "left")
    side = mapping.select(F.col("merged").alias("_m"))
    moved = names.join(side, F.col("person") == F.col("_m"), "left")
    moved = moved.withColumn("sort_order", F.col("sort_order") + F.when(F.col("_m").isNotNull(), 1000).otherwise(0)).drop("_m")
    fall = merge_preview(events, mapping).select(F.col("event_b").alias("event")).distinct()
    kept = rewrite_key(events.join(fall, "event", "left_anti"), "person", mapping).select(*events.columns)
    return gone, rewrite_key(moved, "person", mapping), kept


def merge_preview(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """(survivor, merged, event_a, event_b): events that would collapse; kind, custom kind, day and place compare null-safe."""
    same = [c for c in ("kind", "custom", "day", "place") if c in events.columns]
    a = events.join(mapping, F.col("person") == F.col("survivor")).select("survivor", "merged", F.col("event").alias("event_a"), *same)
    b = events.join(mapping, F.col("person") == F.col("merged")).select(F.col("survivor").alias("_s"), F.col("merged").alias("_m"), F.col("event").alias("event_b"), *(F.col(c).alias(f"_{c}") for c in same))
    equal = (F.col("survivor") == F.col("_s")) & (F.col("merged") == F.col("_m"))
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, equal).select("survivor", "merged", "event_a", "event_b")


def undo(versions: DataFrame, key: str, at: str, since: Column, until: Column) -> DataFrame:
    """The last version of each row before ``since``, for merges not older than ``until`` allows."""
    before = versions.where((F.col(at) < since) & (since >= until))
    cols = [c for c in versions.columns if c != key]
    return before.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(at)).alias("x")).select(key, "x.*")


def new_attempts(candidates: DataFrame, attempts: DataFrame, merged: DataFrame, now: Column, cool_down: int = 90) -> DataFrame:
    """Candidate pairs (local, remote) that are not open, not rejected within ``cool_down`` days, nor merged by remote id."""
    active = attempts.where("merged_at IS NULL AND rejected_at IS NULL")
    fresh = attempts.where(F.col("rejected_at") >= F.date_sub(now, cool_down))
    out = candidates.join(active, ["local", "remote"], "left_anti").join(fresh, ["local", "remote"], "left_anti")
    return out.join(merged.select("remote"), "remote", "left_anti").select(*candidates.columns)
