"""Filters and projections as column expressions and small transforms (no shuffle, no UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(df: DataFrame, tenant: str, value, deleted: str) -> DataFrame:
    """Rows of one tenant that are not soft-deleted. Both predicates reach a Parquet scan."""
    return df.where((F.col(tenant) == value) & F.col(deleted).isNull())


def contains_ci(value: Column, needle: str) -> Column:
    """Case-insensitive substring; ``%``, ``_`` and ``\\`` in the needle are ordinary characters."""
    return F.lower(value).contains(needle.lower())


def name_search(given: Column, surname: Column, needle: str) -> Column:
    """The needle in the given name, the surname, or both joined by a blank."""
    return contains_ci(given, needle) | contains_ci(surname, needle) | contains_ci(F.concat_ws(" ", given, surname), needle)


def starts_ci(value: Column, prefix: str) -> Column:
    return F.lower(value).startswith(prefix.lower())


def like_ci(value: Column, needle: str) -> Column:
    """Substring in which ``%`` and ``_`` of the needle stay wildcards."""
    return value.ilike(f"%{needle}%")


def shares_code(codes: Sequence[str], *columns: Column) -> Column:
    """Any code in any array column; without codes nothing matches."""
    if not codes:
        return F.lit(False)
    wanted = F.array(*[F.lit(c) for c in codes])
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.arrays_overlap(c, wanted), F.lit(False))
    return out


def year_between(date: Column, low: int | None = None, high: int | None = None) -> Column:
    """Either bound may be open; null dates never match."""
    out = date.isNotNull()
    if low is not None:
        out = out & (F.year(date) >= low)
    if high is not None:
        out = out & (F.year(date) <= high)
    return out


def either_side(a: Column, b: Column, value) -> Column:
    return (a == value) | (b == value)


def all_of(**equal) -> Column:
    """Equality filters; None leaves a column unfiltered."""
    out = F.lit(True)
    for name, value in equal.items():
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def tri_state(merged_at: Column, rejected_at: Column) -> Column:
    return F.when(merged_at.isNotNull(), "merged").when(rejected_at.isNotNull(), "rejected").otherwise("pending")


def json_differs(doc: Column, path: str, value: str) -> Column:
    """True unless the field has the value; a missing field or document counts as different."""
    return F.coalesce(F.get_json_object(doc, path), F.lit("")) != value


def mapped(value: Column, table: dict, default) -> Column:
    """A small fixed lookup; unknown and null values take the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(default))


#: Confidence by evidence quality grade.
QUALITY = {0: 0.1, 1: 0.4, 2: 0.7, 3: 0.95}
ROLES = {"viewer": 1, "editor": 2, "owner": 3}


def quality_confidence(grade: Column) -> Column:
    return mapped(grade.cast("int"), QUALITY, 0.5)


def role_satisfies(role: Column, needed: str) -> Column:
    return mapped(role, ROLES, 0) >= ROLES[needed]


def redact(df: DataFrame, private: Column, hide: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Public view: ``drop`` columns go, ``hide`` columns are null in private rows."""
    hidden = {c: F.when(~private, F.col(c)) for c in hide}
    return df.withColumns(hidden).drop(*drop)


def likely_alive(born: Column, died: Column, now: Column, limit: int = 110) -> Column:
    """No death recorded, and no birth or one of at most ``limit`` years ago (365.25 days each)."""
    age = F.datediff(now, born) / 365.25
    return died.isNull() & (born.isNull() | (age <= limit))


def plan_in_force(status: Column, period_end: Column, now: Column, grace_days: int) -> Column:
    """The paid plan counts while active, and past due until the grace period is over."""
    late = (status == "past_due") & (now <= F.date_add(period_end, grace_days))
    return (status == "active") | (status == "trialing") | late


def strip_fields(rows: Column, names: Sequence[str]) -> Column:
    """Each struct of the array without the named fields."""
    return F.transform(rows, lambda x: x.dropFields(*names))


def reference_state(df: DataFrame, key: str, targets: DataFrame, target_key: str, tenant: str, tenant_value, deleted: str) -> DataFrame:
    """``df`` with ``state``: ok, missing, foreign (another tenant's) or deleted, tested in this order."""
    side = targets.select(F.col(target_key).alias("_k"), F.col(tenant).alias("_t"), F.col(deleted).alias("_d"))
    state = (
        F.when(F.col("_k").isNull(), "missing").when(F.col("_t") != tenant_value, "foreign").when(F.col("_d").isNotNull(), "deleted").otherwise("ok")
    )
    return df.join(side, F.col(key) == F.col("_k"), "left").withColumn("state", state).drop("_k", "_t", "_d")
