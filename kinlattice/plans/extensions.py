"""Registries through which a user adds rules, validators, detectors and readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Registry:
    """Named extensions in the order they were added; a name is taken once."""

    def __init__(self, kind: str):
        self.kind, self.items = kind, {}

    def add(self, name: str, item: Callable) -> Callable:
        if name in self.items:
            raise ValueError(f"{self.kind} {name} exists")
        self.items[name] = item
        return item

    def get(self, name: str) -> Callable:
        return self.items[name]


#: pairs -> struct column (rule, direction, weight), null when silent
RULES = Registry("rule")
#: tables of a document -> findings
VALIDATORS = Registry("validator")
#: tables of a tree -> (tree_id, detector, subject, verdict)
DETECTORS = Registry("detector")
#: (spark, path) -> kit rows
READERS = Registry("reader")


def run_rules(pairs: DataFrame, key: list[str], registry: Registry = RULES) -> DataFrame:
    from ..operators import evidence

    rules: list[Column] = [make() for make in registry.items.values()]
    return evidence.compose(pairs, key, rules)


def run_validators(tables: dict[str, DataFrame], registry: Registry = VALIDATORS) -> DataFrame:
    """All findings; a validator that cannot be planned becomes an INFO finding of its own."""
    from ..operators import quality

    out = None
    for name, check in registry.items.items():
        try:
            part = check(tables).select(*quality.FINDING)
        except Exception as e:  # noqa: BLE001 - a broken extension must not hide the others' findings
            spark = next(iter(tables.values())).sparkSession
            part = spark.createDataFrame([(None, name, "INFO", None, f"{type(e).__name__}")], ", ".join(f"{c} string" for c in quality.FINDING))
        out = part if out is None else out.unionByName(part)
    return out


def run_detectors(tables: dict[str, DataFrame], registry: Registry = DETECTORS) -> DataFrame:
    """(tree_id, detector, verdicts): the results of all detectors by tree."""
    out = None
    for name, detect in registry.items.items():
        part = detect(tables).select("tree_id", F.lit(name).alias("detector"), F.struct("subject", "verdict").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("tree_id", "detector").agg(F.array_sort(F.collect_list("v")).alias("verdicts"))


def conforms(df: DataFrame, schema: T.StructType) -> list[str]:
    """What is wrong with the columns of an extension's output; empty if nothing is."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"missing {f.name}" for f in schema.fields if f.name not in have]
    return wrong + [f"{f.name} is {have[f.name].simpleString()}" for f in schema.fields if f.name in have and have[f.name] != f.dataType]
