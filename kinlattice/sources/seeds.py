"""Curated reference files: countries, surname clusters, places, archives, rules, scenario trees."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def countries(spark, path):
    return _json(spark, path, "iso2 string, country string").where("iso2 IS NOT NULL")


def surname_clusters(spark, path) -> DataFrame:
    """(canonical, scope, rank, form, script): every spelling of every cluster."""
    kinds = ["latin", "cyrillic", "hebrew", "yiddish"]
    fields = ", ".join(f"variants_{k}: array<string>" for k in kinds)
    rows = _json(spark, path, f"surname_variant_clusters array<struct<canonical: string, community_scope: string, rank_within_scope: int, {fields}>>")
    c = rows.select(F.explode("surname_variant_clusters").alias("c")).select("c.*")
    spelled = F.flatten(F.array(*[_tagged(f"variants_{k}", k) for k in kinds]))
    return c.select("canonical", F.col("community_scope").alias("scope"), F.col("rank_within_scope").alias("rank"), F.explode(spelled).alias("v")).select("canonical", "scope", "rank", "v.*")


def _tagged(column: str, script: str):
    return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda v: F.struct(v.alias("form"), F.lit(script).alias("script")))


def transliteration(spark, path) -> DataFrame:
    """(form, source, target) of tables given as maps."""
    rows = _json(spark, path, "transliteration_tables map<string, map<string, string>>")
    tables = rows.select(F.explode("transliteration_tables").alias("form", "m"))
    return tables.select("form", F.explode("m").alias("source", "target"))


def places(spark, path) -> DataFrame:
    """(old_name, modern_name, country, latitude, longitude, period, jurisdiction)."""
    schema = "old_name string, modern_name string, modern_country string, lat_lon array<double>, old_jurisdiction array<struct<period: string, name: string>>"
    rows = _json(spark, path, schema)
    return rows.select(
        "old_name", "modern_name", F.col("modern_country").alias("country"), F.get("lat_lon", 0).alias("latitude"), F.get("lat_lon", 1).alias("longitude"), F.explode_outer("old_jurisdiction").alias("j")
    ).select("old_name", "modern_name", "country", "latitude", "longitude", F.col("j.period").alias("period"), F.col("j.name").alias("jurisdiction"))


def archives(spark, path) -> DataFrame:
    """The catalogue; entries without an id, name or a time range that runs forward are refused."""
    schema = "archive_id string, name string, location_country string, location_city string, time_range_start int, time_range_end int, languages array<string>, digitization_level string"
    rows = _json(spark, path, schema)
    bad = rows.where("archive_id IS NULL OR name IS NULL OR time_range_start > time_range_end").count()
    if bad:
        raise ValueError(f"{bad} invalid archive entries")
    return rows


def synonyms(spark, path) -> DataFrame:
    """(canonical, form): every form of an anchor name, itself included; ``{"anchors": [{"canonical", "synonyms": []}]}``.

    Forms are trimmed and lower-case; empty ones drop, and a form of two anchors belongs to the first by name.
    """
    rows = _json(spark, path, "anchors array<struct<canonical: string, synonyms: array<string>>>").select(F.explode("anchors").alias("a"))
    every = F.concat(F.array(F.col("a.canonical")), F.coalesce(F.col("a.synonyms"), F.array().cast("array<string>")))
    forms = rows.select(F.lower(F.trim("a.canonical")).alias("canonical"), F.explode(every).alias("form")).withColumn("form", F.lower(F.trim("form")))
    return forms.where("form <> '' AND canonical <> ''").groupBy("form").agg(F.min("canonical").alias("canonical")).select("canonical", "form")


def rules(spark, path) -> DataFrame:
    """(pattern, rule, weight) of an export target, from JSON lines."""
    return spark.read.schema("pattern string, rule string, weight double").json(path)


#: Sections of a rule document: what a target drops, cannot encode, and does not know the structure of.
RULE_SCHEMA = "target string, version string, drop array<struct<pattern: string, rule: string, weight: double>>, encoding struct<charset: string, substitutes: map<string, string>>, structures array<struct<feature: string, condition: string, weight: double>>"


def target_rules(spark, path) -> dict:
    """The rules of an export target: tables ``drop`` and ``structures``, and ``charset`` and ``substitutes``.

    ``path`` is one small curated document, JSON or (where PyYAML is installed) YAML.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        text = json.dumps(yaml.safe_load(text))
    row = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", RULE_SCHEMA).alias("r")).first()["r"]
    if row is None or row["target"] is None:
        raise ValueError(f"{path}: no target")
    table = lambda rows, schema: spark.createDataFrame([tuple(r) for r in rows or []], schema)
    coding = row["encoding"]
    return {
        "target": row["target"], "version": row["version"], "drop": table(row["drop"], "pattern string, rule string, weight double"),
        "structures": table(row["structures"], "feature string, condition string, weight double"),
        "charset": coding["charset"] if coding else None, "substitutes": dict(coding["substitutes"] or {}) if coding else {},
    }


def seed_tables(tables: dict[str, DataFrame], keys: dict[str, list[str]], path: str) -> dict[str, int]:
    """Writes curated tables below ``path``, a folder each, and returns how many rows were new by name.

    A table that is there keeps its rows; only rows with new keys are added, so a second run adds none.
    """
    from py4j.protocol import Py4JError
    from pyspark.errors import AnalysisException

    added = {}
    for name, df in tables.items():
        new = df.dropDuplicates(keys[name])
        try:
            new = new.join(df.sparkSession.read.parquet(f"{path}/{name}").select(*keys[name]), keys[name], "left_anti")
        except (AnalysisException, Py4JError):  # nothing there yet
            pass
        added[name] = new.count()
        new.write.mode("append").parquet(f"{path}/{name}")
    return added


def trees(spark, path, schema: str = "tree_id string, category string, input_gedcom_excerpt string") -> DataFrame:
    """Scenario documents, one a file; a repeated tree_id is refused."""
    rows = _json(spark, path, schema)
    twice = [r["tree_id"] for r in rows.groupBy("tree_id").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"repeated tree ids: {twice}")
    return rows


def pedigree(spark, path) -> DataFrame:
    """(number, id, father, mother) of an Ahnentafel-numbered document: the parents of n are 2n and 2n + 1."""
    rows = _json(spark, path, "persons array<struct<id: string, ascendancyNumber: string>>").select(F.explode("persons").alias("p"))
    rows = rows.select(F.col("p.ascendancyNumber").try_cast("long").alias("number"), F.col("p.id").alias("id")).where("number > 0")
    side = lambda step, name: rows.select(((F.col("number") - step) / 2).cast("long").alias("number"), F.col("id").alias(name), F.col("number").alias("_n")).where(F.col("_n") % 2 == step).drop("_n")
    return rows.join(side(0, "father"), "number", "left").join(side(1, "mother"), "number", "left")
