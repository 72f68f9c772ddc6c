"""Writers: partitioned tables, JSON dumps, exports with a manifest, and text files of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Bulk append. Rows of one partition value are dealt to as many tasks as they need, not to one."""
    writer = (df.repartition(F.col(partition), F.pmod(F.xxhash64(*df.columns), F.lit(8))) if partition else df).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def dump_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """A folder of JSON for each table, and the manifest (name, n) written beside them."""
    manifest = None
    for name, df in tables.items():
        dump_json(df, f"{path}/{name}")
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        manifest = row if manifest is None else manifest.unionByName(row)
    dump_json(manifest, f"{path}/manifest")
    return manifest


def write_text(lines: DataFrame, path: str) -> None:
    """(file, no, sub, line) as text, a folder for each file, lines in order within it."""
    lines.repartition("file").sortWithinPartitions("file", "no", "sub").select("file", F.col("line").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def write_document(nodes: DataFrame, path: str) -> None:
    """Whole documents as text: the lines of ``nodes`` (file, no, level, xref, tag, value) in order, a folder for each file.

    Line breaks of a value become CONT lines; a file without a trailer gets one.
    """
    from . import gedcom

    lines = gedcom.write_lines(nodes)
    end = nodes.groupBy("file").agg(F.max("no").alias("no"), F.bool_or(F.col("tag") == "TRLR").alias("ends")).where("NOT ends")
    trailer = end.select("file", (F.col("no") + 1).alias("no"), F.lit(0).alias("sub"), F.lit("0 TRLR").alias("line"))
    write_text(lines.select("file", "no", "sub", "line").unionByName(trailer), path)
