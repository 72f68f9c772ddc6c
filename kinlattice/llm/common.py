"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import spread_join
from ..storage import Shelf, ship

__all__ = ["BLANKS", "BLANK_CLASS", "Shelf", "ascii_lower", "maybe_broadcast", "ship", "spread_join", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that the word and line rules name: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Text of one-byte characters takes the quicker built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint where the counted rows are within the limit; a plain (shuffled) side beyond it."""
    return F.broadcast(df) if rows <= limit else df
