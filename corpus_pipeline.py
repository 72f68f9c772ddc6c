"""From raw documents to token ids: language, shared lines, near-duplicates, benchmark passages, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlattice.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from kinlattice.llm.common import Shelf, table

#: Near-duplicates are linked at a similarity of 0.8 on five-word shingles.
SHINGLE, PERCENT = 5, 80


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null texts and texts without a letter go; repeated rows are judged each; columns stay as they are,
    whatever their names; an empty table stays empty.
    """
    return language_id.accepted(docs)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without long lines that five or more documents share, but for one copy.

    ``n_chars``, where there is such a column, is counted again for changed texts. Null and empty texts
    stay as they are, repeated rows are one document, other columns stay, whatever their names.
    """
    own = {c: f"_own_{c}" for c in ("kept_text", "n_lines", "n_dropped") if c in docs.columns}
    out = line_dedup.line_dedup(docs.withColumnsRenamed(own))
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    out = out.withColumns(changed).drop("kept_text", "n_lines", "n_dropped")
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near-duplicates.

    Texts without words, null ones too, and rows without an id are in no group and stay; all rows of a
    document stay or go together; columns stay as they are.
    """
    groups = near_dedup.near_duplicates(docs, SHINGLE, PERCENT)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items.

    Texts without words, null ones too, are clean, and with an empty benchmark all are; repeated rows are
    judged each; columns stay as they are.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row: token ids, and the digest of their decoding.

    A null text counts as empty; repeated rows are encoded each; other columns are not used.
    """
    rows = bpe.bpe_encode(docs.select("doc_id", "text"), bpe.default_tokenizer(), decode=True, keep_text=False)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", by_language),
    ("line_dedup", without_shared_lines),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("bpe", as_tokens),
]
#: Language profiles, signatures and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    shelf = Shelf(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
