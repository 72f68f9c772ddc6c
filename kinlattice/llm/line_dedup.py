"""Line dedup: drop long lines that many documents share, keep the copy in the largest document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Shelf, ascii_lower, spread_join

MIN_CHARS, MIN_DOCS = 40, 5
#: A broadcast of so many line hashes is about 30 MB; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _digests(lines: Column) -> Column:
    """96 bits of hash of each line's key. One step a transform, as its variable is read more than once in the next."""
    keys = F.transform(F.transform(lines, lambda x: F.trim(x, F.lit(BLANKS))), ascii_lower)
    return F.transform(keys, lambda k: F.when(k.isNotNull(), F.struct(F.xxhash64(k).alias("a"), F.hash(k).alias("b"))))


def _is_long(line: Column, min_chars: int) -> Column:
    """Bytes first: they are never fewer than code points, and cost nothing to count."""
    return (F.octet_length(line) >= min_chars) & (F.char_length(F.trim(line, F.lit(BLANKS))) >= min_chars)


def line_dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` distinct documents lose all their lines,
    but for those in the largest doc_id that holds the key. Null text counts as one empty line
    and stays null in ``kept_text``. Rows with a null doc_id are one document together: they
    count as one holder and never are the largest. Several rows of one doc_id are one document.
    Other columns pass through; columns named like the added ones are replaced.
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    long_keys = _digests(F.filter(F.split("text", "\n", -1), lambda x: _is_long(x, min_chars)))
    # the digests of long lines, an eighth of the text or less, are what the later steps read
    hashed = shelf.put(
        docs.where(F.octet_length("text") >= min_chars)
        .select("doc_id", F.array_distinct(long_keys).alias("keys"))
        .where(F.size("keys") > 0)
    )
    held = hashed.select("doc_id", F.explode("keys").alias("key"))
    # rows a key has are at least the documents it has: a cheap first cut without a distinct
    common = shelf.put(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("key"))
    n = common.count()
    # one line may stand in a third of all documents
    near = (lambda df, side: df.join(F.broadcast(side), "key")) if n <= broadcast_rows else (lambda df, side: spread_join(df, side, ["key"], "doc_id"))
    shared = shelf.put(near(held, common).distinct())
    repeated = (
        shared.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("key", "keeper")
    )
    lost = shelf.put(
        near(shared, repeated)
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("_lost"))
        .select(F.col("doc_id").alias("_id"), "_lost")
    )
    # always a shuffle by document: what is lost grows with the documents, so it is no side to broadcast
    split = docs.join(lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn(
        "_lines", F.when(F.col("_lost").isNotNull(), F.split(F.coalesce("text", F.lit("")), "\n", -1))
    )
    # a zip reads its second array once, where a look-up by position could be evaluated line by line
    digests = _digests(F.transform("_lines", lambda x: F.when(_is_long(x, min_chars), x)))
    stays = F.zip_with("_lines", digests, lambda x, d: F.when(~F.coalesce(F.array_contains("_lost", d), F.lit(False)), x))
    kept = split.withColumn("_kept", F.when(F.col("_lost").isNotNull(), F.filter(stays, lambda x: x.isNotNull())))
    text = F.coalesce("text", F.lit(""))
    return kept.select(
        *docs.columns,
        F.when(F.col("_lost").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("kept_text"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )


SQL = r"""
WITH line AS (
  SELECT doc_id, p, ls[p] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), range(1, len(ls) + 1) t(p)
), keyed AS (
  SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, (c.key IS NOT NULL AND c.keeper <> k.doc_id) AS lost FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
