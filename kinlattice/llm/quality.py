"""Quality rules: counts within a document, and lines that many documents of one host share.

Boilerplate is what a host repeats: lines are normalised and hashed, distinct documents counted per
host and line, lines above the limit taken out, and documents with too little left are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, BLANKS, Shelf, ascii_lower, spread_join, table

GRAM = 8
#: Lines in more distinct documents of one host are boilerplate.
MAX_DOCS = 20
#: A document is depleted if less than this share of its words, or fewer than LEAST_WORDS, remain.
LEAST_SHARE, LEAST_WORDS = 0.3, 10
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_CLASS + "+", -1), lambda w: w != "")


def window_hashes(hashes: Column, n: int = GRAM) -> Column:
    """64-bit hashes of the ``n``-word windows, from those of the words (a column: it is read many times)."""
    windows = F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(1), F.size(hashes) - n + 1), lambda i: F.xxhash64(F.slice(hashes, i, n))))
    return F.coalesce(windows, F.array().cast("array<bigint>"))


def _covered(windows: Column, n: int = GRAM) -> Column:
    """Only for documents with equal windows: sorted by hash, those with an equal neighbour, by position."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(s: Column) -> Column:
        twin = lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])
        return F.array_sort(F.transform(F.filter(s, lambda e, k: F.coalesce(twin(e, k), e["h"] == F.get(s, k - 1)["h"], e["h"] == F.get(s, k + 1)["h"], F.lit(False))), lambda e: e["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + n - F.greatest(p, a["end"])).alias("n"), (p + n).alias("end"))
    # aggregate over a one-element array binds the sorted array to a name, so it is sorted once
    return F.aggregate(F.element_at(F.transform(F.array(ranked), marked), 1), start, step)["n"]


def measure(docs: DataFrame) -> DataFrame:
    """Base counts of every row, and its lines as (a, b, n): two hashes of the normalised line, its words."""
    text = F.coalesce("text", F.lit(""))
    has_word = lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0
    host = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    one = docs.select("doc_id", host.alias("host"), text.alias("t")).select(
        "doc_id", "host", "t", words_of(F.col("t")).alias("words"), F.filter(F.split("t", "\n", -1), has_word).alias("lines")
    )
    one = one.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    two = one.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", BLANK_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("hashes")).alias("windows"),
        _lines(F.col("lines")).alias("lines"),
    )
    repeats = F.when(F.size("windows") > F.size(F.array_distinct("windows")), _covered(F.col("windows"))).otherwise(0)
    return two.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        repeats.cast("long").alias("n_repeat_words"), "lines",
    )


def _lines(lines: Column) -> Column:
    """(a, b, n) of each line. One step a transform: its variable holds a value that a later step reads more than once."""
    flat = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, BLANK_CLASS + "+", " ")))
    keys = F.transform(flat, ascii_lower)
    words = lambda key: F.char_length(key) - F.char_length(F.replace(key, F.lit(" "), F.lit(""))) + 1
    return F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("a"), F.hash(k).alias("b"), words(k).cast("int").alias("n")))


def quality(
    docs: DataFrame,
    max_docs: int = MAX_DOCS,
    least_share: float = LEAST_SHARE,
    least_words: int = LEAST_WORDS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """A row of counts and verdicts for every row of ``docs`` (``doc_id``, ``text``, ``source``: the host, one for all if missing).

    ``base_failed``: fewer than 20 words, or more than 30 in 100 of them in repeated eight-word
    windows. ``removed_words``: words of lines that more than ``max_docs`` distinct doc_ids of the host
    hold; the normalised line (A-Z lower-cased, blanks collapsed) counts. ``kept``: neither failed nor
    depleted. Null texts have no words. Rows with a null source are one host; rows with a null doc_id
    one document. Repeated rows are one document and get the same counts.
    """
    shelf = Shelf(docs.sparkSession)
    rows = shelf.put(measure(docs))
    keys = F.array_distinct(F.transform("lines", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    host = F.coalesce("host", F.lit("\x00"))
    held = rows.select(host.alias("host"), F.explode(keys).alias("k")).groupBy("host", "k").agg(F.count(F.lit(1)).alias("n"))
    # rows that hold a line are at least the documents that do: few lines are left for the exact count
    often = shelf.put(held.where(F.col("n") > max_docs).select("host", "k.a", "k.b"))
    n = often.count()
    lines = rows.select("row", "doc_id", host.alias("host"), F.explode("lines").alias("x")).select("row", "doc_id", "host", "x.*")
    # one line of one host may stand in a third of all rows
    on = ["host", "a", "b"]
    near = (lambda df, side: df.join(F.broadcast(side), on)) if n <= broadcast_rows else (lambda df, side: spread_join(df, side, on, "row"))
    seen = shelf.put(near(lines, often).groupBy("row", "doc_id", "host", "a", "b").agg(F.sum("n").alias("n")))
    ids = seen.select("host", "a", "b", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"))
    common = ids.groupBy("host", "a", "b").agg(F.count_distinct("d").alias("docs")).where(F.col("docs") > max_docs).drop("docs")
    removed = near(seen, common).groupBy("row").agg(F.sum("n").alias("removed_words"))
    out = rows.drop("lines", "host").join(removed, "row", "left").drop("row")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("removed_words")
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    depleted = (left < least_words) | (left < least_share * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), ln AS (
  SELECT doc_id, source, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, source, unnest(ls) AS l FROM d)
), keyed AS (
  SELECT doc_id, source, l, len(lw) AS n,
         translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM ln WHERE len(lw) > 0
), dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM keyed GROUP BY doc_id
), common AS (SELECT source, k FROM keyed GROUP BY source, k HAVING count(DISTINCT doc_id) > 20
), gone AS (SELECT doc_id, sum(n) AS removed FROM keyed JOIN common USING (source, k) GROUP BY doc_id
), gram AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g FROM d, range(1, greatest(0, len(w) - 7) + 1) t(p)
), twice AS (SELECT doc_id, g FROM gram GROUP BY doc_id, g HAVING count(*) > 1
), rep AS (SELECT doc_id, count(DISTINCT p + o) AS n_rep FROM gram JOIN twice USING (doc_id, g), range(0, 8) t(o) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words,
         CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND n_words - removed_words >= 10 AND n_words - removed_words >= 0.3 * n_words AS kept
FROM m
"""
