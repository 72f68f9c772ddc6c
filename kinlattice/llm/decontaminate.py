"""Benchmark decontamination: windows of test items found in training texts, word for word.

Windows are found by n-grams: whatever stands at a text's word p, a window of ``len`` words that covers
the n-gram there begins at most ``len`` - n words before it. So every n-gram of the items is hashed into a
broadcast set, a training text is scanned in steps of ``len`` - n + 1 words, and each window has exactly
one n-gram at such a step: none is lost. Where an n-gram is in the set, the windows around it are written
out as words and compared in full. Large benchmarks are taken in blocks, each a broadcast set of bounded
size, so no row of a training text is ever shuffled by an n-gram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, ascii_lower, maybe_broadcast, table

WINDOW = 13
#: A word: letters and digits, and every character above 7F.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same of a text that is not in lower case, where A-Z are letters, and what a word is there.
RAW_GAP, RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct n-gram hashes of a broadcast set (16 bytes each); a benchmark with more is taken in blocks.
BLOCK_WINDOWS = 1_000_000
#: Hits, of all texts together, that are broadcast (about 50 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1)
    return F.filter(split, lambda w: w != "")


def step_of(size: int) -> int:
    """Steps of the scan for windows of ``size`` words; the n-grams have ``size`` - step + 1 words."""
    return (size + 1) // 2


def ngram_hashes(words: Column, size: int, step: int) -> Column:
    """(len, at, h) of the n-grams of a text, from its words' hashes, at words 0, ``step``, 2 * ``step`` and so on."""
    n = size - step_of(size) + 1
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - n, F.lit(step)))
    grams = F.transform(starts, lambda i: F.struct(F.lit(size).alias("len"), i.alias("at"), F.xxhash64(F.slice(words, i + 1, n)).alias("h")))
    return F.coalesce(grams, F.array().cast("array<struct<len:int,at:int,h:bigint>>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, len, gram, ngrams, item_ids): every distinct window of the items (``item_id``, ``text``), its hash and its n-grams' ones.

    Items without words, or without an id, have none; an item of fewer words is one window.
    """
    words = items.where("item_id IS NOT NULL").select(F.col("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    grams = words.select("item_id", F.explode(F.transform(starts, lambda k: F.slice("words", k, window))).alias("w"))
    distinct = grams.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).withColumn("_w", F.transform("w", lambda x: F.xxhash64(x)))
    ngrams = F.coalesce(*[F.when(F.size("w") == k, F.transform(ngram_hashes(F.col("_w"), k, 1), lambda x: x["h"])) for k in range(1, window + 1)])
    return distinct.withColumn("gram", F.array_join("w", " ")).select(F.xxhash64("gram").alias("h"), F.size("w").alias("len"), "gram", ngrams.alias("ngrams"), "item_ids")


def _text_key() -> dict[str, Column]:
    return {"_h1": F.xxhash64("text"), "_h2": F.hash("text")}


def _same_text(df: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` with its key columns renamed, and the condition that joins it to rows with (doc_id, _h1, _h2)."""
    side = df.withColumnsRenamed({"doc_id": "_d", "_h1": "_g1", "_h2": "_g2"})
    return side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))


def _total(df: DataFrame, array: str) -> int:
    """Entries of all arrays, and one for each row."""
    return df.agg(F.coalesce(F.sum(1 + F.size(array)), F.lit(0))).first()[0]


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, _h1, _h2, hits) for every distinct (doc_id, text) of ``docs`` that has a window of the items.

    ``hits`` holds (start, len, item_ids) of each occurrence of a window; start counts words from 0.
    ``_h1`` and ``_h2`` are hashes of the text.
    """
    shelf = Shelf(docs.sparkSession)
    windows = shelf.put(item_windows(items, window))
    ngrams = shelf.put(windows.select("len", F.explode("ngrams").alias("h")).distinct())
    sizes = sorted(r["len"] for r in ngrams.select("len").distinct().collect())  # at most ``window``
    keyed = docs.select("doc_id", "text").withColumns(_text_key())
    if not sizes:
        return keyed.limit(0).select("doc_id", "_h1", "_h2", F.array().cast("array<struct<start:int,len:int,item_ids:array<string>>>").alias("hits"))
    hashed = keyed.select("doc_id", "_h1", "_h2", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("_w"))
    scanned = hashed.select("doc_id", "_h1", "_h2", F.inline(F.concat(*[ngram_hashes(F.col("_w"), k, step_of(k)) for k in sizes])))
    blocks = -(-ngrams.count() // block_windows)
    near = []
    for k in range(blocks):
        block = F.broadcast(ngrams.where(F.pmod("h", F.lit(blocks)) == k))
        near.append(shelf.put(scanned.join(block, ["h", "len"]).select("doc_id", "_h1", "_h2", "len", "at")))
    near = reduce(DataFrame.unionByName, near).groupBy("doc_id", "_h1", "_h2").agg(F.collect_set(F.struct("at", "len")).alias("_near"))
    near = shelf.put(near)
    side, same = _same_text(near)
    texts = keyed.join(maybe_broadcast(side, _total(near, "_near"), broadcast_rows), same)
    texts = texts.select("doc_id", "_h1", "_h2", "_near", words_of(F.col("text")).alias("_w"))
    steps = F.create_map(*[F.lit(x) for k in sizes for x in (k, step_of(k))])

    def around(x: Column) -> Column:
        """The windows that may cover the n-gram found at a step, as words."""
        first, last = F.greatest(F.lit(0), x["at"] - F.element_at(steps, x["len"]) + 1), F.least(x["at"], F.size("_w") - x["len"])
        gram = lambda i: F.struct(i.alias("start"), x["len"].alias("len"), F.array_join(F.slice("_w", i + 1, x["len"]), " ").alias("gram"))
        return F.when(first <= last, F.transform(F.sequence(first, last), gram)).otherwise(F.array().cast("array<struct<start:int,len:int,gram:string>>"))

    spelt = texts.select("doc_id", "_h1", "_h2", F.inline(F.flatten(F.transform("_near", around)))).withColumn("h", F.xxhash64("gram"))
    known = windows.select("h", "len", "gram", "item_ids")
    sure = spelt.join(maybe_broadcast(known, _total(known, "item_ids"), broadcast_rows), ["h", "len", "gram"])
    return shelf.put(sure.groupBy("doc_id", "_h1", "_h2").agg(F.collect_set(F.struct("start", "len", "item_ids")).alias("hits")))


def covered(hits: Column) -> Column:
    """Words inside at least one hit."""
    spans = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["start"], (h["start"] + h["len"]).alias("end")))))
    total = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
    )
    return total["n"].cast("long")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_percent: int = 5, block_windows: int = BLOCK_WINDOWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, hits, contaminated) for every row of ``docs`` (``doc_id``, ``text``).

    A word is hit when it stands in an occurrence of a window; a text is contaminated when it has hits
    and they are at least ``least_percent`` of its words. Texts without words, null ones too, are
    clean; with an empty benchmark all are. Repeated rows get a row each. Extra columns are not used.
    """
    found = find_windows(docs, items, window, block_windows, broadcast_rows)
    side, same = _same_text(found.withColumn("n_hit", covered(F.col("hits"))))
    rows = docs.select("doc_id", "text").withColumns(_text_key()).select("doc_id", "_h1", "_h2", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(maybe_broadcast(side, _total(found, "hits"), broadcast_rows), same, "left")
    ids = F.transform(F.flatten(F.transform("hits", lambda h: h["item_ids"])), lambda i: i.cast("string"))
    items_found = F.coalesce(F.array_sort(F.array_distinct(ids)), F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), items_found.alias("items"), "hits").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "hits",
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= least_percent * F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", window: int = WINDOW, least_percent: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without contaminated documents or, with ``remove="spans"``, with the hit words taken out of their texts.

    Columns are those of ``docs``. Clean rows stay as they are: nulls, empty texts and repeated rows too.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    found = find_windows(docs, items, window, broadcast_rows=broadcast_rows)
    side, same = _same_text(found.withColumn("_n_hit", covered(F.col("hits"))).withColumnRenamed("hits", "_hits"))
    side, n = (side.drop("_hits"), found.count()) if remove == "documents" else (side, _total(found, "hits"))
    keyed = docs.withColumns(_text_key()).join(maybe_broadcast(side, n, broadcast_rows), same, "left")
    n_words = F.size(words_of(F.col("text")))
    bad = F.when(F.col("_n_hit") > 0, 100 * F.col("_n_hit") >= least_percent * n_words).otherwise(False)
    if remove == "documents":
        return keyed.where(~bad).select(*docs.columns)
    # words and the gaps around them; a word goes together with the gap before it
    parts = keyed.withColumns(
        {"_bad": bad, "_words": F.filter(F.split("text", RAW_GAP, -1), lambda w: w != ""), "_gaps": F.split("text", RAW_WORD, -1)}
    )
    hit = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))
    parts = parts.withColumn("_hit", F.when(F.col("_bad"), hit))
    kept = F.transform("_words", lambda w, i: F.when(F.array_contains("_hit", i), "").otherwise(F.concat(F.get("_gaps", i), w)))
    text = F.concat(F.array_join(kept, ""), F.element_at("_gaps", -1))
    return parts.withColumn("text", F.when(F.col("_hit").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS gram
  FROM i, range(1, greatest(1, len(w) - 12) + 1) t(p) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win
), cand AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM d, sizes, range(1, greatest(0, len(w) - n + 1) + 1) t(p)
), hit AS (SELECT c.doc_id, c.p, c.n, win.item_id FROM cand c JOIN win ON c.gram = win.gram AND c.n = win.n
), words AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM hit, range(0, n) t(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
