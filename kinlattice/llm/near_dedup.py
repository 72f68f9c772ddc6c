"""Near-duplicate documents: MinHash, banding, signature verification, exact confirmation, components.

Only one representative of equal word sequences takes part. In a bucket (documents that share a band)
not all pairs are tried: everything is compared with the least id, and components are formed. Only
buckets whose other members are still in several components go on, those of one least component
together: members outside the largest component are compared with the rest, block by block. A pair
within one component cannot change the result, so no link between components is lost, and no bucket
is capped.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, ship, spread_join
from .components import components
from .shingles import MinHash, fingerprint, overlap, shingle_set, word_hashes

#: Contract of op4: three-word shingles, similarity at least 85/100.
SHINGLE, PERCENT = 3, 85
#: Minima of a signature, and the chance that a pair just at the threshold shares no band.
MINIMA, MISS = 125, 1e-6
#: At a similarity of 0.8 an estimate is lower by more than this with probability 1e-7, at 0.85 with 2e-8.
SLACK = 0.2
#: Rows of each side of a block, about.
BLOCK = 200
#: The members of a bucket with more than this are compared with its least in several tasks.
HOT = 1000
#: Open buckets, and groups of them, that are broadcast (16 to 24 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows that keep the chance of missing a pair at the threshold below MISS."""
    fits = [r for r in range(1, MINIMA + 1) if (1 - (percent / 100) ** r) ** (MINIMA // r) <= MISS]
    rows = max(fits, default=1)
    return MINIMA // rows, rows


def _scanner(shingle: int):
    def run(batches):
        import pyarrow as pa

        minhash = MinHash(MINIMA)
        for batch in batches:
            rows = {"f1": [], "f2": [], "n": [], "sig": []}
            for t in batch.column(1):
                words = word_hashes(t.as_py() or "")
                items = shingle_set(words, shingle)
                one, two = fingerprint(words)
                rows["f1"].append(one)
                rows["f2"].append(two)
                rows["n"].append(len(items))
                rows["sig"].append(minhash.signature(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows["f1"], pa.int64()), pa.array(rows["f2"], pa.int64()), pa.array(rows["n"], pa.int64()), pa.array(rows["sig"], pa.list_(pa.int32()))],
                names=["doc_id", "f1", "f2", "n", "sig"],
            )

    return run


def _signer(shingle: int):
    """Puts its signature, null without words, to each row's ``text``."""

    def run(batches):
        import pyarrow as pa

        minhash = MinHash(MINIMA)
        for batch in batches:
            sets = [shingle_set(word_hashes(t.as_py() or ""), shingle) for t in batch.column(batch.schema.get_field_index("text"))]
            sig = pa.array([minhash.signature(x) if len(x) else None for x in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, sig], names=[*batch.schema.names, "sig"])

    return run


def _verifier(shingle: int, percent: int):
    """Keeps (a, b) whose full shingle sets are similar enough; a signature estimate rules out most others."""

    def run(batches):
        import pyarrow as pa

        seen: OrderedDict[int, tuple] = OrderedDict()

        def full(text):
            key = hash(text)
            if key in seen and seen[key][0] == text:
                seen.move_to_end(key)
                return seen[key][1]
            items = shingle_set(word_hashes(text), shingle)
            seen[key] = (text, items)
            if len(seen) > 64:
                seen.popitem(last=False)
            return items

        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.asarray(col[s][k].values) for s in ("sig_a", "sig_b"))
                if (x == y).mean() < percent / 100 - SLACK:
                    continue
                x, y = full(col["text_a"][k].as_py()), full(col["text_b"][k].as_py())
                both = overlap(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([col["a"].take(pa.array(keep, pa.int64())), col["b"].take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def _parts(n):
    return F.ceil(n / HOT).cast("long")


def _texts(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(rep, firsts, text, sig): each text of a document that shares a band with another.

    firsts: the least ids of its buckets, each once and with the rows of the largest such bucket.
    """
    firsts = F.array_sort(F.collect_set(F.struct("first", "n")))
    held = members.groupBy("rep").agg(firsts.alias("firsts"))
    last = lambda x, k: (k == F.size("firsts") - 1) | (F.get("firsts", k + 1)["first"] != x["first"])
    held = held.select("rep", F.filter("firsts", last).alias("firsts"))
    texts = docs.select(F.col("doc_id").alias("rep"), "text", F.xxhash64("text").alias("h")).join(held.hint("merge"), "rep")
    texts = texts.dropDuplicates(["rep", "h"]).select("rep", "firsts", "text")
    return texts.mapInArrow(_signer(shingle), "rep long, firsts array<struct<first:long,n:long>>, text string, sig array<int>").where("sig IS NOT NULL")


def _links(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a bucket's least id and another member whose texts are similar.

    The members of a large bucket are dealt to several tasks. A least id is a member of its own buckets,
    so that it knows the most parts in which it is looked for.
    """
    dealt = texts.select(F.explode("firsts").alias("f"), F.col("rep").alias("b"), F.col("text").alias("text_b"), F.col("sig").alias("sig_b")).where("f.first < b")
    dealt = dealt.select(F.col("f.first").alias("a"), F.pmod(F.xxhash64("b"), _parts(F.col("f.n"))).alias("part"), "b", "text_b", "sig_b")
    own = F.filter("firsts", lambda x: x["first"] == F.col("rep"))
    copied = texts.select(F.col("rep").alias("a"), F.get(own, F.lit(0))["n"].alias("n"), F.col("text").alias("text_a"), F.col("sig").alias("sig_a"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), _parts(F.col("n")) - 1)).alias("part")
    copied = copied.where("n IS NOT NULL").select("a", part, "text_a", "sig_a")
    both = dealt.join(copied.hint("merge"), ["a", "part"]).select("a", "b", "text_a", "text_b", "sig_a", "sig_b")
    return both.mapInArrow(_verifier(shingle, percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (``doc_id``, ``text``).

    Words are runs of non-blanks, A-Z lower-cased. Documents are linked when 100 * intersection of
    their distinct ``shingle``-word shingles >= ``percent`` * union; texts with fewer words are one
    shingle; null texts and texts without words have none and are linked with nothing. The component
    is the least doc_id reachable. Several rows with one doc_id are one document, linked through any
    of its texts, and get one component; n_shingles is that of the row's own text. Rows with a null
    doc_id are linked with nothing and kept, component_id null. Word sequences are equal when 128 bits
    of hash are. Other columns of ``docs`` are not used; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shelf = Shelf(spark)
    docs = docs.select("doc_id", "text")
    scan = shelf.put(docs.mapInArrow(_scanner(shingle), "doc_id long, f1 long, f2 long, n long, sig array<int>"))
    reps = shelf.put(
        scan.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("rows"))
    )
    bands, rows = banding(percent)
    band = lambda k: F.xxhash64(k, F.slice("sig", k * rows + 1, rows))
    buckets = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    members = shelf.put(spread_join(buckets, shared.select("bucket", "first", "n"), ["bucket"], "rep"))
    texts = shelf.put(_texts(docs, members, shingle))
    own = _several(scan, reps, shelf)
    edges = shelf.put(_links(texts, shingle, percent))
    roots = components(edges if own is None else edges.unionByName(own), shelf)
    found = _rest(members, roots, texts, shelf, shingle, percent)
    roots = roots if found is None else components(roots.select("a", "b").unionByName(found), shelf)
    shelf.drop(members, texts, edges)
    # a group of copies may hold a third of all rows; a text of its own is its document's
    root = roots.select(F.col("b").alias("rep"), F.col("a").alias("root"))
    copies = reps.where(F.col("rows") > 1).select("f1", "f2", "rep").join(root, "rep", "left").select("f1", "f2", F.coalesce("root", "rep").alias("label"))
    out = spread_join(scan.select("doc_id", "f1", "f2", "n"), copies, ["f1", "f2"], "doc_id", "left")
    out = out.join(root.withColumnRenamed("rep", "doc_id"), "doc_id", "left")
    least = F.when(F.col("n") > 0, F.coalesce("label", "root", "doc_id")).otherwise(F.coalesce("root", "doc_id"))
    least = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(least)
    return out.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _several(scan: DataFrame, reps: DataFrame, shelf: Shelf) -> DataFrame | None:
    """Edges (a, b) between a document with several texts and the first holder of each; None if there is no such document."""
    text = F.struct("f1", "f2")
    found = scan.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
    found = shelf.put(found.where("lo <> hi").select("doc_id"))
    if found.isEmpty():
        return None
    held = scan.where("n > 0").select("doc_id", "f1", "f2").join(found, "doc_id", "left_semi")
    edges = spread_join(held, reps.select("f1", "f2", "rep"), ["f1", "f2"], "doc_id").where("rep < doc_id")
    return shelf.put(edges.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())


def _with_few(rows: DataFrame, side: DataFrame, on: str) -> DataFrame:
    return rows.join(F.broadcast(side), on) if side.count() <= BROADCAST_ROWS else spread_join(rows, side, [on], "rep")


def _rest(members: DataFrame, roots: DataFrame, texts: DataFrame, shelf: Shelf, shingle: int, percent: int) -> DataFrame | None:
    """Links (a, b) between components, by their roots, that join all whose members are similar; None if there are none.

    Open buckets hold untried members of several components. Those of one least component form a
    group; every member outside a group's largest component is compared with all its members of
    other components, in blocks of both sides, and only links leave a block.
    """
    now = members.where("first < rep").select("bucket", "rep")
    now = now.join(roots.select(F.col("b").alias("rep"), F.col("a").alias("root")), "rep", "left")
    now = shelf.put(now.select("bucket", "rep", F.coalesce("root", "rep").alias("root")))
    open_ = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    open_ = shelf.put(open_.select("bucket", "lo"))
    if open_.isEmpty():
        shelf.drop(now, open_)
        return None
    who = shelf.put(_with_few(now, open_, "bucket").select("lo", "rep", "root").distinct())
    sizes = who.groupBy("lo", "root").agg(F.count(F.lit(1)).alias("n"))
    # the largest component of a group and how many blocks each side has
    blocks = sizes.groupBy("lo").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    count = lambda n: F.ceil(n / BLOCK).cast("int")
    blocks = shelf.put(blocks.select("lo", "main", count(F.col("all")).alias("n_all"), count(F.col("all") - F.col("most")).alias("n_rest")))
    rows = _with_few(who, blocks, "lo")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda side, xs, ys: F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))))
    every, rest = at(0, F.array(own("n_all")), span("n_rest")), at(1, span("n_all"), F.array(own("n_rest")))
    places = F.flatten(F.when(F.col("root") == F.col("main"), every).otherwise(F.concat(every, rest)))
    dealt = rows.select("lo", "rep", "root", places.alias("places")).join(texts.select("rep", "text", "sig"), "rep").select("lo", "rep", "root", "text", "sig", F.inline("places"))
    found = shelf.put(dealt.groupBy("lo", "x", "y").applyInArrow(_block(shingle, percent), "a long, b long"))
    shelf.drop(now, open_, who, blocks)
    return None if found.isEmpty() else found


def _block(shingle: int, percent: int):
    """Links between the components of the two sides of a block, by their roots."""

    def run(rows):
        import pyarrow as pa

        side = rows.column("side").to_numpy()
        root = rows.column("root").to_numpy()
        sig = np.stack([np.asarray(x.values) for x in rows.column("sig")])
        text = rows.column("text")
        sets: dict[int, np.ndarray] = {}

        def full(k):
            if k not in sets:
                sets[k] = shingle_set(word_hashes(text[k].as_py()), shingle)
            return sets[k]

        every, links = np.flatnonzero(side == 0), set()
        for r in np.flatnonzero(side == 1):
            like = (sig[every] == sig[r]).mean(axis=1)
            like[root[every] == root[r]] = 0.0
            done = {x for pair in links if root[r] in pair for x in pair}
            for k in np.argsort(-like, kind="stable"):
                if like[k] < percent / 100 - SLACK:
                    break
                other = every[k]
                if root[other] in done:
                    continue
                x, y = full(int(r)), full(int(other))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = overlap(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    done.add(root[other])
                    links.add((min(root[r], root[other]), max(root[r], root[other])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
