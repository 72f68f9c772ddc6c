"""Positions, runs and overlaps. Range conditions become equi-joins on bins, so they scale out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relationship ranges of shared DNA (public Shared cM Project 4.0): label, low, high, mean.
SHARED_CM = [
    ("Identical twin / Same person", 3400, 4000, 3487),
    ("Parent / Child", 2376, 3720, 3485),
    ("Full sibling", 1613, 3488, 2613),
    ("Grandparent / Grandchild / Aunt / Uncle / Niece / Nephew / Half-sibling", 1156, 2311, 1759),
    ("1st cousin / Great-grandparent / Great-aunt / Great-uncle / Half-aunt / Half-uncle", 396, 1397, 866),
    ("1st cousin once removed / Great-great-grandparent / Half 1st cousin", 102, 979, 432),
    ("2nd cousin / 1st cousin twice removed", 41, 592, 229),
    ("2nd cousin once removed / Half 2nd cousin", 14, 353, 122),
    ("3rd cousin", 0, 234, 73),
    ("3rd cousin once removed", 0, 192, 48),
    ("4th cousin", 0, 139, 35),
    ("5th cousin or more distant", 0, 117, 21),
]
UNRELATED, NOISE = "Unrelated / noise", 7.0


def pieces(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Breakpoints as pieces (group, lo, hi, y_lo, y_hi): half-open, in order, none beyond the last point."""
    w = Window.partitionBy(group).orderBy(x)
    out = points.select(group, F.col(x).alias("lo"), F.col(y).alias("y_lo"), F.lead(x).over(w).alias("hi"), F.lead(y).over(w).alias("y_hi"))
    return out.where(F.col("hi").isNotNull())


def interpolate(values: DataFrame, points: DataFrame, group: str, at: str, x: str, y: str, out: str, bin_width: float) -> DataFrame:
    """``values`` with ``out``: the piecewise linear curve of ``points`` at ``at``, held constant beyond both ends.

    Pieces are spread over bins of ``bin_width`` and joined by (group, bin): never a nested loop. Groups
    without points give null.
    """
    ends = points.groupBy(group).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min_by(y, x).alias("_y0"), F.max_by(y, x).alias("_y1"))
    place = lambda c: F.floor(c / bin_width)
    spread = pieces(points, group, x, y).withColumn("_bin", F.explode(F.sequence(place(F.col("lo")), place(F.col("hi")))))
    held = values.join(ends, group, "left").withColumn("_at", F.least(F.greatest(F.col(at), F.col("_x0")), F.col("_x1")))
    spread = spread.withColumnRenamed(group, "_g")
    on = (F.col(group) == F.col("_g")) & (place(F.col("_at")) == F.col("_bin")) & (F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi"))
    joined = held.join(spread, on, "left")
    line = F.col("y_lo") + (F.col("y_hi") - F.col("y_lo")) * (F.col("_at") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    value = F.when(F.col("_at") == F.col("_x1"), F.col("_y1")).when(F.col("_at") == F.col("_x0"), F.col("_y0")).otherwise(line)
    return joined.withColumn(out, value).select(*values.columns, out)


def runs(df: DataFrame, keys: list[str], order: list[str], hit: Column, at: str) -> DataFrame:
    """Unbroken runs of rows where ``hit`` is true; rows where it is null neither count nor break.

    (keys, start, end, n): an island's number is the count of breaks before it.
    """
    seen = df.withColumn("_hit", hit).where(F.col("_hit").isNotNull())
    island = F.sum((~F.col("_hit")).cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = seen.withColumn("_island", island).where("_hit")
    return marked.groupBy(*keys, "_island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], least: float, bin_width: float) -> DataFrame:
    """Rows of ``a`` and ``b`` (start, end) that share the keys and overlap by at least ``least`` (> 0).

    Both sides are spread over bins; a pair is taken only in the bin where its overlap begins, so it
    appears once. Other columns must differ; the result has ``lo`` and ``hi`` of the overlap.
    """
    place = lambda c: F.floor(c / bin_width)
    spread = lambda df, s, e: df.withColumn("_bin", F.explode(F.sequence(place(F.col(s)), place(F.col(e)))))
    left = spread(a.withColumnsRenamed({"start": "_s1", "end": "_e1"}), "_s1", "_e1")
    right = spread(b.withColumnsRenamed({"start": "_s2", "end": "_e2"}), "_s2", "_e2")
    lo, hi = F.greatest("_s1", "_s2"), F.least("_e1", "_e2")
    both = left.join(right, [*keys, "_bin"]).where((hi - lo >= least) & (place(lo) == F.col("_bin")))
    return both.withColumns({"lo": lo, "hi": hi}).drop("_bin", "_s1", "_e1", "_s2", "_e2")


def label_ranges(values: DataFrame, key: str, value: str, ranges: list[tuple] = SHARED_CM, noise: float = NOISE) -> DataFrame:
    """(key, label, probability): every range that holds the value, by a bell curve of a quarter range's width.

    Below ``noise``, or where no range fits, the one label is UNRELATED; above all ranges it is the first.
    The ranges are a dozen fixed rows, so they are an array expression and no join.
    """
    bands = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"), F.lit(float(m)).alias("mean")) for l, a, b, m in ranges])
    v = F.col(value)
    fits = F.filter(bands, lambda r: (r["lo"] <= v) & (v <= r["hi"]))

    def score(r):
        sigma = F.greatest((r["hi"] - r["lo"]) / 4, F.lit(1.0))
        return F.struct(r["label"].alias("label"), (F.exp(-0.5 * F.pow((v - r["mean"]) / sigma, F.lit(2.0))) / sigma).alias("score"))

    one = lambda label: F.array(F.struct(F.lit(label).alias("label"), F.lit(1.0).alias("score")))
    top = max(r[2] for r in ranges)
    found = F.when(v < noise, one(UNRELATED)).when(F.size(fits) > 0, F.transform(fits, score)).when(v > top, one(ranges[0][0])).otherwise(one(UNRELATED))
    scored = values.select(key, found.alias("_f")).withColumn("_total", F.aggregate("_f", F.lit(0.0), lambda a, x: a + x["score"]))
    return scored.select(key, F.explode("_f").alias("_x"), "_total").select(key, "_x.label", (F.col("_x.score") / F.col("_total")).alias("probability"))


def triplets(segments: DataFrame, least: float, bin_width: float) -> DataFrame:
    """Three people who pairwise share a segment of one chromosome, overlapping by ``least`` or more.

    ``segments``: (a, b, chrom, start, end) with a < b. (chrom, x, y, z, start, end), x < y < z.
    """
    two = overlaps(
        segments.selectExpr("a AS x", "b AS y", "chrom", "start", "end"), segments.selectExpr("a AS x", "b AS z", "chrom", "start", "end"), ["x", "chrom"], least, bin_width
    ).where("y < z")
    third = segments.selectExpr("a AS y", "b AS z", "chrom", "start", "end")
    both = two.withColumnsRenamed({"lo": "start", "hi": "end"})
    three = overlaps(both, third, ["y", "z", "chrom"], least, bin_width)
    return three.selectExpr("chrom", "x", "y", "z", "lo AS start", "hi AS end").distinct()
