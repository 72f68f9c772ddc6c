"""Evidence aggregation, intervals and graphs on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import graph as G
from ..operators import intervals as I
from ..operators import relational as R
from .registry import query, table
from .relational import edges

_EVIDENCE = """SELECT user_id AS h, props AS rule, CASE event_type WHEN 'error' THEN 'contradicts' WHEN 'view' THEN 'neutral' ELSE 'supports' END AS direction,
  least(value / 600, 0.95) AS weight FROM events"""


def evidence_rows(spark, d):
    kind = F.when(F.col("event_type") == "error", "contradicts").when(F.col("event_type") == "view", "neutral").otherwise("supports")
    return table(spark, d, "events").select(F.col("user_id").alias("h"), F.col("props").alias("rule"), kind.alias("direction"), F.least(F.col("value") / 600, F.lit(0.95)).alias("weight"))


_NOISY = f"""SELECT h, greatest(least(1 - coalesce(product(1 - w), 1) - least(0.1 * sum(no), 0.5), 1), 0.05) AS score, count(w) AS n_rules, least(0.1 * sum(no), 0.5) AS penalty
  FROM (SELECT h, rule, avg(weight) FILTER (direction = 'supports') AS w, count(*) FILTER (direction = 'contradicts') AS no FROM ({_EVIDENCE}) {{where}} GROUP BY ALL) GROUP BY h"""


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


@query("a09_noisy_or", f"SELECT h, round(score, 6) AS score, n_rules, round(penalty, 6)::DOUBLE AS penalty FROM ({_NOISY.format(where='')})")
def _(spark, d):
    return rounded(E.noisy_or(evidence_rows(spark, d), "h", "rule", "direction", "weight"), "score", "penalty")


@query(
    "a10_rescore_delta",
    f"""SELECT round(avg(abs(a.score - b.score)), 6) AS mean_delta, round(max(abs(a.score - b.score)), 6) AS max_delta, count(*) AS n
        FROM ({_NOISY.format(where="")}) a JOIN ({_NOISY.format(where="WHERE weight < 0.5")}) b USING (h)""",
)
def _(spark, d):
    rows = evidence_rows(spark, d)
    score = lambda df: E.noisy_or(df, "h", "rule", "direction", "weight")
    return E.score_changes(score(rows), score(rows.where("weight < 0.5")), "h")


@query(
    "a11_report_score",
    """SELECT l_orderkey AS k, round(greatest(coalesce(sum(l_discount * l_quantity) FILTER (l_returnflag <> 'R'), 0) - coalesce(sum(l_discount * l_quantity) FILTER (l_returnflag = 'R'), 0), 0), 6) AS score,
       CASE WHEN bool_or(l_returnflag = 'R') THEN 'conflicting' WHEN count(*) > 1 THEN 'combined' ELSE 'single' END AS method FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    side = F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), side.alias("direction"), "l_discount", "l_quantity")
    return rounded(E.report_score(rows, "k", "direction", "l_discount", "l_quantity"), "score")


@query(
    "a14_segment_totals",
    "SELECT l_suppkey, round(sum(l_quantity), 4) AS total, max(l_quantity) AS longest, count(*) AS n, count(*) FILTER (l_quantity < 15) AS small FROM lineitem WHERE l_quantity >= 7 GROUP BY 1",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity >= 7")
    return rows.groupBy("l_suppkey").agg(
        F.round(F.sum("l_quantity"), 4).alias("total"), F.max("l_quantity").alias("longest"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") < 15).alias("small")
    )


@query(
    "a19_export_loss",
    """SELECT c_mktsegment, least(1, greatest(0, sum(CASE WHEN c_acctbal < 0 THEN 0.05 WHEN c_acctbal > 9000 THEN 0.02 ELSE 0 END) / greatest(1, count(*))))::DOUBLE AS loss FROM
       (SELECT c_mktsegment, c_acctbal FROM customer) GROUP BY 1""",
)
def _(spark, d):
    weight = F.when(F.col("c_acctbal") < 0, 0.05).when(F.col("c_acctbal") > 9000, 0.02).otherwise(0.0)
    loss = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(weight) / F.greatest(F.lit(1), F.count(F.lit(1)))))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(loss, 9).alias("loss"))


@query(
    "a29_weighted_mean",
    """SELECT o_orderkey, round(round(CASE WHEN w > 0 THEN v / w ELSE 0 END, 9), 4) AS score FROM (SELECT o_orderkey,
       0.3 * (o_orderstatus <> 'P')::INT + 0.3 + 0.2 * (o_totalprice > 100000)::INT AS w,
       CASE WHEN o_orderstatus <> 'P' THEN 0.3 * (o_orderstatus = 'F')::INT ELSE 0 END + 0.3 * (o_orderkey % 10) / 10.0 + CASE WHEN o_totalprice > 100000 THEN 0.2 * o_totalprice / 500000 ELSE 0 END AS v FROM orders)""",
)
def _(spark, d):
    parts = [
        (F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("double")), 0.3),
        ((F.col("o_orderkey") % 10) / 10.0, 0.3),
        (F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice") / 500000), 0.2),
    ]
    return table(spark, d, "orders").select("o_orderkey", F.round(F.round(E.weighted_mean(parts), 9), 4).alias("score"))


def person_pairs(spark, d):
    """Customers next to each other, with years, sexes, codes and shared cM made from their columns."""
    c = table(spark, d, "customer")
    sex = F.when(F.col("c_nationkey") % 3 == 0, "M").when(F.col("c_nationkey") % 3 == 1, "F").otherwise("U")
    person = c.select(F.col("c_custkey").alias("id"), (1800 + F.col("c_nationkey")).alias("year"), sex.alias("sex"), F.array("c_mktsegment").alias("codes"), F.col("c_acctbal").alias("cm"))
    a, b = person.withColumnsRenamed({c: f"{c}_a" for c in person.columns}), person.withColumnsRenamed({c: f"{c}_b" for c in person.columns})
    return a.join(b, F.col("id_b") == F.col("id_a") + 1)


_PAIRS = """SELECT a.c_custkey AS id_a, 1800 + a.c_nationkey AS ya, 1800 + b.c_nationkey AS yb, a.c_nationkey % 3 AS sa, b.c_nationkey % 3 AS sb,
  a.c_mktsegment = b.c_mktsegment AS same, a.c_acctbal AS cm FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1"""


@query(
    "r01_r06_composed_rules",
    f"""WITH p AS ({_PAIRS}), f AS (
      SELECT id_a, 'surname' AS rule, 'supports' AS direction, 0.5 AS weight FROM p WHERE same
      UNION ALL SELECT id_a, 'birth_year', CASE WHEN abs(ya - yb) <= 2 THEN 'supports' ELSE 'contradicts' END, CASE WHEN ya = yb THEN 0.4 WHEN abs(ya - yb) <= 2 THEN 0.25 ELSE 0.3 END FROM p WHERE abs(ya - yb) <= 2 OR abs(ya - yb) >= 10
      UNION ALL SELECT id_a, 'place', CASE WHEN cm / 10000 >= 0.8 THEN 'supports' ELSE 'contradicts' END, CASE WHEN cm / 10000 >= 0.8 THEN 0.4 * (cm / 10000) ELSE 0.3 END FROM p WHERE cm / 10000 >= 0.8 OR cm / 10000 < 0.3
      UNION ALL SELECT id_a, 'sex', 'contradicts', 0.95 FROM p WHERE sa < 2 AND sb < 2 AND sa <> sb
      UNION ALL SELECT id_a, 'dna', CASE WHEN cm >= 3400 THEN 'supports' ELSE 'contradicts' END, 0.85 / 1.6 FROM p WHERE cm >= 7 AND (cm >= 3400 OR cm < 1500))
    SELECT id_a, rule, direction, round(weight, 6)::DOUBLE AS weight FROM f""",
)
def _(spark, d):
    kind = F.lit("same_person")
    rules = [
        E.surname_rule(F.col("codes_a"), F.col("codes_b")),
        E.birth_year_rule(F.col("year_a"), F.col("year_b"), kind),
        E.place_rule(F.col("cm_a") / 10000),
        E.sex_rule(F.col("sex_a"), F.col("sex_b"), kind),
        E.dna_rule(F.col("cm_a"), kind, E.population_multiplier(F.lit("ashkenazi"), F.lit("general"))),
    ]
    return rounded(E.compose(person_pairs(spark, d), ["id_a"], rules), "weight")


@query(
    "r05_dna_bands",
    """SELECT k, kind, direction, weight FROM (SELECT k, kind, CASE WHEN s IS NOT NULL THEN 'supports' ELSE 'contradicts' END AS direction, round(coalesce(s, c) / 1.4, 6)::DOUBLE AS weight, cm FROM (
       SELECT o_orderkey AS k, kind, cm, CASE WHEN kind = 'parent_child' AND cm BETWEEN 2376 AND 3720 THEN 0.8 WHEN kind = 'siblings' AND cm BETWEEN 1613 AND 3488 THEN 0.65 END AS s,
       CASE WHEN kind = 'parent_child' AND (cm > 3800 OR cm < 1500) THEN 0.7 WHEN kind = 'siblings' AND cm < 1000 THEN 0.6 END AS c
       FROM (SELECT o_orderkey, o_totalprice / 100 AS cm, unnest(['parent_child', 'siblings', 'marriage']) AS kind FROM orders))) WHERE cm >= 7 AND weight IS NOT NULL""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 100).alias("cm"))
    o = o.withColumn("kind", F.explode(F.array(F.lit("parent_child"), F.lit("siblings"), F.lit("marriage"))))
    found = E.compose(o, ["k", "kind"], [E.dna_rule(F.col("cm"), F.col("kind"), E.population_multiplier(F.lit("sephardi"), F.lit(None).cast("string")))])
    return rounded(found.drop("rule"), "weight")


@query(
    "e14_derived_confidence",
    "SELECT l_orderkey, l_linenumber, round(coalesce(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END, 3) * l_discount, 6)::DOUBLE AS confidence FROM lineitem",
)
def _(spark, d):
    weights = spark.createDataFrame([("A", 1), ("R", 2)], "l_returnflag string, weight int")  # a fixed table of types
    rows = table(spark, d, "lineitem").join(F.broadcast(weights), "l_returnflag", "left")
    return rows.select("l_orderkey", "l_linenumber", F.round(F.coalesce("weight", F.lit(3)) * F.col("l_discount"), 6).alias("confidence"))


# ---- intervals ---------------------------------------------------------------------------------


@query(
    "w04_islands",
    """WITH s AS (SELECT *, CASE WHEN event_type <> 'error' THEN value < 150 END AS hit FROM events), t AS (SELECT * FROM s WHERE hit IS NOT NULL),
       u AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM t)
       SELECT user_id, min(event_id) AS "start", max(event_id) AS "end", count(*) AS n FROM u WHERE hit GROUP BY user_id, island HAVING count(*) >= 3""",
)
def _(spark, d):
    hit = F.when(F.col("event_type") != "error", F.col("value") < 150)
    return I.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], hit, "event_id").where("n >= 3")


@query(
    "j16_interpolate",
    """WITH p AS (SELECT s_nationkey AS g, s_acctbal AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) * 10.0 AS y FROM supplier),
       q AS (SELECT g, x AS lo, y AS y0, lead(x) OVER w AS hi, lead(y) OVER w AS y1, min(x) OVER (PARTITION BY g) AS a, max(x) OVER (PARTITION BY g) AS b,
             arg_min(y, x) OVER (PARTITION BY g) AS ya, arg_max(y, x) OVER (PARTITION BY g) AS yb FROM p WINDOW w AS (PARTITION BY g ORDER BY x)),
       e AS (SELECT DISTINCT g, a, b, ya, yb FROM q)
       SELECT c_custkey, round(CASE WHEN c_acctbal <= a THEN ya WHEN c_acctbal >= b THEN yb ELSE (SELECT y0 + (y1 - y0) * (c_acctbal - lo) / (hi - lo) FROM q WHERE q.g = c_nationkey AND lo <= c_acctbal AND c_acctbal < hi) END, 6)::DOUBLE AS y
       FROM customer LEFT JOIN e ON e.g = c_nationkey""",
)
def _(spark, d):
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal"))
    points = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("x"), (order * 10.0).alias("y"))
    values = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), "c_acctbal")
    return rounded(I.interpolate(values, points, "g", "c_acctbal", "x", "y", "out", 500.0).select("c_custkey", F.col("out").alias("y")), "y")


_SPANS = "SELECT event_id, user_id, epoch(ts) AS s, epoch(ts) + value * 60 AS e FROM events"


@query(
    "j15_interval_overlap_join",
    f"""SELECT a.event_id AS a, b.event_id AS b, round(least(a.e, b.e) - greatest(a.s, b.s), 3) AS overlap FROM ({_SPANS}) a JOIN ({_SPANS}) b ON a.user_id = b.user_id AND a.event_id < b.event_id
        WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 3000""",
)
def _(spark, d):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, d, "events").select("user_id", "event_id", start.alias("start"), (start + F.col("value") * 60).alias("end"))
    both = I.overlaps(e.withColumnRenamed("event_id", "a"), e.withColumnRenamed("event_id", "b"), ["user_id"], 3000.0, 20_000.0).where("a < b")
    return both.select("a", "b", F.round(F.col("hi") - F.col("lo"), 3).alias("overlap"))


def _bands() -> str:
    return ", ".join(f"('{l}', {a}, {b}, {m})" for l, a, b, m in I.SHARED_CM)


@query(
    "j25_range_label_density",
    f"""WITH v AS (SELECT o_orderkey AS k, o_totalprice / 120 - 10 AS cm FROM orders), r(label, lo, hi, mean) AS (VALUES {_bands()}),
        f AS (SELECT k, label, exp(-0.5 * ((cm - mean) / greatest((hi - lo) / 4.0, 1)) ** 2) / greatest((hi - lo) / 4.0, 1) AS s FROM v JOIN r ON cm >= 7 AND cm BETWEEN lo AND hi)
        SELECT k, label, round(s / sum(s) OVER (PARTITION BY k), 6) AS probability FROM f
        UNION ALL SELECT k, CASE WHEN cm > 4000 THEN 'Identical twin / Same person' ELSE 'Unrelated / noise' END, 1.0 FROM v WHERE cm < 7 OR cm > 4000""",
)
def _(spark, d):
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 120 - 10).alias("cm"))
    return rounded(I.label_ranges(v, "k", "cm"), "probability")


@query("w12_share_of_group", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def _(spark, d):
    from pyspark.sql import Window

    total = F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") / total, 6).alias("share"))


#: Twelve kits; a segment stands where its order does, so what overlaps it does not grow with the table.
_SEGMENTS = """SELECT DISTINCT least(l_suppkey % 12, l_partkey % 12) AS a, greatest(l_suppkey % 12, l_partkey % 12) AS b, l_linenumber AS chrom, l_orderkey AS s, l_orderkey + 12 AS e
  FROM lineitem WHERE l_suppkey % 12 <> l_partkey % 12"""


def segments(spark, d):
    l = table(spark, d, "lineitem").where("l_suppkey % 12 <> l_partkey % 12")
    return l.selectExpr("least(l_suppkey % 12, l_partkey % 12) AS a", "greatest(l_suppkey % 12, l_partkey % 12) AS b", "l_linenumber AS chrom", "CAST(l_orderkey AS DOUBLE) AS start", "CAST(l_orderkey + 12 AS DOUBLE) AS end").distinct()


_TRIPLETS = f"""WITH t AS ({_SEGMENTS}), pq AS MATERIALIZED (SELECT p.chrom, p.a AS x, p.b AS y, q.b AS z, greatest(p.s, q.s) AS s, least(p.e, q.e) AS e FROM t p JOIN t q ON p.a = q.a AND p.chrom = q.chrom AND p.b < q.b
        WHERE least(p.e, q.e) - greatest(p.s, q.s) >= 7)
        SELECT DISTINCT pq.chrom, x, y, z, greatest(pq.s, r.s) AS "start", least(pq.e, r.e) AS "end" FROM pq JOIN t r ON r.a = y AND r.b = z AND r.chrom = pq.chrom WHERE least(pq.e, r.e) - greatest(pq.s, r.s) >= 7"""


@query("g07_triplets", _TRIPLETS)
def _(spark, d):
    return I.triplets(segments(spark, d), 7.0, 10.0)


@query("g06_triangulation_groups")  # all pairs of triplets are too many for SQL; compared with brute force in the tests
def _(spark, d):
    """Triplets of a chromosome that share a member and overlap are one group: its members and common interval."""
    return triangulation_groups(I.triplets(segments(spark, d), 7.0, 10.0), 7.0)


def triangulation_groups(trip, least):
    """(chrom, members, start, end): components of overlapping triplets with a common member; short ones drop.

    Among a member's triplets in order of start, one that overlaps any before it overlaps the one that ends
    last, so one link each connects the same triplets as all pairs would. Triplets are ``least`` long or longer.
    """
    from pyspark.sql import Window

    from ..storage import Shelf

    shelf = Shelf(trip.sparkSession)
    t = shelf.put(trip.withColumn("id", F.xxhash64("chrom", "x", "y", "z", "start", "end")))
    by = t.select("id", "chrom", F.explode(F.array("x", "y", "z")).alias("m"), "start", "end")
    before = Window.partitionBy("chrom", "m").orderBy("start", "end", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = by.select("id", "start", F.max(F.struct("end", "id")).over(before).alias("x"))
    pairs = last.where(F.col("x.end") - F.col("start") >= least).select(F.col("x.id").alias("a"), F.col("id").alias("b"))
    comp = G.components(t.select("id"), pairs.select("a", "b"))
    out = t.join(comp, "id").groupBy("chrom", "component").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("x", "y", "z"))))), ",").alias("members"), F.max("start").alias("start"), F.min("end").alias("end")
    )
    return out.where(F.col("end") - F.col("start") >= least).select("chrom", "members", "start", "end")


@query("g08_boost", "SELECT o_orderkey, CASE WHEN n > 10 THEN 0.5 WHEN n = 2 THEN 1.2 WHEN o_orderstatus = 'F' THEN 1.5 ELSE 1.0 END::DOUBLE AS boost FROM (SELECT *, o_orderkey % 14 AS n FROM orders)")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.boost(F.col("o_orderkey") % 14, F.col("o_orderstatus") == "F").alias("boost"))


# ---- graphs ------------------------------------------------------------------------------------


@query(
    "g01_pedigree_depth",
    """WITH RECURSIVE e AS (SELECT c_custkey // 2 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 0),
       c(root, node, depth) AS (SELECT DISTINCT parent, parent, 1 FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT root, child, depth + 1 FROM c JOIN e ON parent = node WHERE depth < 50)
       SELECT root, max(depth)::INT AS depth FROM c GROUP BY root""",
)
def _(spark, d):
    return G.pedigree_depth(spark, edges(spark, d))


@query(
    "g02_ancestors",
    """WITH RECURSIVE a(start, generation, ancestor) AS (SELECT c_custkey, 1, c_custkey // 2 FROM customer WHERE c_custkey > 0 UNION ALL
       SELECT start, generation + 1, ancestor // 2 FROM a WHERE generation < 6 AND ancestor > 0) SELECT * FROM a""",
)
def _(spark, d):
    start = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return G.ancestors(edges(spark, d), start, 6)


def kinship(spark, d):
    e = edges(spark, d)
    families = e.groupBy(F.col("parent").alias("family")).agg(F.min("parent").alias("husband")).withColumn("wife", F.lit(None).cast("long"))
    return G.family_edges(families, e.selectExpr("parent AS family", "child"))


@query(
    "g05_family_edges",
    """WITH e AS (SELECT c_custkey // 2 AS p, c_custkey AS c FROM customer WHERE c_custkey > 0)
       SELECT c AS src, p AS dst, 'parent' AS kind FROM e UNION ALL SELECT p, c, 'child' FROM e UNION ALL SELECT a.c, b.c, 'sibling' FROM e a JOIN e b ON a.p = b.p AND a.c <> b.c""",
)
def _(spark, d):
    return kinship(spark, d)


@query(
    "g03_shortest_paths",
    """WITH RECURSIVE e AS (SELECT c_custkey // 2 AS p, c_custkey AS c FROM customer WHERE c_custkey > 0),
       x AS (SELECT c AS src, p AS dst FROM e UNION SELECT p, c FROM e UNION SELECT a.c, b.c FROM e a JOIN e b ON a.p = b.p AND a.c <> b.c),
       w(start, node, hops) AS (SELECT s, s, 0 FROM (VALUES (37::BIGINT), (150::BIGINT)) v(s) UNION SELECT start, dst, hops + 1 FROM w JOIN x ON src = node WHERE hops < 12)
       SELECT start, node, min(hops)::INT AS hops FROM w WHERE start < (SELECT max(c) + 1 FROM e) OR node = start GROUP BY ALL""",
)
def _(spark, d):
    start = spark.createDataFrame([(37,), (150,)], "id long")
    return G.shortest_paths(kinship(spark, d), start).select("start", "node", "hops")


@query(
    "g04_walk",
    "SELECT a.c_custkey AS anchor, b.c_custkey AS node FROM customer a JOIN customer b ON a.c_custkey // 4 = b.c_custkey // 4 AND a.c_custkey <> b.c_custkey WHERE a.c_custkey >= 2 AND b.c_custkey >= 2",
)
def _(spark, d):
    # grandparent's grandchildren: two steps up, two steps down
    start = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("U").alias("sex"))
    return G.walk(start, kinship(spark, d), people, [("parent", "M"), ("parent", None), ("child", None), ("child", "F")])


@query("g06_components", "SELECT c_custkey AS id, c_custkey % 10 AS component FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    step = c.join(c.select((F.col("id") - 10).alias("id")), "id").select(F.col("id").alias("a"), (F.col("id") + 10).alias("b"))
    return G.components(c, step)


_MATCH = "SELECT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b, l_quantity AS w, l_returnflag FROM lineitem WHERE l_suppkey <> l_partkey % 100"
_GRAPH = f"""WITH t AS ({_MATCH}), k AS (SELECT a, b, max(w) AS weight FROM t WHERE l_returnflag <> 'N' GROUP BY ALL)
  SELECT * FROM k WHERE weight >= 20 UNION ALL SELECT a, b, 1.0 FROM (SELECT DISTINCT a, b FROM t WHERE l_returnflag = 'N') x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = x.a AND k.b = x.b)"""


def match_graph(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_suppkey AS a", "l_partkey % 100 AS b", "l_quantity AS cm", "l_returnflag")
    return G.consolidate(t.where("l_returnflag <> 'N'").drop("l_returnflag"), t.where("l_returnflag = 'N'").select("a", "b"), 20.0)


@query("a17_consolidated_graph", _GRAPH)
def _(spark, d):
    return match_graph(spark, d)


@query(
    "a15_a16_endogamy",
    f"""WITH g AS ({_GRAPH}), s AS (SELECT a % 7 AS cluster, count(*) AS pairs, avg(weight) AS density, avg(weight) FILTER (weight > 1) AS m FROM g WHERE a % 7 = b % 7 GROUP BY 1)
        SELECT cluster, pairs, round(density, 6) AS density, round(coalesce(m, 0), 6) AS mean_cm, CASE WHEN pairs >= 3 THEN CASE WHEN m >= 30 THEN 'AJ' WHEN m >= 25 THEN 'mennonite' WHEN m >= 20 THEN 'iberian_sephardic' END END AS label FROM s""",
)
def _(spark, d):
    g = match_graph(spark, d)
    membership = g.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("cluster", F.col("id") % 7)
    stats = G.inside_weights(g, membership).where("pairs > 0")
    return rounded(stats.withColumn("label", G.endogamy_label(F.col("mean_cm"), F.col("pairs"))), "density", "mean_cm")


@query("g10_communities")
def _(spark, d):
    g = match_graph(spark, d).withColumn("owner", F.lit(1))
    return G.communities(g.select("owner", "a", "b", "weight"), "owner")


@query("g09_refined_communities")
def _(spark, d):
    g = match_graph(spark, d).withColumn("owner", F.lit(1))
    return G.communities(g.select("owner", "a", "b", "weight"), "owner", refined=True)


@query("g11_cycle_groups", "SELECT c_custkey AS id, c_custkey // 5 * 5 AS component FROM customer WHERE c_custkey // 5 * 5 + 4 <= (SELECT max(c_custkey) FROM customer)")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    ring = c.select("src", F.expr("CASE WHEN src % 5 = 4 THEN src - 4 ELSE src + 1 END").alias("dst"))
    bridge = c.select("src", (F.col("src") + 5).alias("dst")).where("src % 5 = 0 AND src % 50 < 45")
    return G.cycle_groups(ring.join(c.withColumnRenamed("src", "dst"), "dst", "left_semi").unionByName(bridge).select("src", "dst"))


@query(
    "g12_mutual_clusters",
    """WITH m AS (SELECT l_orderkey AS kit, l_suppkey AS id, max(l_quantity) AS cm, list(l_partkey % 100) AS w FROM lineitem GROUP BY ALL), s AS (SELECT * FROM m WHERE cm >= 15),
       n AS (SELECT kit, id, unnest(w) AS other FROM s) SELECT DISTINCT n.kit, least(n.id, other) AS a, greatest(n.id, other) AS b FROM n JOIN s ON s.kit = n.kit AND s.id = other WHERE n.id <> other""",
)
def _(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("kit"), F.col("l_suppkey").alias("id"))
    return G.mutual_clusters(l.agg(F.max("l_quantity").alias("cm"), F.collect_list(F.col("l_partkey") % 100).alias("shared_with")), 15.0)


@query(
    "a21_twins",
    "SELECT a.l_orderkey AS family, a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_suppkey < b.l_suppkey WHERE a.l_linenumber > 1",
)
def _(spark, d):
    c = table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("family"), "l_linenumber", "l_suppkey")
    pairs = c.withColumnRenamed("l_suppkey", "a").join(c.withColumnRenamed("l_suppkey", "b"), ["family", "l_linenumber"])
    return pairs.where("a < b").select("family", "a", "b")


@query("u02_first_owner", "SELECT c_nationkey, min(c_custkey) AS owner FROM customer GROUP BY 1")
def _(spark, d):
    return R.pick(table(spark, d, "customer"), ["c_nationkey"], F.col("c_custkey"), F.col("c_custkey")).withColumnRenamed("value", "owner")
