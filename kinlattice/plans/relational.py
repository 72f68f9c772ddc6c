"""Predicates, joins, aggregates, windows, pages and set operations on the star schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import predicates as P
from ..operators import relational as R
from .registry import query, table

NOW = datetime(2024, 1, 31)


# ---- predicates and projections ----------------------------------------------------------------


@query(
    "p01_active_filter",
    "SELECT event_id, user_id FROM (SELECT *, CASE WHEN value > 300 THEN ts END AS deleted_at FROM events) WHERE event_type = 'click' AND deleted_at IS NULL",
)
def _(spark, d):
    rows = table(spark, d, "events").withColumn("deleted_at", F.when(F.col("value") > 300, F.col("ts")))
    return P.active(rows, "event_type", "click", "deleted_at").select("event_id", "user_id")


@query(
    "p02_substring_search",
    r"SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%d w%' OR lower(p_type) LIKE '%d w%' OR lower(p_name || ' ' || p_type) LIKE '%d w%'",
)
def _(spark, d):
    return table(spark, d, "part").where(P.name_search(F.col("p_name"), F.col("p_type"), "D W")).select("p_partkey", "p_name")


@query("p03_prefix_search", "SELECT s_suppkey, s_name FROM supplier WHERE starts_with(lower(s_name), 'supplier#00000001')")
def _(spark, d):
    return table(spark, d, "supplier").where(P.starts_ci(F.col("s_name"), "SUPPLIER#00000001")).select("s_suppkey", "s_name")


@query("p04_unescaped_substring", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%r#%1_7%'")
def _(spark, d):
    return table(spark, d, "customer").where(P.like_ci(F.col("c_name"), "r#%1_7")).select("c_custkey", "c_name")


@query("p05_code_overlap", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['ring', 'bolt']) OR list_has_any([p_brand], ['ring', 'bolt'])")
def _(spark, d):
    return table(spark, d, "part").where(P.shares_code(["ring", "bolt"], F.split("p_name", " "), F.array("p_brand"))).select("p_partkey")


@query("p06_year_range", "SELECT o_orderkey FROM orders WHERE o_orderdate IS NOT NULL AND year(o_orderdate) >= 1996 AND year(o_orderdate) <= 1997")
def _(spark, d):
    return table(spark, d, "orders").where(P.year_between(F.col("o_orderdate"), 1996, 1997)).select("o_orderkey")


@query("p07_threshold_filter", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 950 AND contains(lower(p_type), 'eco')")
def _(spark, d):
    keep = (F.col("p_retailprice") >= 950) & P.contains_ci(F.col("p_type"), "Eco")
    return table(spark, d, "part").where(keep).select("p_partkey", "p_retailprice")


@query("p08_either_side", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey = 7 OR l_suppkey = 7) AND l_returnflag = 'A'")
def _(spark, d):
    keep = P.either_side(F.col("l_partkey"), F.col("l_suppkey"), 7) & P.all_of(l_returnflag="A", l_linestatus=None)
    return table(spark, d, "lineitem").where(keep).select("l_orderkey", "l_linenumber")


@query("p09_in_list", "SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase') AND user_id <> 3")
def _(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase") & (F.col("user_id") != 3)).select("event_id")


_ATTEMPTS = "SELECT event_id, CASE WHEN value > 250 THEN ts END AS merged_at, CASE WHEN value < 20 THEN ts END AS rejected_at FROM events"


def attempts(spark, d):
    when = lambda c: F.when(c, F.col("ts"))
    return table(spark, d, "events").select("event_id", when(F.col("value") > 250).alias("merged_at"), when(F.col("value") < 20).alias("rejected_at"))


@query(
    "p10_tri_state",
    f"SELECT event_id, CASE WHEN merged_at IS NOT NULL THEN 'merged' WHEN rejected_at IS NOT NULL THEN 'rejected' ELSE 'pending' END AS status FROM ({_ATTEMPTS})",
)
def _(spark, d):
    return attempts(spark, d).select("event_id", P.tri_state(F.col("merged_at"), F.col("rejected_at")).alias("status"))


@query(
    "p11_primary_name",
    "SELECT conv_id, arg_min(trim(role || ' ' || left(text, 10)), turn) AS label FROM conversations WHERE trim(role) <> '' OR trim(text) <> '' GROUP BY conv_id",
)
def _(spark, d):
    c = table(spark, d, "conversations")
    filled = (F.trim("role") != "") | (F.trim("text") != "")
    label = F.trim(F.concat_ws(" ", "role", F.substr("text", F.lit(1), F.lit(10))))
    return R.pick(c, ["conv_id"], label, F.col("turn"), filled).withColumnRenamed("value", "label")


@query(
    "p12_display_label",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c_name WHEN o_orderkey % 3 = 1 THEN o_orderstatus || ' ' || year(o_orderdate)
       ELSE left(o_orderpriority, 5) || ' × ' || n_name END AS label
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def _(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    kind = F.col("o_orderkey") % 3
    label = F.when(kind == 0, F.col("c_name")).when(kind == 1, F.concat_ws(" ", "o_orderstatus", F.year("o_orderdate")))
    return rows.select("o_orderkey", label.otherwise(F.concat(F.left("o_orderpriority", F.lit(5)), F.lit(" × "), "n_name")).alias("label"))


@query("p13_json_field_filter", "SELECT event_id FROM events WHERE coalesce(json_extract_string(props, '$.k'), '') <> '69'")
def _(spark, d):
    return table(spark, d, "events").where(P.json_differs(F.col("props"), "$.k", "69")).select("event_id")


@query(
    "p14_json_rows",
    """SELECT event_id, CAST(k AS INTEGER) AS k, CAST(k AS INTEGER) + 5 AS e FROM
       (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k IS NOT NULL AND k >= 10""",
)
def _(spark, d):
    e = table(spark, d, "events")
    segments = F.array(F.struct(F.from_json("props", "k int").k.alias("k")))
    return e.select("event_id", F.explode(segments).alias("s")).where("s.k >= 10").selectExpr("event_id", "s.k AS k", "s.k + 5 AS e")


@query(
    "p15_enum_mapping",
    "SELECT event_id, CASE event_type WHEN 'signup' THEN 'BIRTH' WHEN 'purchase' THEN 'MARRIAGE' ELSE 'CUSTOM' END AS kind, CASE WHEN event_type NOT IN ('signup', 'purchase') THEN event_type END AS custom FROM events",
)
def _(spark, d):
    kind = P.mapped(F.col("event_type"), {"signup": "BIRTH", "purchase": "MARRIAGE"}, "CUSTOM")
    e = table(spark, d, "events").withColumn("kind", kind)
    return e.select("event_id", "kind", F.when(F.col("kind") == "CUSTOM", F.col("event_type")).alias("custom"))


@query(
    "p16_quality_confidence",
    "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 0 THEN 0.1 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 WHEN 3 THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence FROM lineitem",
)
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.quality_confidence(F.col("l_linenumber")).alias("confidence"))


@query("p17_redaction", "SELECT c_custkey, CASE WHEN NOT c_acctbal < 0 THEN c_name END AS c_name, c_nationkey FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return P.redact(c, F.col("c_acctbal") < 0, ["c_name"], ["c_acctbal"])


@query("p18_role_rank", "SELECT c_custkey FROM customer WHERE CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 2 WHEN 'BUILDING' THEN 1 ELSE 0 END >= 2")
def _(spark, d):
    role = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "owner").when(F.col("c_mktsegment") == "MACHINERY", "editor").when(F.col("c_mktsegment") == "BUILDING", "viewer")
    return table(spark, d, "customer").where(P.role_satisfies(role, "editor")).select("c_custkey")


@query(
    "p19_plan_in_force",
    """SELECT user_id, event_type AS status, (event_type = 'active' OR event_type = 'trialing' OR (event_type = 'past_due' AND DATE '2024-01-31' <= CAST(ts AS DATE) + 7)) AS paid
       FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'past_due' ELSE 'canceled' END AS event_type, ts,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("status", P.mapped(F.col("event_type"), {"click": "active", "view": "past_due"}, "canceled"))
    last = e.groupBy("user_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("x"))
    paid = P.plan_in_force(F.col("x.status"), F.col("x.ts").cast("date"), F.lit(NOW).cast("date"), 7)
    return last.select("user_id", "x.status", paid.alias("paid"))


@query(
    "p20_sealed_gate",
    """SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_returnflag <> 'A'
       OR NOT EXISTS (SELECT 1 FROM supplier s WHERE s_acctbal < 2000 AND (s.s_suppkey = l.l_suppkey OR s.s_suppkey = l.l_partkey))""",
)
def _(spark, d):
    # hypotheses of a sealed kind fall if either subject is sealed: one anti-join per side
    l, sealed = table(spark, d, "lineitem"), table(spark, d, "supplier").where("s_acctbal < 2000")
    gated, free = l.where("l_returnflag = 'A'"), l.where("l_returnflag <> 'A'")
    for side in ("l_suppkey", "l_partkey"):
        gated = gated.join(sealed.select(F.col("s_suppkey").alias(side)), side, "left_anti")
    return free.select("l_orderkey", "l_linenumber").unionByName(gated.select("l_orderkey", "l_linenumber"))


@query(
    "p21_likely_alive",
    """SELECT o_custkey, max(died) IS NULL AND (min(born) IS NULL OR date_diff('day', min(born), DATE '2108-01-01') / 365.25 <= 110) AS alive
       FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) END AS born,
             CASE WHEN o_totalprice > 490000 THEN CAST(o_orderdate AS DATE) END AS died FROM orders) GROUP BY o_custkey""",
)
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    people = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min(F.when(F.col("o_orderstatus") == "P", day)).alias("born"), F.max(F.when(F.col("o_totalprice") > 490000, day)).alias("died")
    )
    return people.select("o_custkey", P.likely_alive(F.col("born"), F.col("died"), F.lit("2108-01-01").cast("date")).alias("alive"))


@query(
    "p22_reference_state",
    """SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_brand <> 'Brand#2' THEN 'foreign' WHEN p_size > 25 THEN 'deleted' ELSE 'ok' END AS state
       FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2""",
)
def _(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("ref"))
    parts = table(spark, d, "part").withColumn("deleted_at", F.when(F.col("p_size") > 25, F.col("p_size")))
    return P.reference_state(l, "ref", parts, "p_partkey", "p_brand", "Brand#2", "deleted_at").drop("ref")


@query("p23_strip_answer_keys", "SELECT conv_id, count(*) AS n, min(turn) AS first_turn FROM conversations GROUP BY conv_id")
def _(spark, d):
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.col("text").alias("expected"))).alias("rows"))
    bare = nested.withColumn("rows", P.strip_fields(F.col("rows"), ["expected"]))
    assert bare.schema["rows"].dataType.elementType.names == ["turn", "role"]
    return bare.select("conv_id", F.size("rows").cast("long").alias("n"), F.array_min(F.transform("rows", lambda x: x["turn"])).alias("first_turn"))


# ---- joins -------------------------------------------------------------------------------------


@query(
    "j01_event_participant_place",
    "SELECT o_orderkey, l_linenumber, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 WHERE o_orderstatus = 'F'",
)
def _(spark, d):
    events = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event"))
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), "l_linenumber", F.col("l_suppkey").alias("place"))
    places = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("place"), "s_name")
    return R.event_rows(events, parts, places, "event", "place").select(F.col("event").alias("o_orderkey"), "l_linenumber", "s_name")


@query(
    "j02_exists_year_range",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) BETWEEN 1997 AND 1997 AND o_totalprice > 400000) AND contains(lower(c_name), '1')",
)
def _(spark, d):
    o = table(spark, d, "orders").where(P.year_between(F.col("o_orderdate"), 1997, 1997) & (F.col("o_totalprice") > 400000))
    c = table(spark, d, "customer").where(P.contains_ci(F.col("c_name"), "1"))
    return R.with_match(c, o.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


@query("j03_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    owned = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return R.with_match(table(spark, d, "orders"), owned, ["o_custkey"]).select("o_orderkey")


@query("j04_undocumented_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def _(spark, d):
    cited = table(spark, d, "lineitem").where("l_orderkey IS NOT NULL").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.without_match(table(spark, d, "orders"), cited, ["o_orderkey"]).select("o_orderkey")


_EDGES = "SELECT c_custkey // 2 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 0"


def edges(spark, d):
    """A synthetic pedigree over the customer keys: the parent of k is k // 2."""
    c = table(spark, d, "customer").where("c_custkey > 0")
    return c.select(F.floor(F.col("c_custkey") / 2).cast("long").alias("parent"), F.col("c_custkey").alias("child"))


@query("j05_pedigree_roots", f"SELECT DISTINCT parent FROM ({_EDGES}) e WHERE NOT EXISTS (SELECT 1 FROM ({_EDGES}) f WHERE f.child = e.parent)")
def _(spark, d):
    e = edges(spark, d)
    return R.without_match(e.select("parent").distinct(), e.select(F.col("child").alias("parent")), ["parent"])


@query(
    "j06_left_join_count_page",
    "SELECT s_suppkey, s_name, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY ALL ORDER BY n DESC, s_suppkey LIMIT 20 OFFSET 5",
)
def _(spark, d):
    live = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    rows = R.count_children(table(spark, d, "supplier").select("s_suppkey", "s_name"), live, "s_suppkey", "l_suppkey", "n")
    return R.page(rows, [F.desc("n"), F.asc("s_suppkey")], 20, 5)


@query(
    "j07_three_way",
    "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL",
)
def _(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "j08_groups_with_both",
    "SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (3, 5) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2",
)
def _(spark, d):
    return R.groups_with_all(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", [3, 5])


@query(
    "j09_polymorphic_join",
    """SELECT event_id, event_type, c_name AS label FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'click'
       UNION ALL SELECT event_id, event_type, s_name FROM events JOIN supplier ON s_suppkey = user_id WHERE event_type = 'view'""",
)
def _(spark, d):
    links = table(spark, d, "events").select("event_id", "event_type", "user_id")
    targets = {"click": (table(spark, d, "customer"), "c_custkey", F.col("c_name")), "view": (table(spark, d, "supplier"), "s_suppkey", F.col("s_name"))}
    return R.polymorphic(links, "event_type", "user_id", targets, "label").select("event_id", "event_type", "label")


@query(
    "j10_either_key_join",
    "SELECT DISTINCT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON (l_suppkey = s_suppkey OR l_partkey = s_suppkey) WHERE l_quantity > 45",
)
def _(spark, d):
    l = table(spark, d, "lineitem").where("l_quantity > 45")
    return R.either_key(l, ["l_suppkey", "l_partkey"], table(spark, d, "supplier"), "s_suppkey", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "s_name").distinct()


@query(
    "j11_symmetric_pairs",
    """SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem
       WHERE l_partkey <> l_suppkey GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(spark, d):
    pairs = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return R.canonical(pairs, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "j21_dangling_references",
    "SELECT event_id, user_id FROM events WHERE user_id * 13 NOT IN (SELECT c_custkey FROM customer)",
)
def _(spark, d):
    refs = table(spark, d, "events").withColumn("ref", F.col("user_id") * 13)
    return R.dangling(refs, "ref", table(spark, d, "customer"), "c_custkey").select("event_id", "user_id")


@query("j24_broadcast_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def _(spark, d):
    # nation and region are fixed reference lists of 25 and 5 rows
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return table(spark, d, "customer").join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query(
    "j28_relationship_claims",
    """WITH e AS (SELECT c_custkey // 2 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 0), claim AS (
         SELECT child AS person, 'parent' AS kind, parent AS other FROM e UNION ALL SELECT parent, 'child', child FROM e
         UNION ALL SELECT a.child, 'sibling', b.child FROM e a JOIN e b ON a.parent = b.parent AND a.child <> b.child)
       SELECT person, kind, other, count(o_orderkey) AS citations FROM claim LEFT JOIN orders ON o_custkey = other AND o_orderstatus = 'F' GROUP BY ALL""",
)
def _(spark, d):
    e = edges(spark, d)
    claim = e.selectExpr("child AS person", "'parent' AS kind", "parent AS other").unionByName(e.selectExpr("parent AS person", "'child' AS kind", "child AS other"))
    a, b = e.withColumnRenamed("child", "person"), e.withColumnRenamed("child", "other")
    claim = claim.unionByName(a.join(b, "parent").where("person <> other").selectExpr("person", "'sibling' AS kind", "other"))
    cites = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return R.count_children(claim, cites, "other", "o_custkey", "citations")


@query(
    "j29_claim_priority",
    """SELECT o.o_orderkey, CASE WHEN s.s_suppkey IS NOT NULL THEN 'supplier' WHEN p.p_partkey IS NOT NULL THEN 'part' WHEN c.c_custkey IS NOT NULL THEN 'customer' END AS claim
       FROM orders o LEFT JOIN supplier s ON s_suppkey = o_custkey AND s_acctbal > 0 LEFT JOIN part p ON p_partkey = o_custkey AND p_size > 20 LEFT JOIN customer c ON c_custkey = o_custkey""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    sides = [("supplier", "s_suppkey", "s_acctbal > 0"), ("part", "p_partkey", "p_size > 20"), ("customer", "c_custkey", "true")]
    claims = []
    for name, key, keep in sides:
        o = o.join(table(spark, d, name).where(keep).select(F.col(key).alias("k"), F.lit(name).alias(f"_{name}")), "k", "left")
        claims.append(F.col(f"_{name}"))
    return o.select("o_orderkey", F.coalesce(*claims).alias("claim"))


# ---- aggregates --------------------------------------------------------------------------------


@query(
    "a01_dashboard_counts",
    """SELECT (SELECT count(*) FROM customer) AS persons, (SELECT count(*) FROM orders) AS families, (SELECT count(*) FILTER (event_type = 'click') FROM events) AS clicks,
       (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM documents WHERE lang = 'en') AS documents, (SELECT year(min(o_orderdate)) FROM orders) AS first_year,
       (SELECT max(ts) FROM events) AS updated""",
)
def _(spark, d):
    one = lambda name, *agg: table(spark, d, name).agg(*agg)
    events = one("events", F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("updated"))
    orders = one("orders", F.count(F.lit(1)).alias("families"), F.year(F.min("o_orderdate")).cast("long").alias("first_year"))
    documents = one("documents", F.count_if(F.col("lang") == "en").alias("documents"))
    # each side is one row
    return one("customer", F.count(F.lit(1)).alias("persons")).crossJoin(orders).crossJoin(events).crossJoin(documents)


TOP_GROUPS = """SELECT n_name, count(DISTINCT c_custkey) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
       WHERE o_orderstatus <> 'X' GROUP BY n_name ORDER BY customers DESC, n_name LIMIT 10"""


@query("a02_top_groups_distinct", TOP_GROUPS)
def top_groups_distinct(spark, d):
    # customers with an order are one semi-join; counting them needs no distinct then
    buyers = table(spark, d, "orders").where("o_orderstatus <> 'X'").select(F.col("o_custkey").alias("c_custkey"))
    c = R.with_match(table(spark, d, "customer").select("c_custkey", "c_nationkey"), buyers, ["c_custkey"])
    per = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    named = per.join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return R.page(named.select("n_name", "customers"), [F.desc("customers"), F.asc("n_name")], 10)


@query("a03_min_year", "SELECT o_custkey, year(min(o_orderdate)) AS y FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).cast("long").alias("y"))


@query("a04_latest_and_count", "SELECT event_type, max(ts) AS updated, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("updated"), F.count(F.lit(1)).alias("n"))


@query(
    "a05_sessions_nulls_last",
    """SELECT c_custkey, count(event_id) AS n, max(ts) AS last_ts FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'view'
       GROUP BY 1 ORDER BY last_ts DESC NULLS LAST, c_custkey LIMIT 200""",
)
def _(spark, d):
    views = table(spark, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    rows = table(spark, d, "customer").select("c_custkey").join(views, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return R.page(rows, [F.desc_nulls_last("last_ts"), F.asc("c_custkey")], 200)


@query("a06_citation_count", "SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def _(spark, d):
    return R.count_children(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem"), "p_partkey", "l_partkey", "n")


@query(
    "a07_rolling_budget",
    """SELECT user_id, round(coalesce(sum(value + 1) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR), 0), 4) AS day, round(coalesce(sum(value + 1) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY), 0), 4) AS month,
       count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR) AS runs FROM events GROUP BY 1""",
)
def _(spark, d):
    since = lambda span: F.col("ts") >= F.lit(NOW) - F.expr(span)
    cost = F.col("value") + 1
    total = lambda c: F.round(F.coalesce(F.sum(F.when(c, cost)), F.lit(0.0)), 4)
    day, month = since("INTERVAL 24 HOURS"), since("INTERVAL 30 DAYS")
    return table(spark, d, "events").groupBy("user_id").agg(total(day).alias("day"), total(month).alias("month"), F.count_if(day).alias("runs"))


@query("a08_day_buckets", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-31' - 15 GROUP BY 1")
def _(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").where(day > F.date_sub(F.lit(NOW).cast("date"), 15)).groupBy(day.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a12_collision_groups",
    """WITH k AS (SELECT doc_id, lower(trim(text)) AS key, lang FROM documents),
       g AS (SELECT key, lang, count(*) AS n, min(doc_id) AS a, max(doc_id) AS b FROM k GROUP BY ALL HAVING count(*) >= 2)
       SELECT key, lang, n, n - 1 AS excess, a, b FROM g ORDER BY n DESC, key, lang LIMIT 50""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.trim("text")).alias("key"), "lang")
    g = docs.groupBy("key", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("n >= 2")
    return R.page(g.select("key", "lang", "n", (F.col("n") - 1).alias("excess"), "a", "b"), [F.desc("n"), F.asc("key"), F.asc("lang")], 50)


@query("a13_tag_histogram", "SELECT w AS tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 ORDER BY n DESC, tag LIMIT 30")
def _(spark, d):
    tags = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return R.page(tags, [F.desc("n"), F.asc("tag")], 30)


@query(
    "a18_best_per_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1",
)
def _(spark, d):
    best = F.min_by(F.struct("l_orderkey", "l_linenumber"), F.struct(-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(best.alias("x")).select("l_suppkey", "x.*")


@query("a20_facet_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a21_equal_order_pairs",
    """SELECT a.l_orderkey, a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber)
       WHERE a.l_suppkey < b.l_suppkey AND a.l_linenumber > 0""",
)
def _(spark, d):
    one = table(spark, d, "lineitem").where("l_linenumber > 0").select("l_orderkey", "l_linenumber", "l_suppkey")
    pairs = one.withColumnRenamed("l_suppkey", "a").join(one.withColumnRenamed("l_suppkey", "b"), ["l_orderkey", "l_linenumber"])
    return pairs.where("a < b").select("l_orderkey", "a", "b")


@query("a22_code_union", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS codes FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("codes"))


@query("a23_multiplicity", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("a24_contradictions", "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')")
def _(spark, d):
    is_ = lambda f: F.bool_or(F.col("l_returnflag") == f)
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(is_("A").alias("yes"), is_("R").alias("no")).where("yes AND no").select("l_partkey")


@query(
    "a25_eval_score",
    """SELECT o_custkey, round(round(0.7 * avg((o_orderstatus = 'F')::INT) + 0.2 * avg((o_totalprice > 250000)::INT) + 0.1 * min((o_totalprice > 0)::INT), 9), 4) AS score FROM orders GROUP BY 1""",
)
def _(spark, d):
    share = lambda c: F.avg(c.cast("int"))
    score = 0.7 * share(F.col("o_orderstatus") == "F") + 0.2 * share(F.col("o_totalprice") > 250000) + 0.1 * F.min((F.col("o_totalprice") > 0).cast("int"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.round(score, 9), 4).alias("score"))


@query("a26_outcome_tally", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderdate >= TIMESTAMP '2001-01-01'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a30_support_ratio",
    """SELECT l_suppkey, CASE WHEN count(*) FILTER (l_returnflag IN ('A', 'R')) > 0 THEN round(count(*) FILTER (l_returnflag = 'A') / count(*) FILTER (l_returnflag IN ('A', 'R')), 6) ELSE 0 END::DOUBLE AS confidence
       FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    yes, no = F.count_if(F.col("l_returnflag") == "A"), F.count_if(F.col("l_returnflag") == "R")
    ratio = F.when(yes + no > 0, F.round(yes / (yes + no), 6)).otherwise(0.0)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(ratio.alias("confidence"))


@query(
    "a31_provenance_merge",
    """SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS files, arg_max(event_id, ts) AS last_job, count(*) AS edits FROM events GROUP BY 1""",
)
def _(spark, d):
    files = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return table(spark, d, "events").groupBy("user_id").agg(files.alias("files"), F.max_by("event_id", "ts").alias("last_job"), F.count(F.lit(1)).alias("edits"))


@query("a32_capped_weight", "SELECT l_orderkey, l_linenumber, least(1.0, round(l_quantity / 40, 6))::DOUBLE AS weight FROM lineitem WHERE l_partkey IN (1, 2, 3) OR l_suppkey IN (1, 2, 3)")
def _(spark, d):
    l = table(spark, d, "lineitem").where("l_partkey IN (1, 2, 3) OR l_suppkey IN (1, 2, 3)")
    return l.select("l_orderkey", "l_linenumber", F.least(F.lit(1.0), F.round(F.col("l_quantity") / 40, 6)).alias("weight"))


# ---- window-style operators --------------------------------------------------------------------

_FIRST = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {table}) WHERE rn = 1"


@query("w01_first_row_per_key", _FIRST.format(cols="user_id, event_id", key="user_id", order="ts, event_id", table="events"))
def _(spark, d):
    return R.first_per(table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id")


@query("w02_distinct_on", _FIRST.format(cols="conv_id, turn, role", key="conv_id", order="turn", table="conversations"))
def _(spark, d):
    return R.first_per(table(spark, d, "conversations"), ["conv_id"], [F.asc("turn")]).select("conv_id", "turn", "role")


@query("w03_earliest_dated", "SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def _(spark, d):
    return R.pick(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderpriority"), F.struct("o_orderdate", "o_orderkey"), F.col("o_orderdate").isNotNull())


@query("w05_first_family_per_child", _FIRST.format(cols="l_partkey, l_orderkey", key="l_partkey", order="l_shipdate, l_orderkey, l_linenumber", table="lineitem"))
def _(spark, d):
    return R.first_per(table(spark, d, "lineitem"), ["l_partkey"], [F.asc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_partkey", "l_orderkey")


@query(
    "w06_rank_top_k",
    "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3",
)
def _(spark, d):
    return R.ranked(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("w07_latest_per_key", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("w08_next_in_line", _FIRST.format(cols="c_nationkey, c_custkey", key="c_nationkey", order="c_acctbal, c_custkey", table="(SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')"))
def _(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return R.pick(c, ["c_nationkey"], F.col("c_custkey"), F.struct("c_acctbal", "c_custkey")).withColumnRenamed("value", "c_custkey")


@query("w09_last_non_null", "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (value > 100) AS value FROM events GROUP BY 1")
def _(spark, d):
    seen = F.when(F.col("value") > 100, F.col("value"))
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by(seen, F.when(seen.isNotNull(), F.struct("ts", "event_id"))).alias("value"))


@query(
    "w10_earliest_nulls_last",
    _FIRST.format(cols="o_custkey, o_orderkey", key="o_custkey", order="dated NULLS LAST, o_orderkey", table="(SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS dated FROM orders)"),
)
def _(spark, d):
    o = table(spark, d, "orders").withColumn("dated", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return R.first_per(o, ["o_custkey"], [F.asc_nulls_last("dated"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w11_first_non_null", "SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (value > 200) AS kind FROM events GROUP BY 1")
def _(spark, d):
    big = F.col("value") > 200
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.when(big, F.struct("ts", "event_id"))).alias("kind"))


@query(
    "w13_monotone_check",
    "SELECT user_id, count(*) FILTER (value <= prev) AS breaks FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1",
)
def _(spark, d):
    from pyspark.sql import Window

    prev = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("prev", prev).groupBy("user_id").agg(F.count_if(F.col("value") <= F.col("prev")).alias("breaks"))


# ---- sorts, limits, pages ----------------------------------------------------------------------


@query("l01_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(spark, d):
    return R.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50)


@query("l02_score_then_id", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 40")
def _(spark, d):
    return R.page(table(spark, d, "lineitem"), [F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 40).select("l_orderkey", "l_linenumber", "l_quantity")


@query("l03_nulls_last_page", "SELECT event_id, CASE WHEN value > 50 THEN value END AS v FROM events ORDER BY v DESC NULLS LAST, ts DESC, event_id LIMIT 7000")
def _(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("value") > 50, F.col("value")))
    return R.page(e, [F.desc_nulls_last("v"), F.desc("ts"), F.asc("event_id")], 7000).select("event_id", "v")


@query("l04_dates_nulls_last", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END NULLS LAST, o_orderkey LIMIT 500")
def _(spark, d):
    dated = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return R.page(table(spark, d, "orders"), [dated.asc_nulls_last(), F.asc("o_orderkey")], 500).select("o_orderkey")


@query("l05_top_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def _(spark, d):
    return R.page(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 5)


@query(
    "l06_keyset_page",
    "SELECT event_id, ts FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-15 12:00:00', 5000) ORDER BY ts DESC, event_id DESC LIMIT 21",
)
def _(spark, d):
    return R.keyset_page(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", (datetime(2024, 1, 15, 12), 5000), 20)


@query(
    "l07_merged_categories_page",
    """SELECT * FROM (SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS score FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier
       UNION ALL SELECT 'p', p_partkey, p_retailprice FROM part) ORDER BY score DESC, kind, id LIMIT 50 OFFSET 10""",
)
def _(spark, d):
    parts = [("c", "customer", "c_custkey", "c_acctbal"), ("s", "supplier", "s_suppkey", "s_acctbal"), ("p", "part", "p_partkey", "p_retailprice")]
    frames = [table(spark, d, t).select(F.lit(k).alias("kind"), F.col(i).alias("id"), F.col(s).alias("score")) for k, t, i, s in parts]
    return R.page(frames[0].unionByName(frames[1]).unionByName(frames[2]), [F.desc("score"), F.asc("kind"), F.asc("id")], 50, 10)


@query("l08_total_order", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query(
    "l09_truncate_then_score",
    "SELECT c_custkey, round(c_acctbal / 100, 4) AS score FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50) ORDER BY score DESC, c_custkey LIMIT 5",
)
def _(spark, d):
    first = R.page(table(spark, d, "customer"), [F.asc("c_custkey")], 50)
    return R.page(first.select("c_custkey", F.round(F.col("c_acctbal") / 100, 4).alias("score")), [F.desc("score"), F.asc("c_custkey")], 5)


# ---- set operations ----------------------------------------------------------------------------


@query("u01_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("u02_union_distinct", "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
def _(spark, d):
    return R.union_distinct(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id")))


@query("u03_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def _(spark, d):
    shared = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").subtract(shared)


@query("u04_intersect", "SELECT user_id AS id FROM events INTERSECT SELECT s_suppkey FROM supplier")
def _(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id")).intersect(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query(
    "u05_added_removed",
    "SELECT coalesce(c_custkey, k) AS id, CASE WHEN k IS NULL THEN 'removed' ELSE 'added' END AS change FROM customer FULL JOIN (SELECT c_custkey + 10 AS k FROM customer) ON k = c_custkey WHERE k IS NULL OR c_custkey IS NULL",
)
def _(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    new = old.select((F.col("id") + 10).alias("id"))
    gone, come = R.without_match(old, new, ["id"]), R.without_match(new, old, ["id"])
    return gone.withColumn("change", F.lit("removed")).unionByName(come.withColumn("change", F.lit("added")))


@query(
    "u06_own_and_event_citations",
    "SELECT c_custkey AS person, c_custkey AS ref, 'person' AS via FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT o_custkey, o_orderkey, 'event' FROM orders WHERE o_totalprice > 490000",
)
def _(spark, d):
    own = table(spark, d, "customer").where("c_acctbal > 9000").selectExpr("c_custkey AS person", "c_custkey AS ref", "'person' AS via")
    return own.unionByName(table(spark, d, "orders").where("o_totalprice > 490000").selectExpr("o_custkey AS person", "o_orderkey AS ref", "'event' AS via"))


@query("u07_orphans", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def _(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return R.without_match(table(spark, d, "part"), used, ["p_partkey"]).select("p_partkey")
