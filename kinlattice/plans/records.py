"""Genealogical text, record linkage, versions and validation, on files and people made from the star schema."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import dates, phonetic, similarity
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import versioning as V
from ..sources import dna, gedcom
from .evidence import rounded
from .registry import query, table

MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC"


def texts(spark, d):
    """A file for each nation: a person for each customer, a family for every fourth with the next ones."""
    c = table(spark, d, "customer")
    month = F.get(F.split(F.lit(MONTHS), " "), (F.col("c_custkey") % 12).cast("int"))
    when = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("ABT "), (1700 + F.col("c_custkey") % 200).cast("string"))).otherwise(
        F.concat_ws(" ", (1 + F.col("c_custkey") % 28).cast("string"), month, (1700 + F.col("c_custkey") % 200).cast("string"))
    )
    person = F.concat(
        F.lit("0 @I"), "c_custkey", F.lit("@ INDI\n1 NAME "), "c_mktsegment", F.lit(" /"), "c_name", F.lit("/\n1 SEX "), F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F"),
        F.lit("\n1 BIRT\n2 DATE "), when, F.lit("\n2 PLAC Town "), F.col("c_custkey") % 7, F.lit(", Land\n1 NOTE first\n2 CONT second\n2 CONC  part\n1 _UID "), "c_custkey", F.lit("\n"),
    )
    family = F.when(
        F.col("c_custkey") % 4 == 0,
        F.concat(F.lit("0 @F"), "c_custkey", F.lit("@ FAM\n1 HUSB @I"), "c_custkey", F.lit("@\n1 WIFE @I"), F.col("c_custkey") + 1, F.lit("@\n1 CHIL @I"), F.col("c_custkey") + 2, F.lit("@\n")),
    ).otherwise("")
    rows = c.groupBy(F.col("c_nationkey").cast("string").alias("file")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.concat(person, family).alias("t")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["t"]), "")
    return rows.select("file", F.concat(F.lit("0 HEAD\n1 CHAR UTF-8\n"), body, F.lit("0 TRLR\n")).alias("text"))


def parsed(spark, d):
    lines = gedcom.read_lines(texts(spark, d))
    nodes = gedcom.read_records(lines)
    return lines, nodes, gedcom.documents(nodes)


@query("s04_lines", "SELECT CAST(c_nationkey AS VARCHAR) AS file, 3 + sum(8 + CASE WHEN c_custkey % 4 = 0 THEN 4 ELSE 0 END)::BIGINT AS n FROM customer GROUP BY 1")
def _(spark, d):
    return gedcom.read_lines(texts(spark, d)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("s05_folded_notes", "SELECT c_custkey::VARCHAR AS person, 'first' || chr(10) || 'second part' AS note FROM customer")
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    own = gedcom.of_kind(nodes, docs, "INDI").withColumnRenamed("root", "up")
    notes = own.join(gedcom.child_rows(nodes, ["NOTE"]), ["file", "up"])
    return notes.select(F.substr("xref", F.lit(2)).alias("person"), F.col("value").alias("note"))


@query("s07_persons", "SELECT 'I' || c_custkey AS xref, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex FROM customer")
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    return gedcom.persons(nodes, docs).select("xref", "sex")


@query("s08_names", "SELECT 'I' || c_custkey AS xref, 0 AS sort_order, c_mktsegment AS given, c_name AS surname FROM customer")
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    return gedcom.names(nodes, docs).select("xref", "sort_order", "given", "surname")


@query(
    "s08_event_dates",
    """SELECT 'I' || c_custkey AS xref, 'BIRT' AS type, CASE WHEN c_custkey % 5 = 0 THEN 'ABT' ELSE 'none' END AS qualifier,
       strftime(CASE WHEN c_custkey % 5 = 0 THEN make_date(1700 + c_custkey % 200, 1, 1) ELSE make_date(1700 + c_custkey % 200, 1 + c_custkey % 12, 1 + c_custkey % 28) END, '%Y-%m-%d') AS lower,
       strftime(CASE WHEN c_custkey % 5 = 0 THEN make_date(1700 + c_custkey % 200, 12, 31) ELSE make_date(1700 + c_custkey % 200, 1 + c_custkey % 12, 1 + c_custkey % 28) END, '%Y-%m-%d') AS upper FROM customer""",
)
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    rows = dates.with_dates(gedcom.events(nodes, docs), "date_raw", "d")
    return rows.select("xref", "type", "d.qualifier", F.col("d.lower").cast("string").alias("lower"), F.col("d.upper").cast("string").alias("upper"))


@query("s08_places", "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS file, 'Town ' || c_custkey % 7 AS town, 'Land' AS land FROM customer")
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    return gedcom.places(gedcom.events(nodes, docs)).select("file", F.get("levels", 0).alias("town"), F.get("levels", 1).alias("land"))


@query("s06_families", "SELECT 'F' || c_custkey AS xref, 'I' || c_custkey AS husband, 'I' || (c_custkey + 1) AS wife, 'I' || (c_custkey + 2) AS child FROM customer WHERE c_custkey % 4 = 0")
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    return gedcom.families(nodes, docs).join(gedcom.family_children(nodes, docs), ["file", "xref"]).select("xref", "husband", "wife", "child")


@query("s09_quarantine", "SELECT 'I' || c_custkey AS owner, '_UID' AS tag, c_custkey::VARCHAR AS value FROM customer")
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    return gedcom.quarantine(nodes, docs).join(nodes, ["file", "no"]).select("owner", "tag", "value")


@query("s26_tag_scan", "SELECT * FROM (VALUES ('BIRT'), ('NAME'), ('NOTE'), ('SEX'), ('_UID'), ('INDI'), ('DATE'), ('PLAC'), ('CONT'), ('CONC')) t(tag), (SELECT count(*) AS n FROM customer)")
def _(spark, d):
    lines = texts(spark, d).select(F.explode(F.split("text", "\n")).alias("line"))
    tag = F.regexp_extract("line", gedcom.LINE, 3)
    return lines.select(tag.alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("tag NOT IN ('', 'HEAD', 'TRLR', 'CHAR', 'FAM', 'HUSB', 'WIFE', 'CHIL')")


@query("s25_segments", "SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS documents, (SELECT count(*) FROM customer) AS persons")
def _(spark, d):
    joined = texts(spark, d).agg(F.array_join(F.array_sort(F.collect_list("text")), "").alias("text")).select(F.lit("all").alias("file"), "text")
    nodes = gedcom.read_records(gedcom.read_lines(gedcom.segments(joined)))
    return gedcom.documents(nodes).agg(F.count_if(F.col("tag") == "HEAD").alias("documents"), F.count_if(F.col("tag") == "INDI").alias("persons"))


@query("k01_round_trip", "SELECT 0::BIGINT AS differing, (SELECT count(*) * 9 + 3 * count(DISTINCT c_nationkey) + 4 * count(*) FILTER (c_custkey % 4 = 0) FROM customer)::BIGINT AS lines")
def _(spark, d):
    # written lines, read again, give the same logical lines; CONC text has become part of its line
    lines, nodes, _ = parsed(spark, d)
    text = gedcom.write_lines(nodes)
    files = text.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "sub", "line"))), lambda x: x["line"]), "\n").alias("text"))
    again = gedcom.read_lines(files).select("file", "level", "xref", "tag", "value")
    before = lines.select("file", "level", "xref", "tag", "value")
    differing = before.exceptAll(again).unionByName(again.exceptAll(before)).agg(F.count(F.lit(1)).alias("differing"))
    return differing.crossJoin(text.agg(F.count(F.lit(1)).alias("lines")))  # two single rows


@query("k02_reinjected", "SELECT count(*)::BIGINT AS n, count(*) FILTER (c_custkey >= 0)::BIGINT AS at_end FROM customer")
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    odd = gedcom.quarantine(nodes, docs).select("file", "owner", "no").join(nodes.select("file", "no", "level", "xref", "tag", "value"), ["file", "no"])
    back = gedcom.inject(nodes.join(odd.select("file", "no"), ["file", "no"], "left_anti"), odd)
    return back.where("tag = '_UID'").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") == 1).alias("at_end"))


@query("a27_file_statistics", "SELECT CAST(c_nationkey AS VARCHAR) AS file, count(*) + 1 + count(*) FILTER (c_custkey % 4 = 0) AS records, count(*) AS persons, count(*) FILTER (c_custkey % 4 = 0) AS families FROM customer GROUP BY 1")
def _(spark, d):
    lines, _, docs = parsed(spark, d)
    return gedcom.statistics(docs, lines).select("file", "records", "persons", "families")


# ---- validation --------------------------------------------------------------------------------


def document(spark, d):
    _, nodes, docs = parsed(spark, d)
    return {
        "nodes": nodes, "docs": docs, "refs": gedcom.references(nodes, docs), "persons": gedcom.persons(nodes, docs), "families": gedcom.families(nodes, docs),
        "children": gedcom.family_children(nodes, docs), "events": gedcom.events(nodes, docs),
    }


_FAMILY = "SELECT f.c_nationkey AS file, f.c_custkey AS k, o.c_custkey AS other, n AS step FROM (SELECT * FROM customer WHERE c_custkey % 4 = 0) f, (VALUES (1), (2)) v(n) LEFT JOIN customer o ON o.c_custkey = f.c_custkey + n AND o.c_nationkey = f.c_nationkey"


@query("v01_broken_references", f"SELECT CAST(file AS VARCHAR) AS file, 'F' || k AS subject, 'ERROR' AS severity, CASE step WHEN 1 THEN 'WIFE' ELSE 'CHIL' END || ' I' || (k + step) AS detail FROM ({_FAMILY}) WHERE other IS NULL")
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    return Q.broken_references(gedcom.references(nodes, docs), docs).select("file", "subject", "severity", "detail")


@query(
    "v11_validation_summary",
    f"""WITH f AS ({_FAMILY}), g AS (SELECT k, max(other) FILTER (step = 1) AS mother, max(other) FILTER (step = 2) AS child FROM f GROUP BY k),
        r AS (SELECT 'broken_xref' AS rule, 'ERROR' AS severity, count(*) AS n FROM f WHERE other IS NULL UNION ALL SELECT 'mother_age', 'WARNING', count(*) FROM g WHERE mother IS NOT NULL AND child IS NOT NULL
              UNION ALL SELECT 'father_age', 'WARNING', count(*) FROM g WHERE child IS NOT NULL) SELECT * FROM r WHERE n > 0""",
)
def _(spark, d):
    return Q.validate(document(spark, d)).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("x01_dropped_tags", "SELECT 'I' || c_custkey AS xref, tag, rule FROM customer, (VALUES ('_UID', 'vendor'), ('NOTE', 'note')) t(tag, rule)")
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    rules = spark.createDataFrame([("_*", "vendor", 0.1), ("INDI.NOTE", "note", 0.2), ("NOTE", "any note", 0.3)], "pattern string, rule string, weight double")
    hits = Q.dropped_tags(nodes, rules)
    roots = nodes.select("file", "no", "root").join(docs.select("file", "root", "xref"), ["file", "root"])
    return hits.join(roots, ["file", "no"]).select("xref", "tag", "rule")


@query("x03_charset_losses", "SELECT doc_id, length(regexp_replace(replace(replace(text, 'ä', 'ae'), 'é', 'e'), '[\\x00-\\x7F]', '', 'g')) AS lost FROM documents")
def _(spark, d):
    return Q.charset_losses(table(spark, d, "documents"), "text", {"ä": "ae", "é": "e"}).select("doc_id", F.col("lost").cast("long").alias("lost"))


@query("x04_triggers", "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS file, f AS feature FROM customer, (VALUES ('families'), ('vendor')) t(f) WHERE f = 'vendor' OR c_custkey % 4 = 0")
def _(spark, d):
    _, nodes, _ = parsed(spark, d)
    return Q.triggers(nodes, {"families": "tag = 'FAM'", "vendor": "startswith(tag, '_')", "media": "tag = 'OBJE'"})


@query("x05_export_audit", "SELECT CAST(c_nationkey AS VARCHAR) AS file, 2 * count(*) AS dropped, round(0.1 + 0.2 + 0.02, 6)::DOUBLE AS loss FROM customer GROUP BY 1")
def _(spark, d):
    _, nodes, docs = parsed(spark, d)
    rules = spark.createDataFrame([("_*", "vendor", 0.1), ("INDI.NOTE", "note", 0.2)], "pattern string, rule string, weight double")
    return rounded(Q.export_audit(nodes, rules, gedcom.persons(nodes, docs)), "loss")


# ---- names and text ----------------------------------------------------------------------------


@query("f01_soundex", "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE 'N%'")
def _(spark, d):
    n = table(spark, d, "nation").withColumn("code", phonetic.soundex(F.col("n_name")))
    return n.where("code = 'N350'").select("n_nationkey", "n_name")


@query("f02_daitch_mokotoff")
def _(spark, d):
    from ..storage import ship

    ship(spark)
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    return words.select("name", F.array_join(phonetic.dm_codes("name"), ",").alias("codes"))


@query("f03_indel_ratio")
def _(spark, d):
    from ..storage import ship

    ship(spark)
    n = table(spark, d, "part").select("p_name").distinct()
    pairs = n.selectExpr("p_name AS a").crossJoin(n.selectExpr("p_name AS b"))
    return pairs.select("a", "b", F.round(similarity.indel_ratio("a", "b"), 6).alias("ratio"))


@query("f06_person_scores")
def _(spark, d):
    people = linkable(spark, d)
    scores = lambda pairs: M.person_scores(pairs).select("a", "b", F.round("score", 6).alias("score")).where("score > 0.5")
    return M.scored_people(people, scores)


def linkable(spark, d):
    c = table(spark, d, "customer")
    sex = F.when(F.col("c_custkey") % 3 == 0, "M").when(F.col("c_custkey") % 3 == 1, "F").otherwise("U")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("given"), F.concat(F.lit("name"), (F.col("c_custkey") % 50).cast("string")).alias("surname"), (1800 + F.col("c_custkey") % 5).alias("birth_year"),
        F.concat_ws(", ", F.lit("Town"), F.col("c_nationkey").cast("string")).alias("birth_place"), sex.alias("sex"), F.array((F.col("c_custkey") % 50).cast("string")).alias("codes"),
    )


@query("f09_transliteration", "SELECT c_custkey, 'zhukov shchyogolev ' || c_custkey AS plain, 'žukov ŝëgolev ' || c_custkey AS iso9, 'zhukov shchëgolev ' || c_custkey AS loc FROM customer")
def _(spark, d):
    name = F.concat(F.lit("Жуков Щёголев "), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", *(phonetic.to_latin(name, s).alias(s) for s in ("plain", "iso9", "loc")))


@query("f13_canonical_form", "SELECT doc_id, translate(replace(lower(trim(text)), 'ß', 'ss'), 'äöüéèêçñóíáâàùûîïô', 'aoueeecnoiaaauuiio') AS form FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", phonetic.canonical_form(F.col("text")).alias("form"))


@query("f16_name_parts", "SELECT c_custkey, 'Ivan' AS given, 'Petrovich' AS patronymic, c_mktsegment AS surname FROM customer")
def _(spark, d):
    full = F.concat_ws(" ", F.lit("Ivan"), F.lit("Petrovich"), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", phonetic.parse_name(full).alias("n")).select("c_custkey", "n.*")


@query("f19_gedcom_name", "SELECT c_custkey, c_mktsegment AS given, c_name AS surname, 'Jr' AS suffix FROM customer")
def _(spark, d):
    raw = F.concat(F.col("c_mktsegment"), F.lit(" /"), F.col("c_name"), F.lit("/ Jr"))
    return table(spark, d, "customer").select("c_custkey", phonetic.gedcom_name(raw).alias("n")).select("c_custkey", "n.*")


@query("f18_coordinates", "SELECT s_suppkey, CASE WHEN s_suppkey <= 90 THEN 0 - s_suppkey::DOUBLE END AS lat, s_suppkey::DOUBLE AS lon FROM supplier")
def _(spark, d):
    text = F.col("s_suppkey").cast("string")
    lat, lon = F.concat(F.lit("S"), text), F.concat(F.lit("E "), text)
    return table(spark, d, "supplier").select("s_suppkey", (phonetic.coordinate(lat) + 0.0).alias("lat"), phonetic.coordinate(lon).alias("lon"))


@query("f23_brackets", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS lower, strftime(last_day(o_orderdate), '%Y-%m-%d') AS upper FROM orders")
def _(spark, d):
    low, high = dates.bracket(F.year("o_orderdate"), F.month("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", low.cast("string").alias("lower"), high.cast("string").alias("upper"))


@query("f25_string_equality", "SELECT count(*) FILTER (lower(trim(p_brand)) IS NOT DISTINCT FROM lower(trim(' BRAND#2 '))) AS n FROM part")
def _(spark, d):
    same = F.lower(F.trim("p_brand")).eqNullSafe(F.lower(F.trim(F.lit(" BRAND#2 "))))
    return table(spark, d, "part").agg(F.count_if(same).alias("n"))


@query(
    "f28_cosine_top_k",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS q, e.vec_id AS c, round(greatest(0, least(1, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)))), 6) AS score
       FROM e q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
)
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return M.nearest(e, e.where("id % 50 = 0"), 5)


@query(
    "f29_archive_priority",
    """SELECT s_suppkey, c_custkey, round(0.5 * greatest(0, least(1900 + s_suppkey, 1950) - greatest(1850 + s_suppkey % 40, 1900) + 1) / greatest(50, 1) + 0.3 * (s_suppkey % 2 = 0)::INT + 0.2 * (c_acctbal > 5000)::INT, 6) AS priority
       FROM supplier JOIN customer ON s_nationkey = c_nationkey""",
)
def _(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    both = s.join(c, F.col("s_nationkey") == F.col("c_nationkey"))
    years = similarity.year_overlap(F.lit(1900), F.lit(1950), 1850 + F.col("s_suppkey") % 40, 1900 + F.col("s_suppkey"))
    score = similarity.archive_priority(years, F.col("s_suppkey") % 2 == 0, F.col("c_acctbal") > 5000)
    return both.select("s_suppkey", "c_custkey", F.round(score, 6).alias("priority"))


@query("f30_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("f32_ancestor_numbers", "SELECT c_custkey, c_custkey // 2 AS parent_number, c_custkey % 2 = 0 AS is_father FROM customer WHERE c_custkey > 1")
def _(spark, d):
    from ..functions import kinship

    rows = table(spark, d, "customer").select("c_custkey", kinship.ancestor(F.col("c_custkey")).alias("a")).where("a IS NOT NULL")
    return rows.select("c_custkey", F.col("a.child").alias("parent_number"), "a.is_father")


@query("f33_inline_query", "SELECT c_custkey, c_mktsegment AS surname, CASE WHEN c_custkey % 3 < 2 THEN 'Anna' END AS given, CASE WHEN c_custkey % 3 <> 1 THEN 1800 + c_custkey % 100 END AS year FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    text = F.concat_ws(" ", "c_mktsegment", F.when(k % 3 < 2, F.lit("Anna")), F.when(k % 3 != 1, (1800 + k % 100).cast("string")))
    return table(spark, d, "customer").select("c_custkey", phonetic.inline_query(text).alias("q")).select("c_custkey", "q.*")


@query(
    "f36_quote_containment",
    r"""WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-zà-ÿ]+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-zà-ÿ]+', ' ', 'g') AS t FROM documents)
       SELECT item_id, doc_id FROM q JOIN d ON contains(t, q) WHERE q <> ''""",
)
def _(spark, d):
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-zà-ÿ]+", " ")
    quotes = table(spark, d, "benchmark").select("item_id", F.trim(plain(F.col("text"))).alias("q")).where("q <> ''")
    # words inside a quote are whole words of any text that holds it: an equi-join on the longest, then the comparison
    words = F.split("q", " ")
    inner = F.array_sort(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda a, b: F.length(b) - F.length(a))
    quotes = quotes.withColumn("w", F.get(inner, 0))
    docs = table(spark, d, "documents").select("doc_id", plain(F.col("text")).alias("t"))
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    near = tokens.join(quotes.where("w IS NOT NULL"), "w").select("doc_id", "item_id", "q").distinct()
    found = near.join(docs, "doc_id").where(F.contains("t", "q")).select("item_id", "doc_id")
    # quotes of one or two words have no inner one: blocks of them, of bounded size, are compared with all texts
    short = quotes.where("w IS NULL").select("item_id", "q")
    blocks = -(-short.count() // 1000)
    for k in range(blocks):
        block = F.broadcast(short.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k))
        found = found.unionByName(docs.join(block, F.contains("t", "q")).select("item_id", "doc_id"))
    return found


@query("f26_allele_overlap", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'A' OR l_linestatus = 'F' END AS shares FROM lineitem")
def _(spark, d):
    l = table(spark, d, "lineitem")
    a = F.when(F.col("l_returnflag") == "N", "--").when(F.col("l_returnflag") == "A", "AC").otherwise("CC")
    b = F.when(F.col("l_linestatus") == "F", "AC").otherwise("AA")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", M.shares_allele(a, b).alias("shares"))


# ---- matching ----------------------------------------------------------------------------------


@query("j12_shared_variants", "SELECT a.o_orderkey::VARCHAR AS rsid, 1 + a.o_custkey % 22 AS chrom, a.o_orderkey AS pos FROM orders a WHERE a.o_orderkey % 3 = 0 AND a.o_orderkey % 5 <> 0")
def _(spark, d):
    o = table(spark, d, "orders")
    kit = lambda keep, chrom: o.where(keep).select(F.col("o_orderkey").cast("string").alias("rsid"), chrom.alias("chrom"), F.col("o_orderkey").alias("pos"), F.lit("AC").alias("genotype"), F.col("o_orderkey").alias("line"))
    real = 1 + F.col("o_custkey") % 22
    other = F.when(F.col("o_orderkey") % 5 == 0, F.lit(30)).otherwise(real)
    return M.shared_variants(kit("o_orderkey % 3 = 0", real), kit("true", other)).select("rsid", "chrom", "pos")


@query("j13_blocked_pairs", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_custkey % 50 = b.c_custkey % 50 AND a.c_custkey < b.c_custkey")
def _(spark, d):
    return M.blocked_pairs(linkable(spark, d), "id", "codes")


@query("j14_token_pairs", "SELECT DISTINCT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND list_has_any(string_split(lower(a.p_name), ' '), string_split(lower(b.p_name), ' '))")
def _(spark, d):
    return M.token_pairs(table(spark, d, "part"), "p_partkey", "p_name")


@query("j14_source_pairs")
def _(spark, d):
    p = table(spark, d, "part")
    return rounded(M.source_pairs(p.select("p_partkey", F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_type").alias("abbreviation")), "p_partkey"), "score")


@query("j14_place_pairs")
def _(spark, d):
    places = table(spark, d, "supplier").select("s_suppkey", F.concat_ws(", ", "s_name", F.concat(F.lit("Land "), F.col("s_nationkey").cast("string"))).alias("place"))
    return rounded(M.place_pairs(places, "s_suppkey"), "score")


@query("j20_greedy_assignment")
def _(spark, d):
    l = table(spark, d, "lineitem")
    pairs = l.groupBy(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.max("l_quantity").alias("score"))
    return M.assign(pairs)


@query("j22_family_pairs", "SELECT 'l' || c_custkey AS a, 'r' || c_custkey AS b FROM customer WHERE c_custkey % 4 = 0")
def _(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 4 = 0")
    side = lambda s, k: c.select(F.concat(F.lit(s), "c_custkey").alias("family"), (F.col("c_custkey") + k).alias("husband"), F.when(F.col("c_custkey") % 8 == 0, F.col("c_custkey") + k + 1).alias("wife"))
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("a")).unionByName(table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("a"))).distinct()
    return M.match_families(side("l", 0), side("r", 100000), ids.select("a", (F.col("a") + 100000).alias("b")))


@query("d02_safe_merge", "SELECT c_custkey AS a, c_custkey + 100000 AS b, 5.0::DOUBLE AS score FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    name = F.concat(F.lit("Sur"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "bdfgklmnrs"))
    left = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("G"), "c_custkey").alias("given"), name.alias("surname"), (F.lit(1800) + F.col("c_custkey") % 90).alias("birth_year"), F.concat(F.lit("T"), "c_custkey").alias("birth_place"), F.lit("M").alias("sex"))
    right = left.withColumn("id", F.col("id") + 100000)
    return M.safe_merge(left, right)


# ---- versions ----------------------------------------------------------------------------------


def versions(spark, d):
    """The customers, and a later copy: every seventh gone, every fifth richer, every eleventh new."""
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    more = old.where("c_custkey % 11 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return old, new.unionByName(more)


_NEW = """SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 11 = 0"""


@query(
    "j18_keyed_diff",
    f"""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN 'removed' WHEN o.c_custkey IS NULL THEN 'added' ELSE 'modified' END AS change,
        CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN 'c_acctbal' ELSE '' END AS changed FROM customer o FULL JOIN ({_NEW}) n ON n.c_custkey = o.c_custkey
        WHERE n.c_custkey IS NULL OR o.c_custkey IS NULL OR o.c_acctbal <> n.c_acctbal""",
)
def _(spark, d):
    old, new = versions(spark, d)
    return V.diff(old, new, ["c_custkey"], ["c_name", "c_acctbal"])


@query(
    "j19_three_way_merge",
    """SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN c_acctbal WHEN c_custkey % 3 = 0 THEN c_acctbal + 10 WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS c_acctbal,
       c_custkey % 3 = 0 AND c_custkey % 5 = 0 AS conflict FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 3 = 0""",
)
def _(spark, d):
    old, _ = versions(spark, d)
    base = old.select("c_custkey", "c_acctbal")
    left = base.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 10).otherwise(F.col("c_acctbal")))
    right = base.where("c_custkey % 7 <> 0 OR c_custkey % 3 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    right = right.unionByName(base.where("false"))
    return rounded(V.merge(base, left, right, ["c_custkey"], ["c_acctbal"], "manual"), "c_acctbal", digits=2)


@query(
    "k05_upsert",
    f"""SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM ({_NEW}) UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 7 = 0""",
)
def _(spark, d):
    old, new = versions(spark, d)
    return rounded(V.upsert(old, new, ["c_custkey"], keep=["c_name"]), "c_acctbal", digits=2)


@query("e03_versioned_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END AS score, o_orderstatus AS review FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", (F.col("o_orderkey") % 2).cast("string").alias("version"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("review"))
    new = o.select("o_orderkey", F.lit("0").alias("version"), F.lit(0.0).alias("score"), F.lit("none").alias("review"))
    same = F.col("o.version") == F.col("n.version")
    return V.upsert(old, new, ["o_orderkey"], keep=["review"], unchanged=same).drop("version")


@query("k08_audit_rows", f"""WITH n AS ({_NEW}), o AS (SELECT c_custkey, c_name, c_acctbal FROM customer), j AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS k, o.c_name AS a, n.c_name AS b, o.c_acctbal AS x, n.c_acctbal AS y FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
  SELECT k AS c_custkey, 'c_name' AS "column" FROM j WHERE a IS DISTINCT FROM b UNION ALL SELECT k, 'c_acctbal' FROM j WHERE x IS DISTINCT FROM y""")
def _(spark, d):
    old, new = versions(spark, d)
    return V.audit(old, new, ["c_custkey"], ["c_name", "c_acctbal"]).select("c_custkey", "column")


@query("e02_place_dedup", "SELECT DISTINCT trim(p_type) AS place FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.trim("p_type").alias("place")).dropDuplicates(["place"])


def merges(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 10 = 1")
    return c.select(F.col("c_custkey").alias("merged"), (F.col("c_custkey") - 1).alias("survivor"))


def event_table(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("person"), F.col("o_orderstatus").alias("kind"), F.year("o_orderdate").alias("day"), F.lit(None).cast("string").alias("place"),
        (F.col("o_orderkey") % 3).alias("sources"), F.col("o_totalprice").alias("confidence"), F.col("o_orderkey").alias("created"),
    )


@query(
    "e06_merge_events",
    """WITH m AS (SELECT c_custkey AS merged, c_custkey - 1 AS survivor FROM customer WHERE c_custkey % 10 = 1), o AS (SELECT o_custkey AS person, o_orderstatus AS kind, year(o_orderdate) AS day, o_orderkey AS event FROM orders)
       SELECT coalesce(survivor, person) AS person, kind, day, event FROM o LEFT JOIN m ON merged = person
       WHERE NOT EXISTS (SELECT 1 FROM o s WHERE s.person = survivor AND s.kind = o.kind AND s.day = o.day)""",
)
def _(spark, d):
    c = table(spark, d, "customer")
    people = c.select(F.col("c_custkey").alias("id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    names = c.select(F.col("c_custkey").alias("person"), F.lit(0).alias("sort_order"))
    _, _, events = V.merge_people(people, names, event_table(spark, d), merges(spark, d), F.lit(datetime(2024, 1, 1)))
    return events.select("person", "kind", F.col("day").cast("long").alias("day"), "event")


@query(
    "e05_merge_preview",
    """SELECT a.o_custkey AS survivor, b.o_custkey AS merged, a.o_orderkey AS event_a, b.o_orderkey AS event_b FROM orders a JOIN orders b ON b.o_custkey % 10 = 1 AND b.o_custkey - 1 = a.o_custkey
       AND a.o_orderstatus = b.o_orderstatus AND year(a.o_orderdate) = year(b.o_orderdate)""",
)
def _(spark, d):
    return V.merge_preview(event_table(spark, d), merges(spark, d))


@query("e07_undo_merge", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "ts", "event_type")
    since = F.lit(datetime(2024, 1, 10))
    old = V.undo(rows.withColumn("t", F.col("ts")), "user_id", "t", since, F.lit(datetime(2023, 10, 12)))
    return old.select("user_id", "event_type")


@query("e08_soft_delete", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN '2024-01-01' WHEN c_custkey % 4 = 0 THEN '2020-01-01' END AS deleted FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit(date(2020, 1, 1))).alias("deleted_at"))
    gone = V.soft_delete(c, merges(spark, d).select(F.col("merged").alias("c_custkey")), "c_custkey", F.lit(date(2024, 1, 1)))
    return gone.select("c_custkey", F.col("deleted_at").cast("string").alias("deleted"))


@query("e09_hard_delete_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 10 = 1 UNION ALL SELECT 'events', count(*) FROM events WHERE user_id % 10 = 1")
def _(spark, d):
    out = V.hard_delete({"orders": (table(spark, d, "orders"), "o_custkey"), "events": (table(spark, d, "events"), "user_id")}, merges(spark, d), "merged")
    one = lambda name: out[name][1].select(F.lit(name).alias("name"), "n")
    return one("orders").unionByName(one("events"))


@query("e10_reimport", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 4 = 0")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return V.replace_owned(c, c.where("c_custkey % 4 = 0").withColumn("c_name", F.lit("new")), ["c_custkey"], F.col("c_custkey") % 3 == 0)


@query(
    "e11_new_attempts",
    "SELECT c_custkey AS local, c_custkey * 2 AS remote FROM customer WHERE NOT (c_custkey % 3 = 0 OR c_custkey % 5 = 1 OR c_custkey % 7 = 2)",
)
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("local"), (F.col("c_custkey") * 2).alias("remote"))
    now = F.lit(date(2024, 1, 1))
    old = c.withColumns({
        "merged_at": F.when(F.col("local") % 7 == 2, F.lit(date(2023, 1, 1))),
        "rejected_at": F.when(F.col("local") % 5 == 1, F.lit(date(2023, 12, 1))).when(F.col("local") % 3 != 0, F.lit(date(2020, 1, 1))),
    })
    open_ = old.where("local % 3 = 0").withColumns({"merged_at": F.lit(None).cast("date"), "rejected_at": F.lit(None).cast("date")})
    done = old.where("local % 3 <> 0")
    return V.new_attempts(c, open_.unionByName(done), old.where("merged_at IS NOT NULL"), now)


@query("e15_code_backfill", "SELECT n_nationkey, '636000' AS codes FROM nation WHERE n_name LIKE 'NATION%'")  # N 6, T 3, N 6: vowels have none here
def _(spark, d):
    from ..storage import ship

    ship(spark)
    return table(spark, d, "nation").select("n_nationkey", F.array_join(phonetic.search_codes(F.col("n_name")), ",").alias("codes"))


@query("d03_cross_platform", "SELECT user_id::VARCHAR AS email_hash, count(DISTINCT event_type) AS platforms FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 3")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("email_hash"), F.col("event_type").alias("platform"))
    return Q.identities(rows)


@query(
    "d04_population_links",
    "SELECT l_orderkey AS a, l_suppkey AS b, CASE WHEN l_returnflag = l_linestatus THEN 'same' WHEN l_linenumber > 4 THEN 'documented' ELSE 'crossover' END AS verdict FROM lineitem",
)
def _(spark, d):
    l = table(spark, d, "lineitem")
    links = l.select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("population_a"), F.col("l_linestatus").alias("population_b"), F.greatest(F.col("l_linenumber") - 4, F.lit(0)).alias("sources"))
    return Q.separated_populations(links)


@query("d05_founder_loops", "SELECT l_orderkey AS a, l_suppkey AS b FROM lineitem GROUP BY ALL HAVING count(*) >= 1 AND max(l_quantity) < 15")
def _(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("cm"), F.lit(0).alias("sources"))
    return Q.founder_loops(l, least=1)


@query(
    "d06_preferred_facts",
    "SELECT o_custkey AS subject, o_orderstatus AS fact, arg_min(o_orderpriority, (CASE WHEN o_totalprice > 250000 THEN 0 ELSE 1 END, o_orderkey)) AS value, count(DISTINCT o_orderpriority) > 1 AS overridden FROM orders GROUP BY ALL",
)
def _(spark, d):
    cls = F.when(F.col("o_totalprice") > 250000, "primary").otherwise("derivative")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("fact"), F.col("o_orderpriority").alias("value"), cls.alias("source_class"), F.col("o_orderkey").alias("snippet"))
    return Q.preferred_facts(o)


@query(
    "d07_household_drift",
    """SELECT o_custkey AS household, o_orderkey AS year, (age - lag(age) OVER w) - (o_orderkey - lag(o_orderkey) OVER w) AS drift FROM (SELECT *, o_orderkey + o_orderkey % 9 AS age FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("household"), F.lit("x").alias("name"), F.col("o_orderkey").alias("year"), (F.col("o_orderkey") + F.col("o_orderkey") % 9).alias("age"))
    return Q.household_drift(rows).select("household", "year", "drift")


@query(
    "d08_jurisdictions",
    """SELECT o_orderkey AS event, o_orderstatus AS place, max(j) AS jurisdiction FROM orders LEFT JOIN (VALUES ('F', NULL, 1996, 'old F'), ('F', 1997, NULL, 'new F'), ('O', 1995, 1998, 'O land')) v(p, a, b, j)
       ON p = o_orderstatus AND coalesce(a, -9999) <= year(o_orderdate) AND year(o_orderdate) <= coalesce(b, 9999) GROUP BY ALL""",
)
def _(spark, d):
    spans = spark.createDataFrame([("F", None, 1996, "old F"), ("F", 1997, None, "new F"), ("O", 1995, 1998, "O land")], "place string, valid_from int, valid_to int, jurisdiction string")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("place"), F.year("o_orderdate").alias("year"))
    return Q.jurisdictions(o, spans)


@query("f27_sex_from_calls", "SELECT count(*) FILTER (o_custkey % 25 = 23) AS y_calls, 'M' AS sex FROM orders")
def _(spark, d):
    return dna.infer_sex(table(spark, d, "orders").select((F.col("o_custkey") % 25 + 1).alias("chrom"), F.lit("AA").alias("genotype")))


@query(
    "e04_bulk_hypotheses",
    """WITH p AS (SELECT c_custkey AS id, c_custkey % 50 AS s, 1800 + c_custkey % 5 AS y, c_nationkey AS n, c_custkey % 3 AS sex FROM customer),
       q AS (SELECT a.id AS a, b.id AS b, abs(a.y - b.y) AS g, a.n = b.n AS same, a.sex < 2 AND b.sex < 2 AND a.sex <> b.sex AS clash FROM p a JOIN p b ON a.s = b.s AND a.id < b.id)
       SELECT a, b, round(greatest(least(1 - 0.5 * CASE WHEN g = 0 THEN 0.6 WHEN g <= 2 THEN 0.75 ELSE 1 END * CASE WHEN same THEN 0.6 ELSE 1 END - 0.1 * clash::INT, 1), 0.05), 6)::DOUBLE AS score FROM q""",
)
def _(spark, d):
    from . import pipelines

    return rounded(pipelines.hypotheses(linkable(spark, d)).select("a", "b", "score"), "score")


@query("e01_import", "SELECT 'persons' AS name, count(*) AS n FROM customer UNION ALL SELECT 'names', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM customer UNION ALL SELECT 'families', count(*) FROM customer WHERE c_custkey % 4 = 0")
def _(spark, d):
    from . import pipelines

    tables = pipelines.import_texts(texts(spark, d))
    parts = [tables[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("persons", "names", "events", "families")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("s22_people_for_matching", "SELECT CAST(c_nationkey AS VARCHAR) || '/I' || c_custkey AS id, c_mktsegment AS given, c_name AS surname, 1700 + c_custkey % 200 AS birth_year, 'Town ' || c_custkey % 7 || ', Land' AS birth_place FROM customer")
def _(spark, d):
    from . import pipelines

    people = pipelines.people(pipelines.import_texts(texts(spark, d)))
    return people.select("id", "given", "surname", F.col("birth_year").cast("long").alias("birth_year"), "birth_place")


@query("f07_source_scores", "SELECT p_partkey, round(least(1, 0.7 + 0.2 * CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 0.1 ELSE 0 END), 6)::DOUBLE AS score FROM part")
def _(spark, d):
    authors = F.array("p_brand")
    score = similarity.source_score(F.lit(1.0), authors, F.array(F.lit("Brand#2")), F.col("p_type"), F.lit(" economy "))
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("f08_place_scores", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 0.94 ELSE 0.6 END::DOUBLE AS score FROM customer")
def _(spark, d):
    place = F.concat(F.lit("Land "), F.col("c_nationkey").cast("string"), F.lit(", Town"))
    score = similarity.place_score(place, F.lit("land 3"), F.lit(0.6))
    return table(spark, d, "customer").select("c_custkey", F.round(score, 6).alias("score"))


@query("f12_diacritic_variants", "SELECT doc_id, len(list_distinct([t, translate(t, 'äöü', 'aou'), replace(replace(replace(t, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')])) AS forms, replace(replace(replace(t, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue') AS wide FROM (SELECT doc_id, regexp_replace(text, '[^a-zäöü ]', '', 'g') AS t FROM documents)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^a-zäöü ]", "").alias("t"))
    forms = docs.select("doc_id", phonetic.diacritic_variants(F.col("t"), "de").alias("v"))
    return forms.select("doc_id", F.size("v").alias("forms"), F.element_at("v", -1).alias("wide"))


@query("f14_scripts", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ru' WHEN 1 THEN 'he' ELSE 'en' END AS script FROM customer")
def _(spark, d):
    name = F.get(F.array(F.lit("Иван x"), F.lit("כהן"), F.lit("Smith")), (F.col("c_custkey") % 3).cast("int"))
    return table(spark, d, "customer").select("c_custkey", phonetic.script(name).alias("script"))


@query("f15_archive_variants", "SELECT n_nationkey, n_name IS NOT NULL AS has_own, true AS has_codes FROM nation")
def _(spark, d):
    from ..storage import ship

    ship(spark)
    n = table(spark, d, "nation").withColumn("v", phonetic.archive_variants(F.col("n_name"), phonetic.search_codes(F.col("n_name"))))
    return n.select("n_nationkey", F.array_contains("v", F.col("n_name")).alias("has_own"), F.exists("v", lambda x: x.startswith("__DM__")).alias("has_codes"))


@query("f20_name_tiers", "SELECT p_partkey AS q, 1::BIGINT AS c, 1.0::DOUBLE AS score, 'exact' AS tier FROM part WHERE p_name = 'red widget'")
def _(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("q"), F.col("p_name").alias("name"))
    c = spark.createDataFrame([(1, "Red Widget")], "c long, name string")
    none = spark.createDataFrame([("cohen", "kohen")], "form string, canonical string")
    return M.match_names(q, c, none, 0.95)


@query("f24_dates_equal", "SELECT o_orderkey, abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01')) <= 30 AS same FROM orders")
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    one = lambda c: F.struct(c.alias("lower"), c.alias("upper"))
    o = table(spark, d, "orders").select("o_orderkey", one(day).alias("a"), one(F.lit(date(1998, 1, 1))).alias("b"))
    return o.select("o_orderkey", dates.dates_equal(F.col("a"), F.col("b"), 30).alias("same"))


@query("f31_month_precision", "SELECT o_orderkey, day(o_orderdate) <= 20 AS precise FROM orders")
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    span = F.struct(F.trunc(day, "month").alias("lower"), F.when(F.dayofmonth(day) <= 20, day).otherwise(F.add_months(day, 2)).alias("upper"))
    return table(spark, d, "orders").select("o_orderkey", span.alias("s")).select("o_orderkey", dates.month_precise(F.col("s")).alias("precise"))


@query(
    "j17_archive_scores",
    """SELECT event_id, s_suppkey FROM (SELECT event_id, s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY value DESC, event_id) AS rn FROM events JOIN customer ON c_custkey = user_id JOIN supplier ON s_nationkey = c_nationkey
       WHERE event_type IN ('signup', 'purchase') AND s_acctbal > 0) WHERE rn = 1""",
)
def _(spark, d):
    e = table(spark, d, "events").where("event_type IN ('signup', 'purchase')").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id"))
    # suppliers of a nation have one best event: it is picked before they are joined
    order = F.struct(F.col("value").isNull().alias("unknown"), (-F.col("value")).alias("least"), F.col("event_id"))
    best = e.groupBy("c_nationkey").agg(F.min(order).alias("best"))
    both = best.join(table(spark, d, "supplier").where("s_acctbal > 0"), F.col("s_nationkey") == F.col("c_nationkey"))
    return R.pick(both, ["s_suppkey"], F.col("best.event_id"), F.col("best")).select(F.col("value").alias("event_id"), "s_suppkey")


@query("j23_parent_ages", "SELECT 'I' || (k + 2) AS subject, 'mother_age' AS rule FROM (SELECT f.c_custkey AS k FROM customer f JOIN customer m ON m.c_custkey = f.c_custkey + 1 AND m.c_nationkey = f.c_nationkey JOIN customer c ON c.c_custkey = f.c_custkey + 2 AND c.c_nationkey = f.c_nationkey WHERE f.c_custkey % 4 = 0)")
def _(spark, d):
    doc = document(spark, d)
    pairs = Q.parents(doc["families"], doc["children"], Q.lives(doc["events"]))
    return Q.parent_ages(pairs).where("rule = 'mother_age'").select("subject", "rule")


@query("j26_propagated_matches", f"SELECT c_custkey + {10 * 10**12} AS a, c_custkey + {20 * 10**12} AS b FROM customer WHERE c_custkey % 2 = 0")
def _(spark, d):
    # the ids of fathers, mothers and children do not meet
    c, k, unit, far = table(spark, d, "customer"), F.col("c_custkey"), 10**12, 10**13
    role = lambda s, base, who, step: c.where(f"c_custkey % 2 = 0 OR {step} = 0").select(F.lit(s).alias("source"), (k + base).alias("person"), F.lit(who).alias("role"), (k + base - far + step).alias("other"))
    roles = None
    for s, base in (("l", far), ("r", 2 * far)):
        for who, step in (("child", 0), ("spouse", unit)):
            part = role(s, base, who, step)
            roles = part if roles is None else roles.unionByName(part)
    known = c.select(k.alias("a"), (k + far).alias("b")).unionByName(c.select((k + unit).alias("a"), (k + far + unit).alias("b")))
    return M.propagate(roles, known)


@query("j27_text_references", "SELECT doc_id, p_name AS ref FROM (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents)) JOIN (SELECT DISTINCT p_name FROM part) ON w = string_split(p_name, ' ')[1]")
def _(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    labels = table(spark, d, "part").select("p_name").distinct().withColumn("w", F.get(F.split("p_name", " "), 0))
    return words.join(labels, "w").select("doc_id", F.col("p_name").alias("ref"))


@query("x02_feature_hits", "SELECT CAST(c_nationkey AS VARCHAR) AS file, count(*) AS vendor_tags, count(*) AS approximate FROM customer GROUP BY 1 HAVING count(*) > 0")
def _(spark, d):
    _, nodes, _ = parsed(spark, d)
    return nodes.groupBy("file").agg(F.count_if(F.col("tag").startswith("_")).alias("vendor_tags"), F.count_if(F.col("tag") == "DATE").alias("approximate"))


@query("g14_resolved_references", "SELECT c_custkey AS anchor, c_custkey // 2 AS node FROM customer WHERE c_custkey > 0")
def _(spark, d):
    from ..functions import kinship as K
    from ..operators import graph as G
    from .evidence import kinship

    start = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("U").alias("sex"))
    return G.walk(start, kinship(spark, d), people, K.steps("my father"))


@query("d01_dna_against_tree", "SELECT DISTINCT kit, id FROM (SELECT l_orderkey AS kit, unnest([l_suppkey, l_partkey % 100]) AS id FROM lineitem WHERE l_suppkey <> l_partkey % 100) WHERE id % 2 = 0")
def _(spark, d):
    l = table(spark, d, "lineitem").selectExpr("l_orderkey AS kit", "l_suppkey AS a", "l_partkey % 100 AS b").where("a <> b")
    links = l.select("kit", F.explode(F.array("a", "b")).alias("id")).distinct().withColumns({"cm": F.lit(200.0), "dna_line": F.lit("paternal"), "tree_line": F.when(F.col("id") % 2 == 0, "maternal").otherwise("paternal")})
    return Q.dna_against_tree(links, l)


@query("k07_export_manifest", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier")
def _(spark, d):
    from ..sources import sinks
    from ..storage import shared_dir

    import uuid

    return sinks.export({n: table(spark, d, n) for n in ("nation", "supplier")}, f"{shared_dir(spark)}/export-{uuid.uuid4().hex}")
