"""Files of every encoding and vendor, faulty families, odd dates: a small file or row for each customer or order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import quality as Q
from ..sources import dna, gedcom
from ..storage import shared_dir, ship
from .registry import query, table


@query(
    "s03_encodings",
    """SELECT c_custkey, ['UTF-8', 'UTF-16LE', 'UTF-16BE', 'ISO-8859-1', 'US-ASCII', 'UTF-8'][1 + c_custkey % 6] AS charset, [1.0, 1.0, 1.0, 0.9, 0.8, 0.7][1 + c_custkey % 6]::DOUBLE AS confidence FROM customer""",
)
def _(spark, d):
    text = lambda t: F.encode(F.lit(t), "UTF-8")
    marked = lambda mark: F.concat(F.unhex(F.lit(mark)), text("0 HEAD"))
    case = F.col("c_custkey") % 6
    raw = F.when(case == 0, marked("EFBBBF")).when(case == 1, marked("FFFE")).when(case == 2, marked("FEFF"))
    raw = raw.when(case == 3, text("0 HEAD\n1 CHAR ANSEL\n")).when(case == 4, text("0 HEAD\n1 NOTE plain")).otherwise(text("0 HEAD\n1 NOTE é"))
    found = table(spark, d, "customer").select("c_custkey", gedcom.detect_encoding(raw).alias("e"))
    return found.select("c_custkey", "e.charset", "e.confidence")


# ---- raw genotypes -----------------------------------------------------------------------------

#: The first lines of a file of each vendor.
HEADS = {
    "23andme": ["# This data file generated by 23andMe", "# rsid\tchromosome\tposition\tgenotype"],
    "ancestry": ["#AncestryDNA raw data download", "rsid\tchromosome\tposition\tallele1\tallele2"],
    "myheritage": ["# MyHeritage DNA raw data.", "RSID,CHROMOSOME,POSITION,RESULT"],
    "ftdna": ["RSID,CHROMOSOME,POSITION,RESULT"],
    "livingdna": ["# Living DNA customer genotype data", "# rsid\tchromosome\tposition\tgenotype"],
}
_KIT = """SELECT 'rs' || c_custkey AS rsid, CASE c_custkey % 23 WHEN 0 THEN 23 ELSE c_custkey % 23 END AS chrom, c_custkey * 10 AS pos, ['AC', 'AC', '--', 'GG'][1 + c_custkey % 4] AS genotype FROM customer"""


def kit_file(spark, d, vendor: str) -> str:
    """A folder with one kit in the vendor's format: a row for each customer, every fourth without a call."""
    k = F.col("c_custkey")
    chrom = F.when(k % 23 == 0, "X").otherwise((k % 23).cast("string"))
    call = F.get(F.array(F.lit("AC"), F.lit("CA"), F.lit("--"), F.lit("GG")), (k % 4).cast("int"))
    alleles = [F.when(call == "--", "0").otherwise(F.substr(call, F.lit(i), F.lit(1))) for i in (1, 2)]
    values = [F.concat(F.lit("rs"), k), chrom, (k * 10).cast("string"), *(alleles if vendor == "ancestry" else [call])]
    sep, _ = dna.FORMATS[vendor]
    line = F.concat_ws(sep, *([F.concat(F.lit('"'), v, F.lit('"')) for v in values] if sep == "," else values))
    path = f"{shared_dir(spark)}/kit-{uuid.uuid4().hex}"
    spark.createDataFrame([(x,) for x in HEADS[vendor]], "value string").coalesce(1).write.text(path)
    table(spark, d, "customer").select(line.alias("value")).write.mode("append").text(path)
    return path


def _kit_query(number: int, vendor: str) -> None:
    @query(f"s{number}_{vendor}", _KIT)
    def _(spark, d):
        return dna.read_raw(spark, kit_file(spark, d, vendor), vendor).select("rsid", "chrom", "pos", "genotype")


for _number, _vendor in enumerate(dna.FORMATS, 10):
    _kit_query(_number, _vendor)


@query("s15_format_dispatch", "SELECT * FROM (VALUES ('23andme', '23andme'), ('ancestry', 'ancestry'), ('myheritage', 'myheritage'), ('ftdna', 'ftdna'), ('livingdna', 'livingdna')) t(vendor, found)")
def _(spark, d):
    return spark.createDataFrame([(v, dna.detect(head)) for v, head in HEADS.items()], "vendor string, found string")


# ---- faulty families ---------------------------------------------------------------------------

#: What a file has instead of the usual family, by its number modulo 11.
FAULTS = {1: {"twice": True}, 2: {"wife": "F"}, 3: {"mother_sex": "M"}, 4: {"bare": True}, 5: {"mother_born": 1820}, 6: {"mother_born": 1770}, 7: {"father_born": 1820}, 8: {"father_died": 1828}, 9: {"mother_died": 1795}, 10: {"father_born": 1750}}
USUAL = {"twice": False, "wife": "M", "mother_sex": "F", "bare": False, "father_born": 1800, "father_died": 1880, "mother_born": 1805, "mother_died": 1890}


def family_file(case: int) -> str:
    x = USUAL | FAULTS.get(case, {})
    child = "1 CHIL @C@\n" * (2 if x["twice"] else 1)
    bare = "0 NOTE bare\n" if x["bare"] else ""
    return (
        "0 HEAD\n1 CHAR UTF-8\n1 _VEND x\n"
        f"0 @F@ INDI\n1 NAME A /B/\n1 SEX M\n1 BIRT\n2 DATE 1 JAN {x['father_born']}\n1 DEAT\n2 DATE 1 JAN {x['father_died']}\n"
        f"0 @M@ INDI\n1 SEX {x['mother_sex']}\n1 BIRT\n2 DATE 1 JAN {x['mother_born']}\n1 DEAT\n2 DATE 1 JAN {x['mother_died']}\n"
        "0 @C@ INDI\n1 BIRT\n2 DATE 1 JUN 1830\n1 EDUC School\n1 CHAN\n2 DATE 1 JAN 2000\n"
        f"0 @U@ FAM\n1 HUSB @F@\n1 WIFE @{x['wife']}@\n{child}{bare}0 TRLR\n"
    )


def families(spark, d):
    ship(spark)
    text = F.get(F.array(*[F.lit(family_file(k)) for k in range(11)]), (F.col("c_custkey") % 11).cast("int"))
    files = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file"), text.alias("text"))
    nodes = gedcom.read_records(gedcom.read_lines(files))
    return nodes, gedcom.documents(nodes)


@query(
    "v02_v09_findings",
    """SELECT c_custkey::VARCHAR AS file, rule, severity, subject FROM customer JOIN (VALUES (1, 'duplicate_child', 'WARNING', 'U'), (2, 'duplicate_spouse', 'ERROR', 'U'), (3, 'same_sex_spouse', 'WARNING', 'U'), (4, 'missing_xref', 'ERROR', NULL),
       (5, 'mother_age', 'WARNING', 'C'), (6, 'mother_age', 'ERROR', 'C'), (7, 'father_age', 'WARNING', 'C'), (8, 'born_after_death', 'ERROR', 'C'), (9, 'death_before_birth', 'ERROR', 'M'), (9, 'born_after_death', 'ERROR', 'C'),
       (10, 'father_age', 'ERROR', 'C')) v(k, rule, severity, subject) ON c_custkey % 11 = k""",
)
def _(spark, d):
    nodes, docs = families(spark, d)
    found = Q.validate({
        "nodes": nodes, "docs": docs, "refs": gedcom.references(nodes, docs), "persons": gedcom.persons(nodes, docs), "families": gedcom.families(nodes, docs),
        "children": gedcom.family_children(nodes, docs), "events": gedcom.events(nodes, docs),
    })
    # a record without an xref is named by its line
    return found.select("file", "rule", "severity", F.when(F.col("rule") != "missing_xref", F.col("subject")).alias("subject"))


@query("s09_quarantine_kinds", "SELECT c_custkey::VARCHAR AS file, kind, tag, value FROM customer, (VALUES ('HEAD', '_VEND', 'x'), ('INDI', 'CHAN', NULL), ('INDI', 'DATE', '1 JAN 2000')) v(kind, tag, value)")
def _(spark, d):
    nodes, docs = families(spark, d)
    return gedcom.quarantine(nodes, docs).join(nodes, ["file", "no"]).select("file", "kind", "tag", F.nullif("value", F.lit("")).alias("value"))


@query("s08_attributes", "SELECT c_custkey::VARCHAR AS file, 'C' AS xref, 'EDUC' AS type FROM customer")
def _(spark, d):
    nodes, docs = families(spark, d)
    return gedcom.events(nodes, docs).where("type NOT IN ('BIRT', 'DEAT')").select("file", "xref", "type")


# ---- dates -------------------------------------------------------------------------------------

_YEAR = "1700 + o_orderkey % 199"


@query(
    "f21_dates",
    f"""WITH y AS (SELECT o_orderkey, o_orderkey % 8 AS k, {_YEAR} AS y FROM orders)
        SELECT o_orderkey, CASE k WHEN 1 THEN NULL WHEN 2 THEN (y + 1) || '-01-01' WHEN 6 THEN (y + 1) || '-01-01' WHEN 7 THEN y || '-01-' || (CASE WHEN y <= 1700 THEN 11 WHEN y <= 1800 THEN 12 ELSE 13 END) ELSE y || '-01-01' END AS lower,
        CASE k WHEN 0 THEN (y + 5) || '-12-31' WHEN 1 THEN (y - 1) || '-12-31' WHEN 2 THEN NULL WHEN 3 THEN (y + 3) || '-12-31' WHEN 6 THEN (y + 1) || '-12-31' WHEN 7 THEN y || '-01-' || (CASE WHEN y <= 1700 THEN 11 WHEN y <= 1800 THEN 12 ELSE 13 END)
        ELSE y || '-12-31' END AS upper, CASE k WHEN 1 THEN 'BEF' WHEN 2 THEN 'AFT' WHEN 4 THEN 'INT' WHEN 5 THEN 'EST' ELSE 'none' END AS qualifier FROM y""",
)
def _(spark, d):
    y = F.lit(1700) + F.col("o_orderkey") % 199
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    forms = [
        text("BET ", y, " AND ", y + 5), text("BEF ", y), text("AFT ", y), text("FROM ", y, " TO ", y + 3), text("INT ", y, " (as read)"), text("EST ", y),
        text(y, "/", F.lpad(((y + 1) % 100).cast("string"), 2, "0")), text("@#DJULIAN@ 1 JAN ", y),
    ]
    rows = table(spark, d, "orders").select("o_orderkey", F.get(F.array(*forms), (F.col("o_orderkey") % 8).cast("int")).alias("raw"))
    parsed = dates.with_dates(rows, "raw", "d")
    return parsed.select("o_orderkey", F.col("d.lower").cast("string").alias("lower"), F.col("d.upper").cast("string").alias("upper"), "d.qualifier")
