"""Vendor files of raw genotypes and genetic maps, by Spark's own text and CSV readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_CALL = "--"
#: Fixed formats: separator, column names, and whether a header row stands without a comment mark.
FORMATS = {
    "23andme": ("\t", ["rsid", "chrom", "pos", "genotype"]),
    "ancestry": ("\t", ["rsid", "chrom", "pos", "allele1", "allele2"]),
    "myheritage": (",", ["rsid", "chrom", "pos", "genotype"]),
    "ftdna": (",", ["rsid", "chrom", "pos", "genotype"]),
    "livingdna": ("\t", ["rsid", "chrom", "pos", "genotype"]),
}


def detect(lines: list[str]) -> str:
    """The vendor by the first lines; the order of the tests matters, as formats share columns."""
    head = "\n".join(lines).lower()
    body = [x for x in lines if x.strip() and not x.startswith("#")]
    first = body[0].lower() if body else ""
    if "23andme" in head:
        return "23andme"
    if "ancestrydna" in head or "allele1" in head:
        return "ancestry"
    if "myheritage" in head or (head.startswith("#") and "rsid,chromosome,position,result" in head.replace('"', "")):
        return "myheritage"
    if first.replace('"', "").startswith("rsid,chromosome,position,result"):
        return "ftdna"
    if "living dna" in head or "livingdna" in head or "rsid\tchromosome\tposition\tgenotype" in head:
        return "livingdna"
    raise ValueError("unknown raw-data format")


def chromosome(c: Column) -> Column:
    """1 to 22, X 23, Y 24, MT 25; null for anything else."""
    c = F.upper(F.trim(c))
    named = F.when(c == "X", 23).when(c == "Y", 24).when(c.isin("MT", "M"), 25)
    number = c.try_cast("int")
    return F.coalesce(named, F.when(number.between(1, 25), number))


def genotype(a: Column, b: Column | None = None) -> Column:
    """Alleles in order; ``--`` for a no-call."""
    raw = F.upper(F.trim(a if b is None else F.concat(a, b)))
    raw = F.when(raw.rlike("^[ACGTDI]{1,2}$"), raw).otherwise(NO_CALL)
    return F.array_join(F.array_sort(F.split(raw, "")), "")


def read_raw(spark: SparkSession, path: str, vendor: str | None = None) -> DataFrame:
    """(rsid, chrom, pos, genotype, line): one kit's rows; header and malformed rows drop.

    The vendor is told from the first 20 lines. ``line`` keeps the order of duplicates.
    """
    vendor = vendor or detect([r[0] for r in spark.read.text(path).limit(20).collect()])
    sep, names = FORMATS[vendor]
    schema = ", ".join(f"{n} string" for n in names)
    rows = spark.read.schema(schema).csv(path, sep=sep, comment="#", quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    call = genotype(F.col("allele1"), F.col("allele2")) if "allele1" in names else genotype(F.col("genotype"))
    out = rows.select("rsid", chromosome(F.col("chrom")).alias("chrom"), F.col("pos").try_cast("int").alias("pos"), call.alias("genotype"), F.monotonically_increasing_id().alias("line"))
    return out.where("chrom IS NOT NULL AND pos IS NOT NULL AND rsid IS NOT NULL AND lower(rsid) <> 'rsid'")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, cm) of a folder of files named by chromosome; columns are split at blanks, headers drop."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.col("_metadata.file_name").alias("file"))
    chrom = F.regexp_extract("file", r"(?i)chr(\d+|X)", 1)
    out = rows.select(F.when(F.upper(chrom) == "X", 23).otherwise(chrom.try_cast("int")).alias("chrom"), F.get("c", 0).try_cast("long").alias("pos"), F.element_at("c", -1).try_cast("double").alias("cm"))
    return out.where("pos IS NOT NULL AND cm IS NOT NULL")


def map_breaks(points: DataFrame) -> DataFrame:
    """Map points whose position does not rise: a valid map has none."""
    from pyspark.sql import Window

    prev = F.lag("pos").over(Window.partitionBy("chrom").orderBy("cm", "pos"))
    return points.withColumn("prev", prev).where("pos <= prev").select("chrom", "pos")


def infer_sex(rows: DataFrame, least: int = 10) -> DataFrame:
    """(calls, sex): male from enough called positions of Y, else female where X was read, else unknown."""
    called = F.col("genotype") != NO_CALL
    y, x = F.count_if(called & (F.col("chrom") == 24)), F.count_if(called & (F.col("chrom") == 23))
    return rows.agg(y.alias("y_calls"), F.when(y >= least, "M").when(x > 0, "F").otherwise("U").alias("sex"))
