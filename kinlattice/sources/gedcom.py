"""Genealogical text files as tables: lines, record trees, entities, quarantine, and the way back to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import phonetic
from ..storage import Shelf, ship

#: Lines of a bin: running values of a file are carried from bin to bin, so a huge file is no single task.
BIN = 20_000
#: Fixed grammar: level, optional xref, tag, optional value.
LINE = r"^\s*(\d{1,2})\s+(?:@([^@]+)@\s+)?([A-Za-z0-9_]+)(?: (.*))?$"
#: Fixed tags.
PERSON_EVENTS = [
    "BIRT", "CHR", "DEAT", "BURI", "CREM", "ADOP", "BAPM", "BARM", "BASM", "BLES", "CHRA", "CONF", "FCOM", "ORDN", "NATU", "EMIG", "IMMI", "CENS", "PROB", "WILL", "GRAD", "RETI", "EVEN",
    "CAST", "DSCR", "EDUC", "IDNO", "NATI", "NCHI", "NMR", "OCCU", "PROP", "RELI", "RESI", "SSN", "TITL", "FACT",
]
FAMILY_EVENTS = ["ANUL", "CENS", "DIV", "DIVF", "ENGA", "MARB", "MARC", "MARR", "MARL", "MARS", "RESI", "EVEN"]
#: Direct children that an extractor reads, by kind of record; all others are quarantined.
KNOWN_TAGS = {
    "INDI": ["NAME", "SEX", "FAMS", "FAMC", "NOTE", "SOUR", "OBJE", *PERSON_EVENTS],
    "FAM": ["HUSB", "WIFE", "CHIL", "NOTE", "SOUR", "OBJE", *FAMILY_EVENTS],
    "SOUR": ["TITL", "AUTH", "PUBL", "ABBR", "TEXT", "REPO", "DATA", "NOTE", "OBJE"],
    "NOTE": ["CONC", "CONT", "SOUR"], "OBJE": ["FILE", "FORM", "TITL", "NOTE", "SOUR", "_FILE"],
    "REPO": ["NAME", "ADDR", "PHON", "EMAIL", "WWW", "NOTE"], "SUBM": ["NAME", "ADDR", "PHON", "EMAIL", "WWW", "LANG", "RFN", "RIN", "NOTE"],
    "HEAD": ["GEDC", "SOUR", "DEST", "DATE", "SUBM", "SUBN", "FILE", "COPR", "CHAR", "LANG", "NOTE"],
}


def detect_encoding(raw: Column) -> Column:
    """(charset, confidence): byte-order mark, then the CHAR line of the first 4096 bytes, then the bytes' look."""
    head = F.substring(raw, 1, 4096)
    mark = F.hex(F.substring(raw, 1, 3))
    said = F.upper(F.regexp_extract(F.decode(head, "ISO-8859-1"), r"(?m)^\s*1 CHAR ([^\r\n]+)", 1))
    named = F.when(said.rlike("UTF-?8"), "UTF-8").when(said.rlike("UNICODE|UTF-?16"), "UTF-16LE").when(said.rlike("ASCII"), "US-ASCII").when(said.rlike("ANSEL|ANSI|8859"), "ISO-8859-1").when(said.rlike("1251|CYRILLIC"), "windows-1251")
    ascii_only = ~F.decode(raw, "ISO-8859-1").rlike(r"[^\x00-\x7F]")
    row = lambda name, sure: F.struct(F.lit(name).alias("charset") if isinstance(name, str) else name.alias("charset"), F.lit(sure).alias("confidence"))
    return (
        F.when(mark.startswith("EFBBBF"), row("UTF-8", 1.0)).when(mark.startswith("FFFE"), row("UTF-16LE", 1.0)).when(mark.startswith("FEFF"), row("UTF-16BE", 1.0))
        .when(named.isNotNull(), row(named, 0.9)).when(ascii_only, row("US-ASCII", 0.8)).when(F.is_valid_utf8(raw.cast("string")), row("UTF-8", 0.7)).otherwise(row("windows-1251", 0.3))
    )


@F.pandas_udf(T.StringType())
def _decode(raw, charset):
    """Charsets that the built-in ``decode`` does not take."""
    import pandas as pd

    return pd.Series([bytes(r).decode({"windows-1251": "cp1251"}.get(c, c), "replace") for r, c in zip(raw, charset, strict=True)])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, charset, confidence), a row a file. ``path`` may be any store that Spark reads."""
    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", detect_encoding(F.col("content")).alias("e"))
    native = ["UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16LE", "UTF-16BE"]
    text = lambda name: F.decode("content", name)
    some = raw.where(F.col("e.charset").isin(native))
    chosen = F.when(F.col("e.charset") == "UTF-16LE", text("UTF-16LE")).when(F.col("e.charset") == "UTF-16BE", text("UTF-16BE")).when(F.col("e.charset") == "UTF-8", F.try_validate_utf8(F.col("content").cast("string"))).otherwise(text("ISO-8859-1"))
    rest = raw.where(~F.col("e.charset").isin(native)).withColumn("text", _decode("content", "e.charset"))
    out = some.withColumn("text", F.coalesce(chosen, text("ISO-8859-1"))).unionByName(rest)
    return out.select("file", F.regexp_replace("text", "^﻿", "").alias("text"), "e.charset", "e.confidence")


def binned(df: DataFrame) -> DataFrame:
    """``df`` with ``_bin``, the bin of each line."""
    return df.withColumn("_bin", F.floor(F.col("no") / BIN))


def carried(df: DataFrame, **values: Column) -> DataFrame:
    """Binned lines, without ``_bin``, with the largest value so far of each of ``values``, up to and with each line: within bins, then across them.

    What grows with the line number, as the number itself does, is so the last value.
    """
    rows = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    inner = Window.partitionBy("file", "_bin").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("file", "_bin").agg(*(F.max(f"_v_{k}").alias(f"_end_{k}") for k in values))
    before = Window.partitionBy("file").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("file", "_bin", *(F.max(f"_end_{k}").over(before).alias(f"_carry_{k}") for k in values))
    rows = rows.withColumns({f"_in_{k}": F.max(f"_v_{k}").over(inner) for k in values}).join(bins, ["file", "_bin"])
    rows = rows.withColumns({k: F.coalesce(f"_in_{k}", f"_carry_{k}") for k in values})
    return rows.drop("_bin", *(f"_{part}_{k}" for part in ("v", "in", "carry") for k in values))


def read_lines(texts: DataFrame) -> DataFrame:
    """(file, no, level, xref, tag, value): logical lines, continuations folded in.

    CONT adds a line break and its text, CONC its text, but only to the line right above them in the
    hierarchy while that one is open; otherwise they are lost. A line that cannot be read continues the open one.
    The result is written to the shared folder, as every extractor reads it.
    """
    shelf = Shelf(texts.sparkSession)
    # whole files are few, large rows: dealt evenly before they are split
    dealt = texts.select("file", "text").repartition(max(2, texts.sparkSession.sparkContext.defaultParallelism))
    split = dealt.select("file", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("no", "line")).where("trim(line) <> ''")
    part = lambda k: F.regexp_extract("line", LINE, k)
    ok = part(1) != ""
    rows = split.select("file", "no", "line", F.when(ok, part(1).cast("int")).alias("level"), F.nullif(part(2), F.lit("")).alias("xref"), F.when(ok, F.upper(part(3))).alias("tag"), F.when(ok, part(4)).alias("value"))
    more = F.col("tag").isin("CONT", "CONC") | F.col("tag").isNull()
    rows = shelf.put(rows)
    # the next line tells whether a line is continued; that of a bin's last line is not known
    following = F.lead(more).over(Window.partitionBy("file", "_bin").orderBy("no"))
    marked = binned(rows).withColumn("_more", more).withColumn("_continued", F.coalesce(following, F.lit(True)))
    # a line's number and its level, below 100, as one number
    opened = carried(marked, open=F.when(~more, F.col("no").cast("long") * 100 + F.col("level")))
    opened = shelf.put(opened.where("open IS NOT NULL"))
    names = ["file", "no", "level", "xref", "tag", "value"]
    text = F.when(F.col("tag") == "CONC", F.coalesce("value", F.lit(""))).otherwise(F.concat(F.lit("\n"), F.coalesce("value", "line")))
    taken = opened.where("_more").where(F.col("tag").isNull() | (F.col("level") == F.pmod("open", F.lit(100)) + 1))
    more_rows = taken.groupBy("file", F.floor(F.col("open") / 100).cast("int").alias("no")).agg(F.array_sort(F.collect_list(F.struct(F.col("no").alias("at"), text.alias("t")))).alias("more"))
    # few lines are continued: only those are gathered and joined
    lines = opened.where("NOT _more AND _continued").select(*names).join(more_rows, ["file", "no"], "left")
    tail = F.array_join(F.transform("more", lambda m: m["t"]), "")
    value = F.when(F.col("more").isNull(), F.col("value")).when(F.col("value").isNull() & (tail == ""), F.lit(None)).otherwise(F.concat(F.coalesce("value", F.lit("")), tail))
    alone = opened.where("NOT _more AND NOT _continued").select(*names)
    out = shelf.put(alone.unionByName(lines.withColumn("value", value).select(*names)))
    shelf.drop(rows, opened)
    return out


def read_records(lines: DataFrame) -> DataFrame:
    """``lines`` with ``root`` (line of the level-0 record) and ``parent``.

    The parent is the nearest line above with a lower level, also where levels jump. Lines above a file's
    first record are dropped. Written like the lines.
    """
    deepest = lines.agg(F.max("level")).first()[0] or 0
    # the last line of each level so far; those of a former record are above the root, so never the nearest
    last = {f"_last{k}": F.when(F.col("level") == k, F.col("no")) for k in range(max(1, deepest))}
    rows = carried(binned(lines), **last).where("_last0 IS NOT NULL")
    lower = F.slice(F.array(*last), F.lit(1), F.col("level"))
    parent = F.when(F.col("level") > 0, F.array_max(lower))
    return Shelf(lines.sparkSession).put(rows.select(*lines.columns, F.col("_last0").alias("root"), parent.alias("parent")))


def documents(nodes: DataFrame) -> DataFrame:
    """(file, root, tag, xref): the records that count: the first HEAD, and of repeated xrefs the last; no TRLR."""
    top = nodes.where("level = 0 AND tag <> 'TRLR'").select("file", F.col("no").alias("root"), "tag", "xref")
    head = top.where("tag = 'HEAD'").groupBy("file").agg(F.min("root").alias("root")).select("file", "root", F.lit("HEAD").alias("tag"), F.lit(None).cast("string").alias("xref"))
    rest = top.where("tag <> 'HEAD' AND xref IS NOT NULL").groupBy("file", "tag", "xref").agg(F.max("root").alias("root"))
    return head.unionByName(rest.select("file", "root", "tag", "xref"))


def child_rows(nodes: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(file, up, no, tag, value) of nodes with one of the tags."""
    return nodes.where(F.col("tag").isin(list(tags)) & (F.col("level") > 0)).select("file", F.col("parent").alias("up"), "no", "tag", "value")


def pivoted(owners: DataFrame, nodes: DataFrame, tags: Sequence[str], key: str = "no") -> DataFrame:
    """``owners`` with a column for the first child of each tag. One join and one aggregate for all tags."""
    rows = child_rows(nodes, tags)
    first = [F.min_by(F.when(F.col("tag") == t, F.col("value")), F.when(F.col("tag") == t, F.col("no"))).alias(t.lower()) for t in tags]
    side = rows.groupBy("file", "up").agg(*first).withColumnRenamed("up", key)
    return owners.join(side, ["file", key], "left")


def pointer(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"^@([^@]+)@$", 1), F.lit(""))


def of_kind(nodes: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    return docs.where(F.col("tag") == tag).select("file", "root", "xref")


def persons(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(file, xref, sex, root)."""
    own = of_kind(nodes, docs, "INDI").withColumnRenamed("root", "no")
    sex = F.upper(F.trim("sex"))
    return pivoted(own, nodes, ["SEX"]).select("file", "xref", F.when(sex.isin("M", "F", "X"), sex).otherwise("U").alias("sex"), F.col("no").alias("root"))


def names(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(file, xref, sort_order, given, surname, suffix, nickname): parts of the value, overridden by sub-lines."""
    own = of_kind(nodes, docs, "INDI").withColumnRenamed("root", "up")
    rows = own.join(child_rows(nodes, ["NAME"]), ["file", "up"])
    rows = pivoted(rows, nodes, ["GIVN", "SURN", "NSFX", "NICK"]).withColumn("n", phonetic.gedcom_name(F.coalesce("value", F.lit(""))))
    order = F.row_number().over(Window.partitionBy("file", "xref").orderBy("no")) - 1
    return rows.select("file", "xref", order.alias("sort_order"), F.coalesce("givn", "n.given").alias("given"), F.coalesce("surn", "n.surname").alias("surname"), F.coalesce("nsfx", "n.suffix").alias("suffix"), F.col("nick").alias("nickname"))


def events(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(file, owner, kind, xref, no, type, custom, date_raw, place_raw) of people and families, in order."""
    out = None
    for tag, tags in (("INDI", PERSON_EVENTS), ("FAM", FAMILY_EVENTS)):
        own = of_kind(nodes, docs, tag).withColumnRenamed("root", "up")
        part = own.join(child_rows(nodes, tags), ["file", "up"]).withColumn("owner", F.lit(tag))
        out = part if out is None else out.unionByName(part)
    out = pivoted(out.withColumnRenamed("value", "own_value"), nodes, ["DATE", "PLAC", "TYPE"])
    return out.select("file", "owner", "xref", "no", F.col("tag").alias("type"), F.when(F.col("tag").isin("EVEN", "FACT"), F.coalesce("type", "own_value")).alias("custom"), F.col("date").alias("date_raw"), F.trim("plac").alias("place_raw"))


def families(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(file, xref, husband, wife, root)."""
    own = of_kind(nodes, docs, "FAM").withColumnRenamed("root", "no")
    rows = pivoted(own, nodes, ["HUSB", "WIFE"])
    return rows.select("file", "xref", pointer(F.col("husb")).alias("husband"), pointer(F.col("wife")).alias("wife"), F.col("no").alias("root"))


def family_children(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(file, xref, child, position)."""
    own = of_kind(nodes, docs, "FAM").withColumnRenamed("root", "up")
    rows = own.join(child_rows(nodes, ["CHIL"]), ["file", "up"]).withColumn("child", pointer(F.col("value"))).where("child IS NOT NULL")
    order = F.row_number().over(Window.partitionBy("file", "xref").orderBy("no")) - 1
    return rows.select("file", "xref", "child", order.alias("position"))


def sources(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    own = of_kind(nodes, docs, "SOUR").withColumnRenamed("root", "no")
    return pivoted(own, nodes, ["TITL", "AUTH", "ABBR"]).select("file", "xref", F.col("titl").alias("title"), F.col("auth").alias("author"), F.col("abbr").alias("abbreviation"))


def citations(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(file, owner_no, source, page, quay): SOUR lines that point to a source record of the file; others drop."""
    rows = child_rows(nodes, ["SOUR"]).withColumn("source", pointer(F.col("value")))
    rows = pivoted(rows.where("source IS NOT NULL"), nodes, ["PAGE", "QUAY"])
    known = docs.where("tag = 'SOUR'").select("file", F.col("xref").alias("source"))
    out = rows.join(known, ["file", "source"], "left_semi")
    return out.select("file", F.col("up").alias("owner_no"), "source", "page", F.col("quay").try_cast("int").alias("quay"))


def places(event_rows: DataFrame) -> DataFrame:
    """Distinct trimmed places of a file with their levels, the most local first."""
    raw = event_rows.where("place_raw <> ''").select("file", "place_raw").distinct()
    return raw.select("file", "place_raw", F.transform(F.split("place_raw", ","), lambda x: F.trim(x)).alias("levels"))


def references(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(file, xref, kind, field, target): every pointer of a record's own lines."""
    rows = nodes.where("level = 1").select("file", "root", F.col("tag").alias("field"), pointer(F.col("value")).alias("target")).where("target IS NOT NULL")
    return rows.join(docs.select("file", "root", "xref", F.col("tag").alias("kind")), ["file", "root"]).select("file", "xref", "kind", "field", "target")


def quarantine(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(file, owner, kind, no, top): lines of direct children with unknown tags, and of unknown records whole."""
    table = [(k, t) for k, tags in KNOWN_TAGS.items() for t in tags]
    known = F.broadcast(nodes.sparkSession.createDataFrame(table, "kind string, tag string"))  # a fixed table
    tops = nodes.where("level = 1").join(docs.where(F.col("tag").isin(list(KNOWN_TAGS))).select("file", "root", F.col("xref").alias("owner"), F.col("tag").alias("kind")), ["file", "root"])
    odd = tops.join(known, ["kind", "tag"], "left_anti").select("file", "owner", "kind", F.col("no").alias("top"), "root")
    above = Window.partitionBy("file", "root").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    first = nodes.withColumn("top", F.last(F.when(F.col("level") == 1, F.col("no")), ignorenulls=True).over(above))
    inside = first.select("file", "no", "top").join(odd.drop("root"), ["file", "top"]).select("file", "owner", "kind", "no", "top")
    whole = nodes.where("level = 0").where(~F.col("tag").isin("TRLR", *KNOWN_TAGS)).select("file", F.col("xref").alias("owner"), F.col("tag").alias("kind"), F.col("no").alias("root"))
    rest = nodes.select("file", "no", "root").join(whole, ["file", "root"]).select("file", "owner", "kind", "no", F.col("root").alias("top"))
    return inside.unionByName(rest)


def write_lines(nodes: DataFrame) -> DataFrame:
    """(file, no, sub, line): text lines in order; line breaks of a value become CONT lines, CONC is never written."""
    parts = F.split(F.coalesce("value", F.lit("")), "\n", -1)
    rows = nodes.select("file", "no", "level", "xref", "tag", F.posexplode(parts).alias("sub", "part"))
    head = F.concat_ws(" ", F.col("level").cast("string"), F.when(F.col("xref").isNotNull(), F.concat(F.lit("@"), "xref", F.lit("@"))), "tag", F.nullif("part", F.lit("")))
    more = F.concat_ws(" ", (F.col("level") + 1).cast("string"), F.lit("CONT"), F.nullif("part", F.lit("")))
    return rows.select("file", "no", "sub", F.when(F.col("sub") == 0, head).otherwise(more).alias("line"))


def inject(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """Lines of ``tags`` (file, owner, no, level, xref, tag, value) put at the end of their owners' records.

    Owners that are not there drop. The result orders by (root, at, no).
    """
    roots = nodes.where("level = 0").select("file", F.col("xref").alias("owner"), "root")
    extra = tags.join(roots, ["file", "owner"]).select("file", "no", "level", "xref", "tag", "value", "root", F.lit(1).alias("at"))
    return nodes.select("file", "no", "level", "xref", "tag", "value", "root", F.lit(0).alias("at")).unionByName(extra)


def segments(texts: DataFrame) -> DataFrame:
    """Files that hold several documents, one after the other, as one row each: (file, text) with ``#k`` added."""
    parts = F.split("text", r"(?m)^(?=0 HEAD)")
    rows = texts.select("file", F.posexplode(F.filter(parts, lambda x: F.trim(x) != "")).alias("k", "text"))
    return rows.select(F.concat_ws("#", "file", F.col("k").cast("string")).alias("file"), "text")


def statistics(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, records, persons, families, sources, lines)."""
    n = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    is_ = lambda t: F.count_if(F.col("tag") == t)
    return docs.groupBy("file").agg(F.count(F.lit(1)).alias("records"), is_("INDI").alias("persons"), is_("FAM").alias("families"), is_("SOUR").alias("sources")).join(n, "file")
