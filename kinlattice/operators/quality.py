"""Validation of families and people, and what an export to another program would lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates

#: Rows of a curated table that are broadcast.
BROADCAST_ROWS = 100_000
FINDING = ["file", "rule", "severity", "subject", "detail"]


def finding(df: DataFrame, rule: str, severity: Column | str, subject: Column, detail: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("file", F.lit(rule).alias("rule"), severity.alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def broken_references(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pointers to records that are not there: errors for lineage fields, else warnings."""
    known = docs.where("xref IS NOT NULL").select("file", F.col("xref").alias("target")).distinct()
    bad = refs.join(known, ["file", "target"], "left_anti")
    severity = F.when(F.col("field").isin("HUSB", "WIFE", "CHIL", "FAMS", "FAMC"), "ERROR").otherwise("WARNING")
    return finding(bad, "broken_xref", severity, F.col("xref"), F.concat_ws(" ", "field", "target"))


def duplicate_children(children: DataFrame) -> DataFrame:
    twice = children.groupBy("file", "xref", "child").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return finding(twice, "duplicate_child", "WARNING", F.col("xref"), F.col("child"))


def same_spouses(families: DataFrame) -> DataFrame:
    return finding(families.where("husband = wife"), "duplicate_spouse", "ERROR", F.col("xref"), F.col("husband"))


def same_sex_spouses(families: DataFrame, persons: DataFrame) -> DataFrame:
    sex = lambda who: persons.select("file", F.col("xref").alias(who), F.col("sex").alias(f"{who}_sex"))
    both = families.where("husband <> wife").join(sex("husband"), ["file", "husband"]).join(sex("wife"), ["file", "wife"])
    return finding(both.where("husband_sex = wife_sex AND husband_sex IN ('M', 'F')"), "same_sex_spouse", "WARNING", F.col("xref"), F.col("husband_sex"))


def missing_xref(nodes: DataFrame) -> DataFrame:
    bare = nodes.where("level = 0 AND xref IS NULL AND tag NOT IN ('HEAD', 'TRLR')")
    return finding(bare, "missing_xref", "ERROR", F.col("no"), F.col("tag"))


def lives(events: DataFrame) -> DataFrame:
    """(file, xref, birth, death): the first dated birth and death, as date intervals."""
    dated = dates.with_dates(events.where("owner = 'INDI' AND type IN ('BIRT', 'DEAT') AND date_raw IS NOT NULL"), "date_raw", "d")
    dated = dated.where("d.lower IS NOT NULL OR d.upper IS NOT NULL")
    one = lambda t: F.min_by(F.when(F.col("type") == t, F.struct("d.lower", "d.upper")), F.when(F.col("type") == t, F.col("no")))
    return dated.groupBy("file", "xref").agg(one("BIRT").alias("birth"), one("DEAT").alias("death"))


def parents(families: DataFrame, children: DataFrame, life: DataFrame) -> DataFrame:
    """(file, xref, child, parent, role, birth, parent_birth, parent_death)."""
    long = families.select("file", "xref", F.explode(F.array(F.struct(F.lit("father").alias("role"), F.col("husband").alias("parent")), F.struct(F.lit("mother").alias("role"), F.col("wife").alias("parent")))).alias("x")).select("file", "xref", "x.*")
    pairs = long.where("parent IS NOT NULL").join(children.select("file", "xref", "child").distinct(), ["file", "xref"])
    pairs = pairs.join(life.select("file", F.col("xref").alias("child"), "birth"), ["file", "child"])
    return pairs.join(life.select("file", F.col("xref").alias("parent"), F.col("birth").alias("parent_birth"), F.col("death").alias("parent_death")), ["file", "parent"])


#: Youngest usual and oldest possible age of a parent.
AGES = {"mother": (13, 55), "father": (14, 75)}


def parent_ages(pairs: DataFrame) -> DataFrame:
    """Parents too young (warning) or too old (error) at the birth, in years between the lower bounds."""
    rows = pairs.where("birth.lower IS NOT NULL AND parent_birth.lower IS NOT NULL").withColumn("age", F.year("birth.lower") - F.year("parent_birth.lower"))
    out = None
    for role, (low, high) in AGES.items():
        odd = rows.where((F.col("role") == role) & ((F.col("age") < low) | (F.col("age") > high)))
        part = finding(odd, f"{role}_age", F.when(F.col("age") < low, "WARNING").otherwise("ERROR"), F.col("child"), F.concat_ws(" ", "parent", F.col("age").cast("string")))
        out = part if out is None else out.unionByName(part)
    return out


def born_after_death(pairs: DataFrame) -> DataFrame:
    """Children born after the mother's death, or more than 305 days after the father's; month-precise dates only."""
    rows = pairs.where(dates.month_precise(F.col("birth")) & dates.month_precise(F.col("parent_death")))
    slack = F.when(F.col("role") == "father", 305).otherwise(0)
    late = rows.where(F.col("birth.lower") > F.date_add(F.col("parent_death.upper"), slack))
    return finding(late, "born_after_death", "ERROR", F.col("child"), F.concat_ws(" ", "role", "parent"))


def death_before_birth(life: DataFrame) -> DataFrame:
    bad = life.where(F.year("death.upper") < F.year("birth.lower"))
    return finding(bad, "death_before_birth", "ERROR", F.col("xref"), F.year("death.upper"))


def validate(doc: dict[str, DataFrame]) -> DataFrame:
    """All findings of a document given as tables: nodes, docs, refs, persons, families, children, events."""
    life = lives(doc["events"])
    pairs = parents(doc["families"], doc["children"], life)
    found = [
        broken_references(doc["refs"], doc["docs"]), duplicate_children(doc["children"]), same_spouses(doc["families"]), same_sex_spouses(doc["families"], doc["persons"]),
        missing_xref(doc["nodes"]), parent_ages(pairs), born_after_death(pairs), death_before_birth(life),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def dropped_tags(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, no, tag, rule, weight): lines that a target drops; ``KIND.TAG`` rules beat ``TAG``, those ``TAG*``.

    ``rules``: (pattern, rule, weight), a small curated table.
    """
    kinds = nodes.where("level = 0").select("file", "root", F.col("tag").alias("kind"))
    rows = nodes.where("level > 0").join(kinds, ["file", "root"]).select("file", "no", "kind", "tag")
    r = F.broadcast(rules) if rules.count() <= BROADCAST_ROWS else rules
    full = rows.withColumn("pattern", F.explode(F.array(F.concat_ws(".", "kind", "tag"), "tag", F.concat(F.left("tag", F.lit(1)), F.lit("*")))))
    rank = F.when(F.col("pattern").contains("."), 0).when(F.col("pattern").endswith("*"), 2).otherwise(1)
    hits = full.join(r, "pattern").withColumn("_k", rank)
    return hits.groupBy("file", "no", "tag").agg(F.min_by(F.struct("rule", "weight"), F.struct("_k", "rule")).alias("x")).select("file", "no", "tag", "x.*")


def charset_losses(rows: DataFrame, text: str, substitutes: dict[str, str]) -> DataFrame:
    """``rows`` with ``exported``: substitutes first, then ``?`` for what is left beyond ASCII, and ``lost``, its count."""
    out = F.col(text)
    for a, b in substitutes.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    lost = F.char_length(F.regexp_replace(out, r"[\x00-\x7F]", ""))
    return rows.withColumns({"exported": F.regexp_replace(out, r"[^\x00-\x7F]", "?"), "lost": lost})


def triggers(nodes: DataFrame, needs: dict[str, str]) -> DataFrame:
    """(file, feature): structures present in a file; ``needs`` maps a feature to a condition over its lines."""
    flags = nodes.groupBy("file").agg(*[F.bool_or(F.expr(c)).alias(f) for f, c in needs.items()])
    pairs = F.array(*[F.when(F.col(f), F.lit(f)) for f in needs])
    return flags.select("file", F.explode(F.array_compact(pairs)).alias("feature"))


def export_audit(nodes: DataFrame, rules: DataFrame, persons: DataFrame, severity: float = 0.01) -> DataFrame:
    """(file, dropped, loss): rule weights and a charge for each dropped line, over the people; 0 to 1."""
    hits = dropped_tags(nodes, rules).groupBy("file").agg(F.count(F.lit(1)).alias("dropped"), F.sum("weight").alias("w"))
    size = persons.groupBy("file").agg(F.count(F.lit(1)).alias("people"))
    rows = size.join(hits, "file", "left").na.fill({"dropped": 0, "w": 0.0})
    loss = (F.col("w") + severity * F.col("dropped")) / F.greatest(F.lit(1), F.col("people"))
    return rows.select("file", "dropped", F.least(F.lit(1.0), F.greatest(F.lit(0.0), loss)).alias("loss"))


def identities(matches: DataFrame, least: int = 3) -> DataFrame:
    """(email_hash, platforms): one person's kits on ``least`` or more platforms, by their contact digest.

    A name that also appears with another digest does not join its bearers.
    """
    known = matches.where("email_hash IS NOT NULL")
    return known.groupBy("email_hash").agg(F.count_distinct("platform").alias("platforms")).where(F.col("platforms") >= least)


def separated_populations(links: DataFrame) -> DataFrame:
    """(a, b, verdict): links between clusters of different populations are crossovers unless endorsed by a source."""
    verdict = F.when(F.col("population_a") == F.col("population_b"), "same").when(F.col("sources") > 0, "documented").otherwise("crossover")
    return links.select("a", "b", verdict.alias("verdict"))


def founder_loops(links: DataFrame, least: int = 3, small_cm: float = 15.0) -> DataFrame:
    """(a, b): links that many small segments carry and no source supports: shared founders, not a near relation."""
    few = links.groupBy("a", "b").agg(F.count_if(F.col("cm") < small_cm).alias("small"), F.max("cm").alias("longest"), F.max("sources").alias("sources"))
    return few.where((F.col("small") >= least) & (F.col("longest") < small_cm) & (F.col("sources") == 0)).select("a", "b")


def preferred_facts(snippets: DataFrame) -> DataFrame:
    """(subject, fact, value, overridden): the primary source's value, and whether a derivative one differs."""
    order = F.struct(F.when(F.col("source_class") == "primary", 0).otherwise(1), F.col("snippet"))
    chosen = snippets.groupBy("subject", "fact").agg(F.min_by("value", order).alias("value"), F.count_distinct("value").alias("n"))
    return chosen.select("subject", "fact", "value", (F.col("n") > 1).alias("overridden"))


def household_drift(entries: DataFrame, tolerance: int = 3) -> DataFrame:
    """(household, name, drift, state): age change against the years between two revisions; absence proves nothing."""
    order = Window.partitionBy("household", "name").orderBy("year")
    rows = entries.withColumns({"_y": F.lag("year").over(order), "_a": F.lag("age").over(order)})
    drift = (F.col("age") - F.col("_a")) - (F.col("year") - F.col("_y"))
    state = F.when(F.col("_y").isNull(), "single").when(F.abs(drift) <= tolerance, "consistent").otherwise("drift")
    return rows.select("household", "name", "year", drift.alias("drift"), state.alias("state"))


def jurisdictions(events: DataFrame, spans: DataFrame) -> DataFrame:
    """(event, place, jurisdiction) in force in the event's year. ``spans``: (place, valid_from, valid_to, jurisdiction), open ends null."""
    both = events.join(spans, "place", "left")
    inside = (F.coalesce("valid_from", F.lit(-9999)) <= F.col("year")) & (F.col("year") <= F.coalesce("valid_to", F.lit(9999)))
    hit = F.when(inside, F.struct("valid_from", "jurisdiction"))
    return both.groupBy("event", "place").agg(F.max(hit).alias("x")).select("event", "place", "x.jurisdiction")


def dna_against_tree(links: DataFrame, mutual: DataFrame, strong_cm: float = 100.0) -> DataFrame:
    """(kit, id): strong matches in a mutual cluster of a line that the tree says they do not belong to."""
    strong = links.where((F.col("cm") >= strong_cm) & (F.col("dna_line") != F.col("tree_line")))
    grouped = mutual.select("kit", F.explode(F.array("a", "b")).alias("id")).distinct()
    return strong.join(grouped, ["kit", "id"], "left_semi").select("kit", "id")
