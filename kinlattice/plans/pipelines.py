"""End-to-end flows: import of files into tables, loading people for linkage, and bulk hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, phonetic
from ..operators import evidence as E
from ..operators import matching as M
from ..operators import predicates as P
from ..operators import relational as R
from ..sources import gedcom
from ..storage import Shelf, ship


def import_texts(texts: DataFrame) -> dict[str, DataFrame]:
    """Nine tables of the files' content. Lines and records are written once and read by every extractor."""
    spark = texts.sparkSession
    ship(spark)
    shelf = Shelf(spark)
    nodes = gedcom.read_records(gedcom.read_lines(texts))
    docs = shelf.put(gedcom.documents(nodes))
    events = gedcom.events(nodes, docs)
    names = gedcom.names(nodes, docs)
    cites = gedcom.citations(nodes, docs).withColumn("confidence", P.quality_confidence(F.col("quay")))
    return {
        "persons": gedcom.persons(nodes, docs), "names": names.withColumn("codes", phonetic.search_codes(F.coalesce("surname", F.lit("")))),
        "events": dates.with_dates(events, "date_raw", "date"), "places": gedcom.places(events), "families": gedcom.families(nodes, docs),
        "family_children": gedcom.family_children(nodes, docs), "sources": gedcom.sources(nodes, docs), "citations": cites, "unknown_tags": gedcom.quarantine(nodes, docs),
    }


def people(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, given, surname, birth_year, birth_place, sex, codes): first name and first birth of each person."""
    first = R.first_per(tables["names"], ["file", "xref"], [F.asc("sort_order")]).select("file", "xref", "given", "surname", "codes")
    birth = tables["events"].where("owner = 'INDI' AND type = 'BIRT'")
    born = birth.groupBy("file", "xref").agg(F.min_by(F.struct(F.year("date.lower").alias("birth_year"), F.col("place_raw").alias("birth_place")), "no").alias("b"))
    rows = tables["persons"].join(first, ["file", "xref"], "left").join(born, ["file", "xref"], "left")
    return rows.select(F.concat_ws("/", "file", "xref").alias("id"), "given", "surname", "b.birth_year", "b.birth_place", "sex", "codes")


def hypotheses(persons: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, score, n_rules, penalty) for every pair that shares a surname code: rules set-wise, then one aggregation.

    Rules see each pair of people alike in codes, birth and sex once.
    """
    return M.scored_people(persons, lambda pairs: _hypotheses(pairs, least), ["codes", "birth_year", "birth_place", "sex"])


def _hypotheses(pairs: DataFrame, least: float) -> DataFrame:
    kind = F.lit("same_person")
    rules = [
        E.surname_rule(F.col("codes_a"), F.col("codes_b")),
        E.birth_year_rule(F.col("birth_year_a"), F.col("birth_year_b"), kind),
        E.place_rule(F.when(F.lower("birth_place_a") == F.lower("birth_place_b"), 1.0).when(F.col("birth_place_a").isNotNull() & F.col("birth_place_b").isNotNull(), 0.5)),
        E.sex_rule(F.col("sex_a"), F.col("sex_b"), kind),
    ]
    found = E.compose(pairs, ["a", "b"], rules).withColumn("pair", F.struct("a", "b"))
    scores = E.noisy_or(found, "pair", "rule", "direction", "weight")
    return scores.select("pair.*", "score", "n_rules", "penalty").where(F.col("score") >= least)


def in_batches(items: list, run, canceled, size: int = 100) -> tuple[int, bool]:
    """Calls ``run`` on ``size`` items at a time, asking ``canceled()`` before each: (items done, whether it ended early).

    For actions that write: each batch is a job of its own, so what is done stays done.
    """
    for start in range(0, len(items), size):
        if canceled():
            return start, True
        run(items[start : start + size])
    return len(items), False
