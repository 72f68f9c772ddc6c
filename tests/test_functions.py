import random
from datetime import date
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlattice.functions import dates, kinship, phonetic, similarity
from kinlattice.storage import ship


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
def test_lcs(a, b):
    assert similarity.lcs(a, b) == slow_lcs(a, b)
    assert similarity.ratio(a, b) == similarity.ratio(b, a)
    assert 0 <= similarity.token_set(a, b) <= 1


def test_ratios():
    assert similarity.ratio("", " ") == 1.0 and similarity.ratio("a", "") == 0.0 and similarity.ratio(None, "a") is None
    assert similarity.ratio("Kitten", "sitting") == pytest.approx(8 / 13)
    assert similarity.token_set("Slonim, Grodno", "grodno slonim, empire") == 1.0
    assert similarity.token_set("a b", "c d") < 0.5


def test_columns_of_pairs(spark):
    ship(spark)
    df = spark.createDataFrame([("ab", "abc"), (None, "x"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(similarity.indel_ratio("a", "b")).collect()]
    assert got == [pytest.approx(0.8), None, 1.0]


@pytest.mark.parametrize(("name", "codes"), [("Zhitnitzky", {"436450"}), ("Mintz", {"640000"}), ("Cohen", {"456000", "560000"}), ("", set()), ("Иван", set()), ("Schwartz", {"479400"})])
def test_daitch_mokotoff(name, codes):
    assert set(phonetic.daitch_mokotoff(name)) == codes


def test_scripts_meet(spark):
    ship(spark)
    df = spark.createDataFrame([("Шмидт", "Shmidt"), ("Жуков", "Zhukov"), (None, None)], "a string, b string")
    rows = df.select(phonetic.search_codes(F.coalesce("a", F.lit(""))).alias("x"), phonetic.search_codes(F.coalesce("b", F.lit(""))).alias("y")).collect()
    assert all(set(r.x) & set(r.y) for r in rows[:2]) and rows[2].x == []


def test_names(spark):
    df = spark.createDataFrame([("Иван Иванович Петров",), ("Петров Иван Иванович",), ("Anna",), ("Ivanov",), ("",), ("Anna Maria von Berg",), ("John Smith",)], "n string")
    got = [tuple(r.x) for r in df.select(phonetic.parse_name(F.col("n")).alias("x")).collect()]
    assert got[:2] == [("Иван", "Иванович", "Петров")] * 2
    assert got[2:5] == [("Anna", None, None), (None, None, "Ivanov"), (None, None, None)]
    assert got[5] == ("Anna Maria von", None, "Berg") and got[6] == ("John", None, "Smith")
    parts = spark.createDataFrame([("Anna /Berg/ Jr",), ("Anna",), ("/Berg/",), ("Anna /Berg",), ("",)], "n string")
    assert [tuple(r.x) for r in parts.select(phonetic.gedcom_name(F.col("n")).alias("x")).collect()] == [("Anna", "Berg", "Jr"), ("Anna", None, None), (None, "Berg", None), ("Anna", "Berg", None), (None, None, None)]


def test_coordinates(spark):
    df = spark.createDataFrame([("N52.5",), ("W 13.25",), ("S95",), ("181",), ("x",), ("-12.5",)], "v string")
    assert [r[0] for r in df.select(phonetic.coordinate(F.col("v"))).collect()] == [52.5, -13.25, None, None, None, -12.5]


def test_longitudes_as_written(spark):
    df = spark.createDataFrame([("E 181",), ("w200.5",), ("E x",), ("N 91",), ("-181",)], "v string")
    assert [r[0] for r in df.select(phonetic.coordinate(F.col("v"))).collect()] == [181.0, -200.5, None, None, None]


@pytest.mark.parametrize(
    ("text", "lower", "upper", "qualifier"),
    [
        ("12 JAN 1900", date(1900, 1, 12), date(1900, 1, 12), "none"), ("FEB 1904", date(1904, 2, 1), date(1904, 2, 29), "none"), ("1900", date(1900, 1, 1), date(1900, 12, 31), "none"),
        ("BEF 1850", None, date(1849, 12, 31), "BEF"), ("AFT 1850", date(1851, 1, 1), None, "AFT"), ("BEF 5 JUN 1850", None, date(1850, 6, 4), "BEF"), ("~1850", date(1850, 1, 1), date(1850, 12, 31), "ABT"),
        ("BET 1800 AND MAR 1810", date(1800, 1, 1), date(1810, 3, 31), "none"), ("FROM 1900", date(1900, 1, 1), None, "none"), ("TO 1901", None, date(1901, 12, 31), "none"),
        ("198_", date(1980, 1, 1), date(1989, 12, 31), "none"), ("19__", date(1900, 1, 1), date(1999, 12, 31), "none"), ("202002", date(2020, 2, 1), date(2020, 2, 29), "none"), ("10/1941", date(1941, 10, 1), date(1941, 10, 31), "none"),
        ("1750/51", date(1751, 1, 1), date(1751, 12, 31), "none"), ("1699/00", date(1700, 1, 1), date(1700, 12, 31), "none"), ("44 BC", None, None, "none"), ("(who knows)", None, None, "none"), ("31 FEB 1900", None, None, "none"),
        ("@#DJULIAN@ 1 JAN 1900", date(1900, 1, 13), date(1900, 1, 13), "none"), ("@#DHEBREW@ 1 TSH 5784", date(2023, 9, 16), date(2023, 9, 16), "none"), ("@#DFRENCH R@ 9 THER 2", date(1794, 7, 27), date(1794, 7, 27), "none"),
        ("@#DROMAN@ 5 JAN 700", None, None, "none"), ("INT 1900 (about)", date(1900, 1, 1), date(1900, 12, 31), "INT"),
    ],
)
def test_dates(text, lower, upper, qualifier):
    got = dates.parse_date(text)
    assert (got["lower"], got["upper"], got["qualifier"]) == (lower, upper, qualifier)


def test_hebrew_years_are_whole():
    for year in range(5600, 5800):
        assert dates.hebrew_to_day(year + 1, 1, 1).toordinal() - dates.hebrew_to_day(year, 1, 1).toordinal() == sum(dates.hebrew_lengths(year))


def test_parsed_once_for_each_string(spark):
    rows = [(1, "1900"), (2, "1900"), (3, None), (4, "junk")]
    got = {r.id: r.d for r in dates.with_dates(spark.createDataFrame(rows, "id int, raw string"), "raw", "d").collect()}
    assert got[1] == got[2] and got[3] is None and got[4].phrase == "junk" and got[4].lower is None


def test_kinship_words():
    assert kinship.steps("my father's mother") == [("parent", "M"), ("parent", "F")]
    assert kinship.steps("great-grandmother") == [("parent", None), ("parent", None), ("parent", "F")]
    assert kinship.steps("wife's brother") == [("spouse", "F"), ("sibling", "M")] and kinship.steps("neighbour") is None


def test_cosine(spark):
    rng = random.Random(1)
    vectors = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(5)] + [[0.0] * 4, [1.0]]
    pairs = list(combinations(range(len(vectors)), 2))
    df = spark.createDataFrame([(vectors[a], vectors[b]) for a, b in pairs], "a array<double>, b array<double>")
    for (a, b), r in zip(pairs, df.select(similarity.cosine(F.col("a"), F.col("b"))).collect(), strict=True):
        x, y = vectors[a], vectors[b]
        norm = sum(v * v for v in x) ** 0.5 * sum(v * v for v in y) ** 0.5
        want = 0.0 if len(x) != len(y) or not norm else min(1.0, max(0.0, sum(p * q for p, q in zip(x, y, strict=True)) / norm))
        assert r[0] == pytest.approx(want)
