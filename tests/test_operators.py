import random
import tracemalloc
from collections import defaultdict
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from kinlattice.operators import evidence, graph, intervals, matching, quality, versioning
from kinlattice.plans import extensions, pipelines
from kinlattice.plans.evidence import triangulation_groups


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_noisy_or_edges(spark):
    rows = [(1, "a", "supports", 0.5), (1, "a", "supports", 0.7), (1, "b", "supports", 0.5), (2, "a", "neutral", 0.9), (3, "a", "contradicts", 0.9)] + [(4, f"r{k}", "contradicts", 0.1) for k in range(9)] + [(4, "s", "supports", 1.0)]
    got = {r.h: (round(r.score, 6), r.n_rules, round(r.penalty, 6)) for r in evidence.noisy_or(table(spark, rows, "h int, rule string, d string, w double"), "h", "rule", "d", "w").collect()}
    assert got == {1: (0.8, 2, 0.0), 2: (0.05, 0, 0.0), 3: (0.05, 0, 0.1), 4: (0.5, 1, 0.5)}
    every = evidence.with_unsupported(table(spark, [(9,), (1,)], "h int"), evidence.noisy_or(table(spark, rows, "h int, rule string, d string, w double"), "h", "rule", "d", "w"), "h")
    assert {r.h: round(r.score, 6) for r in every.collect()} == {9: 0.0, 1: 0.8}


def test_runs_skip_no_calls_and_break_at_mismatch(spark):
    hits = [True, True, None, True, False, False, True, None, None]
    rows = [(1, k, h) for k, h in enumerate(hits)] + [(2, 0, None)]
    got = sorted((r.k, r.start, r.end, r.n) for r in intervals.runs(table(spark, rows, "k int, pos int, h boolean"), ["k"], ["pos"], F.col("h"), "pos").collect())
    assert got == [(1, 0, 3, 3), (1, 6, 6, 1)]


def test_interpolation_clamps(spark):
    points = table(spark, [(1, 10.0, 0.0), (1, 20.0, 1.0), (1, 40.0, 2.0), (2, 5.0, 7.0)], "g int, x double, y double")
    values = table(spark, [(1, v) for v in (0.0, 10.0, 15.0, 20.0, 30.0, 40.0, 99.0)] + [(2, 1.0), (2, 9.0), (3, 1.0)], "g int, at double")
    got = {(r.g, r.at): r.out for r in intervals.interpolate(values, points, "g", "at", "x", "y", "out", 7.0).collect()}
    assert got == {(1, 0.0): 0.0, (1, 10.0): 0.0, (1, 15.0): 0.5, (1, 20.0): 1.0, (1, 30.0): 1.5, (1, 40.0): 2.0, (1, 99.0): 2.0, (2, 1.0): 7.0, (2, 9.0): 7.0, (3, 1.0): None}


@pytest.mark.parametrize("width", [1.0, 3.0, 100.0])
def test_overlaps_equal_all_pairs(spark, width):
    rng = random.Random(4)
    rows = [(k, rng.randint(1, 2), s := float(rng.randint(0, 40)), s + rng.randint(1, 25)) for k in range(60)]
    df = table(spark, rows, "id int, c int, start double, end double")
    got = {(r.a, r.b) for r in intervals.overlaps(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), ["c"], 5.0, width).collect()}
    assert got == {(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and min(x[3], y[3]) - max(x[2], y[2]) >= 5}


def test_triangulation(spark):
    rows = [(1, 2, 1, 0.0, 20.0), (1, 3, 1, 5.0, 25.0), (2, 3, 1, 0.0, 30.0), (1, 4, 1, 6.0, 26.0), (3, 4, 1, 0.0, 30.0), (1, 5, 2, 0.0, 9.0)]
    trip = intervals.triplets(table(spark, rows, "a int, b int, chrom int, start double, end double"), 7.0, 10.0)
    assert {(r.x, r.y, r.z, r.start, r.end) for r in trip.collect()} == {(1, 2, 3, 5.0, 20.0), (1, 3, 4, 6.0, 25.0)}
    assert [tuple(r) for r in triangulation_groups(trip, 7.0).collect()] == [(1, "1,2,3,4", 6.0, 20.0)]
    assert triangulation_groups(trip, 14.5).count() == 2  # they overlap by 14 only, so they stay apart
    chain = table(spark, [(1, 1, 2, 3, 0.0, 20.0), (1, 1, 2, 4, 10.0, 30.0), (1, 1, 2, 5, 20.0, 40.0)], "chrom int, x int, y int, z int, start double, end double")
    assert triangulation_groups(chain, 7.0).count() == 0  # linked one by one, without a common interval


def test_relationship_labels(spark):
    values = table(spark, [(1, 3500.0), (2, 3.0), (3, 9000.0), (4, 2350.0), (5, 100.0)], "k int, cm double")
    got = defaultdict(dict)
    for r in intervals.label_ranges(values, "k", "cm").collect():
        got[r.k][r.label] = r.probability
    assert set(got[1]) == {"Identical twin / Same person", "Parent / Child"} and sum(got[5].values()) == pytest.approx(1.0)
    assert got[2] == {"Unrelated / noise": 1.0} and got[3] == {"Identical twin / Same person": 1.0} and got[4] == {"Full sibling": 1.0}


def test_components_and_cycles(spark):
    rng = random.Random(3)
    edges = [tuple(rng.sample(range(80), 2)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(30)]
    parent = {k: k for k in [*range(80), *range(200, 231)]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {(r.id, r.component) for r in graph.components(table(spark, [(k,) for k in parent], "id long"), table(spark, edges, "a long, b long")).collect()}
    assert got == {(k, find(k)) for k in parent}
    ring = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 1), (6, 8)]
    assert {(r.id, r.component) for r in graph.cycle_groups(table(spark, ring, "src long, dst long")).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    assert graph.cycle_groups(table(spark, [(1, 2), (2, 3)], "src long, dst long")).count() == 0
    # rounds over the whole graph, without a last task, give the same
    again = random.Random(3)
    links = [*ring, *{(100 + again.randrange(30), 100 + again.randrange(30)) for _ in range(45)}]
    groups = lambda rows: {(r.id, r.component) for r in graph.cycle_groups(table(spark, links, "src long, dst long"), rows).collect()}
    assert groups(0) == groups(1000) and len(groups(0)) > 8


def test_shortest_paths(spark):
    families = table(spark, [(1, 10, 11), (2, 12, 13), (3, 20, 21)], "family int, husband int, wife int")
    children = table(spark, [(1, 20), (1, 22), (2, 21), (3, 30)], "family int, child int")
    edges = graph.family_edges(families, children)
    got = {r.node: (r.hops, r.spouses, " ".join(r.path)) for r in graph.shortest_paths(edges, table(spark, [(30,)], "id int")).collect()}
    assert got[22] == (2, 0, "parent sibling") and got[10] == (2, 0, "parent parent") and got[30] == (0, 0, "")
    assert {r.node for r in graph.ancestors(edges.where("kind = 'parent'").selectExpr("src AS child", "dst AS parent"), table(spark, [(30,)], "id int"), 1).selectExpr("ancestor AS node").collect()} == {20, 21}
    people = table(spark, [(10, "M"), (11, "F"), (20, "M"), (21, "F"), (22, "U")], "id int, sex string")
    assert {r.node for r in graph.walk(table(spark, [(30,)], "id int"), edges, people, [("parent", "M"), ("sibling", "F")]).collect()} == {22}


def test_greedy_modularity(spark):
    edges = [(a, b, 10.0) for g in ((1, 2, 3, 4), (5, 6, 7, 8)) for a in g for b in g if a < b] + [(4, 5, 1.0)]
    assert graph.greedy_modularity(edges, list(range(1, 10))) == {**dict.fromkeys((1, 2, 3, 4), 1), **dict.fromkeys((5, 6, 7, 8), 5), 9: 9}
    rows = [(o, a + 100 * o, b + 100 * o, w) for o in (1, 2) for a, b, w in edges]
    got = {(r.owner, r.id): r.cluster for r in graph.communities(table(spark, rows, "owner int, a int, b int, weight double"), "owner").collect()}
    assert got[1, 104] == 101 and got[1, 105] == 105 and got[2, 208] == 205 and len(got) == 16


def test_greedy_modularity_equals_its_definition():
    rng = random.Random(6)
    for trial in range(40):
        n, resolution = rng.choice([6, 14, 25]), rng.choice([0.7, 1.0, 1.6])
        nodes = [f"n{k}" for k in range(n)] if trial % 2 else list(range(n))
        edges = [(*rng.sample(nodes, 2), float(rng.randint(1, 3))) for _ in range(rng.choice([n // 2, 2 * n, 5 * n]))]
        total, degree, between, members = sum(w for *_, w in edges), dict.fromkeys(nodes, 0.0), {}, {x: [x] for x in nodes}
        for a, b, w in edges:
            degree[a], degree[b], pair = degree[a] + w, degree[b] + w, tuple(sorted((a, b), key=str))
            between[pair] = between.get(pair, 0.0) + w
        while between:
            gain = lambda p: round(between[p] / total - resolution * degree[p[0]] * degree[p[1]] / (2 * total * total), 12)  # noqa: B023, E731
            a, b = min(between, key=lambda p: (-gain(p), str(p[0]), str(p[1])))
            if gain((a, b)) <= 0:
                break
            degree[a], members[a], before, between = degree[a] + degree[b], members[a] + members.pop(b), between, {}
            for p, w in before.items():
                p = tuple(sorted({a if x == b else x for x in p}, key=str))
                if len(p) == 2:
                    between[p] = between.get(p, 0.0) + w
        assert graph.greedy_modularity(edges, nodes, resolution) == {x: min(m) for m in members.values() for x in m}


def peak_bytes(f, edges, nodes):
    tracemalloc.start()
    try:
        f(edges, nodes)
        return tracemalloc.get_traced_memory()[1] / len(edges)
    finally:
        tracemalloc.stop()


def hubs(rng, n=20, leaves=600):
    return [(h, 100 + k, float(rng.randint(20, 50))) for k in range(leaves) for h in range(n)], [*range(n), *range(100, 100 + leaves)]


def test_greedy_modularity_of_hubs_is_small():
    assert peak_bytes(graph.greedy_modularity, *hubs(random.Random(5))) < 250


def test_assignment_equals_a_global_pass(spark):
    rng = random.Random(8)
    rows = [(a, b, round(rng.random(), 1)) for a in range(40) for b in rng.sample(range(100, 140), 2)]
    left, right, want = set(), set(), set()
    for a, b, s in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b, s))
    for local in (matching.LOCAL_PAIRS, 20, 0):
        assert {tuple(r) for r in matching.assign(table(spark, rows, "a int, b int, score double"), local).collect()} == want


def test_pedigree_depth(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 5), (100, 101), (7, 7000), (100, 101), (None, 3), (200, None)]
    got = {r.root: r.depth for r in graph.pedigree_depth(spark, table(spark, edges, "parent int, child int")).collect()}
    assert got == {1: 50, 100: 50}
    assert graph.pedigree_depth(spark, table(spark, [(1, 2), (2, 1)], "parent int, child int")).count() == 0


def test_blocks_without_codes(spark):
    rows = [(1, ["a", "b"]), (2, ["b"]), (3, []), (4, None), (5, ["a", "b"])]
    got = {tuple(r) for r in matching.blocked_pairs(table(spark, rows, "id int, codes array<string>"), "id", "codes").collect()}
    assert got == {(1, 2), (1, 5), (2, 5), (3, 4)}


def test_person_scores(spark):
    schema = "id int, given string, surname string, birth_year int, birth_place string, sex string, codes array<string>"
    people = table(spark, [(1, "Anna", "Berg", 1900, "Slonim", "F", ["x"]), (2, "Anna", "Berg", 1902, "Slonim, Grodno", "F", ["x"]), (3, "Anna", "Berg", None, None, "M", ["x"]), (4, None, "Berg", None, None, None, ["y"])], schema)
    pairs = table(spark, [(1, 2), (1, 3), (1, 4), (2, 4)], "a int, b int")
    got = {(r.a, r.b): round(r.score, 6) for r in matching.person_scores(matching.attach(pairs, people, people, "id")).collect()}
    assert 0.9 < got.pop((1, 2)) < 0.95 and got == {(1, 3): 0.0, (1, 4): 1.0, (2, 4): 1.0}


def test_shared_variants_keep_the_last_duplicate(spark):
    a = table(spark, [("r1", 1, 10, "AA", 1), ("r1", 1, 11, "AC", 2), ("r2", 23, 5, "AA", 3), ("r3", 2, 7, "--", 4)], "rsid string, chrom int, pos int, genotype string, line long")
    b = table(spark, [("r1", 1, 99, "CC", 1), ("r2", 23, 5, "AA", 2), ("r3", 3, 7, "AA", 3)], "rsid string, chrom int, pos int, genotype string, line long")
    assert [tuple(r) for r in matching.shared_variants(a, b).collect()] == [("r1", 1, 11, "AC", "CC")]


def test_diff_of_itself_is_empty_and_merge_is_symmetric(spark):
    base = table(spark, [(1, "a", 1.0), (2, None, 2.0), (3, "c", None)], "k int, x string, y double")
    assert versioning.diff(base, base, ["k"], ["x", "y"]).count() == 0
    left = table(spark, [(1, "L", 1.0), (2, None, 2.0), (4, "n", 1.0)], "k int, x string, y double")  # 3 deleted
    right = table(spark, [(1, "R", 1.0), (2, "z", 2.0), (3, "c", None)], "k int, x string, y double")
    merged = lambda p: sorted(tuple(r) for r in versioning.merge(base, left, right, ["k"], ["x", "y"], p).collect())
    assert merged("left") == [(1, "L", 1.0, False), (2, "z", 2.0, False), (4, "n", 1.0, False)]
    assert merged("manual")[0] == (1, "a", 1.0, True) and merged("right")[0] == (1, "R", 1.0, False) and merged("skip")[0] == (1, "a", 1.0, False)
    got = {r.k: (r.change, r.changed) for r in versioning.diff(base, left, ["k"], ["x", "y"]).collect()}
    assert got == {1: ("modified", "x"), 3: ("removed", ""), 4: ("added", "")}


def test_merge_people(spark):
    people = table(spark, [(1, None), (2, None), (3, datetime(2020, 1, 1))], "id int, deleted_at timestamp")
    names = table(spark, [(1, 0), (2, 0), (2, 1)], "person int, sort_order int")
    events = table(spark, [(1, 1, "BIRT", date(1900, 1, 1), None, 1, 0.5, 1), (2, 2, "BIRT", date(1900, 1, 1), None, 2, 0.1, 2), (3, 2, "DEAT", None, "x", 0, 0.1, 3)], "event int, person int, kind string, day date, place string, sources int, confidence double, created int")
    p, n, e = versioning.merge_people(people, names, events, table(spark, [(2, 1)], "merged int, survivor int"), F.lit(datetime(2024, 1, 1)))
    assert {(r.id, r.deleted_at, r.merged_into) for r in p.collect()} == {(1, None, None), (2, datetime(2024, 1, 1), 1), (3, datetime(2020, 1, 1), None)}
    assert sorted(tuple(r) for r in n.collect()) == [(1, 0), (1, 1000), (1, 1001)]
    assert {(r.person, r.event) for r in e.collect()} == {(1, 1), (1, 3)}
    # equal events of somebody who is in no merge stay, and so do equal events of the merged that the survivor has not
    events = table(spark, [(1, 9, "RESI", "d", None, None), (2, 9, "RESI", "d", None, None), (3, 2, "RESI", "d", None, "a"), (4, 2, "RESI", "d", None, "a"), (5, 1, "RESI", "d", None, "b"), (6, 2, "EVEN", None, None, None), (7, 1, "EVEN", None, None, None)], "event int, person int, kind string, day string, place string, custom string")
    e = versioning.merge_people(people, names, events, table(spark, [(2, 1)], "merged int, survivor int"), F.lit(datetime(2024, 1, 1)))[2]
    assert {(r.person, r.event) for r in e.collect()} == {(9, 1), (9, 2), (1, 3), (1, 4), (1, 5), (1, 7)} and e.columns == events.columns


GEDCOM = """0 HEAD
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Adam /Berg/
1 SEX M
1 BIRT
2 DATE 1 JAN 1900
1 DEAT
2 DATE 5 MAR 1920
1 FAMS @F1@
0 @I2@ INDI
1 NAME Eva /Berg/
1 SEX M
1 BIRT
2 DATE 1 JAN 1910
0 @I3@ INDI
1 NAME Kid /Berg/
1 NOTE a long
2 CONC  line
2 CONT and more
a stray line
1 BIRT
2 DATE 2 FEB 1921
1 DEAT
2 DATE 1899
1 SOUR @S1@
2 QUAY 3
1 SOUR @S9@
1 _TAG x
2 _SUB y
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 CHIL @I3@
1 CHIL @I3@
1 CHIL @I9@
0 @F2@ FAM
1 HUSB @I1@
1 WIFE @I1@
0 @S1@ SOUR
1 TITL Book
0 @I2@ INDI
1 NAME Eve /Berg/
1 SEX M
1 BIRT
2 DATE 1 JAN 1910
0 @X1@ _ODD
1 A b
0 INDI
1 NAME No /Ref/
0 TRLR
"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    from kinlattice.sources import gedcom

    folder = tmp_path_factory.mktemp("ged")
    (folder / "a.ged").write_text(GEDCOM)
    (folder / "b.ged").write_bytes("0 HEAD\r\n1 CHAR WINDOWS-1251\r\n0 @I1@ INDI\r\n1 NAME Иван /Петров/\r\n0 TRLR\r\n".encode("cp1251"))
    (folder / "c.ged").write_bytes(b"\xff\xfe" + "0 HEAD\n0 @I1@ INDI\n1 NAME Ünal /Öz/\n0 TRLR\n".encode("utf-16-le"))
    texts = gedcom.read_texts(spark, str(folder))
    return texts, pipelines.import_texts(texts)


def test_import(tables):
    texts, t = tables
    assert {r.file[-5:]: r.charset for r in texts.collect()} == {"a.ged": "UTF-8", "b.ged": "windows-1251", "c.ged": "UTF-16LE"}
    rows = lambda name, *c: sorted(tuple(r) for r in t[name].where("file LIKE '%a.ged'").select(*c).collect())
    assert rows("persons", "xref", "sex") == [("I1", "M"), ("I2", "M"), ("I3", "U")]
    assert rows("names", "xref", "given", "surname") == [("I1", "Adam", "Berg"), ("I2", "Eve", "Berg"), ("I3", "Kid", "Berg")]
    assert rows("family_children", "xref", "child", "position") == [("F1", "I3", 0), ("F1", "I3", 1), ("F1", "I9", 2)]
    assert rows("sources", "xref", "title") == [("S1", "Book")] and rows("citations", "source", "quay", "confidence") == [("S1", 3, 0.95)]
    assert {x[0] for x in rows("unknown_tags", "kind")} == {"INDI", "_ODD"} and t["unknown_tags"].count() == 4
    others = {r.given: r.surname for r in t["names"].where("file NOT LIKE '%a.ged'").collect()}
    assert others == {"Иван": "Петров", "Ünal": "Öz"}


def test_folding_and_validation(tables, spark):
    from kinlattice.sources import gedcom

    texts, _ = tables
    nodes = gedcom.read_records(gedcom.read_lines(texts.where("file LIKE '%a.ged'")))
    note = nodes.where("tag = 'NOTE'").first()
    assert note.value == "a long line\nand more\na stray line" and nodes.where("no = 31").count() == 1
    docs = gedcom.documents(nodes)
    doc = {"nodes": nodes, "docs": docs, "refs": gedcom.references(nodes, docs), "persons": gedcom.persons(nodes, docs), "families": gedcom.families(nodes, docs), "children": gedcom.family_children(nodes, docs), "events": gedcom.events(nodes, docs)}
    found = {(r.rule, r.severity, r.subject) for r in quality.validate(doc).collect()}
    assert found == {
        ("born_after_death", "ERROR", "I3"), ("broken_xref", "ERROR", "F1"), ("broken_xref", "WARNING", "I3"), ("death_before_birth", "ERROR", "I3"), ("duplicate_child", "WARNING", "F1"),
        ("duplicate_spouse", "ERROR", "F2"), ("missing_xref", "ERROR", "48"), ("mother_age", "WARNING", "I3"), ("same_sex_spouse", "WARNING", "F1"),
    }


def test_level_jumps_and_lost_continuations(spark):
    from kinlattice.sources import gedcom

    text = "0 HEAD\n0 @N1@ NOTE a\n1 SOUR x\n1 CONT lost\n0 @I1@ INDI\n3 NAME deep\n2 GIVN g\n1 SEX M\n"
    nodes = {r.no: r for r in gedcom.read_records(gedcom.read_lines(spark.createDataFrame([("f", text)], "file string, text string"))).collect()}
    assert nodes[1].value == "a" and 3 not in nodes and nodes[5].parent == 4 and nodes[6].parent == 4 and nodes[7].parent == 4


def _plain_records(text: str) -> dict:
    """Lines folded and nested one after the other: {no: (level, tag, value, root, parent)}."""
    import re

    from kinlattice.sources import gedcom

    out, opened, above = {}, None, {}
    for no, line in enumerate(re.split(r"\r\n|\n|\r", text)):
        m = re.match(gedcom.LINE, line)
        if not line.strip():
            continue
        tag = m and m.group(3).upper()
        if m is None or tag in ("CONT", "CONC"):
            if opened is not None and (m is None or int(m.group(1)) == out[opened][0] + 1):
                tail = line if m is None else m.group(4) or ""
                out[opened][2] += tail if tag == "CONC" else "\n" + tail
            continue
        level = int(m.group(1))
        out[no] = [level, tag, m.group(4) or "", None, None]
        opened = no
    for no, row in out.items():
        above[row[0]] = no
        row[3] = above.get(0)
        row[4] = max((n for k, n in above.items() if k < row[0]), default=None)
    return {no: tuple(row) for no, row in out.items() if row[3] is not None}


@pytest.mark.parametrize("size", [1, 3, 20_000])
def test_records_do_not_depend_on_bins(spark, monkeypatch, size):
    import random

    from kinlattice.sources import gedcom

    rng = random.Random(7)
    line = lambda: rng.choice(["0 HEAD", "0 @I1@ INDI", "1 NOTE a", "1 NOTE", "2 CONT b", "2 CONC c", "1 CONT d", "2 CONC", "3 DATE e", "2 SOUR", "stray", "", "1 cont f"])
    texts = {f"f{i}": rng.choice(["\n", "\r\n"]).join(line() for _ in range(40)) for i in range(6)} | {"none": "", "blank": "\n\n", "early": "1 NOTE a\n2 CONT b\nstray"}
    monkeypatch.setattr(gedcom, "BIN", size)
    nodes = gedcom.read_records(gedcom.read_lines(spark.createDataFrame([*texts.items(), ("null", None)], "file string, text string")))
    got = {}
    for r in nodes.collect():
        got.setdefault(r.file, {})[r.no] = (r.level, r.tag, r.value, r.root, r.parent)
    assert got == {f: rows for f, t in texts.items() if (rows := _plain_records(t))}


def test_registries(spark):
    reg = extensions.Registry("validator")
    reg.add("bad", lambda t: 1 / 0)
    reg.add("good", lambda t: quality.finding(t["x"], "good", "ERROR", F.col("file"), F.lit("d")))
    with pytest.raises(ValueError, match="exists"):
        reg.add("good", None)
    got = {(r.rule, r.severity) for r in extensions.run_validators({"x": spark.createDataFrame([("f",)], "file string")}, reg).collect()}
    assert got == {("bad", "INFO"), ("good", "ERROR")}
    rules = extensions.Registry("rule")
    rules.add("surname", lambda: evidence.surname_rule(F.col("a"), F.col("b")))
    pairs = spark.createDataFrame([(1, ["x"], ["x"]), (2, ["x"], ["y"]), (3, None, ["y"])], "k int, a array<string>, b array<string>")
    assert [tuple(r) for r in extensions.run_rules(pairs, ["k"], rules).collect()] == [(1, "surname", "supports", 0.5)]


def test_detectors_and_contracts(spark):
    from pyspark.sql import types as T

    links = spark.createDataFrame([("t1", 1, 2, "x", "y", 0), ("t1", 3, 4, "x", "x", 0), ("t2", 5, 6, "x", "y", 1)], "tree_id string, a int, b int, population_a string, population_b string, sources int")
    reg = extensions.Registry("detector")
    pairs = lambda t: F.concat_ws("-", "a", "b").alias("subject")
    reg.add("crossover", lambda t: t["links"].join(quality.separated_populations(t["links"]), ["a", "b"]).select("tree_id", pairs(t), "verdict"))
    got = {r.tree_id: [tuple(v) for v in r.verdicts] for r in extensions.run_detectors({"links": links}, reg).collect()}
    assert got == {"t1": [("1-2", "crossover"), ("3-4", "same")], "t2": [("5-6", "documented")]}
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("z", T.StringType())])
    assert extensions.conforms(links, schema) == ["missing z", "a is int"]


def test_rules_over_evidence(spark):
    loops = spark.createDataFrame([(1, 2, 8.0, 0), (1, 2, 9.0, 0), (1, 2, 10.0, 0), (3, 4, 9.0, 0), (5, 6, 8.0, 1), (5, 6, 8.0, 1), (5, 6, 8.0, 1)], "a int, b int, cm double, sources int")
    assert [tuple(r) for r in quality.founder_loops(loops).collect()] == [(1, 2)]
    facts = spark.createDataFrame([("p", "birth", "1900", "derivative", 1), ("p", "birth", "1901", "primary", 2), ("q", "birth", "1850", "derivative", 3)], "subject string, fact string, value string, source_class string, snippet int")
    assert {tuple(r) for r in quality.preferred_facts(facts).collect()} == {("p", "birth", "1901", True), ("q", "birth", "1850", False)}
    entries = spark.createDataFrame([("h", "Ivan", 1834, 20), ("h", "Ivan", 1850, 37), ("h", "Petr", 1850, 3), ("h", "Oleg", 1834, 20), ("h", "Oleg", 1850, 50)], "household string, name string, year int, age int")
    got = {(r.name, r.year): (r.drift, r.state) for r in quality.household_drift(entries).collect()}
    assert got["Ivan", 1850] == (1, "consistent") and got["Oleg", 1850] == (14, "drift") and got["Petr", 1850] == (None, "single")
    platforms = spark.createDataFrame([("e", p) for p in "abc"] + [("f", "a"), (None, "a"), (None, "b"), (None, "c")], "email_hash string, platform string")
    assert [tuple(r) for r in quality.identities(platforms).collect()] == [("e", 3)]
