"""Document writer, merge application, curated rules and synonyms, seeds, kinship words, communities, batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinlattice.functions import kinship, phonetic
from kinlattice.operators import graph, modularity, quality, versioning
from kinlattice.plans import pipelines
from kinlattice.sources import gedcom, seeds, sinks

from .test_operators import hubs, peak_bytes

TEXT = "0 HEAD\n1 CHAR UTF-8\n0 @I1@ INDI\n1 NAME A /B/\n1 NOTE one\n2 CONT two"


def test_write_document(spark, tmp_path):
    nodes = gedcom.read_records(gedcom.read_lines(spark.createDataFrame([("a", TEXT), ("b", TEXT + "\n0 TRLR")], "file string, text string")))
    sinks.write_document(nodes, f"{tmp_path}/out")
    again = {r.file: sorted(r.lines) for r in spark.read.text(f"{tmp_path}/out").groupBy("file").agg(F.collect_list("value").alias("lines")).collect()}
    want = sorted([*TEXT.split("\n"), "0 TRLR"])
    assert again == {"a": want, "b": want}
    parts = next((tmp_path / "out" / "file=a").glob("part*"))
    assert parts.read_text().strip().split("\n")[-1] == "0 TRLR"


def test_apply_merge(spark):
    table = lambda rows: spark.createDataFrame(rows, "k int, x string, y double")
    base, left = table([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None)]), table([(1, "L", 1.0), (2, "b", 2.0), (4, "n", 1.0)])
    right = table([(1, "R", 1.0), (2, "z", 2.0), (3, "c", None)])
    rows, counts = versioning.apply_merge(base, versioning.merge(base, left, right, ["k"], ["x", "y"], "manual"), ["k"])
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 1.0), (2, "z", 2.0), (4, "n", 1.0)]
    assert counts.first().asDict() == {"inserted": 1, "updated": 1, "deleted": 1, "conflicts": 1}


def test_curated_files(spark, tmp_path):
    (tmp_path / "anchors.json").write_text(json.dumps({"anchors": [{"canonical": "Cohen", "synonyms": ["Kohen", " KAGAN ", ""]}, {"canonical": "Abel", "synonyms": ["kagan"]}, {"canonical": "Levi", "synonyms": None}]}))
    got = {(r.canonical, r.form) for r in seeds.synonyms(spark, f"{tmp_path}/anchors.json").collect()}
    assert got == {("cohen", "cohen"), ("cohen", "kohen"), ("abel", "kagan"), ("abel", "abel"), ("levi", "levi")}
    rules = {
        "target": "x", "version": "1", "drop": [{"pattern": "_*", "rule": "vendor", "weight": 0.1}], "encoding": {"charset": "ASCII", "substitutes": {"ä": "ae"}},
        "structures": [{"feature": "media", "condition": "tag = 'OBJE'", "weight": 0.2}],
    }
    (tmp_path / "r.json").write_text(json.dumps(rules))
    paths = [f"{tmp_path}/r.json"]
    try:
        import yaml

        (tmp_path / "r.yaml").write_text(yaml.safe_dump(rules))
        paths.append(f"{tmp_path}/r.yaml")
    except ImportError:
        pass
    for path in paths:
        r = seeds.target_rules(spark, path)
        assert (r["target"], r["charset"], r["substitutes"]) == ("x", "ASCII", {"ä": "ae"})
        assert [tuple(x) for x in r["drop"].collect()] == [("_*", "vendor", 0.1)] and r["structures"].first().feature == "media"
        needs = {x.feature: x.condition for x in r["structures"].collect()}
        nodes = gedcom.read_records(gedcom.read_lines(spark.createDataFrame([("a", TEXT + "\n1 OBJE\n1 _UID 5")], "file string, text string")))
        assert [x.feature for x in quality.triggers(nodes, needs).collect()] == ["media"]
        assert [x.tag for x in quality.dropped_tags(nodes, r["drop"]).collect()] == ["_UID"]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="target"):
        seeds.target_rules(spark, f"{tmp_path}/bad.json")


def test_seed_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, name string")
    assert seeds.seed_tables({"t": rows}, {"t": ["id"]}, f"{tmp_path}/s") == {"t": 2}
    assert seeds.seed_tables({"t": rows.unionByName(spark.createDataFrame([(3, "c")], "id int, name string"))}, {"t": ["id"]}, f"{tmp_path}/s") == {"t": 1}
    assert spark.read.parquet(f"{tmp_path}/s/t").count() == 3


def test_kinship_languages_and_names(spark):
    assert kinship.steps("мой дед") == kinship.steps("grandfather") == kinship.steps("Opa") and kinship.steps("moja córka") == [("child", "F")]
    assert kinship.steps("nobody") is None
    one = spark.createDataFrame([("Ivan Petrovich", "Smith Anna 1850"), ("Anna Maria", "Smith 1850"), (None, "a b c d")], "g string, q string")
    rows = one.select(phonetic.patronymic_of_given(F.col("g")).alias("p"), phonetic.inline_query(F.col("q")).alias("q")).collect()
    assert [tuple(r.p) for r in rows[:2]] == [("Ivan", "Petrovich"), ("Anna Maria", None)]
    assert [tuple(r.q) for r in rows] == [("Smith", "Anna", 1850), ("Smith", None, 1850), (None, None, None)]


def test_refined_communities(spark):
    rng = random.Random(4)
    for _ in range(20):
        nodes = list(range(30))
        edges = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(70)})
        edges = [(a, b, float(rng.randint(1, 9)) * (5 if a // 10 == b // 10 else 1)) for a, b in edges]
        greedy, refined = graph.greedy_modularity(edges, nodes), graph.refined_modularity(edges, nodes)
        assert graph.modularity(edges, refined) >= graph.modularity(edges, greedy) - 1e-12
        for c in set(refined.values()):  # connected
            part = {n for n in nodes if refined[n] == c}
            seen, todo = {min(part)}, [min(part)]
            while todo:
                n = todo.pop()
                for a, b, _ in edges:
                    for x, y in ((a, b), (b, a)):
                        if x == n and y in part and y not in seen:
                            seen.add(y)
                            todo.append(y)
            assert seen == part and c == min(part)


def test_refined_communities_of_hubs_are_small():
    edges, nodes = hubs(random.Random(5))
    assert peak_bytes(graph.refined_modularity, edges, nodes) < 250
    refined, greedy = graph.refined_modularity(edges, nodes), graph.greedy_modularity(edges, nodes)
    assert graph.modularity(edges, refined) >= graph.modularity(edges, greedy) - 1e-12


def test_refined_communities_need_little_beside_the_graph(monkeypatch):
    whole = graph.refined_modularity(*hubs(random.Random(5)))
    monkeypatch.setattr(modularity, "BLOCK", 1000, raising=False)
    edges, nodes = hubs(random.Random(5))
    assert peak_bytes(graph.refined_modularity, edges, nodes) < 70
    assert graph.refined_modularity(edges, nodes) == whole


def test_refined_communities_of_packed_rows(spark):
    # two groups, in each a component of many rows of edges and many small ones
    rng, edges = random.Random(7), {}
    for g in "xy":
        big = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(700)}
        edges[g] = [(f"{g}{a}", f"{g}{b}", float(rng.randint(1, 9)) * (6 if a % 4 == b % 4 else 1)) for a, b in sorted(big)]
        edges[g] += [(f"{g}{k}", f"{g}{k + 1}", 3.0) for k in range(100, 200, 2)] + [(f"{g}300", f"{g}300", 2.0)]
        rng.shuffle(edges[g])
    rows = spark.createDataFrame([(g, *e) for g in edges for e in edges[g]], "owner string, a string, b string, weight double").repartition(3)
    got = {(r.owner, r.id): r.cluster for r in graph.communities(rows, "owner", refined=True).collect()}
    assert len(got) == 2 * 161
    for g in edges:
        total = sum(w for *_, w in edges[g])
        for part in (lambda k: k < 60, lambda k: k >= 60):
            inside = [e for e in edges[g] if part(int(e[0][1:]))]
            if part(0):
                want = graph.refined_modularity(inside, sorted({x for e in inside for x in e[:2]}), sum(w for *_, w in inside) / total)
                assert len(set(want.values())) > 1
            else:
                want = {x: min(a, b) for a, b, _ in inside for x in (a, b)}
            assert {k: c for (o, k), c in got.items() if o == g and k in want} == want


def test_batches_end_when_canceled():
    done = []
    assert pipelines.in_batches(list(range(250)), done.extend, lambda: False) == (250, False) and done == list(range(250))
    done.clear()
    assert pipelines.in_batches(list(range(250)), done.extend, lambda: len(done) >= 200) == (200, True) and len(done) == 200


def test_quarantine_of_unknown_children(spark):
    text = "0 HEAD\n1 CHAR UTF-8\n1 _VEND x\n0 @I1@ INDI\n1 EDUC School\n1 RELI r\n1 CHAN\n2 DATE 1 JAN 2000\n1 REFN 7\n0 @F1@ FAM\n1 RESI\n2 PLAC here\n0 @R1@ REPO\n1 EMAIL a@b\n0 @S1@ SUBM\n1 RFN 3\n0 TRLR"
    nodes = gedcom.read_records(gedcom.read_lines(spark.createDataFrame([("a", text)], "file string, text string")))
    docs = gedcom.documents(nodes)
    assert {(r.kind, r.tag) for r in gedcom.quarantine(nodes, docs).join(nodes, ["file", "no"]).collect()} == {("HEAD", "_VEND"), ("INDI", "CHAN"), ("INDI", "DATE"), ("INDI", "REFN")}
    assert {(r.xref, r.type) for r in gedcom.events(nodes, docs).collect()} == {("I1", "EDUC"), ("I1", "RELI"), ("F1", "RESI")}
