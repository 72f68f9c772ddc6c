"""Queries without SQL on whole tables: rows beyond the first ids count. Brute force on small fixtures."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from kinlattice import catalog
from kinlattice.functions import similarity
from kinlattice.operators import matching


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def lines(rng, n):
    """(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag), ids of all sizes."""
    return [(rng.randrange(4000), rng.randrange(300), rng.randrange(120), rng.randint(1, 2), float(rng.randint(1, 50)), rng.choice("ANR")) for _ in range(n)]


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"


def test_greedy_assignment(spark, tmp_path):
    rows = lines(random.Random(1), 400)
    write(spark, tmp_path, "lineitem", rows, LINES)
    best = {}
    for a, b, _, _, q, _ in rows:
        best[a, b] = max(q, best.get((a, b), 0))
    left, right, want = set(), set(), set()
    for (a, b), q in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b, q))
    got = {tuple(r) for r in catalog.QUERIES["j20_greedy_assignment"](spark, str(tmp_path)).collect()}
    assert got == want and max(a for a, *_ in want) >= 300


def test_person_scores(spark, tmp_path):
    ids = [3, 53, 599, 600, 603, 649, 653, 5000, 5003, 5050]
    write(spark, tmp_path, "customer", [(k, f"SEG{k % 2}", k % 3) for k in ids], "c_custkey long, c_mktsegment string, c_nationkey int")
    got = {(r.a, r.b): r.score for r in catalog.QUERIES["f06_person_scores"](spark, str(tmp_path)).collect()}
    year = lambda g: 1.0 if g == 0 else 0.7 if g <= 2 else 0.0
    want = {}
    for a, b in itertools.combinations(ids, 2):
        clash = {a % 3, b % 3} == {0, 1}
        place = similarity.token_set(f"Town, {a % 3}", f"Town, {b % 3}")
        score = 0.3 + 0.3 + 0.2 * year(abs(a % 5 - b % 5)) + 0.2 * place
        if a % 50 == b % 50 and not clash and score > 0.5:
            want[a, b] = round(score, 6)
    assert got == want and (603, 653) in want


def test_indel_ratios(spark, tmp_path):
    names = [f"{a} {b}" for a in ("red", "blue", "small") for b in ("widget", "wigdet", "gear")]
    write(spark, tmp_path, "part", [(n,) for n in names + names], "p_name string")
    got = {(r.a, r.b): r.ratio for r in catalog.QUERIES["f03_indel_ratio"](spark, str(tmp_path)).collect()}
    assert got == {(a, b): round(similarity.ratio(a, b), 6) for a in names for b in names}


def test_communities(spark, tmp_path):
    clique = lambda ids: [(1, b, a, 1, 40.0, "A") for a, b in itertools.combinations(ids, 2)]
    rows = clique([3, 4, 5]) + clique([40, 41, 42, 43]) + [(1, 40, 5, 1, 25.0, "A")]
    write(spark, tmp_path, "lineitem", rows, LINES)
    got = {r.id: r.cluster for r in catalog.QUERIES["g10_communities"](spark, str(tmp_path)).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 40: 40, 41: 40, 42: 40, 43: 40}


def test_triangulation_groups(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k % 70, p % 9, s % 9, c, q, f) for k, p, s, c, q, f in lines(rng, 260)]
    write(spark, tmp_path, "lineitem", rows, LINES)
    segments = {(min(s, p), max(s, p), c, float(k), k + 12.0) for k, p, s, c, _, _ in rows if s != p}
    trip = set()
    for a, b in itertools.product(segments, segments):
        if a[0] == b[0] and a[2] == b[2] and a[1] < b[1] and min(a[4], b[4]) - max(a[3], b[3]) >= 7:
            for x in segments:
                lo, hi = max(a[3], b[3], x[3]), min(a[4], b[4], x[4])
                if x[:3] == (a[1], b[1], a[2]) and hi - lo >= 7:
                    trip.add((a[2], a[0], a[1], b[1], lo, hi))
    trip = sorted(trip)
    parent = {t: t for t in trip}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in itertools.combinations(trip, 2):
        if a[0] == b[0] and {*a[1:4]} & {*b[1:4]} and min(a[5], b[5]) - max(a[4], b[4]) >= 7:
            parent[find(a)] = find(b)
    groups = {}
    for t in trip:
        groups.setdefault(find(t), []).append(t)
    want = []
    for g in groups.values():
        lo, hi = max(t[4] for t in g), min(t[5] for t in g)
        if hi - lo >= 7:
            want.append((g[0][0], ",".join(map(str, sorted({m for t in g for m in t[1:4]}))), lo, hi))
    got = sorted(map(tuple, catalog.QUERIES["g06_triangulation_groups"](spark, str(tmp_path)).collect()))
    assert got == sorted(want) and len(trip) > len(groups) > 3


def test_whole_texts(spark, tmp_path):
    start = "this opening of a benchmark item has more than sixty letters of text in it"
    docs = [
        (1, f"say {start}, and then the Grüße at its end.", "en"), (2, f"Say {start} but another end", "en"), (3, f"say {start} but another end ", "en"), (4, "Straße und Mädchen", "de"),
        (5, "x" * 45 + "ä", "de"), (6, "Oh no", "en"),
    ]
    write(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string")
    write(spark, tmp_path, "benchmark", [(10, f"{start} and then the grüße"), (11, "Oh, no!"), (12, "!")], "item_id long, text string")
    run = lambda name: {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("f36_quote_containment") == {(10, 1), (11, 6)}
    assert run("f13_canonical_form") >= {(1, f"say {start}, and then the grusse at its end."), (4, "strasse und madchen")}
    assert run("f12_diacritic_variants") == {(1, 3, "say this opening of a benchmark item has more than sixty letters of text in it and then the ruee at its end"), (2, 1, "ay this opening of a benchmark item has more than sixty letters of text in it but another end"), (3, 1, "say this opening of a benchmark item has more than sixty letters of text in it but another end "), (4, 3, "trae und aedchen"), (5, 3, "x" * 45 + "ae"), (6, 1, "h no")}
    assert run("a12_collision_groups") == {(f"say {start} but another end", "en", 2, 1, 2, 3)}


SLIPS = [
    "Moscow", "moskow", "Mosckow", "Slonim", "Slonim, Grodno", "Slonin, Grodno", "slonim, Grodno, Russian Empire", "Grodno", "parish register", "register parish", "Parisch registar", "aab", "baa", "a", "b", "", " ", ",",
    "Census of 1897", "census 1897 of", "Cenzus  of 1896", "日本 東京", "日本 東亰", None, "Moscow",
]


def test_place_pairs(spark):
    score = lambda a, b: (lambda t, x, y: max(t, 0.85 + 0.15 * t) if x and x == y[: len(x)] else t)(
        similarity.token_set(a, b), *sorted(([w.strip().lower() for w in p.split(",") if w.strip()] for p in (a, b)), key=len)
    )
    for least in (0.6, 0.8):
        want = {(i, j): round(score(a, b), 6) for (i, a), (j, b) in itertools.combinations(enumerate(SLIPS), 2) if a is not None and b is not None and score(a, b) >= least}
        places = spark.createDataFrame(list(enumerate(SLIPS)), "id long, place string")
        got = [(r.a, r.b, round(r.score, 6)) for r in matching.place_pairs(places, "id", least).collect()]
        assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want
    assert (0, 1) in want and (3, 6) in want  # a slip without a common word; a place within a place


def test_source_pairs(spark):
    rng = random.Random(2)
    titles = [t for t in SLIPS if t] + ["".join(rng.choice("abc ") for _ in range(rng.randint(3, 9))) + "x" for _ in range(60)]
    rows = [(k, t, [None, ["x"], ["x", "y"], ["z"], []][k % 5], [None, "AB", " ab ", ""][k % 4]) for k, t in enumerate(titles)]

    def score(a, b):
        x, y = set(a[2] or ()), set(b[2] or ())
        t = similarity.token_set(a[1], b[1])
        base = t * 0.7 + len(x & y) / len(x | y) * 0.2 if x and y else t * 0.9
        p, q = ((s or "").strip().lower() for s in (a[3], b[3]))
        return min(base + (0.1 if p == q != "" else 0.0), 1.0)

    sources = spark.createDataFrame(rows, "id long, title string, authors array<string>, abbreviation string")
    got = [(r.a, r.b, round(r.score, 6)) for r in matching.source_pairs(sources, "id", 0.75).collect()]
    want = {(a[0], b[0], round(score(a, b), 6)) for a, b in itertools.combinations(rows, 2) if score(a, b) >= 0.75}
    assert len(got) == len(want) and set(got) == want
    words = lambda k: set(titles[k].lower().split())
    assert any(not words(a) & words(b) for a, b, _ in want)


def test_token_block_equals_the_ratio_of_two():
    rng = random.Random(12)
    words = ["land", "a", "abc", "cab", "östra", "x" * 40, "y" * 30]
    texts = [t for t in SLIPS if t is not None] + [" ".join(rng.choice(words) if rng.random() < 0.6 else "".join(rng.choice("abcÄ#") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    block, always = similarity.TokenBlock(texts), np.arange(len(texts)) % 2 == 0
    for x in texts:
        for k, got in enumerate(block.ratios(x, 0.7, always)):
            want = similarity.token_set(x, texts[k])
            assert got == want or (max(got, want) < 0.7 and not always[k])


def test_similar_texts_from_keys_and_from_blocks(spark):
    texts = {k: t for k, t in enumerate(SLIPS[:-1] + [f"Supplier#{k:05d}, Land {k % 7}" for k in range(300)]) if t is not None}
    kinds = spark.createDataFrame(list(texts.items()), "cls long, text string")
    for nested in (False, True):
        keys, blocks = ({(r.x, r.y): r.score for r in matching.similar_texts(kinds, 0.8, nested, dense).collect()} for dense in (0.0, 1e9))
        assert keys == blocks and len(keys) > 40_000


def test_source_pairs_of_copies(spark):
    # three classes of copies: one pair of classes is scored, however many copies there are
    rows = [(k, "red bolt", [f"b{k % 3}"], "LARGE") for k in range(600)]
    sources = spark.createDataFrame(rows, "id long, title string, authors array<string>, abbreviation string")
    got = {(r.a, r.b) for r in matching.source_pairs(sources, "id", 0.85).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(600), 2) if a % 3 == b % 3}
    kinds, _ = matching.classes(sources, "id", ["title", "authors", "abbreviation"])
    assert kinds.count() == 3


def test_nearest(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, [float(rng.randint(-3, 3)) for _ in range(4)]) for k in range(220)] + [(300, [0.0] * 4), (350, [1.0, 2.0]), (351, [2.0, 4.0]), (352, [])]
    write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>")

    def cosine(a, b):
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return 0.0 if len(a) != len(b) or not size else min(1.0, max(0.0, sum(x * y for x, y in zip(a, b, strict=True)) / size))

    want = {}
    for q, v in rows:
        if q % 50 == 0:
            want[q] = sorted(((c, round(cosine(v, w), 6)) for c, w in rows if c != q), key=lambda x: (-x[1], x[0]))[:5]
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
    for out in (catalog.QUERIES["f28_cosine_top_k"](spark, str(tmp_path)), matching.nearest(df, df.where("id % 50 = 0"), 5, block=3)):
        got = {}
        for r in out.orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append((r.c, round(r.score, 6)))
        assert got == want and len(want) == 7


def test_archive_scores(spark, tmp_path):
    write(spark, tmp_path, "events", [(1, 7, "signup", None), (2, 7, "purchase", 5.0), (3, 7, "view", 9.0), (4, 8, "signup", 5.0), (5, 9, "signup", None)], "event_id long, user_id long, event_type string, value double")
    write(spark, tmp_path, "customer", [(7, 1), (8, 1), (9, 2)], "c_custkey long, c_nationkey int")
    write(spark, tmp_path, "supplier", [(1, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 1, -1.0), (5, 3, 1.0), (3, 1, 1.0)], "s_suppkey long, s_nationkey int, s_acctbal double")
    out = catalog.QUERIES["j17_archive_scores"](spark, str(tmp_path))
    # an unknown value is the last
    assert sorted((r.s_suppkey, r.event_id) for r in out.collect()) == [(1, 2), (2, 2), (3, 2)]


def test_expanded_pairs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, [rng.choice("abc") for _ in range(rng.randint(0, 2))] if k % 9 else None) for k in range(80)]
    rows += [(5, ["z"]), (6, ["z"])]  # repeated keys
    sets = {}
    for k, c in rows:
        sets.setdefault(k, set()).update(c or [""])
    want = sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b])
    df = spark.createDataFrame(rows, "id long, codes array<string>")
    texts = spark.createDataFrame([(k, " ".join(c) if c is not None else None) for k, c in rows], "id long, t string")
    words = sorted((a, b) for a, b in want if (sets[a] & sets[b]) - {""})
    monkeypatch.setattr(matching, "CHUNK", 7)
    for ids in (1000, 0):  # classes broadcast, and joined
        monkeypatch.setattr(matching, "BROADCAST_IDS", ids)
        assert sorted(tuple(r) for r in matching.blocked_pairs(df, "id", "codes").collect()) == want
        out = matching.token_pairs(texts, "id", "t")
        assert sorted(tuple(r) for r in out.collect()) == words


def test_expanded_rows_are_made_as_they_are_read(spark):
    texts = spark.range(800).select("id", F.lit("red ring").alias("t"))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan is known only as it runs
    try:
        plan = matching.token_pairs(texts, "id", "t")._jdf.queryExecution().executedPlan()
        plan.executeTake(1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    while plan.nodeName() != "Generate":
        plan = plan.children().head()
    # for the first of 319,600 pairs, which are of one chunk
    assert 0 < plan.metrics().apply("numOutputRows").value() <= 32_000


def test_classes_are_scored_once(spark):
    rows = [(k, f"G{k % 2}", "S", 1800, "T", "M", ["x"] if k % 4 else None) for k in range(40)]
    people = spark.createDataFrame(rows, "id long, given string, surname string, birth_year int, birth_place string, sex string, codes array<string>")
    seen = []

    def score(pairs):
        seen.append(pairs.count())
        return pairs.select("a", "b", (F.col("given_a") == F.col("given_b")).alias("same"))

    got = sorted(tuple(r) for r in matching.scored_people(people, score).collect())
    assert got == [(a, b, a % 2 == b % 2) for a, b in itertools.combinations(range(40), 2) if (a % 4 > 0) == (b % 4 > 0)]
    assert seen == [4]  # the classes are G0 and G1 with the code, G0 without


def test_safe_merge_by_levels(spark, monkeypatch):
    rng = random.Random(6)
    person = lambda k: (k, rng.choice(["A", "a ", "B", None]), rng.choice(["Berg", "Bergh", "Stone", None]), rng.choice([1800, 1801, 1803, None]), rng.choice(["T", "t", None]), rng.choice(["M", "F", "U", None]))
    one, two = [person(k) for k in range(30)], [person(k) for k in range(100, 130)]
    word = lambda v: None if v is None else v.strip().lower()
    code = lambda s: "" if s is None else s[0]
    pairs = []
    for x, y in itertools.product(one, two):
        n = sum(x[k] is not None and word(x[k]) == word(y[k]) for k in (1, 2, 4, 5)) + (None not in (x[3], y[3]) and abs((x[3] or 0) - (y[3] or 0)) <= 1)
        if code(x[2]) == code(y[2]) and {x[5], y[5]} != {"M", "F"} and n >= 2:
            pairs.append((-n, x[0], y[0]))
    left, right, want = set(), set(), []
    for n, a, b in sorted(pairs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.append((a, b, -float(n)))
    tables = [spark.createDataFrame(t, "id long, given string, surname string, birth_year int, birth_place string, sex string") for t in (one, two)]
    sizes, assign = [], matching.assign
    monkeypatch.setattr(matching, "assign", lambda p: (sizes.append(p.count()), assign(p))[1])
    assert sorted(tuple(r) for r in matching.safe_merge(*tables).collect()) == sorted(want)
    assert len({n for *_, n in want}) > 2 and len(sizes) > 2 and sum(sizes) < len(pairs)


def test_no_broadcast_by_packed_size(spark):
    from kinlattice.operators.relational import spread_join
    from kinlattice.storage import Shelf

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    wide = Shelf(spark).put(spark.range(200_000).select("id", F.repeat(F.lit("x"), 1000).alias("t")))  # 200 MB of rows, a small file
    assert "BroadcastHashJoin" not in plan(spark.range(10_000_000).join(wide, "id"))
    assert "BroadcastHashJoin" not in plan(spread_join(spark.range(10_000_000), spark.range(100), ["id"], "id"))
