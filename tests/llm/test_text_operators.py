"""Line dedup, near-dedup, decontamination, quality rules, licences and personal data against brute force."""

import hashlib
import random
import re
import textwrap
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from kinlattice.llm import components, decontaminate, licenses, line_dedup, near_dedup, pii, quality
from kinlattice.llm.common import Shelf
from tests.llm.helpers import hostile_docs, prose, write

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hostile_docs(), SCHEMA).withColumns({"n_lines": F.lit(1), "spans": F.lit("x"), "key": F.lit(0), "bucket": F.lit(0), "row": F.lit(2)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def ascii_lower(s):
    return s.encode().lower().decode()


def test_line_dedup(docs, spark):
    rows = hostile_docs()
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 40:
                holders[key].add(i)
    want = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(h := holders.get(ascii_lower(x.strip(" \t\n\x0b\x0c\r")), ())) < 5 or i == max(h)]
        want[i, "\n".join(keep), len(lines), len(lines) - len(keep)] += 1
    got = Counter((r.doc_id, r.kept_text or "", r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs).collect())
    assert got == want and sum(x[3] for x in got) >= 11
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    # the shuffled way for many keys gives the same
    other = Counter((r.doc_id, r.kept_text or "", r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs, broadcast_rows=0).collect())
    assert other == want


def brute_components(rows, size, percent):
    sets = defaultdict(set)
    for i, t, *_ in rows:
        w = [ascii_lower(x) for x in words(t)]
        k = min(size, len(w))
        sets[i] |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_group(seed, n, edits):
    rng = random.Random(seed)
    base = prose(rng, 120).split()
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 999)}"
        yield " ".join(w)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, size, percent):
    rows = hostile_docs() + [(100 + k, t, "en", "a") for k, t in enumerate(near_group(1, 60, 9))]
    rows += [(300 + k, t, "en", "a") for k, t in enumerate(near_group(2, 40, 4))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size, percent).collect()}
    want = {i: (n, c, c == i) for i, (n, c) in brute_components(rows, size, percent).items()}
    assert got == want and len({c for _, c, _ in want.values()}) < len(want) - 30


def test_near_dedup_without_ids_and_rows(docs, spark):
    some = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (2, "A b c d")], "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(some).collect()), key=str)
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 2, None, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_dedup_of_several_texts_with_one_id(spark):
    rng = random.Random(12)
    x, y, z = (prose(rng, 60) for _ in range(3))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    # 1 links 2 through x and 3 through y; 5 has a text of 4 and an empty one; 7 holds 6's text beside 8's
    rows = [(1, x), (1, y), (2, near(x)), (3, near(y)), (4, z), (5, z), (5, ""), (6, "six of one"), (7, "six of one"), (7, "half a dozen"), (8, "half a dozen"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    root = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 9}
    assert got == Counter((i, root[i], i == root[i]) for i, _ in rows)


def test_near_dedup_over_many_blocks(spark, monkeypatch):
    # small blocks and hot bounds: the grid of blocks and the dealing of hot texts
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "HOT", 3)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    rows = [(100 + k, t, "en", "a") for k, t in enumerate(near_group(1, 70, 12))] + [(300 + k, t, "en", "a") for k, t in enumerate(near_group(2, 40, 30))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_dedup_takes_few_stages(spark, monkeypatch):
    # on a cluster with many partitions each small stage costs seconds: large groups of near copies that stay in several components
    rows = [(100 + k, t, "en", "a") for k, t in enumerate(near_group(1, 70, 12))] + [(300 + k, t, "en", "a") for k, t in enumerate(near_group(2, 40, 30))]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain, shuffles = Shelf.put, []

    def put(self, df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning"))
        return plain(self, df)

    monkeypatch.setattr(Shelf, "put", put)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(rows, 3, 85)
    assert sum(shuffles) <= 28


def test_components(spark):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)} | {(100 + k, 101 + k) for k in range(40)}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {(r.b, r.a) for r in components.components(spark.createDataFrame(sorted(edges), "a long, b long"), Shelf(spark)).collect()}
    assert got == {(x, find(x)) for x in list(parent) if find(x) != x}


def brute_contamination(rows, items):
    pat = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pat.findall(ascii_lower(t or ""))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = Counter()
    for i, t, *_ in rows:  # repeated rows too
        w, hit, found = pat.findall(ascii_lower(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_decontaminate(spark, tmp_path):
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate([30, 13, 14, 5, 1, 20, 0])] + [(50, None), (51, "Ünïcode wörds ïn a short ïtem")]
    items += [(9, items[0][1]), (9, items[0][1])]
    rows = hostile_docs()
    rows += [(200 + k, f"{prose(rng, 9)} -- {t.upper() if k % 2 else t} ... {prose(rng, 200 if k % 3 else 3)}", "en", "a") for k, (_, t) in enumerate(items) if t]
    rows.append((300, items[0][1] * 3, "en", "a"))
    path = write(spark, rows, SCHEMA, tmp_path, "documents")
    write(spark, items, "item_id long, text string", tmp_path, "benchmark")
    got = Counter(map(tuple, decontaminate.op3_decontaminate(spark, path).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    want = brute_contamination(rows, items)
    assert got == want and sum(x[5] for x in want) > 4
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    rows_of = lambda out: Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in out.collect())
    plain = rows_of(decontaminate.contamination(docs, bench))
    # a benchmark in blocks, and shuffled joins, give the same rows
    assert plain == rows_of(decontaminate.contamination(docs, bench, block_windows=9, broadcast_rows=0))
    assert Counter((x[0], x[1], x[2], x[5]) for x in want.elements()) == Counter((x[0], x[1], x[2], x[4]) for x in plain.elements())
    bad = {x[0] for x in want if x[5]}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {r[0] for r in rows} - bad
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[4] == dict((r[0], r[1]) for r in rows)[4] and len(cut[300]) < 60
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_quality(docs, spark, tmp_path):
    rng = random.Random(2)
    rows = hostile_docs()
    rows += [(400 + k, "\n".join([prose(rng, 12)] + [f"Line {j} that every page of this host has {j}" for j in range(8 if k < 25 else 1)]), "en", "h") for k in range(30)]
    rows += [(500, " ".join([prose(rng, 9)] * 6), "en", "h"), (501, ("w " * 50).strip(), "en", "h")]
    path = write(spark, [r for r in rows if r[0] != 40] + [rows[-1][:1] and (40, "x y", "en", "a")], SCHEMA, tmp_path, "documents")
    got = quality.op5_quality(spark, path).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.execute(quality.SQL).df()[list(got.columns)].sort_values("doc_id").reset_index(drop=True)
    assert got.astype(object).values.tolist() == want.astype(object).values.tolist()
    assert got[got.doc_id == 500].base_failed.all() and (~got.kept & ~got.base_failed).sum() == 25
    assert quality.quality(docs).count() == docs.count() and quality.quality(docs.limit(0)).count() == 0
    assert quality.quality(docs.drop("source")).count() == docs.count()
    # shuffled joins give the same, on the table with repeated rows and on the one with boilerplate
    for table in (docs, spark.read.parquet(f"{path}/documents.parquet")):
        assert Counter(quality.quality(table, broadcast_rows=0).collect()) == Counter(quality.quality(table).collect())


def test_licenses(docs, spark):
    mit = licenses.KNOWN["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + mit.replace(".", "").upper()), (2, mit.replace("License", "Licence") + "\n© 2011 X. All rights reserved."),
        (3, None), (4, ""), (5, mit[:-20]), (6, "Some text.\nlicensed under the apache licence, version 2.0\nmore"), (1, "Licensed under CC BY 4.0"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("own"))
    out = licenses.scan_licenses(table, licenses.known(spark), licenses.known(spark, licenses.NOTICES)).collect()
    want = [(1, "MIT", ()), (2, "MIT", ()), (3, None, ()), (4, None, ()), (5, None, ()), (6, None, ("Apache-2.0",)), (1, None, ("CC-BY-4.0",))]
    assert Counter((r.doc_id, r.license, tuple(r.notices)) for r in out) == Counter(want)
    assert licenses.scan_licenses(docs, licenses.known(spark), licenses.known(spark, licenses.NOTICES), 0).count() == docs.count()


def wrapped(text, width):
    """Paragraphs broken anew, lines that name a holder left as they are."""
    out, part = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip() and not re.match(r"\W*(copyright \(c\)|copyright \[)", line, re.I):
            part.append(line.strip())
            continue
        out += textwrap.wrap(" ".join(part), width, break_on_hyphens=False) + [line]
        part = []
    return "\n".join(out)


def test_known_licenses_at_any_width(spark, tmp_path):
    rows, want = [], {}
    for name, text in licenses.known_texts().items():
        for width in (60, 71, 80, 100):
            for head in ("", "Copyright (c) 1998-2004, The Example Authors <a@b.c>\nAll rights reserved.\n\n", "Copyright The Example Authors\n", "  (c) 2011 Example Ltd\n"):
                want[len(rows)] = name
                rows.append((len(rows), head + wrapped(text, width), "en", "a"))
    for text in ("Copyright notice and this permission: none", "(c) keep the notice", "copyright holders be liable"):
        rows.append((len(rows), text, "en", "a"))
    path = write(spark, rows, SCHEMA, tmp_path, "documents")
    got = licenses.op9_licenses(spark, path).toPandas().sort_values("doc_id")
    assert {i: x for i, x in zip(got.doc_id, got.license, strict=True) if x} == want and len(licenses.known_texts()) > 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    sql = con.execute(licenses.sql()).df().sort_values("doc_id")
    assert got.digest.tolist() == sql.digest.tolist() and got.license.fillna("").tolist() == sql.license.fillna("").tolist()
    # only the three texts that name no holder keep their words
    assert licenses.known(spark, {"x": ["Copyright notice and this permission: none", "(c) keep the notice", "copyright holders be liable", "© X", "All rights reserved"]}).where("n_chars > 0").count() == 3


def test_notices_of_any_words(spark):
    mine = licenses.known(spark, {"own": ["My own terms apply.", "Nobody: may / copy"], "none": [""]})
    docs = spark.createDataFrame([(1, "a\n** my OWN terms, apply!\nb"), (2, "nobody may copy"), (3, ""), (4, None), (5, "My own terms")], "doc_id long, text string")
    for rows in (licenses.BROADCAST_ROWS, 0):
        got = {r.doc_id: (r.license, r.notices) for r in licenses.scan_licenses(docs, mine, mine, rows).collect()}
        assert got == {1: (None, ["own"]), 2: ("own", ["own"]), 3: (None, []), 4: (None, []), 5: (None, [])}
    none = licenses.known(spark, {})
    assert {(r.license, tuple(r.notices)) for r in licenses.scan_licenses(docs, none, none).collect()} == {(None, ())}


def base_spans(t):
    t, out = t or "", []
    for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *x.span()))
    for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in x.group().split(".")):
            out.append(("ip", *x.span()))
    for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", x.group())
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *x.span()))
    for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", x.group())) <= 15:
            out.append(("phone", *x.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_personal_data(spark, tmp_path):
    rng = random.Random(6)
    alphabets = ["a@b.c", "1.2", "12 -", "+1(2) 3", "ab@.%+-_9", "4 ", "0.255", "😀é@.a1", "+12.3-4@a"]
    rows = [(k, "".join(rng.choice(alphabets[k % len(alphabets)]) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    rows += [(1000, None), (1001, "é😀 mail a.b@c.de. x@y.z_q@w.v ip 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 tel +1 (555) 555-0100")]
    rows += [(1002, "1" * 30_000), (1003, "a." * 20_000), (1004, "+" + "(" * 20_000), (1005, "a@" + "b." * 10_000 + "c"), (1006, "9 " * 9_000)]
    path = write(spark, rows, "doc_id long, text string", tmp_path, "documents")
    got = {r.doc_id: r for r in pii.op10_pii(spark, path).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = base_spans(t)
        assert got[i].base_sha256 == sha(want), (i, t, want, got[i].spans)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_personal_data_beyond_patterns(spark):
    rows = [(k, f"call me +1 (555) 555-01{k:02d} or write to u{k}@mail.com from 10.0.{k}.1") for k in range(60)]
    rows += [(100, "tel +1 (853) 555-7168 4111111111111111 and jane at mail dot com"), (101, None), (102, "version 1.2.3")]
    out = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ("phone", 4, 21) in out[100] and ("card", 22, 38) in out[100] and out[101] == [] and out[102] == []
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reliabilities_are_estimated():
    """Votes drawn from labelers of known reliability: the posterior of each pattern is near the true one."""
    rng = random.Random(21)
    right, prior = (0.95, 0.85, 0.75, 0.65), 0.4
    seen, truth = Counter(), Counter()
    for _ in range(40_000):
        real = rng.random() < prior
        v = tuple((1 if real else -1) * (1 if rng.random() < r else -1) for r in right)
        seen["name", v] += 1
        truth["name", v] += real
    got = {key: p for key, p, _ in pii.estimate([(k, v, n) for (k, v), n in sorted(seen.items())])}
    wrong = [abs(got[key] - truth[key] / n) for key, n in seen.items() if n > 300]
    assert len(wrong) > 8 and max(wrong) < 0.1, max(wrong)
    rows = [(k, v, 0, got[k, v], n) for (k, v), n in seen.items()]
    w = pii.fit(rows)
    agree = sum(n for k, v, form, p, n in rows if (sum(a * b for a, b in zip(w, pii._features(k, v, form), strict=True)) > 0) == (p > 0.5))
    assert agree > 0.97 * sum(seen.values())


def test_planted_secrets(spark):
    rng = random.Random(31)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hexa, base = "0123456789abcdef", "ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789"
    forms = [lambda: f'token = "{draw(hexa, 40)}"', lambda: f"api_key: {draw(base, 32)}", lambda: f"export AWS_KEY='AKIA{draw(base.upper(), 16)}'", lambda: f"Authorization: Bearer ghp_{draw(base, 36)}"]
    rows, places = [], {}
    for k in range(400):
        value = forms[k % 4]() if k % 5 else ""
        text = f"{prose(rng, 20)} {value} {prose(rng, 15)} +1 (555) 555-01{k % 100:02d} section 12.4.1"
        rows.append((k, text))
        if value:
            run = max(re.findall("[A-Za-z0-9_]+", value), key=len)
            places[k] = (text.index(run), text.index(run) + len(run))
    out = {r.doc_id: {(x.start, x.end) for x in r.spans if x.kind == "secret"} for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(places[k] in out[k] for k in places) >= 0.9 * len(places)
    assert all(not out[k] for k in out if k not in places)


def test_decontaminate_spans_of_any_case(spark):
    item = "The USA and I saw A McDonald sign near the old NATO base in Paris today"
    rows = [
        (1, f"USA NEWS: I Went home. {item}! Then A USA Visit."), (2, f"ABC {item.upper()} -- XYZ I"), (3, f"camelCase iPhone, {item.lower()}. The End"),
        (4, f"{item}"), (5, "THE USA AND I saw nothing."), (6, None),
    ]
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    grams = [w.lower() for w in word.findall(item)]
    want = {}
    for i, t in rows:
        found = list(word.finditer(t or ""))
        low = [m[0].lower() for m in found]
        hit = {k + j for k in range(len(low) - 12) for s in range(len(grams) - 12) if low[k : k + 13] == grams[s : s + 13] for j in range(13)}
        out, at = "", 0
        for k, m in enumerate(found):  # a word goes together with the gap before it
            out, at = out + ("" if k in hit else t[at : m.end()]), m.end()
        want[i] = t if not hit else out + t[at:]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), remove="spans").collect()}
    assert got == want and want[1] == "USA NEWS: I Went home! Then A USA Visit." and want[2] == "ABC -- XYZ I"
