"""Language ID, toxicity and URL filters: brute-force parts, held-out accuracy, hostile rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from kinlattice.llm import language_id, toxicity, url_filter
from tests.llm.helpers import hostile_docs, write

SYLLABLES = {"en": "the ing tion er and ou th wh".split(), "de": "sch ung ein ich ver keit der ä".split(), "fr": "eau oi que é ment le un ç".split()}


def corpus(n=400, seed=4, toxic_words=("zorkle", "vexu")):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(40, 90))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(toxic_words) + rng.choice(["", "ing", "oi"]))
        rows.append((k, " ".join(words), lang, f"src{k % 3}"))
        labels.append((k, 1 - toxic, toxic))
    return rows, labels


def brute_profile(space, text):
    """Bind and bundle letter by letter."""
    symbols, last = [], None
    for c in text.lower():
        s = ord(c) if c.isalpha() else 0
        if s or last != 0:
            symbols.append(s)
        last = s
    if not any(symbols):
        return np.zeros(space.dim)
    symbols = ([0] if symbols[0] else []) + symbols + ([0] if symbols[-1] else [])
    total = np.zeros(space.dim)
    for k in range(len(symbols) - 2):
        a, b, c = (space.letter(x).astype(float) for x in symbols[k : k + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total / max(np.linalg.norm(total), 1e-12)


def test_profiles_equal_letterwise_binding(monkeypatch):
    texts = ["abc abd", "", "  ", "Zebra! a1b", "é" * 30, "a", "日本 bad", "?!", "dead beef " * 50]
    for rows in (language_id._CACHE_ROWS, 3):  # a small cache is emptied and filled again
        monkeypatch.setattr(language_id, "_CACHE_ROWS", rows)
        space = language_id.Space(dim=256)
        got = np.concatenate([v for _, v, _ in space.vectors_of(texts, block=4)])
        for k, t in enumerate(texts):
            assert np.allclose(got[k], brute_profile(space, t), atol=1e-5), t


def test_languages_of_many_letters(spark):
    """Chinese, Japanese and Korean differ by letters that are hundreds beyond any common alphabet."""
    rng = random.Random(3)
    alphabets = {"zh": range(0x4E00, 0x4E00 + 600), "ja": [*range(0x3041, 0x3090), *range(0x5E00, 0x5E00 + 200)], "ko": range(0xAC00, 0xAC00 + 500), "en": range(97, 123)}
    words = {lang: ["".join(chr(rng.choice(points)) for _ in range(rng.randint(1, 3))) for _ in range(150)] for lang, points in alphabets.items()}
    rows = [(k, "".join(rng.choice(words[lang]) for _ in range(200)), lang) for k, lang in enumerate(sorted(alphabets) * 40)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 15 and all(r.lang_pred == r.lang for r in held)


def test_language_held_out(spark, tmp_path):
    rows, _ = corpus()
    rows += [(1000, None, "en", "a"), (1001, "?? 12", "de", "a"), (1002, "", None, "a"), (1003, "the thing and whing", None, None), (1003, "the thing and whing", None, None)]
    path = write(spark, rows, "doc_id long, text string, lang string, source string", tmp_path, "documents")
    got = language_id.op8_language_id(spark, path).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"] and by[1000].score == 0
    held = [r for r in got if r.doc_id < 1000 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) >= 0.98 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_language_hostile(spark):
    docs = spark.createDataFrame(hostile_docs(), "doc_id long, text string, lang string, source string").withColumn("score", F.lit(7))
    assert {r.score for r in language_id.accepted(docs).collect()} == {7}
    assert language_id.accepted(docs).columns == docs.columns
    assert language_id.identify(docs.limit(0)).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def brute_decode(model, seen):
    """All readings of a short string, the cheapest."""
    readings = [("", 0.0)]
    for k, c in enumerate(seen):
        skip = toxicity.REPEAT if k and seen[k - 1] == c else toxicity.SEPARATOR if c in toxicity.SEPARATORS else None
        options = [(c, 0.0)] if c.isalpha() else [(x, toxicity.MASK if c == "*" else toxicity.SIGN) for x in toxicity.LOOKALIKES.get(c, "")]
        if not options and skip is None:
            skip = 3.0
        readings = [(w + x, p + q) for w, p in readings for x, q in options] + ([(w, p + skip) for w, p in readings] if skip is not None else [])

    def cost(word, paid):
        s = "^^" + word + "$"
        return paid - sum(model.log(s[k : k + 3]) for k in range(len(s) - 2))

    return min(cost(w, p) for w, p in readings)


def test_viterbi_is_the_cheapest_reading(spark):
    rows, _ = corpus(60)
    model = toxicity.char_model(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    for seen in ["z0rk1e", "t.h.e", "wh*n", "eeeau", "1!|", "", "a", "~~", "x#y", "th3-1ng"]:
        assert math.isclose(toxicity.decode(model, seen)[1], brute_decode(model, seen), abs_tol=1e-9), seen


def test_char_model_counts_all_letters(spark):
    texts = ["abc abd 日本語 日本人", "abc", None, ""]
    model = toxicity.char_model(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    weights = {"abc": round(math.sqrt(2) * 1000) / 1000, "abd": 1.0, "日本語": 1.0, "日本人": 1.0}
    assert math.isclose(model._seen("abc", "^日本")[0], 2.0) and math.isclose(model._seen("abc", "日本語")[0], 1.0)
    assert math.isclose(model._seen("ab", "ab")[0], sum(weights[w] for w in ("abc", "abd")), rel_tol=1e-6) and model._seen("ab", "日本")[1] == 2
    # probabilities of what may follow a context add up to one, but for what was never seen
    follow = "cdabe日本語人$"
    assert 0.9 < sum(math.exp(model.log("ab" + x)) for x in follow) <= 1.0001


def test_toxicity_held_out_and_disguised(spark, tmp_path):
    rows, labels = corpus(900)
    clean = rows[[x[2] for x in labels].index(0)][1]
    extra = ["z0rkle zork1e", "z o r k l e", "z.o.r.k.l.e", "zoooorkle", "z  o  r  k  l  e", "z\to\tr\tk\tl\te", "z o r\nk l e"]
    rows += [(5000 + k, f"{clean} {t} {clean}", "en", "a") for k, t in enumerate(extra)] + [(6000, None, None, None), (6001, "", "en", "a"), (6002, clean, "en", "a"), (6002, clean, "en", "a")]
    path = write(spark, rows, "doc_id long, text string, lang string, source string", tmp_path, "documents")
    write(spark, labels + [(None, 1, 1), (6001, None, None), (0, *labels[0][1:])], "doc_id long, quality int, toxic int", tmp_path, "labels")
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, path).collect()}
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held) > 100
    assert all(got[5000 + k].predicted == 1 for k in range(len(extra))), [got[5000 + k].score for k in range(len(extra))]
    assert got[6000].predicted == got[6001].predicted == got[6002].predicted == 0 and got[6000].score == got[6001].score
    restorer = toxicity.Restorer(toxicity.char_model(spark.read.parquet(f"{path}/documents.parquet")))
    assert "zorkle" in restorer.text("a Z0RKLE there") and restorer.text("plain words") == "plain words"


def test_toxicity_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model, judge = toxicity.train(docs, labels)
    assert toxicity.toxicity(docs, model, judge).count() == 0
    some = spark.createDataFrame([(1, "words", 5.0)], "doc_id long, text string, score double")
    assert 0 <= toxicity.toxicity(some, model, judge).first().score <= 1


def brute_rules(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut].encode().lower().decode(), rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, *rule


def brute_scores(urls, order):
    """Witten-Bell models over dictionaries."""
    counts = defaultdict(lambda: [Counter(), Counter()])
    for u, verdict, train in urls:
        if train:
            p = "\x02" * (order - 1) + u + "\x03"
            for k in range(order - 1, len(p)):
                for n in range(order):
                    counts[p[k - n : k]][verdict == "block"][p[k]] += 1
    out = {}
    for u, _, _ in urls:
        p, total = "\x02" * (order - 1) + u + "\x03", 0.0
        for k in range(order - 1, len(p)):
            logs = []
            for c in (0, 1):
                prob = 1 / 256
                for n in range(order):
                    seen = counts[p[k - n : k]][c]
                    t, d = sum(seen.values()), len(seen)
                    prob = (seen[p[k]] + d * prob) / (t + d) if t else prob
                logs.append(math.log(prob))
            total += logs[0] - logs[1]
        out[u] = total / (len(p) - order + 1)
    return out


def test_url_filter(spark):
    rng = random.Random(9)
    hosts = ["good.org", "example.org", "a.example.org", "shop.com", "spam-x.com", "other.net", "GOOD.Org", "org", "xorg", "fr.com"]
    paths = ["", "/", "/es/1", "/en/12", "/en/2", "/fr/7?x=1", "/de/9#t", "/es", "?q=/es/", "#a/b"]
    rows = [(k, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.randint(0, 40)}") for k in range(500)]
    rows += [(900, None), (901, ""), (902, "no scheme/x"), (903, "://"), (904, "a://b://c/d"), (905, "http://other.net/spam-x"), (905, "http://other.net/spam-x"), (906, "http://ü.net/" + "z" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("h"), "a": F.lit(1), "g": F.lit(2)})
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute_rules(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    part = {u: int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % url_filter.CALIBRATE for _, u in rows if u is not None}
    urls = [(u, brute_rules(u)[3], brute_rules(u)[3] is not None and part[u] != 0) for u in {u for _, u in rows if u is not None}]
    want = brute_scores(urls, url_filter.ORDER)
    for r in got:
        if r.url is not None and r.rule is None:
            assert math.isclose(r.score, want[r.url], abs_tol=1e-6), r.url
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    plain = spark.createDataFrame([(1, "http://x.net/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.filter_urls(plain).collect()} == {"allow"}
    wide = {(r.page_id, r.score) for r in url_filter.filter_urls(pages, broadcast_rows=400).collect()}
    assert wide == {(r.page_id, r.score) for r in got}
