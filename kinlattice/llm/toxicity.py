"""Toxicity scores on deobfuscated text.

Words may be disguised: digits and signs for letters, letters repeated, separators put between them.
A noisy channel explains each odd word: a lattice of letters that could stand behind every character,
decoded by Viterbi under a character trigram model of the corpus. The restored words give the features
(words and word beginnings) of a small classifier.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship
from .shingles import shingle_set, word_hashes

#: Signs and the letters they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u", "*": "aeiou",
}
SEPARATORS = set(".-_*~'’·•/\\+|")
#: Costs in nats of the channel's steps: a sign for a letter, a masked vowel, a repeated letter, a separator.
SIGN, MASK, REPEAT, SEPARATOR = 0.7, 1.5, 0.4, 0.4
#: Every letter is told apart. Counts of all texts go to so many slots a table by the hash of their letters,
#: which bounds the model (five tables, 8 bytes a slot) whatever the alphabets are.
SLOTS = 1 << 20
#: Documents the classifier is fitted on, at most (about).
SAMPLE = 16_000
#: A feature needs this log-likelihood ratio (a chance of one in a thousand) and this lower bound of its log odds.
LEAST_G2, LEAST_ODDS = 10.83, 1.0
#: Parts of the drawn rows: each is scored by the features of the others when the curve is fitted.
FOLDS = 3
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
_TRIM_L = "\"'([{<«“‘¿*#~_-.,;:"
_TRIM_R = "\"')]}>»”’?*#~_-.,;:!&%"
_ODD = re.compile(r"[^\W\d_][0-9@$!|+(€£¡µ*._~'’·•/\\-]+[^\W\d_]|[0-9@$|+€£¡][^\W\d_]|[^\W\d_][0-9@$|+€£]|([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\s{1,3}\S){2,}(?!\S)")


class CharModel:
    """Interpolated character trigrams of words, with word ends as ``^`` and ``$``.

    ``tables``: for "abc", "bc", "c" (counts of a letter after two, one and no letters) and "ab", "b" (their
    contexts): slots, summed counts and, for contexts, summed numbers of different letters that follow.
    """

    def __init__(self, tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.tables = tables
        self.total = float(tables["c"][1].sum()) if "c" in tables else 0.0
        self.total = self.total or 1.0
        self.floor = 1.0 / (self.total + 1000.0)
        self._memo: dict[str, float] = {}
        self._dense: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_memo": {}, "_dense": {}}

    def _seen(self, table: str, key: str) -> tuple[float, float]:
        if table not in self._dense:
            n, kinds = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)
            if table in self.tables:
                slots, counts, follow = self.tables[table]
                n[slots], kinds[slots] = counts, follow
            self._dense[table] = n, kinds
        n, kinds = self._dense[table]
        slot = xxhash.xxh64_intdigest(key.encode(errors="replace"), seed=42) % SLOTS
        return float(n[slot]), float(kinds[slot])

    def log(self, gram: str) -> float:
        """Log probability of the third letter after the first two (Witten-Bell smoothing)."""
        got = self._memo.get(gram)
        if got is None:
            p = 0.999 * self._seen("c", gram[2])[0] / self.total + 0.001 * self.floor
            for table, here in (("b", gram[1:]), ("ab", gram)):
                n, k = self._seen(table, here[:-1])
                seen = self._seen("bc" if table == "b" else "abc", here)[0]
                p = (min(seen, n) + k * p) / (n + k) if n else p
            got = self._memo[gram] = math.log(p)
            if len(self._memo) > 400_000:
                self._memo.clear()
        return got


def decode(model: CharModel, seen: str) -> tuple[str, float]:
    """The likeliest hidden word behind the characters, and its cost (negative log probability)."""
    # state: the last two letters; value: (cost, back pointer)
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    last = ""
    for c in seen:
        new: dict[str, tuple[float, tuple | None]] = {}
        options = []
        if c.isalpha():
            options = [(c, 0.0)]
        elif c in LOOKALIKES:
            options = [(x, MASK if c == "*" else SIGN) for x in LOOKALIKES[c]]
        skip = REPEAT if c == last else SEPARATOR if c in SEPARATORS else None
        if not options and skip is None:
            skip = 3.0
        for state, (cost, back) in states.items():
            if skip is not None:
                old = new.get(state)
                if old is None or cost + skip < old[0]:
                    new[state] = (cost + skip, back)
            for letter, price in options:
                total = cost + price - model.log(state + letter)
                key = state[1] + letter
                old = new.get(key)
                if old is None or total < old[0]:
                    new[key] = (total, (letter, back))
        states, last = new, c
    cost, back = min(((v[0] - model.log(s + "$"), v[1]) for s, v in states.items()), key=lambda x: x[0])
    out = []
    while back is not None:
        out.append(back[0])
        back = back[1]
    return "".join(reversed(out)), cost


class Restorer:
    def __init__(self, model: CharModel):
        self.model = model
        self.memo: dict[str, str] = {}

    def word(self, token: str) -> str:
        """A lower-case token without marks around it, decoded if it looks disguised."""
        got = self.memo.get(token)
        if got is None:
            bare = token.lstrip(_TRIM_L).rstrip(_TRIM_R)
            got = decode(self.model, bare)[0] if _ODD.search(bare) else bare
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[token] = got
        return got

    def spaced(self, text: str):
        """Words written as single characters with blanks between, where one word is likelier than many."""
        for m in _SPACED.finditer(text):
            seen = "".join(m.group().split())
            if sum(c.isalpha() for c in seen) < 2:
                continue
            word, cost = decode(self.model, seen)
            apart = -sum(self.model.log("^^" + c) + self.model.log("^" + c + "$") for c in seen)
            if cost < apart:
                yield word

    def words(self, text: str) -> set[str]:
        text = text.lower()
        out = {self.word(t) for t in set(text.split())}
        out.update(self.spaced(text))
        return out

    def text(self, text: str) -> str:
        """The whole text restored, blanks kept as they are."""
        lower = text.lower()
        out = re.sub(r"\S+", lambda m: self.word(m.group()) if _ODD.search(m.group()) else m.group(), lower)
        spaced = {m.group(): next(iter(Restorer.spaced(self, m.group())), m.group()) for m in _SPACED.finditer(out)}
        return _SPACED.sub(lambda m: spaced.get(m.group(), m.group()), out)


def features(words: set[str]) -> set[str]:
    out = set()
    for w in words:
        if w:
            out.add("=" + w)
            for n in BEGINNINGS:
                if len(w) >= n:
                    out.add(w[:n])
    return out


def char_model(docs: DataFrame) -> CharModel:
    """Trigrams of the words of all texts; a distinct word weighs the root of its count.

    Everything is counted by shuffles with partial sums; what reaches the driver is at most SLOTS rows a
    table. Weights are whole thousandths, so that sums do not depend on their order.
    """
    from .common import Shelf

    shelf = Shelf(docs.sparkSession)
    token = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    words = docs.select(token.alias("w")).where("w <> ''").groupBy("w").agg(F.round(F.sqrt(F.count(F.lit(1))) * 1000).cast("long").alias("n"))
    padded = words.select(F.concat(F.lit("^^"), "w", F.lit("$")).alias("k"), "n")
    at = F.sequence(F.lit(1), F.char_length("k") - 2)
    grams = padded.select(F.explode(F.transform(at, lambda i: F.substr("k", i, F.lit(3)))).alias("g"), "n")
    n, kinds = F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")
    three = shelf.put(grams.groupBy("g").agg(n))
    two = shelf.put(three.groupBy(F.substr("g", F.lit(2), F.lit(2)).alias("g")).agg(n))
    one = two.groupBy(F.substr("g", F.lit(2), F.lit(1)).alias("g")).agg(n)
    none = F.lit(0).cast("long").alias("kinds")
    tables = {
        "abc": three.select("g", "n", none), "bc": two.select("g", "n", none), "c": one.select("g", "n", none),
        "ab": three.groupBy(F.left("g", F.lit(2)).alias("g")).agg(n, kinds), "b": two.groupBy(F.left("g", F.lit(1)).alias("g")).agg(n, kinds),
    }
    slot = F.pmod(F.xxhash64("g"), F.lit(SLOTS)).cast("int").alias("slot")
    found = {}
    for name, df in tables.items():
        rows = df.groupBy(slot).agg(n, F.sum("kinds").alias("kinds")).orderBy("slot").toPandas()
        found[name] = rows["slot"].to_numpy(np.int32), (rows["n"] / 1000).to_numpy(np.float32), rows["kinds"].to_numpy(np.float32)
    return CharModel(found)


def _sketcher(batches):
    """The two least of the three-word shingles' hashes, as one number: equal for copies and, mostly, near copies.

    Other texts share both with a probability of about the square of their similarity.
    """
    import pyarrow as pa

    for batch in batches:
        least = []
        for t in batch.column(1):
            items = shingle_set(word_hashes(t.as_py() or ""), 3)
            least.append(xxhash.xxh64_intdigest(items[:2].tobytes()) - (1 << 63))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["doc_id", "text", "toxic", "sketch"])


def _counter(model: CharModel):
    """(f, part, t, c): of the toxic and clean texts of each part, those that have a feature."""

    def run(batches):
        import pyarrow as pa

        restorer = Restorer(model)
        seen: dict[int, tuple[Counter, Counter]] = {}
        for batch in batches:
            for text, label, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                clean, toxic = seen.setdefault(part, (Counter(), Counter()))
                (toxic if label else clean).update(features(restorer.words(text.as_py() or "")))
        for part, (clean, toxic) in seen.items():
            names = list(toxic.keys() | clean.keys())
            for k in range(0, len(names), 50_000):
                some = names[k : k + 50_000]
                columns = [pa.array(some, pa.string()), pa.array([part] * len(some), pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([toxic[x] for x in some], pa.int64()), pa.array([clean[x] for x in some], pa.int64())], names=["f", "part", "t", "c"]
                )

    return run


class Classifier:
    """Summed log odds of the features present, through a fitted logistic curve."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float]):
        self.weights, self.curve = weights, curve
        self.memo: dict[str, tuple[str, float] | None] = {}

    def word(self, w: str) -> tuple[str, float] | None:
        """The strongest feature of a word, under the word's beginning; remembered."""
        if w not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            best = max((self.weights[f] for f in features({w}) if f in self.weights), default=None)
            self.memo[w] = None if best is None else (w[:4], best)
        return self.memo[w]

    def evidence(self, words: set[str]) -> float:
        """Words of one beginning add up slowly, as they may be forms of one word; long texts need more of them."""
        found: dict[str, list[float]] = {}
        for got in map(self.word, words):
            if got is not None:
                found.setdefault(got[0], []).append(got[1])
        total = sum(max(v) * (1 + math.log(len(v))) for v in found.values())
        return math.log1p(total / math.log(2 + len(words)))

    def score(self, words: set[str]) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * self.evidence(words)))))


def _scorer(model: CharModel, judges: list, names: list[str], column: str, part: int | None = None):
    """Adds ``column``: what the judge says of the restored words; ``part``, if any, is the column that names the judge."""

    def run(batches):
        import pyarrow as pa

        restorer = Restorer(model)
        for batch in batches:
            at = batch.schema.names.index
            which = batch.column(part).to_pylist() if part is not None else [0] * batch.num_rows
            scores = [judges[k](restorer.words(t.as_py() or "")) for t, k in zip(batch.column(at("text")), which, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), pa.array(scores, pa.float64())], names=[*names, column])

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _g2(t, c, tox: float, clean: float):
    """Log-likelihood ratio of a feature's 2 x 2 table: ``t`` of the toxic and ``c`` of the clean texts have it; 0 without one of the kinds."""
    if not tox or not clean:
        return F.lit(0.0)
    total, having = tox + clean, t + c
    part = lambda seen, row, col: F.when(seen > 0, seen * F.log(seen * total / (row * col))).otherwise(0.0)
    others = total - having
    return 2 * (part(t, having, tox) + part(c, having, clean) + part(tox - t, others, tox) + part(clean - c, others, clean))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression in one variable, lightly regularised, by Newton's method."""
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - 0.05 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return round(float(w[0]), 9), round(float(w[1]), 9)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[CharModel, Classifier]:
    """The character model of all texts, and a classifier from about ``sample`` labelled rows at most.

    Held-out rows, null labels and null ids are not used; of repeated labels the largest holds.
    """
    ship(docs.sparkSession)
    from .common import Shelf

    model = char_model(docs)
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    n = labels.count()
    drawn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003 * min(1.0, sample / max(1, n)))
    # the draw is bounded by ``sample``, so it is the side to send; the texts stay where they are
    drawn = drawn.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sampled = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # copies of one toxic text would make evidence of all its words: a group of copies counts once
    sketched = Shelf(docs.sparkSession).put(sampled.mapInArrow(_sketcher, "doc_id long, text string, toxic int, sketch long"))
    one = sketched.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id"))
    rows = Shelf(docs.sparkSession).put(sketched.join(one, ["sketch", "toxic", "doc_id"], "left_semi"))
    part = (F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("h")).cast("binary")) % FOLDS).cast("int")
    rows = rows.select("text", "toxic", part.alias("part"))
    sizes = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda label, without: float(sum(n for (k, y), n in sizes.items() if y == label and k != without))
    tox, clean = size(1, None), size(0, None)
    prior = (tox + 0.5) / (tox + clean + 1.0)
    if not tox or not clean:
        return model, Classifier({}, (math.log(prior / (1 - prior)), 0.0))
    counts = rows.mapInArrow(_counter(model), "f string, part int, t long, c long")
    in_part = lambda column, k: F.sum(F.when(F.col("part") == k, F.col(column)).otherwise(0)).alias(f"{column}{k}")
    counts = counts.groupBy("f").agg(*(in_part(c, k) for c in "tc" for k in range(FOLDS)))
    # the features of all rows, and of all but a part; their number is bounded by the drawn texts
    ways = [(None, tox, clean), *((k, size(1, k), size(0, k)) for k in range(FOLDS))]
    seen = lambda column, without: sum(F.col(f"{column}{k}") for k in range(FOLDS) if k != without).cast("double")
    g2 = [_g2(seen("t", k), seen("c", k), a, b).alias(f"g{i}") for i, (k, a, b) in enumerate(ways)]
    found = counts.select("*", *g2).where(" OR ".join(f"g{i} >= {LEAST_G2}" for i in range(len(ways)))).toPandas()
    models = []
    for i, (k, a, b) in enumerate(ways):
        t, c = (sum(found[f"{column}{j}"].to_numpy(float) for j in range(FOLDS) if j != k) for column in "tc")
        # a lower bound of the log odds, so that rare features weigh little
        odds = np.log((t + 0.5) / (a + 1)) - np.log((c + 0.5) / (b + 1)) - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        good = (t >= 2) & (odds >= LEAST_ODDS) & (found[f"g{i}"].to_numpy(float) >= LEAST_G2)
        models.append({f: round(float(w), 9) for f, w in zip(found["f"][good], odds[good], strict=True)})
    judges = [Classifier(m, (0.0, 1.0)).evidence for m in models[1:]]
    scored = rows.mapInArrow(_scorer(model, judges, ["toxic"], "x", 2), "toxic int, x double").toPandas().sort_values(["x", "toxic"])
    return model, Classifier(models[0], _fit_curve(scored["x"].to_numpy(), scored["toxic"].to_numpy(float)))


def toxicity(docs: DataFrame, model: CharModel, classifier: Classifier) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more likely toxic) added, from ``text`` alone.

    Null and empty texts have no evidence and get the curve's lowest score. Other columns pass
    through; one named ``score`` is replaced. Empty tables give empty results.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_scorer(model, [classifier.score], docs.columns, "score"), schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, classifier = train(docs, table(spark, sf_dir, "labels"))
    out = toxicity(docs, model, classifier)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
