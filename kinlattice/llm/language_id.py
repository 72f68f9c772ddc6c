"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is the product of its letters' vectors,
each rotated by its distance from the n-gram's end; a text is the sum of its n-grams; a language is the
sum of its training texts' unit vectors. A text gets the language of the largest cosine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

DIM, NGRAM, SEED = 1024, 3, 20_011
#: Texts a language is learned from, at most (about: chosen by a hash of the id).
SAMPLE_PER_LANG = 1500
UND = "und"
#: A code point has 21 bits, so an n-gram of three is one whole number.
_BITS = 21
_CACHE_ROWS = 24_000
_CACHE_LETTERS = 20_000
_LETTERS: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    return _LETTERS


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")


class Space:
    """Letter vectors, seeded by code point, and the vectors of n-grams made from them, both when first met."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self._clear()

    def _clear(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.grams = np.zeros((1024, self.dim), dtype=np.float32)

    def letter(self, point: int) -> np.ndarray:
        """The vector of a code point; 0 is the blank. The same in every process."""
        got = self.letters.get(point)
        if got is None:
            if len(self.letters) >= _CACHE_LETTERS:
                self.letters.clear()
            got = self.letters[point] = (np.random.default_rng([self.seed, point]).integers(0, 2, self.dim) * 2 - 1).astype(np.int8)
        return got

    def _learn(self, codes: list[int]) -> None:
        known = len(self.rows)
        if known + len(codes) > len(self.grams):
            self.grams = np.concatenate([self.grams, np.zeros((max(len(self.grams), known + len(codes) - len(self.grams)), self.dim), np.float32)])
        for k, code in enumerate(codes, known):
            bound = np.ones(self.dim, dtype=np.int8)
            for back in range(NGRAM):
                bound = bound * np.roll(self.letter((code >> (_BITS * back)) & ((1 << _BITS) - 1)), back)
            self.grams[k] = bound
            self.rows[code] = k

    def codes(self, text: str) -> np.ndarray:
        """n-gram codes; runs of other characters are one blank, also at both ends."""
        p = _points(text)
        s = np.where(_is_letter()[p], p, 0)
        if not s.any():
            return np.zeros(0, dtype=np.int64)
        s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])]
        s = np.concatenate([[0][: int(s[0] > 0)], s, [0][: int(s[-1] > 0)]]).astype(np.int64)
        out = np.zeros(max(0, len(s) - NGRAM + 1), dtype=np.int64)
        for k in range(NGRAM):
            out = (out << _BITS) | s[k : len(s) - NGRAM + 1 + k]
        return out

    def vectors_of(self, texts: list[str], block: int = 64):
        """Yields (start, unit vectors, whether there are letters) by block of texts."""
        for start in range(0, len(texts), block):
            codes = [self.codes(t) for t in texts[start : start + block]]
            every, at = np.unique(np.concatenate(codes), return_inverse=True)
            found = np.zeros((len(codes), self.dim), np.float32)
            ends = np.cumsum([len(c) for c in codes])
            # a part of the block's distinct n-grams at a time, however many it has
            for first in range(0, len(every), _CACHE_ROWS):
                some = every[first : first + _CACHE_ROWS].tolist()
                if len(self.rows) > _CACHE_ROWS:
                    self._clear()
                self._learn([c for c in some if c not in self.rows])
                rows = np.fromiter((self.rows[c] for c in some), np.int64, len(some))
                counts = np.zeros((len(codes), len(some)), dtype=np.float32)
                for k, end in enumerate(ends):
                    own = at[end - len(codes[k]) : end] - first
                    counts[k] = np.bincount(own[(own >= 0) & (own < len(some))], minlength=len(some))
                found += counts @ self.grams[rows]
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            yield start, found / np.where(norm > 0, norm, 1), np.array([len(c) > 0 for c in codes], dtype=bool)


#: Unit vectors are summed as whole numbers of this size, so that a sum does not depend on its order.
_UNIT = 1e9


def _bundler(dim: int):
    def run(batches):
        import pyarrow as pa

        space, sums = Space(dim), {}
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(0)]
            langs = batch.column(1).to_pylist()
            for start, unit, _ in space.vectors_of(texts):
                for k, v in enumerate(unit):
                    sums[langs[start + k]] = sums.get(langs[start + k], 0) + np.round(v.astype(np.float64) * _UNIT).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(range(dim), pa.int32()), pa.array(v, pa.int64())], names=["lang", "k", "v"])

    return run


def _labeller(dim: int, langs: list[str], prototypes: np.ndarray, names: list[str]):
    def run(batches):
        import pyarrow as pa

        space = Space(dim)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(batch.schema.names.index("text"))]
            lang, score = [UND] * len(texts), [0.0] * len(texts)
            for start, unit, lettered in space.vectors_of(texts):
                if not langs:
                    break
                cos = unit.astype(np.float64) @ prototypes.T
                best = cos.argmax(axis=1)
                for k in np.flatnonzero(lettered):
                    lang[start + k], score[start + k] = langs[best[k]], float(min(1.0, max(0.0, cos[k, best[k]])))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(n)) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    return run


def held_out():
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("doc_id").isNotNull()


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their unit prototypes.

    Learns from about ``per_lang`` labelled texts of a language at most, chosen by hash of the id among
    those outside the held-out fifth. What comes to the driver is one vector a language.
    """
    ship(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out())
    share = {r["lang"]: per_lang / r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return [], np.zeros((0, dim))
    cut = F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, float(v))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    sample = labelled.where(draw < cut).select("text", "lang")
    sums: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(_bundler(dim), "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r["lang"], np.zeros(dim))[r["k"]] = r["v"] / _UNIT
    langs = sorted(k for k, v in sums.items() if np.linalg.norm(v) > 0)
    prototypes = np.stack([sums[k] / np.linalg.norm(sums[k]) for k in langs]) if langs else np.zeros((0, dim))
    return langs, np.round(prototypes, 9)


def identify(docs: DataFrame, model=None, per_lang: int = SAMPLE_PER_LANG, dim: int = DIM) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the cosine, 0 to 1) added.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned. Only
    ``text`` decides; equal cosines take the first language by name. Empty tables give empty results;
    other columns pass through, and those named like the added ones are replaced.
    """
    ship(docs.sparkSession)
    langs, prototypes = model or train(docs, per_lang, dim)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_labeller(dim, langs, prototypes, docs.columns), schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Below this cosine a text resembles no learned language at all.
LEAST_SCORE = 0.05


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told: not ``und``, cosine at least ``least``. Columns unchanged."""
    found = identify(docs.withColumnsRenamed({c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}), train(docs))
    told = found.where((F.col("lang_pred") != UND) & (F.col("score") >= least)).drop("lang_pred", "score")
    return told.withColumnsRenamed({f"_own_{c}": c for c in ("lang_pred", "score")}).select(*docs.columns)
