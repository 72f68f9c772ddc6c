"""String similarity. The Indel ratio has no built-in counterpart, so it runs on Arrow batches of distinct pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit a character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """2 * LCS / (lengths) of the trimmed lower-case strings; 1 if both are empty, 0 if one is."""
    if a is None or b is None:
        return None
    a, b = a.strip().lower(), b.strip().lower()
    if not a or not b:
        return float(a == b)
    return 2.0 * lcs(a, b) / (len(a) + len(b))


def token_set(a: str | None, b: str | None) -> float | None:
    """Best ratio among common words, common with the first's rest, and common with the second's rest."""
    if a is None or b is None:
        return None
    x, y = set(a.strip().lower().split()), set(b.strip().lower().split())
    if not x or not y:
        return float(x == y)
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 1.0
    one, two = (" ".join(filter(None, [common, " ".join(sorted(s))])) for s in (x - y, y - x))
    best = ratio(one, two)
    return max(best, ratio(common, one), ratio(common, two)) if common else best


class TokenBlock:
    """Texts that are compared with one text at a time: all of ``token_set`` for one of them in a few array steps.

    Both sides of a pair begin with their common words, so only the rests need a common subsequence. Texts of
    the block without the common words are kept as one matrix of characters for each set of common words.
    """

    def __init__(self, texts):
        import numpy as np

        self.words = [frozenset(t.strip().lower().split()) for t in texts]
        self.empty = np.array([not w for w in self.words], dtype=bool)
        holders: dict = {}
        for k, words in enumerate(self.words):
            for w in words:
                holders.setdefault(w, []).append(k)
        self.holders = {w: np.array(at) for w, at in holders.items()}
        self.code = {c: k for k, c in enumerate(sorted({c for w in holders for c in w} | {" "}), 1)}
        self.rests: dict = {}

    def rest(self, common: frozenset):
        """(row of each text or -1, characters by place and row with their tree, lengths, texts) of the texts that hold ``common``, without it."""
        import numpy as np

        if common not in self.rests:
            at = sorted(set.intersection(*(set(self.holders[w].tolist()) for w in common))) if common else list(range(len(self.words)))
            texts = [" ".join(sorted(self.words[k] - common)) for k in at]
            row, sizes = np.full(len(self.words), -1), np.array([len(t) for t in texts])
            row[at] = np.arange(len(at))
            codes = np.zeros((sizes.max(initial=0), len(at)), dtype=np.intp)
            for k, t in enumerate(texts):
                codes[: len(t), k] = [self.code[c] for c in t]
            # texts that begin alike share the steps of their beginnings
            node, steps = np.zeros(len(at), dtype=np.intp), []
            for place in codes:
                some, node = np.unique(node * (len(self.code) + 1) + place, return_inverse=True)
                steps.append(divmod(some, len(self.code) + 1))
            self.rests[common] = row, (codes, steps, node), sizes, texts
        return self.rests[common]

    def ratios(self, text: str, least: float, always):
        """``token_set`` of ``text`` with each text of the block; what is certainly below ``least`` may be 0 unless ``always``."""
        import numpy as np

        words = frozenset(text.strip().lower().split())
        if not words:
            return self.empty.astype(float)
        shared = sorted(w for w in words if w in self.holders)
        out = np.zeros(len(self.words))
        if len(shared) > 62:
            out[:] = [token_set(text, " ".join(w)) for w in self.words]
            return out
        held = np.zeros(len(self.words), dtype=np.int64)
        for k, w in enumerate(shared):
            held[self.holders[w]] |= 1 << k
        for mask in (np.flatnonzero(np.bincount(held)) if len(shared) < 12 else np.unique(held)).tolist():
            at = np.flatnonzero(held == mask)
            common = frozenset(w for k, w in enumerate(shared) if mask >> k & 1)
            mine = " ".join(sorted(words - common))
            row, codes, sizes, texts = self.rest(common)
            where = row[at]
            n, m, c = sizes[where], len(mine), len(" ".join(common))
            head = c + 1 if common else 0  # the common words and a space
            whole = bool(common) & ((n == 0) | (m == 0))
            plain = np.maximum(2.0 * c / (c + head + m), 2.0 * c / (c + head + n)) if common else np.zeros(len(at))
            most = np.maximum(2.0 * (head + np.minimum(n, m)) / (2 * head + m + n), plain)
            todo = ~whole & ((most >= least - 1e-9) | always[at])
            found = np.zeros(len(at))
            if todo.any():
                some = where[todo]
                length = self._lcs(mine, codes, texts, some)
                found[todo] = np.maximum(2.0 * (head + length) / (2 * head + m + n[todo]), plain[todo])
            found[whole] = 1.0
            out[at] = found
        return out

    def _lcs(self, mine: str, codes, texts, some):
        """As ``lcs``, for all rows ``some`` of a matrix at once."""
        import numpy as np

        if len(mine) > 64:
            return np.array([lcs(mine, texts[k]) for k in some.tolist()])
        codes, steps, node = codes
        table = np.zeros(len(self.code) + 1, dtype=np.uint64)
        for k, c in enumerate(mine):
            if c in self.code:
                table[self.code[c]] |= np.uint64(1 << k)
        full = np.uint64((1 << len(mine)) - 1)
        every = 8 * len(some) > codes.shape[1]
        if every:
            left = np.full(1, full)
            for up, place in steps:
                left = left[up]
                hit = left & table[place]
                left = (left + hit) | (left - hit)
        else:
            left = np.full(len(some), full)
            for place in codes[:, some]:
                hit = left & table[place]
                left = (left + hit) | (left - hit)
        length = len(mine) - np.bitwise_count(left & full).astype(np.int64)
        return length[node[some]] if every else length


def _pairwise(f, name):
    @F.pandas_udf(T.DoubleType())
    def run(a, b):
        import pandas as pd

        seen: dict = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in seen:
                seen[pair] = f(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    run.__name__ = name
    return run


indel_ratio = _pairwise(ratio, "indel_ratio")
token_set_ratio = _pairwise(token_set, "token_set_ratio")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"[\s,;]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats: 1 if both are empty, 0 if one is."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(both / union)


def cosine(a: Column, b: Column) -> Column:
    """Clipped to 0..1; 0 for different lengths or a zero vector. Built-in expressions only."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / size)))


def source_score(title: Column, authors_a: Column, authors_b: Column, abbrev_a: Column, abbrev_b: Column) -> Column:
    """Title (a token-set ratio) .7 and authors .2, or title .9 without authors on both sides; equal abbreviations add .1."""
    known = (F.size(authors_a) > 0) & (F.size(authors_b) > 0)
    base = F.when(known, title * 0.7 + jaccard(authors_a, authors_b) * 0.2).otherwise(title * 0.9)
    clean = lambda c: F.lower(F.trim(c))
    same = F.coalesce((clean(abbrev_a) == clean(abbrev_b)) & (clean(abbrev_a) != ""), F.lit(False))
    return F.least(base + F.when(same, 0.1).otherwise(0.0), F.lit(1.0))


def levels(place: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(place), ","), lambda x: F.trim(x)), lambda x: x != "")


def place_score(a: Column, b: Column, tokens: Column) -> Column:
    """``tokens`` (a token-set ratio), or .85 + .15 of it where one place is the beginning of the other."""
    x, y = levels(a), levels(b)
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    nested = (F.size(short) > 0) & (F.slice(long, F.lit(1), F.size(short)) == short)
    return F.least(F.lit(1.0), F.when(nested, 0.85 + 0.15 * tokens).otherwise(tokens))


def year_score(a: Column, b: Column) -> Column:
    """1 if equal, .7 up to two years apart, else 0; null if either is unknown."""
    gap = F.abs(a - b)
    return F.when(gap == 0, 1.0).when(gap <= 2, 0.7).when(gap.isNotNull(), 0.0)


def year_overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Years that the other span has of this one, as a share of this one's length (one year at least)."""
    shared = F.least(other_end, end) - F.greatest(other_start, start) + 1
    return F.greatest(F.lit(0), shared) / F.greatest(end - start, F.lit(1))


def archive_priority(years: Column, same_city: Column, same_locale: Column) -> Column:
    """Fixed weights: years .5, city .3, locale .2; unknown parts count nothing."""
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return 0.5 * F.coalesce(years, F.lit(0.0)) + 0.3 * flag(same_city) + 0.2 * flag(same_locale)
