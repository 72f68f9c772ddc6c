"""Byte-level BPE by tree concatenation.

A long text is cut into leaves at arbitrary characters, the leaves are encoded on their own, and
neighbours are joined pairwise up a tree. A join takes a window of tokens on both sides of the cut,
encodes its bytes afresh and accepts the result only where both sides provably agree; otherwise the
window doubles, in the end to both whole sides. Why an accepted join is exact:

* the pre-tokenizer's pattern has no look-behind, so its pieces after a *sure boundary* (see
  ``Codec.boundaries``) do not depend on what stands before it, nor those before it on what follows;
* within one pre-token, a token sequence is the BPE encoding if and only if every adjacent pair of
  it encodes to itself. If the window is one unbroken run and its first and last tokens are the old
  ones, every adjacent pair in the joined sequence is one that occurred in a valid encoding.

Leaves bound the cost of text without breaks, for which BPE is superlinear. Texts longer than
``row_chars`` are spread over rows of their own, so one huge document is not one task.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

LEAF_CHARS = 4096
ROW_CHARS = 1 << 20
#: The public pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 16
#: Code points on whose class regular-expression engines may differ: no boundary is sure beside them.
UNSURE = r"\x00-\x08\x0e-\x1f\x7f-\x9f﻿᠎​"
_LETTER, _NUMBER = r"\p{L}", r"\p{N}"
_OTHER = rf"[^\s\p{{L}}\p{{N}}{UNSURE}']"
_WORD = rf"[^\s{UNSURE}]"
#: A position is sure: between non-space and space; between classes, unless an apostrophe precedes.
SURE = regex.compile(
    rf"(?<={_WORD})(?=[ \n\t])|(?<={_LETTER})(?={_NUMBER}|{_OTHER}|')|(?<={_NUMBER})(?={_LETTER}|{_OTHER}|')"
    rf"|(?<={_OTHER})(?={_LETTER}|{_NUMBER})"
)
#: One unbroken run: letters, numbers, other marks without apostrophes, or white space.
RUN = regex.compile(rf"\p{{L}}+|\p{{N}}+|{_OTHER}+|[ \n\t\r]+")


def _byte_of() -> dict[str, int]:
    """The public printable-byte alphabet: printable Latin-1 bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary (a ``tokenizers`` JSON file without normaliser)."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        assert spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel"
        assert spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"]
        assert spec["post_processor"] is None and spec["model"]["type"] in ("BPE", 3)
        to_byte, vocab = _byte_of(), spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        # the rank of a merge is the id of what it makes: only then do ids alone tell the merges
        assert ids == sorted(ids) and not spec["model"]["dropout"] and not spec["model"]["ignore_merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        assert not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ranks = {bytes(to_byte[c] for c in w): i for w, i in vocab.items() if w not in self.special}
        self.core = tiktoken.Encoding("kinlattice", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.reach = max((len(s) for s in self.special), default=1)
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}

    def plain(self, text: str) -> list[int]:
        """Encode at one go."""
        try:
            return self.core.encode(text, allowed_special="all")
        except UnicodeEncodeError:  # lone surrogates cannot be stored as UTF-8
            return self.core.encode(text.encode("utf-8", "replace").decode(), allowed_special="all")

    def text_of(self, ids: list[int]) -> str:
        """Bytes of the tokens as text; invalid UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def boundaries(self, text: str) -> list[int]:
        """Character positions that begin a pre-token in any surroundings, none inside a special token."""
        at = [m.start() for m in SURE.finditer(text)]
        for m in self.marks.finditer(text):
            at = [p for p in at if not m.start() < p < m.end()]
        # a special token may also stand across the window's edge
        return [p for p in at if self.reach <= p <= len(text) - self.reach]

    def leaf(self, text: str) -> list[int]:
        return self.plain(text)

    def join(self, a: list[int], b: list[int], window: int = WINDOW) -> list[int]:
        """The encoding of text(a) + text(b), given the encodings of both."""
        if not a or not b:
            return a or b
        i = j = max(window, self.reach + 3)
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            left, right = self._text(a[len(a) - i :]), self._text(b[:j])
            if left is None and i < len(a):  # the window starts inside a character
                i += 1
                continue
            if right is None and j < len(b):
                j += 1
                continue
            done = self._try(a, b, i, j, left, right)
            if done is not None:
                return done
            i, j = 2 * i, 2 * j

    def _text(self, ids: list[int]) -> str | None:
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")
        except UnicodeDecodeError:
            return None

    def _try(self, a, b, i, j, left, right) -> list[int] | None:
        text = left + right
        sure = self.boundaries(text)
        run = RUN.fullmatch(text)
        # where both old encodings and the new one surely begin a pre-token
        lo = max((p for p in sure if p < len(left)), default=None)
        hi = min((p for p in sure if p > len(left)), default=None)
        if i == len(a):
            lo = 0
        if j == len(b):
            hi = len(text)
        if lo is not None and hi is not None:
            return self._spliced(a, b, i, j, text, lo, hi)
        if run and lo is None and hi is None:
            if text[0].isspace() and not self.bytes_of[b[j]][:1].isspace():
                return None  # the last blank of a run belongs to the next word
            new = self.plain(text)
            if new[0] == a[len(a) - i] and new[-1] == b[j - 1]:
                return a[: len(a) - i] + new + b[j:]
        elif lo is not None and hi is None and (m := RUN.fullmatch(text, lo)) and self._inside(b, j, m):
            new = self.plain(text[lo:])
            if new[-1] == b[j - 1]:
                return a[: len(a) - i] + self._prefix(a[len(a) - i :], text[:lo]) + new + b[j:]
        elif hi is not None and lo is None and RUN.fullmatch(text, 0, hi) and not text[0].isspace():
            new = self.plain(text[:hi])
            if new[0] == a[len(a) - i]:
                return a[: len(a) - i] + new + self._suffix(b[:j], len(text[hi:].encode())) + b[j:]
        return None

    def _inside(self, b, j, run) -> bool:
        return not run.group()[-1].isspace() or self.bytes_of[b[j]][:1].isspace()

    def _spliced(self, a, b, i, j, text, lo, hi):
        head = self._prefix(a[len(a) - i :], text[:lo])
        tail = self._suffix(b[:j], len(text[hi:].encode()))
        return a[: len(a) - i] + head + self.plain(text[lo:hi]) + tail + b[j:]

    def _prefix(self, ids, text) -> list[int]:
        """The first tokens, as far as the text goes; a sure boundary is a token boundary."""
        want, out = len(text.encode()), []
        for t in ids:
            if want <= 0:
                break
            out.append(t)
            want -= len(self.bytes_of[t])
        assert want == 0
        return out

    def _suffix(self, ids, want: int) -> list[int]:
        out = []
        for t in reversed(ids):
            if want <= 0:
                break
            out.append(t)
            want -= len(self.bytes_of[t])
        assert want == 0
        return out[::-1]

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Join neighbours pairwise until one is left."""
        while len(parts) > 1:
            odd = parts[-1:] if len(parts) % 2 else []
            parts = [self.join(x, y) for x, y in zip(parts[::2], parts[1::2], strict=False)] + odd
        return parts[0] if parts else []

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
        if len(text) <= leaf_chars:
            return self.leaf(text)
        return self.tree([self.leaf(text[k : k + leaf_chars]) for k in range(0, len(text), leaf_chars)])

    def decode(self, ids) -> str:
        return self.text_of(list(ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def pack(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def unpack(data: bytes) -> list[int]:
    return np.frombuffer(data, dtype="<u4").tolist()


def _encoder(path: str, leaf_chars: int, text_column: str, keep: list[str], decode: bool):
    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for batch in batches:
            ids, decoded = [], []
            for t in batch.column(batch.schema.names.index(text_column)):
                found = c.encode(t.as_py() or "", leaf_chars)
                ids.append(pack(found))
                if decode:
                    decoded.append(c.decode(found))
            made = [pa.array(ids, pa.binary()), *([pa.array(decoded, pa.string())] if decode else [])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(n)) for n in keep), *made], names=[*keep, "ids", *["decoded"][: int(decode)]]
            )

    return run


def _joiner(path: str, decode: bool):
    def run(key, rows):
        import pyarrow as pa

        c = codec(path)
        order = np.argsort(rows.column("_part").to_numpy())
        ids = c.tree([unpack(rows.column("ids")[int(k)].as_py()) for k in order])
        out = {"_doc": pa.array([key[0].as_py()], pa.string()), "ids": pa.array([pack(ids)], pa.binary())}
        return pa.table(out | ({"decoded": pa.array([c.decode(ids)], pa.string())} if decode else {}))

    return run


def bpe_encode(
    docs: DataFrame, tokenizer: str, leaf_chars: int = LEAF_CHARS, row_chars: int = ROW_CHARS, decode: bool = False, keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit token ids) added.

    ``tokenizer`` is the path of a byte-level BPE vocabulary on every node. The ids are those of one
    encoding of the whole text, without added special tokens (their strings in a text do become their
    ids). With ``decode`` a column ``decoded`` holds the text of the ids, made in the same pass. Null
    text counts as empty: no ids. Repeated rows are encoded each; other columns pass through, and those
    named like the added ones are replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("ids", *["decoded"][: int(decode)])
    keep = [c for c in docs.columns if keep_text or c != "text"]
    added = [T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.StringType())][: int(decode)]]
    whole = T.StructType([*(docs.schema[c] for c in keep), *added])
    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = docs.where(size <= row_chars).mapInArrow(_encoder(tokenizer, leaf_chars, "text", keep, decode), whole)
    # texts beyond row_chars, in rows of that size, then joined per text; equal texts are encoded once
    long = docs.where(size > row_chars).withColumn("_doc", F.sha2("text", 256))
    n = F.ceil(F.char_length("text") / row_chars).cast("int")
    parts = (
        long.dropDuplicates(["_doc"])
        .select("_doc", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("_part"))
        .select("_doc", "_part", F.substr("text", F.col("_part") * row_chars + 1, F.lit(row_chars)).alias("_piece"))
        .repartition("_doc", "_part")
        .mapInArrow(_encoder(tokenizer, leaf_chars, "_piece", ["_doc", "_part"], False), "_doc string, _part int, ids binary")
    )
    joined = parts.groupBy("_doc").applyInArrow(_joiner(tokenizer, decode), T.StructType([T.StructField("_doc", T.StringType()), *added]))
    return short.unionByName(long.join(joined, "_doc").select(*whole.names))


def _decoder(path: str, schema_names: list[str]):
    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for batch in batches:
            texts = [c.decode(unpack(x.as_py() or b"")) for x in batch.column(batch.schema.names.index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def bpe_decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``rows`` with ``decoded`` (text of ``ids``) added. Special tokens are written out; null ids give ''."""
    ship(rows.sparkSession)
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_decoder(tokenizer, rows.columns), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .common import table

    tokenizer = tokenizer or default_tokenizer()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, tokenizer, decode=True, keep_text=False).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
