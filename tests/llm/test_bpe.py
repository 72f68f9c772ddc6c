import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinlattice.llm import bpe

PATH = bpe.default_tokenizer()
ALPHABETS = [
    "ab", "a", " ", " \n", " a", "'s", "don't'll ", "aB3 ,'\n", "é ü", "日本a ", "12 ,", "\t\n \r", "=-_", "<|endoftext|>", "a'", "𝒜😀x ", "  a", "\x85a\x1c ",
]


@pytest.fixture(scope="module")
def both():
    return bpe.codec(PATH), Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(7)
    for k, letters in enumerate(ALPHABETS * 12):
        yield "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 30, 120, 400])))
        parts = [letters * rng.randint(1, 9), "<|endoftext|>", "the quick brown fox's", "x" * rng.randint(1, 60), " " * rng.randint(1, 40), "Geschäftsführer", "1234567", "--==--"]
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 20, 64])
def test_tree_equals_one_encoding(both, leaf):
    codec, want = both
    for text in texts():
        ids = want.encode(text, add_special_tokens=False).ids
        assert codec.encode(text, leaf) == ids, (leaf, text)
        assert codec.decode(ids) == want.decode(ids, skip_special_tokens=False)


def test_unbroken_text_is_joined_by_windows(both):
    codec, want = both
    rng = random.Random(3)
    for letters in ("ab", "abcdefghij", " ", "=", "7", "é"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        assert codec.encode(text, 512) == want.encode(text, add_special_tokens=False).ids


def test_query_rows(spark):
    rows = [(1, "Hello world " * 50), (2, None), (3, ""), (1, "again"), (4, "a" * 3000), (5, "x <|endoftext|> y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'k' AS _part")
    out = bpe.bpe_decode(bpe.bpe_encode(docs, PATH, leaf_chars=64, row_chars=500), PATH).collect()
    want = Tokenizer.from_file(PATH)
    got = sorted((r.doc_id, r.decoded, bytes(r.ids)) for r in out)
    exp = sorted((i, t or "", np.array(want.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in rows)
    assert got == exp and {r._part for r in out} == {"k"}
    assert bpe.bpe_encode(docs.limit(0), PATH).count() == 0


def test_digest_columns(spark, tmp_path):
    rows = [(1, "Some text, some more."), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op1_bpe(spark, str(tmp_path)).collect()}
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
