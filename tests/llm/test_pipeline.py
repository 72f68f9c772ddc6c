import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from kinlattice.llm import bpe, decontaminate, near_dedup
from tests.llm.helpers import hostile_docs, prose, write

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows):
    write(spark, [(*r, len(r[1] or "")) for r in rows], DOCS, path, "documents")
    return write(spark, [(1, "a benchmark item of thirteen words or more that nobody should ever train any model on")], "item_id long, text string", path, "benchmark")


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    rows = hostile_docs() + [(500, "a benchmark item of thirteen words or more that nobody should ever train any model on", "en", "a")]
    path = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [x.split()[0] for x in DOCS.split(", ")]
        kept[name] = {r.doc_id for r in docs.collect()}
    everyone = {r[0] for r in rows}
    assert kept["language_id"] >= everyone - {1, 2, 3, 9, 11}
    assert not kept["language_id"] & {1, 2, 3, 9}
    assert kept["line_dedup"] == kept["language_id"]
    assert kept["line_dedup"] - kept["near_dedup"] == {5, 6, 8}
    assert kept["near_dedup"] - kept["decontaminate"] == {500}
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(final) == kept["decontaminate"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    codec = bpe.codec(bpe.default_tokenizer())
    assert all(codec.decode(bpe.unpack(r.ids)) == texts[i] and r.n_tokens * 4 == len(r.ids) for i, r in final.items())


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_stages_keep_clashing_columns(spark, tmp_path):
    names = ["kept_text", "n_lines", "n_dropped", "lang_pred", "score", "hits", "n_hit", "component_id", "kept", "n"]
    docs = spark.createDataFrame(hostile_docs(), "doc_id long, text string, lang string, source string").withColumns({c: F.lit(99) for c in names})
    write(spark, [(1, "one item of a few words")], "item_id long, text string", tmp_path, "benchmark")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == 99 for r in rows for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_a_text_of_megabytes(spark, tmp_path):
    rng = random.Random(2)
    long = "\n".join(prose(rng, 14) for _ in range(40_000))
    rows = [(1, long, "en", "a"), (2, long + " more", "en", "a"), (3, "a few words of another text", "en", "a")]
    assert len(long) > 2_000_000
    path = write(spark, rows, "doc_id long, text string, lang string, source string", tmp_path, "documents")
    write(spark, [(1, " ".join(long.split()[1000:1040]))], "item_id long, text string", tmp_path, "benchmark")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.op4_near_dedup(spark, path).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}
    assert {r.doc_id: r.n_hit for r in decontaminate.op3_decontaminate(spark, path).collect()} == {1: 40, 2: 40, 3: 0}
    assert {r.doc_id: r.decoded_sha256 for r in bpe.op1_bpe(spark, path).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in rows}
