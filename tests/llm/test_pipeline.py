import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard join", "substring dedup", "benchmark decontamination", "bpe"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left = {r["doc_id"] for r in docs.collect()}
        assert left <= set(before) and len(left) > 0.6 * len(before)
        if name == "substring dedup":
            texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
            assert all(n == len(t) for t, n in texts.values()) and all(len(t) <= len(before[i]) for i, (t, _) in texts.items())
    whole = {(r["doc_id"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r["doc_id"], tuple(r["token_ids"])) for r in docs.collect()}


def test_stages_of_odd_rows(spark, odd, nothing):
    """Null and empty texts, repeated rows, null ids and columns named like results: all stages but the last keep columns and values as they are."""
    docs = odd.selectExpr("*", "length(text) + 0L AS n_chars", "7 AS predicted", "'w' AS n_words", "'r' AS n_removed")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        got = stage(spark, docs, SF).collect()
        assert got, name
        if name != "bpe":
            assert all((r["score"], r["predicted"], r["n_words"], r["n_removed"], r["_text"]) == (0.5, 7, "w", "r", "x") for r in got), name
            left = [(r["doc_id"], r["text"]) for r in got]
            assert (2, None) in left and (3, "") in left and any(i is None for i, _ in left), name  # clean ones stay
        if name == "jaccard join":
            assert sum(i == 1 for i, _ in left) == 2  # repeated rows of an id are one document
