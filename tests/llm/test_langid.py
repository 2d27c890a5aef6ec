import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import langid
from marlstone.llm.base import split_of

WORDS = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "straße über größe schön mädchen fußball".split(), "cc": "ñandú corazón mañana señor también".split()}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang], n))


def test_held_out_accuracy_and_results(spark):
    rng = np.random.default_rng(1)
    rows = [(i, text(lang := list(WORDS)[i % 3], int(rng.integers(5, 400)), rng), lang) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, split_of(F.col("doc_id"), 4) != 2).collect()
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 240


def test_tables_and_convolution_agree():
    rng = np.random.default_rng(2)
    model = langid.train([text(lang, 60, rng).encode() for lang in list(WORDS) * 20], list(WORDS) * 20)
    x = langid.windows([b"some bytes \xc3\xa9 here"])[0]
    pairs = x[:, :-1].astype(int) * 256 + x[:, 1:]
    three = (model.by_pair[pairs[:, :-1]][:, :, langid.FILTERS : 2 * langid.FILTERS] + model.by_byte[x[:, 2:]]).max(1)
    p = langid.log_probabilities(model, x)
    assert np.allclose(np.exp(p).sum(1), 1, atol=1e-5) and three.shape == (1, langid.FILTERS)


def test_windows_cover_whole_texts():
    x, owner, weight = langid.windows([b"a" * 600, b"", b"b"])
    assert owner.tolist() == [0, 0, 0, 2] and weight.tolist() == [256, 256, 88, 1] and (x[2, 88:] == 32).all()


def test_odd_rows(odd):
    got = langid.identify(odd, F.lit(True)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by_id[2]["lang_pred"] == by_id[3]["lang_pred"] == by_id[4]["lang_pred"] == by_id[9]["lang_pred"] == "und" and by_id[2]["score"] == 0
    assert by_id[1]["lang_pred"] == "en" and by_id[1]["_text"] == "x" and by_id[8]["lang_pred"] == "en"


def test_empty_and_unlabelled(nothing, odd):
    assert langid.identify(nothing, F.lit(True)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()} == {"und"}
