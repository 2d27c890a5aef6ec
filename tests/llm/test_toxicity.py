import math
import os
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import textvec, toxicity


def corpus(n=900, seed=5):
    rng = np.random.default_rng(seed)
    parts = "re nd on ti in th er ha st ed ou ly en at or es".split()
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts, int(rng.integers(1, 5)))) for _ in range(int(rng.integers(15, 120)))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(int(rng.integers(2, 6))):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["zwackel", "Blumpfig", "grozzo"])))
        rows.append((i, " ".join(words)))
        if i % 10:
            labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") % 3 != 1)
    return docs, marks, model, toxicity.score(docs, model).collect()


def test_held_out(scored):
    *_, got = scored
    held = [r for r in got if r["doc_id"] % 3 == 1]
    assert len(got) == 900 and np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]) > 0.98
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


# A plain version, with strings and dictionaries

def plain_expressions(text):
    """Lists of symbols."""
    out, run, dense = [], "", None
    ranges = lambda c: any(a <= ord(c) < z for a, z in toxicity.DENSE)

    def close():
        if dense:
            out.extend(run[i : i + toxicity.DENSE_LONGEST] for i in range(len(run)))
        else:
            out.extend(run[i : i + toxicity.LONGEST] for i in range(0, len(run), toxicity.LONGEST))

    for c in text + "\n":
        good = c.isalnum() or unicodedata.category(c)[0] == "M"
        if run and (not good or ranges(c) != dense):
            close()
            run = ""
        if good:
            run, dense = run + c.lower()[0], ranges(c)
    return out


class Plain:
    def __init__(self, texts, learned):
        """learned: (text, class) rows."""
        words = {w for t in texts for w in plain_expressions(t or "")}
        five = {tuple(("^^^^" + w + "$")[i : i + 5]) for w in words for i in range(len(w) + 1)}
        self.counts = []
        kinds = five
        for _ in range(4):  # of four symbols down to one: how many kinds of symbols stand before
            self.counts.append(Counter(k[1:] for k in kinds))
            kinds = set(self.counts[-1])
        self.own = {0: Counter(), 1: Counter()}
        for text, c in learned:
            for w in set(plain_expressions(text or "")):
                for i in range(len(w) + 1):
                    self.own[c][w[:i], (w + "$")[i]] += 1

    def shared(self, gram):
        level = self.counts[4 - len(gram)]
        if len(gram) == 1:
            return (level[gram] + 0.5) / (sum(level.values()) + 0.5 * (len(level) + 1))
        after = [n for k, n in level.items() if k[:-1] == gram[:-1]]
        lower = self.shared(gram[1:])
        return max(level[gram] - 0.75, 0) / sum(after) + 0.75 * len(after) / sum(after) * lower if after else lower

    def p(self, c, before, symbol, lower):
        after = [n for (b, _), n in self.own[c].items() if b == before]
        return max(self.own[c][before, symbol] - 2, 0) / sum(after) + sum(min(n, 2) for n in after) / sum(after) * lower if after else lower

    def ratio(self, w):
        total = 0.0
        for i, s in enumerate(w + "$"):
            if any(b == w[:i] for c in (0, 1) for b, _ in self.own[c]):
                lower = self.shared(tuple(("^^^" + w + "$")[i : i + 4]))
                total += math.log(self.p(1, w[:i], s, lower) / self.p(0, w[:i], s, lower))
        return total

    def difference(self, text):
        words = plain_expressions(text or "")
        return sum(math.log(0.99 + 0.01 * math.exp(self.ratio(w))) for w in words) / sum(len(w) + 1 for w in words) if words else 0.0


TEXTS = ["der Hund und der Hut", "Hunger, hündisch! 42 é", "ΟΔΟΣ дом дома", "日本語のテキスト です", None, "", "...", "x" * 150, "der der der Hund", "die Hunde und die Katze", "Katzen zwackel zwack zwackeln", "zwackel und zwackeln", "nur zwackelig"]
CLASSES = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1]


def test_against_a_plain_version(spark, monkeypatch):
    """All from the same rows: expressions, shared counts, class models, mixing and normalising."""
    texts, classes = TEXTS * 3, CLASSES * 3
    plain = Plain(texts, list(zip(texts, classes, strict=True)))
    monkeypatch.setattr(toxicity, "CALIBRATE_ROWS", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(classes)), "doc_id long, toxic int"), F.lit(True))
    new = [*TEXTS, "zwackel", "zwackeln", "Hundezwackel", "unbekannt", "日本", "dom ДОМАМ", "zwackel " * 4000]
    got = toxicity.differences(toxicity.unsqueezed(model.blob, model.root), new)
    assert np.allclose(got, [plain.difference(t) for t in new], atol=1e-5)
    expected = 1 / (1 + np.exp(-np.clip(model.slope * np.log(np.maximum(got, 0) + toxicity.FLOOR) + model.intercept, -30, 30)))
    assert np.allclose(toxicity.scores(model, new), expected) and model.slope > 0


def test_expressions():
    x = toxicity.scan(["Ab c--d2é", "", "  ", "abc日本語かn", "z" * 130])
    got = ["".join(map(chr, x.symbols[s : s + n])) for s, n in zip(x.starts, x.sizes, strict=True)]
    assert got == ["ab", "c", "d2é", "abc", "日本語か", "本語か", "語か", "か", "n", "z" * 64, "z" * 64, "zz"] and x.bounds.tolist() == [0, 3, 3, 3, 9, 12]
    assert all(got[a:z] == plain_expressions(t) for t, a, z in zip(["Ab c--d2é", "", "  ", "abc日本語かn", "z" * 130], x.bounds, x.bounds[1:], strict=False))


def test_levels_hold_little_more_than_the_symbols():
    """The driver builds the class models: no running sums and powers for each symbol there, and the same hashes as the tasks'."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, toxicity.LONGEST + 1, 60000)
    symbols, starts = rng.integers(97, 105, int(sizes.sum()), dtype=np.uint32), np.cumsum(sizes) - sizes
    tracemalloc.start()
    for _ in toxicity.levels(symbols, starts, sizes):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(symbols)
    sums = toxicity._sums(symbols)
    for depth, x in enumerate(toxicity.levels(symbols, starts, sizes)):
        own = toxicity._hashes(sums, starts[x.expressions], np.minimum(depth + 1, sizes[x.expressions]))
        ended = sizes[x.expressions] == depth
        own[ended] = toxicity._ended(own[ended])
        assert np.array_equal(x.hashes[x.which], own)


def test_texts_do_not_depend_on_neighbours(scored):
    model = toxicity.unsqueezed(scored[2].blob, scored[2].root)
    texts = ["zwackel words here", None, "", "ab", "zwackel words here", "...", "x " * 5000]
    together = toxicity.differences(model, texts)
    assert np.allclose(together, [toxicity.differences(model, [t])[0] for t in texts])
    assert together[1] == 0 and together[0] == together[4]


def test_pieces_of_a_batch(scored, monkeypatch):
    """A task works a batch off in pieces: a few bytes of memory for each symbol of the batch, and the same results however it is cut."""
    model = toxicity.unsqueezed(scored[2].blob, scored[2].root)
    rows, _ = corpus(4000, seed=9)
    texts = [t for _, t in rows]
    monkeypatch.setattr(textvec, "_KEPT", {})
    known = toxicity.Slots()
    toxicity.differences(model, ["zwackel"], known)  # what is kept for good
    tracemalloc.start()
    whole = toxicity.differences(model, texts, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 1 << 20 and peak < 20 << 20
    monkeypatch.setattr(toxicity, "CHUNK", 1000)
    assert np.array_equal(whole, toxicity.differences(model, texts))


def test_threshold_counts_as_toxic(spark, scored):
    *_, model, _ = scored
    df = spark.createDataFrame([("zwackel zwackel the",)], "text string")
    exact = toxicity.score(df, model).first()["score"]
    assert toxicity.score(df, model, threshold=exact).first()["predicted"] == 1 and toxicity.score(df, model, threshold=np.nextafter(exact, 2)).first()["predicted"] == 0


def test_odd_rows(spark, scored, odd, nothing):
    _, marks, model, _ = scored
    got = toxicity.score(odd, model).collect()
    assert len(got) == 10 and got[0]["_text"] == "x" and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1  # repeated rows
    assert toxicity.score(nothing, model).collect() == []
    assert toxicity.fit(nothing, marks, F.lit(True)) is None
    assert toxicity.fit(odd, marks.limit(0), F.lit(True)) is None
    assert {(r["score"], r["predicted"]) for r in toxicity.score(odd, None).collect()} == {(0.0, 0)}
    assert "text" in toxicity.score(odd, model, keep_text=True).columns


def test_odd_labels(spark, odd):
    """Null ids and labels are left out; of repeated labels the largest counts."""
    marks = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (-7, None), (8, 0)], "doc_id long, toxic int")
    same = spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, toxic int")
    a, b = toxicity.fit(odd, marks, F.lit(True)), toxicity.fit(odd, same, F.lit(True))
    assert a == b and a is not None
    assert toxicity.fit(odd, same.where("toxic = 1"), F.lit(True)) is None


def test_labels_of_excluded_rows_do_not_matter(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.col("doc_id") % 3 != 1
    flipped = [(i, 1 - t if i % 3 == 1 else t) for i, t in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"), learn) for x in (labels, flipped))
    assert a.blob == b.blob and np.allclose(a[1:], b[1:])


def test_shared_counts_cover_all_rows(spark, monkeypatch):
    """Unlabelled texts change the shared order, however many rows the class models may learn from."""
    rows, labels = corpus(300)
    monkeypatch.setattr(toxicity, "LEARN_ROWS", 30)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    more = docs.unionAll(spark.createDataFrame([(9000 + i, f"zwa{i} zwe{i} zwi{i}") for i in range(50)], "doc_id long, text string"))
    a, b = toxicity.fit(docs, marks, F.lit(True)), toxicity.fit(more, marks, F.lit(True))
    assert a.blob != b.blob


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_recall_by_language(spark):
    from marlstone.llm import queries

    sf = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, sf).where("held_out")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("found")).collect()
    n = {(r["lang"], r["toxic"]): (r["n"], r["found"]) for r in rows}
    assert all(n[lang, 1][1] >= 0.9 * n[lang, 1][0] for lang in ("en", "de", "fr", "es"))
    assert sum(found for (_, t), (_, found) in n.items() if t == 0) <= 0.01 * sum(k for (_, t), (k, _) in n.items() if t == 0)
