import numpy as np
import pytest

from marlstone.llm import decontam


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(7)
    common = [f"c{i}" for i in range(8)]
    word = lambda: str(rng.choice(common)) if rng.random() < 0.4 else f"w{rng.integers(0, 4000)}"
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, sentence(int(rng.integers(12, 25))) + " " + sentence(int(rng.integers(8, 20)))) for i in range(60)]
    docs, truth = [], set()
    for d in range(150):
        parts = [sentence(int(rng.integers(1, 200)))]
        if d % 5 == 0:
            i = int(rng.integers(0, 60))
            truth.add((d, i))
            parts += [items[i][1].upper() if d % 10 else items[i][1].replace(" ", "\n"), sentence(int(rng.integers(1, 150)))]
        if d % 5 == 1:  # the question alone, or words of an item in another order
            i = int(rng.integers(0, 60))
            words = items[i][1].split()
            rng.shuffle(words)
            parts += [" ".join(words)] if d % 2 else [decontam.parts_of(items[i][1])[0][:60]]
        docs.append((d, " ".join(parts)))
    return items, docs, truth


def test_planted_items_are_found_and_no_others(spark, world):
    items, docs, truth = world
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth
    assert all(r["score"] >= decontam.THRESHOLD and r["question_overlap"] >= 0.5 and r["answer_overlap"] >= 0.5 for r in got)


def test_wand_against_scoring_everything(world):
    items, docs, _ = world
    index = decontam.build(items)
    everything = set(range(len(items) // decontam.BLOCK + 1))
    for _, text in docs[:60]:
        for threshold in (0.05, 0.2, 0.5):
            words = decontam.folded([text.encode()])
            terms = np.flatnonzero(np.isin(index.terms, words.hashes))
            scores = np.zeros(len(index.items))
            for t in terms.tolist():
                scores[index.item[index.first[t] : index.first[t + 1]]] += index.weight[index.first[t] : index.first[t + 1]]
            got = dict(decontam.wand(index, terms, everything, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-9).tolist())
            assert all(abs(got[i] - scores[i]) < 1e-9 for i in got)


def test_search_loses_nothing_to_bounds(world, monkeypatch):
    items, docs, _ = world
    index = decontam.build(items)
    found = {(p, i) for p, i, *_ in decontam.search(index, [t.encode() for _, t in docs])}
    for d, text in docs:  # every passage, every item
        words = decontam.folded([text.encode()])
        _, start, end = decontam.passages(words.bounds, index.passage)
        for a, z in zip(start.tolist(), end.tolist(), strict=True):
            h = words.hashes[a:z]
            terms = np.flatnonzero(np.isin(index.terms, h))
            scores = np.zeros(len(items))
            for t in terms.tolist():
                scores[index.item[index.first[t] : index.first[t + 1]]] += index.weight[index.first[t] : index.first[t + 1]]
            runs = decontam.windows(h, decontam.RUN)
            for i in np.flatnonzero(scores >= decontam.THRESHOLD).tolist():
                if min(np.isin(part, runs).mean() for part in (index.question[i], index.answer[i])) >= decontam.OVERLAP:
                    assert (d, i) in found


def test_passages_cover_every_stretch():
    for n in (1, 5, 31, 32, 33, 64, 100, 999):
        owner, start, end = decontam.passages(np.array([0, 0, n]), 64)
        assert set(owner.tolist()) == {1} and end.max() == n
        for a in range(max(1, n - 31)):
            assert any(s <= a and min(a + 32, n) <= e for s, e in zip(start.tolist(), end.tolist(), strict=True))


def test_question_and_answer():
    assert decontam.parts_of("What is the name? It is Bob Smith here.") == ("What is the name?", " It is Bob Smith here.")
    q, a = decontam.parts_of("one two three four five six seven eight nine")
    assert (q + " " + a).split() == "one two three four five six seven eight nine".split() and len(a.split()) >= decontam.LEAST_ANSWER


def test_odd_rows(spark, odd, nothing, world):
    items = spark.createDataFrame([*world[0][:5], (None, "x"), (900, None), (901, ""), (902, "..."), (903, "the cat sat on the mat"), (904, "the cat sat on the mat")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd, items).collect()}
    assert got == {(1, 903), (1, 904)}
    assert decontam.contaminated(nothing, items).collect() == []
    assert decontam.contaminated(odd, items.limit(0)).collect() == []
    left = decontam.clean(odd, items)
    assert left.columns == odd.columns and 1 not in {r["doc_id"] for r in left.collect()} and left.count() == 8
    assert decontam.clean(odd, items.limit(0)).count() == 10


def test_items_in_parts(spark, world, monkeypatch):
    items, docs, truth = world
    monkeypatch.setattr(decontam, "PART_BYTES", 2000)
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontam.indexes(frame)) > 1
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), frame).collect()
    assert truth <= {(r["doc_id"], r["item_id"]) for r in got}


@pytest.mark.parametrize(("n", "copies"), [(5, 3), (14, 3), (60, 20)])
def test_copies_of_one_item_are_found(world, n, copies):
    items = [(i, world[0][0 if i < copies else i][1]) for i in range(n)]
    texts = ["so " * 90 + items[0][1] + " and so on" * 40, items[-1][1], "so on and on"]
    found = {(p, i) for p, i, *_ in decontam.search(decontam.build(items), [t.encode() for t in texts])}
    assert found == {*((0, i) for i in range(copies)), (1, n - 1)}


def test_short_parts_are_found(world):
    items = [*world[0][:40], (100, "Zyx"), (101, "Qua wub"), (102, "Who wrote the famous play Hamlet? Shakespeare"), (103, "vex nob tir gam lup sed fiq mor"),
             (104, "What is six times seven? = 42 ."), (105, "vor ? bex dal ! - nuk")]
    texts = [f"so it goes {t} and on and on" for _, t in items[40:]] + ["who wrote about a famous play of 41", "qua and wub, zyxx"]
    found = {(p, i) for p, i, *_ in decontam.search(decontam.build(items), [t.encode() for t in texts])}
    assert found == {(p, 40 + p) for p in range(6)}


def test_parts_give_the_results_of_the_whole(spark, world, monkeypatch):
    items, docs, _ = world
    halves = [(1000 + d, " ".join(t.split()[: len(t.split()) // 2 + d % 7 - 2])) for d, (_, t) in enumerate(items)]  # near the threshold
    frame = spark.createDataFrame(items, "item_id long, text string")
    texts = spark.createDataFrame(docs + halves, "doc_id long, text string")
    monkeypatch.setattr(decontam, "OVERLAP", 0.0)
    [index] = decontam.indexes(frame)
    found = lambda indexes: sorted((p, int(x.items[i]), round(s, 9)) for x in indexes for p, i, s, *_ in decontam.search(x, [t.encode() for _, t in docs + halves]))
    whole, rows = found([index]), decontam.contaminated(texts, frame).count()
    monkeypatch.setattr(decontam, "PART_BYTES", 1000)
    parts = decontam.indexes(frame)
    assert len(parts) > 4 and {x.passage for x in parts} == {index.passage}
    assert found(parts) == whole and len(whole) > 50
    assert decontam.contaminated(texts, frame).count() == rows
