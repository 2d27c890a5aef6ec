import numpy as np
import pytest

from marlstone.llm import jaccard
from marlstone.llm.components import components

from .conftest import ROWS


def sets(text, n):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    s = [sets(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    key = lambda i: -(1 << 63) if i is None else i
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), (key(d), d)), (key(d), d), key=lambda x: x[0])
    return sorted(((key(d), len(s[i]), key(low[find(i)][1])) for i, (d, _) in enumerate(rows)))


def check(spark, rows, n, percent):
    got = jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent).collect()
    key = lambda i: -(1 << 63) if i is None else i
    assert sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in got) == brute(rows, n, percent)


def corpus(seed, chain=False):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(1, 260)))]
        for _ in range(int(rng.integers(1, 9))):
            words = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                words[int(rng.integers(0, len(words)))] = f"x{rng.integers(0, 10**6)}"
            words = words[int(rng.integers(0, 1 + len(words) // 20)) :]
            rows.append((len(rows) * 3 - 20, " ".join(words)))
            if chain:
                base = words or base
    rng.shuffle(rows)
    return [(int(i), str(t)) for i, t in rows]


@pytest.mark.parametrize(("seed", "n", "percent", "chain"), [(1, 4, 85, False), (2, 4, 85, True), (3, 5, 80, False), (4, 5, 80, True), (5, 2, 60, True)])
def test_against_all_pairs(spark, seed, n, percent, chain):
    check(spark, corpus(seed, chain), n, percent)


def test_small_sets(spark):
    check(spark, [(i, " ".join(f"a{x}" for x in range(i % 7, i % 7 + i % 9))) for i in range(60)], 3, 50)


def test_odd_rows(spark, odd, nothing):
    check(spark, [*ROWS, (30, "THE cat\tsat on the MAT"), (31, "one two"), (32, "ONE  two"), (33, "é É"), (34, "É é")], 4, 85)
    assert len(jaccard.components_of(odd).collect()) == len(ROWS)
    assert jaccard.components_of(nothing).collect() == []


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components_of(spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("parted", [0, 1 << 26])
def test_blocks_of_large_groups(spark, monkeypatch, parted):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 4)
    monkeypatch.setattr(jaccard, "PARTED", parted)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, 120))] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    check(spark, rows, 4, 85)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 85, 95):
        bands = jaccard.Bands(percent)
        for _ in range(200):
            size = int(rng.integers(1, 400))
            union = rng.integers(0, 1 << 62, size, dtype=np.int64).astype(np.uint64)
            differ = size * (100 - percent) // 100
            a, b = union[: size - differ // 2], union[differ - differ // 2 :]
            owner = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
            text, key = jaccard.signatures(owner, np.r_[a, b], 2, bands)
            assert set(key[text == 0].tolist()) & set(key[text == 1].tolist())


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(50):
        pool = rng.integers(0, 1 << 62, 300, dtype=np.int64).astype(np.uint64)
        a, b = pool[: int(rng.integers(1, 300))], pool[int(rng.integers(0, 299)) :]
        size = np.array([len(a), len(b)])
        blob, start = jaccard.sketches(np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[a, b], size)
        bits = int(jaccard.sketch_bits(size).min())
        x, y = (jaccard.folded(blob[start[i] : start[i + 1]].tobytes(), bits) for i in (0, 1))
        assert np.bitwise_count(x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_representatives_keep_columns(spark, odd, nothing):
    out = jaccard.representatives(odd.union(odd.limit(1).selectExpr("77L doc_id", "upper(text) text", "lang", "source", "_text", "_id", "score")))
    assert out.columns == odd.columns and 77 not in {r["doc_id"] for r in out.collect()} and out.count() == len(ROWS)
    assert jaccard.representatives(nothing).collect() == []


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(100)] + [(500, 400), (400, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[500] == got[400] == 400


def test_parts_of_many_rows():
    """Rows joined over shared parts of sketches are those joined by looking at all pairs."""
    rng = np.random.default_rng(11)
    hashes, owner, size = [], [], []
    for c in range(60):
        base = rng.integers(0, 1 << 62, int(rng.integers(20, 60)), dtype=np.int64).astype(np.uint64)
        for _ in range(int(rng.integers(1, 40 if c == 0 else 5))):
            own = base[rng.random(len(base)) > 0.06]
            own = np.unique(np.r_[own, rng.integers(0, 1 << 62, int(rng.integers(0, 4)), dtype=np.int64).astype(np.uint64)])
            owner += [len(size)] * len(own)
            size.append(len(own))
            hashes += own.tolist()
    size = np.array(size)
    blob, start = jaccard.sketches(np.array(owner), np.array(hashes, np.uint64), size)
    held = [blob[start[i] : start[i + 1]].tobytes() for i in range(len(size))]
    ids = rng.permutation(len(size))
    got = jaccard.parted(ids, size, held, 80)
    few, jaccard.FEW = jaccard.FEW, 10**6
    try:
        assert (got == jaccard.parted(ids, size, held, 80)).all()
    finally:
        jaccard.FEW = few
    assert len(set(got.tolist())) < len(size)
