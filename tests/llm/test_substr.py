import hashlib
import re

import numpy as np
import pytest

from marlstone.llm import substr

from .conftest import ROWS


def brute(rows, window=20):
    """(id, n_words, n_removed, kept) by looking at every window."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    order = lambda i: -(1 << 63) if i is None else i
    for i, w in words:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, (order(i), j)), (order(i), j))
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (order(i), j):
                gone |= set(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return out


def check(spark, rows, window=20):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substr.dedup(df, window=window, digest=True).collect())
    assert got == sorted((i is not None, i or 0, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows, window))


def test_every_offset_shares_a_cover_position():
    for period, members in substr.PERIODS.items():
        assert all(any((i + k) % period in members and (j + k) % period in members for k in range(period)) for i in range(period) for j in range(period))


@pytest.mark.parametrize("window", [20, 12, 9, 5])
def test_against_brute_force(spark, window):
    rng = np.random.default_rng(window)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(window, 60)))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [" ".join(f"u{x}" for x in rng.integers(0, 3000, int(rng.integers(0, 40))))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [passages[int(rng.integers(0, 8))], " ".join(f"v{x}" for x in rng.integers(0, 3000, int(rng.integers(0, 15))))]
        rows.append((i, " ".join(parts)))
    rows += [(100, "same " * 70), (101, "same\n" * 45), (102, rows[3][1]), (3, rows[3][1]), (5, rows[7][1])]
    check(spark, rows, window)


def test_odd_rows(spark, odd):
    check(spark, ROWS + [(None, "no id here but a text that has words " * 5), (20, "no id here but a text that has words " * 5)])
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substr.dedup(odd).collect()}
    assert (2, 0, 0) in got and (5, 30001, 29999) in got


def test_texts_and_columns_stay(spark, odd, nothing):
    out = substr.dedup(odd)
    assert out.columns == ["doc_id", "lang", "source", "_text", "_id", "score", "n_words", "n_removed", "text"]
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[2] is None and texts[4] == " \t\n" and texts[1] == "the cat sat on the mat"
    assert substr.dedup(nothing).collect() == []


def test_copies_over_many_flushes(spark, monkeypatch):
    monkeypatch.setattr(substr, "FLUSH", 64)
    monkeypatch.setattr(substr, "FLUSH_WINDOWS", 64)
    p = " ".join(f"p{i}" for i in range(30))
    check(spark, [(i, f"a{i} {p} b{i} " + (p if i % 3 == 0 else "")) for i in range(80)])
