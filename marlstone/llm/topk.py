"""Exact top-k by inner product of whole-number vectors.

Vectors are sparse rows of (dimension, weight). Queries and candidates are packed into
blocks; every block of queries meets every block of candidates, whose postings by
dimension are scattered into dense score arrays, dimension after dimension; the best k
are taken by partition selection and merged, in the task and then by query.

Scores are whole numbers of any size: 32 or 64 bits where a bound of the blocks' weights shows that these suffice, else Python's.

Defined results: vectors that are null, or hold a null or non-finite component, take no part,
nor do rows with a null id; vectors of different lengths meet in the dimensions they share;
an empty vector scores 0; each row is a query and a candidate of its own, repeated ids too; a query's own row, which is no candidate, is one
with its id and its vector; of equal scores the smaller id comes first; a score beyond 64 bits is ranked as it is and shown as the nearest number of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Vectors in a block: candidates, queries, and queries scored at once.
CANDIDATES, QUERIES, AT_ONCE = 4096, 1024, 32
FIRST, LAST = -(1 << 63), (1 << 63) - 1


def taking_part(vector: Column) -> Column:
    """The vector as doubles; null if it takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, vector.cast("array<double>"))


def sortable(n: int) -> bytes:
    """Bytes that sort as whole numbers do."""
    digits = abs(n).to_bytes((abs(n).bit_length() + 7) // 8, "big")
    out = len(digits).to_bytes(2, "big") + digits
    return b"\1" + out if n >= 0 else b"\0" + bytes(255 - x for x in out)


def _packed(rows: DataFrame, most: int, names: tuple[str, str, str]) -> DataFrame:
    """Blocks of at most that many rows: ids (int64), lengths (int32) and components (float64), as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, weights, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            block = [pa.array([b"".join(x)], pa.binary()) for x in (ids, lengths, weights)]
            for x in (ids, lengths, weights):
                x.clear()
            return pa.RecordBatch.from_arrays(block, names=list(names))

        for b in batches:
            for start in range(0, b.num_rows, most):
                part = b.slice(start, most)
                if held and held + part.num_rows > most:
                    yield out()
                    held = 0
                vectors = part.column(1)
                ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
                lengths.append(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32).tobytes())
                weights.append((vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).tobytes())  # no -0.0: equal vectors have equal bytes
                held += part.num_rows
        if held:
            yield out()

    return rows.mapInArrow(run, ", ".join(f"{n} binary" for n in names))


class Block(NamedTuple):
    """Vectors by row; of the weights, floor(scale * x), one row for each dimension, absent ones 0, and what none exceeds."""

    ids: np.ndarray
    vectors: list[bytes]
    dense: np.ndarray
    most: int


def _unpacked(ids: bytes, lengths: bytes, weights: bytes, scale: int) -> Block:
    i, n, x = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int32), np.frombuffer(weights)
    ends = np.cumsum(n)
    rows, at = np.repeat(np.arange(len(i)), n), np.arange(len(x)) - np.repeat(ends - n, n)
    if float(np.abs(x).max(initial=0)) * scale < 1 << 52:
        w = np.floor(x * scale).astype(np.int64)
        most = int(np.abs(w).max(initial=0))
    else:
        w = np.array([math.floor(Fraction(v) * scale) for v in x.tolist()], object)
        most = max(map(abs, w.tolist()), default=0)
    dense = np.zeros((int(n.max(initial=0)), len(i)), w.dtype)
    dense[at, rows] = w
    return Block(i, [weights[8 * (z - k) : 8 * z] for k, z in zip(n.tolist(), ends.tolist(), strict=True)], dense, most)


def _postings(dense: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each dimension, the rows that have it and their weights."""
    out = []
    for weights in dense:
        rows = np.flatnonzero(weights)
        out.append((slice(None), weights) if len(rows) == len(weights) else (rows, weights[rows]))
    return out


def _scores(queries: np.ndarray, postings: list, n: int) -> np.ndarray:
    """Term at a time: each query's weight times the postings of its dimension, added into its dense row."""
    out = np.zeros((queries.shape[1], n), queries.dtype)
    product = np.empty_like(out)
    for weights, (rows, own) in zip(queries, postings, strict=False):
        has = np.flatnonzero(weights)
        if isinstance(rows, slice) and len(has) == len(weights):
            out += np.multiply.outer(weights, own, out=product)
        elif len(has) and len(own):
            at = np.arange(n)[rows]
            out[np.ix_(has, at)] += np.multiply.outer(weights[has], own)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest rows of (score, id, own), ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= least)
        scores, ids, own = scores[rows], ids[rows], own[rows]
    order = np.lexsort((ids, scores))[::-1] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: scores[i], reverse=True), np.int64)
    scores, ids, own = scores[order], ids[order], own[order]
    ties = np.cumsum(np.r_[False, scores[1:] != scores[:-1]])
    order = np.lexsort((~own, ids, ties))[:k]
    return scores[order], ids[order], own[order]


def top_k(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest candidates."""
    rows = [df.select(F.col(id_col).cast("long").alias("id"), taking_part(F.col(vector_col)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL") for df in (candidates, queries)]
    parts = max(1, -(-queries.where(F.col(id_col).isNotNull()).count() // QUERIES))
    # equal rows are asked once: their answers are alike
    asked = rows[1].groupBy("id", "v").agg(F.count("*").alias("copies"))
    blocks = _packed(rows[0], CANDIDATES, ("c_ids", "c_lengths", "c_weights")).crossJoin(_packed(asked.select("id", "v").repartition(parts), QUERIES, ("q_ids", "q_lengths", "q_weights")))
    more = k + 1  # the own row may be one of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        last: tuple = ()
        for b in batches:
            for row in b.to_pylist():
                packed = (row["c_ids"], row["c_lengths"], row["c_weights"])
                if last[:1] != (packed,):
                    block = _unpacked(*packed, scale)
                    last = (packed, block, {})
                _, block, postings = last
                ask = _unpacked(row["q_ids"], row["q_lengths"], row["q_weights"], scale)
                bound = block.most * ask.most * min(len(block.dense), len(ask.dense))
                kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
                if kind not in postings:
                    postings[kind] = _postings(block.dense.astype(kind))
                same = np.isin(ask.ids, block.ids)
                for start in range(0, len(ask.ids), AT_ONCE):
                    scores = _scores(ask.dense[:, start : start + AT_ONCE].astype(kind), postings[kind], len(block.ids))
                    for at, found in enumerate(scores, start):
                        q, vector, own = int(ask.ids[at]), ask.vectors[at], np.zeros(len(block.ids), bool)
                        if same[at]:
                            for i in np.flatnonzero(block.ids == q).tolist():
                                own[i] = block.vectors[i] == vector
                        found = _best(found, block.ids, own, more)
                        if (q, vector) in best:
                            found = _best(*(np.concatenate(x) for x in zip(best[q, vector], found, strict=True)), more)
                        best[q, vector] = found
        for (q, vector), (scores, ids, own) in best.items():
            exact = [int(s) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [pa.array([q] * len(ids), pa.int64()), pa.array([vector] * len(ids), pa.binary()), pa.array(ids), pa.array([max(FIRST, min(LAST, s)) for s in exact], pa.int64()), pa.array([sortable(s) for s in exact], pa.binary()), pa.array(own)],
                names=["query_id", "vector", "vec_id", "score", "exact", "own"],
            )

    found = blocks.mapInArrow(run, "query_id long, vector binary, vec_id long, score long, exact binary, own boolean")
    query = W.partitionBy("query_id", "vector")
    other = found.withColumn("owns", F.row_number().over(W.partitionBy("query_id", "vector", "own").orderBy(F.desc("exact"), "vec_id"))).where("NOT own OR owns > 1")
    ranked = other.withColumn("rank", F.row_number().over(query.orderBy(F.desc("exact"), "vec_id"))).where(F.col("rank") <= k)
    repeated = _vectors_as_bytes(asked.where("copies > 1"))
    times = ranked.join(repeated, ["query_id", "vector"], "left").select("query_id", "rank", "vec_id", "score", F.coalesce("copies", F.lit(1)).alias("copies"))
    return times.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", "rank", "vec_id", "score")


def _vectors_as_bytes(asked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [(np.array(v, np.float64) + 0.0).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.binary()), b.column(2)], names=["query_id", "vector", "copies"])

    return asked.select("id", "v", "copies").mapInArrow(run, "query_id long, vector binary, copies long")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
