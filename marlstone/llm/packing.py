"""Arrays dealt out by bucket: one row for each bucket and flush, whose columns are the arrays' bytes.

A shuffle then moves a few large rows, and a bucket's arrays are put together again on the
other side, one bucket after the other, without Python code for each element.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Buckets for each shuffle partition.
SPREAD = 2


def buckets(spark: SparkSession) -> int:
    """How many buckets: a bucket's share of the data shrinks as the cluster's partitions grow."""
    return SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema(columns: int, keys: Sequence[str] = ("bucket",)) -> str:
    return ", ".join([*(f"{k} int" for k in keys), *(f"c{i} binary" for i in range(columns))])


def packed(bucket: np.ndarray, arrays: Sequence[np.ndarray | None], kind: int | None = None) -> pa.RecordBatch:
    """Rows of (bucket, kind if given, the bytes of each array's elements in the bucket), elements in order; None: no bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    edges = np.r_[first, len(bucket)]
    columns = [pa.array(bucket[first].astype(np.int32))]
    if kind is not None:
        columns.append(pa.array(np.full(len(first), kind, np.int32)))
    for x in arrays:
        if x is None:
            columns.append(pa.array([b""] * len(first), pa.binary()))
            continue
        data = np.ascontiguousarray(x[order])
        columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges * data.itemsize).astype(np.int32)), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", *(["kind"] if kind is not None else []), *(f"c{i}" for i in range(len(arrays)))])


def unpacked(batches: Iterator[pa.RecordBatch], kinds: Sequence[np.dtype | type], keys: int = 1) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """(bucket and kind, arrays) for each run of rows with equal keys within a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        own = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        edges = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        columns = [b.column(keys + i) for i in range(len(kinds))]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield tuple(own[:, a].tolist()), [np.frombuffer(b"".join(c.slice(a, z - a).to_pylist()), t) for c, t in zip(columns, kinds, strict=True)]


def whole(runs: Iterator[tuple[tuple[int, ...], list[np.ndarray]]]) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """The runs of equal keys put together."""
    last, held = None, []
    for key, arrays in runs:
        if key != last and held:
            yield last, [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        last = key
        held.append(arrays)
    if held:
        yield last, [np.concatenate(x) for x in zip(*held, strict=True)]
