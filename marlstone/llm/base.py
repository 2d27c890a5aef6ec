"""What the operators share: reading tables, cutting lineage, and the splits by crc32."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of spark.checkpoint.dir.

    Only where that setting is absent and Spark runs in one JVM is a temporary
    folder used; on a cluster a missing setting is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="marlstone-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to about most; a larger row stands alone."""
    start, total, at = 0, 0, -1
    for at, n in enumerate(sizes):
        if total and total + n > most:
            yield start, at
            start, total = at, 0
        total += n
    if at >= start:
        yield start, at + 1


def text_pieces(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows with about so many bytes of text, and these texts, null ones empty."""
    for a, z in pieces((n or 0 for n in pc.binary_length(column).to_pylist()), most):
        yield a, z, [t or b"" for t in raw_texts(column.slice(a, z - a))]


def zipped(df: DataFrame, text: str = "_text") -> DataFrame:
    """df with the text column as zstd frames, which shuffles move at less than half of the bytes; null stays null."""
    names = df.columns
    at = names.index(text)
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for a, z in pieces((n or 0 for n in pc.binary_length(b.column(at)).to_pylist()), 4 << 20):
                part = b.slice(a, z - a)
                small = pa.array([None if t is None else squeeze(t) for t in raw_texts(part.column(at))], pa.binary())
                yield pa.RecordBatch.from_arrays([small if i == at else c for i, c in enumerate(part.columns)], names=names)

    return df.mapInArrow(run, schema)


def unzipped(column: pa.Array) -> list[bytes | None]:
    """The texts of zipped()."""
    grow = zstandard.ZstdDecompressor().decompress
    return [None if z is None else grow(z) for z in column.to_pylist()]


def zipped_pieces(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """As text_pieces, for zipped() texts."""
    for a, z in pieces((3 * (n or 0) for n in pc.binary_length(column).to_pylist()), most):
        yield a, z, [t or b"" for t in unzipped(column.slice(a, z - a))]


def free(df: DataFrame, name: str) -> str:
    """name, or with underscores added, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy() -> None:
    """Give memory that a task has freed back to the system; workers live on after it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Rows and bytes in a batch that goes to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> None:
    """Texts are long: let the session send at most so many rows and bytes to Python at once (Spark's own limits are 10,000 rows and no bytes); a larger row goes alone."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _number(conf.get(key)) <= most:
            conf.set(key, str(most))


def _number(setting: str) -> int:
    """A setting's number, with or without a unit."""
    digits = setting.rstrip("bB").lower()
    return int(digits[:-1]) << {"k": 10, "m": 20, "g": 30}[digits[-1]] if digits[-1:] in ("k", "m", "g") else int(digits)
