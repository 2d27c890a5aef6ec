"""A SELECT over each micro-batch of a streaming DataFrame; statements see the batch as a table."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from pyspark.sql.streaming import DataStreamWriter

    from ..engine import Engine


def select_each_batch(engine: Engine, sql: str, stream: DataFrame, table: str, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer, to be started by the caller, that hands each batch's result to sink with the batch's number."""
    def run(batch: DataFrame, number: int) -> None:
        own = engine.clone()
        own.register(table, batch)
        sink(own.query(sql), number)

    return stream.writeStream.foreachBatch(run)
