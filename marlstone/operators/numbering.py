"""Row numbers in file order, without bringing the rows into one partition."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import RunFault

WITHIN = (1 << 33) - 1


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: what is read from there, joins for example, has the same partitions each time."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RunFault("__ROWNUM over joins needs spark.checkpoint.dir, a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marlstone-checkpoint-"))
    return df.checkpoint()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a column that counts its rows from 1, in the order of its partitions.

    Partitions are counted first (one row each); a row's number is its place in its partition
    plus the rows of those before. df must give the same partitions twice, as scans do.
    """
    marked = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(WITHIN))})
    sizes = df.groupBy(F.spark_partition_id().alias("_part")).count()
    before = sizes.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    return marked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
