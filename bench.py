"""Headline queries, timed: python bench.py prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 4). Registered scripts run
over Parquet into Spark's noop sink; the four text_ queries run over two tab separated files of
BENCH_ROWS rows (default 2,000,000; 0 leaves them out) and write their whole result as a text file. Each
query runs once to warm up; the median of three further runs counts.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = ("bench_join", "bench_group", "bench_like", "bench_order", "flagship", "group_multi", "join_multi", "lazy_pivot", "in_subquery", "distinct", "having", "everything")
TEXT = {
    "text_join": "select * into [out.tsv] from t1 join t2 on t1.foo = t2.foo",
    "text_group": "select bar, count(*) into [out.tsv] from t1 group by bar",
    "text_like": "select foo into [out.tsv] from t1 where foo like '%aa[0-9]aa%'",
    "text_order": "select * into [out.tsv] from t1 order by foo, baz desc",
}


def make(spark: SparkSession, folder: str, rows: int) -> None:
    """t1.tsv and t2.tsv: foo of 8 hex digits, bar of 2, baz a number, from fixed seeds."""
    for k, name in enumerate(("t1", "t2")):
        digits = lambda n, seed: F.substring(F.sha2(F.concat_ws("-", F.col("id"), F.lit(seed)), 256), 1, n)
        line = F.concat_ws("\t", digits(8, 10 * k), digits(2, 10 * k + 1), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(262144)).cast("string"))
        spark.range(0, rows, 1, 4).select(line.alias("value")).write.mode("overwrite").text(f"file://{folder}/parts")
        with open(os.path.join(folder, f"{name}.tsv"), "wb") as out:
            out.write(b"foo\tbar\tbaz\n")
            for part in sorted(p for p in os.listdir(f"{folder}/parts") if p.startswith("part-")):
                with open(f"{folder}/parts/{part}", "rb") as f:
                    shutil.copyfileobj(f, out)
        shutil.rmtree(f"{folder}/parts")


def timed(run) -> float:
    run()
    seconds = []
    for _ in range(3):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    from marlstone import queries
    from marlstone.engine import Engine

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    found = {}
    for name in HEADLINE:
        found[name] = timed(lambda q=queries.QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save())
    if rows := int(os.environ.get("BENCH_ROWS", 2_000_000)):
        folder = tempfile.mkdtemp(prefix="marlstone-bench-")
        try:
            make(spark, folder, rows)
            for name, sql in TEXT.items():
                found[name] = timed(lambda sql=sql: Engine(spark, folder, overwrite=True).execute(sql))
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}), flush=True)


if __name__ == "__main__":
    sys.exit(main())
