"""Difference files as a change feed: each micro-batch is applied to a versioned graph table.

A replayed batch writes the same version again, so the result doesn't depend on
how often a batch ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..operators.graphs import FORWARD, REVERSE, SPO

CHANGE_TYPE = f"seq long, op string, s string, p string, o {T.TERM_TYPE}"


def changes_of(quads: DataFrame, seq: int) -> DataFrame:
    """(seq, op, s, p, o) rows of a difference model's quads."""
    op = F.when(F.col("g") == FORWARD, "add").when(F.col("g") == REVERSE, "delete")
    return quads.select(F.lit(seq).cast("long").alias("seq"), op.alias("op"), *SPO).filter("op is not null")


def fold(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The graph after all changes: for each triple the last one counts; of one sequence number, an addition wins over a deletion."""
    last = changes.groupBy(*SPO).agg(F.max(F.struct("seq", (F.col("op") == "add").alias("add"))).alias("m")).select(*SPO, F.col("m.add").alias("add"))
    kept = base.select(*SPO).distinct().join(last.filter("not add"), SPO, "left_anti")
    return kept.select(*SPO).union(last.filter("add").select(*SPO)).distinct()


def run(spark: SparkSession, source: str, base: DataFrame, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Apply the Parquet change files under ``source`` in micro-batches; the last version of the graph."""
    base.select(*SPO).distinct().write.mode("overwrite").parquet(f"{folder}/version=-1")

    def step(df: DataFrame, batch: int) -> None:
        before = spark.read.parquet(f"{folder}/version={batch - 1}")
        fold(before, df).write.mode("overwrite").parquet(f"{folder}/version={batch}")

    q = spark.readStream.schema(CHANGE_TYPE).option("maxFilesPerTrigger", files_per_batch).parquet(source).writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start()
    q.awaitTermination()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)]
    last = max(int(n.split("=")[1]) for n in names if n.startswith("version="))
    return spark.read.parquet(f"{folder}/version={last}")
