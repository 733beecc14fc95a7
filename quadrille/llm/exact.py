"""Exact dedup as stateful streaming over fingerprints.

State is keyed by digest, lives in RocksDB without expiry and retains the
stable identifier (the largest id so far), its content locator (file and row)
and the number of arrivals. Every hit is checked on full bytes: rows are grouped
by the bytes themselves (with map-side combine, so a text repeated by a third of
all rows reaches the shuffle once a task), and a digest whose byte groups
disagree with its state is split by content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filed, fresh_path, located, remove, staged

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def stream_state(arrivals: DataFrame, files_per_batch: int = 4096, rows_per_store: int = 500_000) -> DataFrame:
    """Run the keyed stream over a staged table (_digest, _id, _loc); final state: _digest, _stay(_id, _loc), _n."""
    spark = arrivals.sparkSession
    files = arrivals.inputFiles()
    folder = files[0].rpartition("/")[0]
    out, marks = fresh_path(spark, "dedup-state"), fresh_path(spark, "dedup-marks")
    stores = min(max(6, arrivals.count() // rows_per_store), 20_000)
    conf = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        "spark.sql.shuffle.partitions": str(stores),
    }
    own = spark.newSession()  # the caller's settings stay as they are
    for k, v in conf.items():
        own.conf.set(k, v)
    updates = (
        own.readStream.schema(arrivals.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
        .groupBy("_digest")
        .agg(F.max(F.struct("_id", "_loc")).alias("_stay"), F.count(F.lit(1)).alias("_n"))
    )
    # a replayed micro-batch overwrites its own folder, so each update counts once
    query = (
        updates.writeStream.outputMode("update")
        .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"))
        .option("checkpointLocation", marks)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    remove(spark, marks)
    updated = spark.read.schema(updates.schema).parquet(f"{out}/batch=*")
    # identifiers and counts only grow, so the largest is the last
    return updated.groupBy("_digest").agg(F.max("_stay").alias("_stay"), F.max("_n").alias("_n"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda c: c,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 4096,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, locator.

    Rows with equal texts (after ``normalise``; null counts as empty) form a
    group; the row with the largest id stays, and of repeated rows with that id
    the one with the last locator, so exactly one row of a group is kept. Null
    ids sort below all others. An empty table gives an empty result. Columns of
    ``docs`` other than the two named are not read, whatever their names.
    ``digest`` may be weak: groups are told apart by bytes.
    """
    docs = filed(docs, "dedup-input")
    text = normalise(F.coalesce(docs[text_col], F.lit("")))
    rows = located(docs, _id=docs[id_col], _text=text)
    fingerprints = staged(rows.select("_id", "_loc", F.sha2("_text", 256).alias("_sha"), digest(F.col("_text")).alias("_digest")), "dedup-arrivals")
    if not fingerprints.inputFiles() or fingerprints.isEmpty():
        states = fingerprints.select("_digest", F.struct("_id", "_loc").alias("_stay"), F.lit(1).cast("long").alias("_n"))
    else:
        states = stream_state(fingerprints, files_per_batch)
    states = staged(states, "dedup-states")

    # full bytes of the hits: grouping compares the texts themselves
    by_bytes = (
        rows.select("_id", "_loc", "_text", digest(F.col("_text")).alias("_digest"))
        .groupBy("_digest", "_text")
        .agg(F.max(F.struct("_id", "_loc")).alias("_stay2"), F.count(F.lit(1)).alias("_n2"))
    )
    hits = states.filter("_n > 1").select("_digest", "_n")
    split = staged(by_bytes.select("_digest", "_n2").join(hits, "_digest").filter("_n <> _n2").select("_digest").distinct(), "dedup-collisions")
    out = fingerprints.join(states, "_digest", "left")
    if not split.isEmpty():
        again = rows.select("_loc", "_text", digest(F.col("_text")).alias("_digest")).join(split, "_digest", "left_semi")
        classes = by_bytes.join(split, "_digest", "left_semi")
        told = again.join(classes, ["_digest", "_text"]).select("_loc", "_stay2", "_n2")
        out = out.join(told, "_loc", "left").withColumns({"_stay": F.coalesce("_stay2", "_stay"), "_n": F.coalesce("_n2", "_n")})
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_stay._id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_loc") == F.col("_stay._loc")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.col("_loc").alias("locator"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; same columns.

    Null counts as empty, so one of all null and empty texts stays; of equal texts
    the largest id, and of rows that repeat it the last stored, stays; null ids
    are below all others; texts of any length are compared whole; an empty table
    gives no rows; extra columns, of whatever names, are carried along.
    """
    docs = filed(docs, "dedup-input")
    names = docs.columns
    rows = located(docs, **{f"_c{i}": docs[c] for i, c in enumerate(names)})
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("locator").alias("_loc"))
    return rows.join(kept, "_loc", "left_semi").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
