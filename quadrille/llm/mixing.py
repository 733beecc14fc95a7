"""Mixing sources to target weights by systematic sampling, in SQL functions only.

Within a source, documents stand in the order (size class, hash, size, id); each
adds its expected copies (target / source size) to a prefix sum, one random
offset shifts the whole source, and a document is emitted once per integer
boundary that it crosses. The prefix sum has two levels - counts of (source,
class, leading bits of the hash) chunks, then rank within the chunk - so that a
source with a third of all rows is spread over many tasks. How many bits lead
doesn't change the order, so the draw doesn't depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, word_count

CYCLE = (3, 1, 2)
ROWS_PER_SALT = 50_000


HASH_BITS = 32


def _hash(*parts: Column) -> Column:
    """Eight hex digits of an MD5 as a number of ``HASH_BITS`` bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(_null, _source, source_size) -> the same with target.

    Sources by code point, null last, weigh ``cycle`` in turn and share ``share``
    times all sizes; a target stops at ``cap`` times its source's size and the
    excess is shared again by weight. That is water-filling: sources are filled
    in the order of cap / weight, so running sums give the level. One row per
    source: the windows without partition hold as many rows as there are sources.
    """
    order = Window.orderBy("_null", "_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    fill = Window.orderBy("_ratio", "_null", "_source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    t = t.withColumn("_rank", F.row_number().over(fill)).withColumn(
        "_level",
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after),
    )
    t = t.withColumn("_open", F.when(F.col("_ratio") > F.col("_level"), F.struct("_rank", "_level")))
    t = t.withColumn("_first", F.min("_open").over(everything))
    full = F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank"))
    return t.select("_null", "_source", "source_size", F.when(full, F.col("_cap")).otherwise(F.col("_weight") * F.col("_first._level")).alias("target"))


def systematic_mix(
    rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, share: float = 1.5, cap: float = 2.0, seed: str = "mix", rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """``rows`` with size, source_size, target, copies and taken (columns of ``rows`` are kept under a struct ``row``).

    ``size``: by default the words of ``text``; null counts as 0. A null source
    is a source of its own, last in order. Sources without words get no copies.
    Repeated rows are sampled one by one; ids may be null or repeated. The draw
    depends on seed, source, id and size alone, so reruns agree. An empty table
    gives an empty result.
    """
    size = word_count(rows["text"]) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    base = rows.select(
        F.struct(*[rows[c] for c in rows.columns]).alias("row"),
        size.alias("size"),
        F.coalesce(rows[source_col].cast("string"), F.lit("")).alias("_source"),
        rows[source_col].isNull().alias("_null"),
        F.coalesce(rows[id_col].cast("string"), F.lit("")).alias("_id"),
    )
    counts = base.groupBy("_null", "_source").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("source_size"))
    counts = staged(counts, "mix-sources")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    bits = min((total // rows_per_salt).bit_length(), HASH_BITS)
    base = base.withColumn("_class", F.floor(F.sqrt(F.col("size").cast("double")))).withColumn("_hash", _hash(F.lit(seed), F.col("_id")))
    base = base.withColumn("_salt", F.shiftright("_hash", HASH_BITS - bits))
    keys = ["_null", "_source", "_class", "_salt"]
    chunks = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chunks = chunks.withColumn("_before", F.sum("_n").over(Window.partitionBy("_null", "_source").orderBy("_class", "_salt")) - F.col("_n"))
    targets = source_targets(counts.drop("_rows"), share, cap)
    chunks = chunks.join(targets, ["_null", "_source"]).drop("_n")
    at = base.join(chunks, keys).withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", "size", "_id")))
    offset = _hash(F.lit(seed), F.lit("offset"), F.col("_null").cast("int").cast("string"), F.col("_source")) / F.lit(float(1 << HASH_BITS))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(offset + F.col("_at") * step) - F.floor(offset + (F.col("_at") - 1) * step)
    copies = F.least(crossed, F.lit(int(cap)).cast("long"))
    return at.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emit_copies(rows: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``rows``, each row once per copy, and the copy's number from 1.

    The number is called ``copy``, or ``copy_2`` and so on where ``rows`` has that
    name. Null texts have no words and are taken by their place in the order alone;
    null sources are a source; repeated rows and null ids are sampled one by one;
    texts of any length count whole; an empty table gives no rows.
    """
    mixed = systematic_mix(rows, **options)
    names = rows.columns
    number = next(x for x in ("copy", *(f"copy_{k}" for k in range(2, len(names) + 3))) if x not in names)
    return (
        mixed.filter("copies > 0")
        .select(*[F.col("row").getField(c).alias(f"_c{i}") for i, c in enumerate(names)], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
        .select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], F.col("_copy").alias(number))
    )
