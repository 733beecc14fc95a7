"""Line dedup over content-defined chunks or all windows of lines.

Units that occur more than once anywhere are removed, but for the first occurrence,
after their bytes were compared. ``window_lines`` has every window of ``WINDOW``
lines and every line of more than ``LONG_WORDS`` words as a unit, so that a passage
which is shared with any other place goes whole, wherever it is cut from:
its windows are shared one by one, and those across its edges aren't. A line's first
occurrence in all stays, as any window around it has an earlier twin only
where the line has one.

``chunk_lines`` gives disjoint chunks, of which a passage shorter than some chunks may hold none. A rolling hash over the hashes of ``WINDOW`` consecutive lines ends a chunk where
it is divisible by ``DIVISOR``, so boundaries move with the content when lines
are inserted before it. Chunks of one line don't count.

Keys are counted first; the bytes of units with a repeated key are grouped by key
and bytes, combined before the shuffle, so that a unit found in a third of all
documents is shuffled once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, filed, located, staged

WINDOW = 2
DIVISOR = 2
#: A chunk ends after so many lines at the latest: runs of one repeated line have no boundary of their own.
MOST_LINES = 64
#: A line of more words is a unit by itself among windows.
LONG_WORDS = 50
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def key_of(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def chunk_lines(lines: list[bytes], window: int = WINDOW, divisor: int = DIVISOR, most: int = MOST_LINES) -> list[tuple[int, int]]:
    """(first line, number of lines) of the chunks, in order, covering all lines."""
    out, start, rolling = [], 0, 0
    top = pow(BASE, window, 1 << 64)
    hashes: list[int] = []
    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line)
        hashes.append(h)
        rolling = (rolling * BASE + h) & MASK
        if i >= window:
            rolling = (rolling - hashes[i - window] * top) & MASK
        full = i - start + 1
        # the low bits of a product depend on low bits alone, so the high ones are taken
        if full >= most or full >= 2 and i + 1 >= window and (rolling >> 33) % divisor == 0:
            out.append((start, full))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines) - start))
    return out


def chunk_units(lines: list[bytes]) -> list[tuple[int, int]]:
    """The chunks of two lines and more."""
    return [(start, n) for start, n in chunk_lines(lines) if n > 1]


def window_lines(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, number of lines) of every window of ``WINDOW`` lines and every long line, by first line; they overlap."""
    out = []
    for i, line in enumerate(lines):
        # so many words have as many bytes and spaces between them
        if len(line) > 2 * LONG_WORDS and len(line.split()) > LONG_WORDS:
            out.append((i, 1))
        if i + WINDOW <= len(lines):
            out.append((i, WINDOW))
    return out


Units = Callable[[list[bytes]], list[tuple[int, int]]]


def chunks(rows: DataFrame, key: Callable[[bytes], bytes] = key_of, units: Units = chunk_units) -> DataFrame:
    """(_id, _loc, idx, first, n, key) of the units in (_id, _loc, _text)."""
    return _cut(rows.select("_id", "_loc", "_text"), lambda lines, _: enumerate(units(lines)), key, False)


def bodies(rows: DataFrame, places: DataFrame, key: Callable[[bytes], bytes] = key_of) -> DataFrame:
    """(_id, _loc, idx, first, n, key, body) of the ``places`` (_loc, idx, first, n) in (_id, _loc, _text)."""
    wanted = places.groupBy("_loc").agg(F.collect_list(F.struct("idx", "first", "n")).alias("_spans"))
    return _cut(rows.select("_id", "_loc", "_text").join(wanted, "_loc").select("_id", "_loc", "_text", "_spans"), lambda _, spans: [(x["idx"], (x["first"], x["n"])) for x in spans], key, True)


def _cut(rows: DataFrame, spans_of: Callable, key: Callable[[bytes], bytes], with_body: bool) -> DataFrame:
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "_loc", "idx", "first", "n", "key", *["body"] * with_body]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, idx, first, n, keys, body, size = [], [], [], [], [], [], 0

            def flush():
                at = pa.array(owner, pa.int64())
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(idx, pa.int32()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(keys, pa.binary())]
                return pa.RecordBatch.from_arrays(columns + [pa.array(body, pa.binary())] * with_body, names)

            for i, text in enumerate(byte_texts(batch.column(2))):
                lines = text.split(b"\n")
                for k, (start, count) in spans_of(lines, batch.column(3)[i].as_py() if with_body else None):
                    held = b"\n".join(lines[start : start + count])
                    owner.append(i)
                    idx.append(k)
                    first.append(start)
                    n.append(count)
                    keys.append(key(held))
                    if with_body:
                        body.append(held)
                        size += len(held)
                        if size > 8 << 20:
                            yield flush()
                            owner, idx, first, n, keys, body, size = [], [], [], [], [], [], 0
                if len(owner) > 50_000:
                    yield flush()
                    owner, idx, first, n, keys, body, size = [], [], [], [], [], [], 0
            yield flush()

    return rows.mapInArrow(run, f"_id {kind}, _loc string, idx int, first int, n int, key binary" + ", body binary" * with_body)


def _merged(spans: Column) -> Column:
    """Sorted (first, n), those that overlap made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        end = F.greatest(last["first"] + last["n"], s["first"] + s["n"])
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), (end - last["first"]).alias("n"))))
        return F.when(s["first"] < last["first"] + last["n"], joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.slice(spans, 1, 1), add)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[bytes], bytes] = key_of, units: Units = chunk_units) -> DataFrame:
    """One row per document: id, n_lines, n_removed, removed ('first:count' by line), text without the removed units.

    Lines are split at \\n. The first occurrence, which stays, is the one with the
    smallest id, then locator, then position; a repetition that overlaps it only
    goes beyond it. Null counts as empty: one empty
    line, nothing removed, text ''. Repeated documents lose their units but for
    the first; null ids sort first; an empty table gives no rows; columns not
    named aren't read. ``key`` may be weak: bytes decide.
    """
    docs = filed(docs, "line-input")
    rows = located(docs, _id=docs[id_col], _text=F.coalesce(docs[text_col].cast("string"), F.lit("")))
    places = staged(chunks(rows, key, units), "line-chunks")
    repeated = places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    places = staged(places.join(repeated, "key", "left_semi"), "line-repeats")
    found = bodies(rows, places, key)
    compared = found.groupBy("key", "body").agg(F.min(F.struct("_id", "_loc", "idx", "first")).alias("stay"), F.count(F.lit(1)).alias("times"))
    classes = staged(compared.select("key", "stay", "times"), "line-classes")
    unequal = staged(classes.groupBy("key").count().filter("count > 1").select("key"), "line-collisions")
    seen = places.join(classes.filter("times > 1").join(unequal, "key", "left_anti"), "key")
    if not unequal.isEmpty():  # one key for different bytes: occurrences join on the bytes
        told = found.join(unequal, "key", "left_semi").join(compared.filter("times > 1"), ["key", "body"])
        seen = seen.unionByName(told.select(seen.columns))
    gone = seen.filter((F.col("_loc") != F.col("stay._loc")) | (F.col("idx") != F.col("stay.idx")))
    begin = F.when(F.col("_loc") == F.col("stay._loc"), F.greatest("first", F.col("stay.first") + F.col("n"))).otherwise(F.col("first"))
    gone = gone.select("_loc", begin.alias("first"), (F.col("first") + F.col("n") - begin).alias("n")).filter("n > 0")
    gone = gone.groupBy("_loc").agg(_merged(F.sort_array(F.collect_list(F.struct("first", "n")))).alias("spans"))
    out = rows.join(gone, "_loc", "left").withColumn("lines", F.split("_text", "\n", -1))
    cut = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), cut)
    return out.select(
        F.col("_id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"].cast("string"), s["n"].cast("string"))), ","), F.lit("")).alias("removed"),
        F.when(F.col("spans").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).alias("text"),
    )
