"""Helpers shared by the operators: shared folder, staged tables, row locators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: The five white-space bytes 09-0D and the space, as a Java regex class body.
WS = r" \t-\r"

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was staged inside: results that are still to be read must have been written elsewhere."""
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            remove(spark, path)
        _made.reset(token)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut at files that outlive any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame | str) -> None:
    """Delete a staged table that no later plan reads."""
    path = df if isinstance(df, str) else df.inputFiles()[0].rpartition("/")[0] if df.inputFiles() else None
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def filed(df: DataFrame, name: str = "input") -> DataFrame:
    """``df`` itself where it is a plain file scan, else a staged copy: its locators then mean the same in every plan."""
    try:
        df.select(df.metadataColumn("_metadata"))
    except Exception:  # noqa: BLE001 - analysis says that the relation has no file metadata
        return staged(df, name)
    return df


def located(df: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` of ``df``, a plain file scan (see ``filed``), and ``_loc``, the file and row number of each row.

    A locator names stored content, so it survives task retries and is the same
    in every plan over the same files.
    """
    meta = df.metadataColumn("_metadata")
    at = F.concat(meta["file_path"], F.lit("#"), meta["row_index"].cast("string"))
    return df.select(*[c.alias(k) for k, c in columns.items()], at.alias("_loc"))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The column, null counting as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs outside white space (09-0D, 20); null counts as none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"[{WS}]+"))).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty; ``bytes.split()`` splits at 09-0D and 20, ``lower()`` is A-Z only."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function for mapInArrow, giving freed memory back to the system at the end of each task: workers wait, with what their allocators keep, beside the tasks of later stages."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Return the memory that Arrow's and the C library's allocators hold free."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def slices(texts: list[bytes], most_bytes: int = 1 << 20):
    """Index ranges of consecutive texts of about ``most_bytes`` together (a longer text stands alone)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_bytes:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
