"""WARC archives with revisit resolution.

Headers (id, digest, size) are shuffled by payload digest to find the original of
each repeated payload; every record is written with fresh headers, repeated ones
as revisit records without payload; reading joins revisits to the responses that
they refer to.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filed, fresh_path, located, staged

LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_headers(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(_loc, page_id, url, payload_bytes, payload_digest, original(page_id, _loc, url) or null): one row per page.

    Of equal payloads of at least ``least_bytes`` the smallest id is the original
    (of repeated rows with it, the first stored). The minimum is combined before
    the shuffle, so a payload on a third of all pages stays cheap.
    """
    pages = filed(pages, "warc-input")
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    url = pages[url_col].cast("string") if url_col else F.lit(None).cast("string")
    rows = located(pages, page_id=pages[id_col], url=url, payload_bytes=F.octet_length(html).cast("long"), payload_digest=F.sha2(html, 256))
    rows = staged(rows, "warc-headers")
    original = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(F.struct("page_id", "_loc", "url")).alias("original"), F.count(F.lit(1)).alias("_n"))
    return rows.join(original.filter("_n > 1").drop("_n"), "payload_digest", "left")


def record_id(page_id, loc: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}@{loc}')}>"


def clean(url: str | None) -> str:
    """Header values hold no line breaks or other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def encode(row, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    revisit = row.original_loc is not None and row.original_loc != row._loc
    payload = (row.html or "").encode("utf-8", "surrogatepass")
    http = HTTP % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row.page_id, row._loc)}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean(row.url)}", f"WARC-Payload-Digest: sha256:{row.payload_digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row.original_id, row.original_loc)}", f"WARC-Refers-To-Target-URI: {clean(row.original_url)}", f"WARC-Refers-To-Date: {date}"]
    head += ["X-Page-ID: " + ("" if row.page_id is None else str(row.page_id)), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str | None = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write one archive per task under ``folder``; manifest (path, records), staged.

    A retried task writes a file of another name; only files named in the
    manifest, which is committed with the winning attempt, belong to the archive.
    """
    pages = filed(pages, "warc-input")
    heads = payload_headers(pages, id_col, url_col, html_col, least_bytes)
    heads = heads.select("_loc", "payload_digest", F.col("original._loc").alias("original_loc"), F.col("original.page_id").cast("string").alias("original_id"), F.col("original.url").alias("original_url"))
    url = pages[url_col].cast("string") if url_col else F.lit(None).cast("string")
    # ids travel as text: a null among numbers would make them floats
    rows = located(pages, page_id=pages[id_col].cast("string"), url=url, html=pages[html_col].cast("string")).join(heads, "_loc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        out = None
        for batch in batches:
            # object columns keep missing ids as None
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                out = out or fs.open_output_stream(path, compression=None)
                out.write(encode(_Row(*row), date))
                n += 1
        if out:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n]})

    columns = ["_loc", "page_id", "url", "html", "payload_digest", "original_loc", "original_id", "original_url"]
    return staged(rows.select(*columns).mapInPandas(write, "path string, records long"), "warc-manifest")


class _Row:
    __slots__ = ("_loc", "page_id", "url", "html", "payload_digest", "original_loc", "original_id", "original_url")

    def __init__(self, *values):
        for k, v in zip(self.__slots__, values, strict=True):
            setattr(self, k, v)


def members(stream) -> Iterator[bytes]:
    """The records of a gzip archive, one at a time; an archive that ends inside a record is an error."""
    z, parts, rest, begun = zlib.decompressobj(31), [], b"", False
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            if begun:
                raise EOFError("the archive ends inside a record")
            return
        parts.append(z.decompress(data))
        rest, begun = b"", not z.eof
        if z.eof:
            yield b"".join(parts)
            rest, z, parts = z.unused_data, zlib.decompressobj(31), []


def decode(record: bytes) -> dict:
    """Header fields, and the payload's size and digest, computed from its bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    return {
        "record_id": fields["WARC-Record-ID"],
        "record_type": fields["WARC-Type"],
        "page": fields["X-Page-ID"] or None,
        "url": fields["WARC-Target-URI"],
        "refers": fields.get("WARC-Refers-To"),
        "declared": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "digest": hashlib.sha256(payload).hexdigest(),
        "bytes": len(payload),
        "payload": payload,
    }


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the archives in ``manifest``: record_id, record_type, page, url, refers, declared, digest, bytes (, payload)."""
    schema = "record_id string, record_type string, page string, url string, refers string, declared string, digest string, bytes long" + ", payload binary" * payloads

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"]:
                with fs.open_input_stream(path, compression=None) as stream:
                    held, size = [], 0
                    for record in members(stream):
                        row = decode(record)
                        if not payloads:
                            del row["payload"]
                        held.append(row)
                        size += len(record)
                        if len(held) >= 1000 or payloads and size > 1 << 23:
                            yield pd.DataFrame(held)
                            held, size = [], 0
                    if held:
                        yield pd.DataFrame(held)

    # a task per archive or so: the manifest is one short row a file
    spread = manifest.repartition(max(1, min(manifest.count(), 10_000)), "path")
    return spread.mapInPandas(read, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per record: page, payload_bytes, payload_digest, record_type, refers_to, url; revisits take size and digest from their response.

    A revisit whose response is missing keeps its declared digest, with null size and reference.
    """
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page").alias("_page"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    out = records.join(originals, "refers", "left")
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "page",
        F.when(revisit, F.col("_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.coalesce("_digest", "declared")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("_page")).alias("refers_to"),
        "url",
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", html_col: str = "html") -> DataFrame:
    """Write every page, read the archives back, resolve: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Null html is an empty payload; null or odd urls are percent-encoded or
    ``about:blank``; null ids stay null; repeated rows are records of their own
    (the first stored is the response). An empty table gives no archive and no
    rows; columns other than the three named aren't read.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    kind = pages.schema[id_col].dataType
    records = staged(read_archives(spark, write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col), folder), "warc-records")
    out = resolve_revisits(records)
    return out.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")
