"""Web archives: gzip-per-record WARC files, written from rows and read back sequentially (operator 3).

The reader walks an archive's gzip members one after another with incremental decompression, frames each record by its
Content-Length, checks block and payload digests and holds one record at a time. Archives are read through Spark's
``binaryFile`` source, so they may lie in any store that Spark reads; the writer rolls to a new archive at a bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontolith.llm.common import cut, drop_cut, map_batches, new_place

#: Compressed bytes after which the writer starts another archive.
ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 16
_CRLF, _END = b"\r\n", b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    problem: str = ""


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in [*headers, ("WARC-Block-Digest", base32_sha1(block)), ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + _CRLF + block + _END) + squeeze.flush()


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int = 6) -> bytes:
    """A page as a response record, or as a revisit of ``refers_to``'s record, which has the HTTP headers but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url if url else f"urn:page:{page}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", base32_sha1(payload)),
    ]
    if page is not None:
        headers.append(("X-Page-ID", str(page)))
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    return record_bytes(headers, http + (payload if refers_to is None else b""), level)


def _members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Decompressed bytes of the gzip members, with an empty chunk after each member."""
    unzip = zlib.decompressobj(31)
    fed = False
    for data in chunks:
        while data:
            fed = True
            out = unzip.decompress(data, CHUNK * 4)
            if out:
                yield out
            if unzip.eof:
                data, fed = unzip.unused_data, False
                unzip = zlib.decompressobj(31)
                yield b""
            else:
                data = unzip.unconsumed_tail
    if fed:
        raise EOFError("the archive ends within a gzip member")


def read_records(chunks: Iterator[bytes]) -> Iterator[Record]:
    """The records of one archive. Wrong framing raises ValueError, a cut archive EOFError; a digest that differs is told in ``problem``."""
    held = bytearray()
    for piece in _members(chunks):
        if piece:
            held += piece
            continue
        head_end = held.find(_END)
        if head_end < 0:
            raise ValueError("a record has no header end")
        lines = bytes(held[:head_end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record doesn't begin with its version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        n = int(headers.get("content-length", "-1"))
        begin = head_end + len(_END)
        if n < 0 or bytes(held[begin + n :]) != _END:
            raise ValueError("a record's length differs from its Content-Length")
        block = bytes(held[begin : begin + n])
        held = bytearray()
        want = headers.get("warc-block-digest")
        yield Record(headers, block, "" if want is None or want == base32_sha1(block) else "block digest differs")


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(_END)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


def payload_columns(html: Column) -> tuple[Column, Column]:
    """Length and lower-case hex SHA-1 of the payload: the UTF-8 text, empty for null."""
    body = F.coalesce(html.cast("string"), F.lit("")).cast("binary")
    return F.octet_length(body).cast("long"), F.sha1(body)


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads of at least ``least_bytes`` the largest page_id answers, the others refer to it.

    Rows that repeat that largest page_id are all responses; payloads whose ids are all null too.
    """
    size, digest = payload_columns(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), size.alias("n"), digest.alias("digest"))
    firsts = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    same = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "html", F.when(~same, F.col("first")).alias("refers_to"))


def write_archives(planned: DataFrame, place: str, date: str = "1970-01-01T00:00:00Z", level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` rows as archives under ``place``; returns ``(archive, records, bytes)``, already run.

    A task writes under a hidden name and renames when an archive is whole; a task that runs again writes the same
    names with the same rows in the same order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(place)
        task = TaskContext.get()
        made: list[tuple[str, int, int]] = []
        out, name, temp, records, size = None, "", "", 0, 0

        def finish():
            nonlocal out
            if out is not None:
                out.close()
                store.move(temp, f"{root}/{name}")
                made.append((name, records, size))
                out = None

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{len(made):05d}.warc.gz"
                    temp = f"{root}/_writing-{task.taskAttemptId()}-{name}"
                    out, records = store.open_output_stream(temp, compression=None), 0
                    info = record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: kontolith\r\nformat: WARC File Format 1.1\r\n", level)
                    out.write(info)
                    size = len(info)
                data = page_record(page, url, (html or "").encode(), refers, date, level)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    finish()
        finish()
        cols = list(zip(*made, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["archive", "records", "bytes"])

    spark = planned.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    ordered = planned.select("page_id", "url", "html", "refers_to").sortWithinPartitions("page_id", "url", F.length("html"), "html")
    return cut(ordered.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, place: str, with_payload: bool = False) -> DataFrame:
    """Response and revisit records of all archives under ``place``: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, problem``.

    ``payload_bytes`` and ``payload_digest`` describe the full payload: recomputed for a response, for a revisit as its
    HTTP headers and digest header say. ``problem`` is empty if all digests agree.
    """

    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for k in range(batch.num_rows):
                content = memoryview(batch.column(0)[k].as_buffer())
                for r in read_records(bytes(content[i : i + CHUNK]) for i in range(0, len(content), CHUNK)):
                    kind = r.headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    http, body = http_parts(r.block)
                    stated = r.headers.get("warc-payload-digest", "")
                    n, problem = int(http.get("content-length", len(body))), r.problem
                    if kind == "response" and (len(body) != n or stated != base32_sha1(body)):
                        problem = problem or "payload differs from its digest or length"
                    page, refers = r.headers.get("x-page-id"), r.headers.get("x-refers-to-page-id")
                    rows.append((int(page) if page else None, r.headers.get("warc-target-uri"), n, base64.b32decode(stated.partition(":")[2]).hex(), kind, int(refers) if refers else None, problem, body if with_payload else None))
                    if len(rows) >= 2000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

        return step

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(place).select("content")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string, payload binary"
    out = map_batches(files, make, schema)
    return out if with_payload else out.drop("payload")


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) to archives in the shared folder and read them back, one row per page.

    Null html is an empty payload, null urls become a urn of the page; an empty table gives no rows; repeated rows give
    a record each. Extra columns are ignored. A record whose digest differs raises an error.
    """
    spark = pages.sparkSession
    place = new_place(spark, "warc")
    drop_cut(write_archives(plan_records(pages, least_bytes), place))
    back = read_archives(spark, place)
    checked = F.when(F.col("problem") != "", F.raise_error(F.concat(F.lit("archive record: "), "problem"))).otherwise(F.col("payload_digest"))
    return back.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
