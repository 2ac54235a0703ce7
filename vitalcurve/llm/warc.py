"""WARC archives with an index: written record by record, read back by coalesced byte ranges.

Each task writes one archive, a gzip member per record, and an index row for
each record: file, offset, length, URL and digest. A selection of index rows is
sorted by file and offset, neighbouring records are joined to one range, and
the ranges are read. Repeats of a payload are written as revisits of the record
with the smallest id.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attempt_name, columns_of, open_folder, shared_dir, text_pieces, written

#: Ranges closer than this are read as one, of at most RANGE_BYTES (a longer record is a range of its own).
GAP_BYTES = 64 << 10
RANGE_BYTES = 4 << 20
#: Bytes of archives that a task reads, about.
TASK_BYTES = 8 << 20
#: When the records say they were made, unless the caller says so.
DATE = "2020-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of ``refers_to`` that has the HTTP header alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Header fields (lower-cased names) and payload of one record; a record cut short raises ``ValueError``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    block = rest[: int(fields.get("content-length", -1))]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "payload-length": length}


_RESULT = [("file", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType())]


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = DATE
) -> DataFrame:
    """Writes a record per page into ``folder``; returns the index: id, url, file, offset, length, digest and kind.

    Pages of at least ``min_bytes`` bytes with equal payloads: the smallest id
    is the response (all rows that have it, if it is repeated), the others are
    its revisits; null ids come last. Null html is an empty payload.
    """
    source = columns_of(pages, [id_col, url_col, html_col]).select(
        F.col(id_col).cast("bigint").alias("_page"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html")
    )
    sha, size = F.sha2("_html", 256), F.octet_length("_html")
    # a payload's copies are counted before the shuffle; only payloads with copies are joined back
    copies = source.where(size >= min_bytes).groupBy(sha.alias("_sha")).agg(F.min("_page").alias("_first"), F.count("*").alias("_n"))
    # written, so that both sides of the join come straight from a shuffle and a payload of very many pages is split
    copies = written(copies.where("_n > 1 AND _first IS NOT NULL").drop("_n"), "repeated-payloads")
    marked = source.withColumn("_sha_own", sha).join(copies, F.col("_sha_own") == F.col("_sha"), "left")
    marked = marked.select("_page", "_url", "_html", F.when(~F.col("_page").eqNullSafe(F.col("_first")), F.col("_first")).alias("_refers"))

    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("url", T.StringType()), *(T.StructField(n, t) for n, t in _RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        system, path = open_folder(folder)
        name, offset = f"{attempt_name('pages')}.warc.gz", 0

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for piece, texts in text_pieces(all_batches(), "_html"):
                rows: list[tuple] = []
                for page, url, html, refers in zip(piece.column("_page").to_pylist(), piece.column("_url").to_pylist(), texts, piece.column("_refers").to_pylist()):
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = payload_digest(payload)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, payload, digest, refers, date)) + packer.flush()
                    out.write(member)
                    rows.append((page, url, name, offset, len(member), len(payload), digest, "response" if refers is None else "revisit", refers))
                    offset += len(member)
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

    return written(marked.mapInArrow(run, schema), "warc-index")


def read_records(selected: DataFrame, folder: str, id_col: str = "page_id") -> DataFrame:
    """(id, url, payload binary, payload_bytes, payload_digest, record_type, refers_to) of the records that the index rows name.

    Records of one file that lie within GAP_BYTES of one another form a range of
    RANGE_BYTES at most. The digest is computed from the payload that was read
    (of a revisit, which has none, it is the record's own), and one that differs
    from the record's raises ``ValueError``.
    """
    # records by whole ranges of a file: each range is read once, wherever it goes
    placed = selected.select("file", "offset", "length", (F.col("offset") / RANGE_BYTES).cast("bigint").alias("_range"))
    total = selected.agg(F.sum("length")).first()[0] or 0  # the index is small; the tasks are sized by what it points to
    spread = placed.repartition(max(1, -(-total // TASK_BYTES)), "file", "_range").sortWithinPartitions("file", "offset")
    fields = [(id_col, T.LongType()), ("url", T.StringType()), ("payload", T.BinaryType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix(f"<{_URN}").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for name, start, stop, places in _ranges(batch):
                with system.open_input_file(f"{path}/{name}") as file:
                    data = file.read_at(stop - start, start)
                rows = []
                for offset, length in places:
                    found = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    digest = found["warc-payload-digest"].removeprefix("sha1:")
                    if found["warc-type"] == "response" and (payload_digest(found["payload"]) != digest or len(found["payload"]) != found["payload-length"]):
                        raise ValueError(f"payload differs from its digest in {name} at {offset}")
                    rows.append(
                        (number(found["warc-record-id"]), found.get("warc-target-uri"), found["payload"], found["payload-length"], digest, found["warc-type"], number(found.get("warc-refers-to")))
                    )
                types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

    return spread.mapInArrow(run, schema)


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, stop, records) of the coalesced ranges of sorted index rows."""
    name, start, stop, places = "", 0, 0, []
    for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
        if places and (file != name or offset - stop > GAP_BYTES or offset + length - start > RANGE_BYTES):
            yield name, start, stop, places
            places = []
        if not places:
            name, start = file, offset
        stop = offset + length
        places.append((offset, length))
    if places:
        yield name, start, stop, places


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes all pages as WARC archives (in the shared folder, unless ``folder`` is given) and reads every record back.

    An empty table gives no archive and no row. Repeated pages are records of
    their own; columns besides the three are not read.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc"
    index = write_archives(pages, folder, id_col, url_col, html_col, min_bytes)
    return read_records(index, folder, id_col)
