"""WARC archives as a chunked record table.

Payloads are written as WARC/1.1 records.  A payload beyond ``segment`` bytes
becomes rows of record identifier and chunk number: a first segment and
``continuation`` records, none larger than a segment.  The writer cuts them
from the input's buffer, one after the other, with one running digest that
each carries as it stands; it copies no payload as a whole.  When the archives
are read back, records of one segment are digested where they are read; the
chunk rows of longer ones are brought together by record identifier, sorted by
chunk number and streamed through one running digest, which must agree at
every chunk.  No record of several segments is put together again.

Archives are written and read by Spark's text source in the shared folder, one
record a row.  The row delimiter is the end of a record followed by the start
of the next one; segments are cut inside every such byte sequence in a
payload, so that files can be split anywhere between records.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import checkpoint_dir, cut_lineage, read, sliced

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a segment of the query's archives: longer pages become chunk rows.
SEGMENT = 1 << 14
#: Revisits up to this number are broadcast, about 10 MB; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000


#: A record's end where another's start follows.
MARK = re.compile(re.escape(END) + b"(?=" + re.escape(VERSION) + b")")


def cuts(body, size: int, before: int = 0) -> Iterator[tuple[int, int]]:
    """Bounds of the segments of a payload, a bytes-like object: at most
    ``size`` bytes each, the first with ``before`` bytes in front of it that
    end like a record.  None holds a record's end and another's start, as it
    stands after a header's end, and none starts like a record."""
    at, n, room = 0, len(body), max(1, size - before)
    # ends of records in the payload, or begun in what stands before it
    marks = itertools.chain((m.start() - len(END) for m in MARK.finditer(END + bytes(body[:len(END) + len(VERSION)])) if m.start() < len(END)),
                            (m.start() for m in MARK.finditer(body)))
    found = next(marks, n)
    while True:
        end = min(n, at + room)
        while found < at - len(END):
            found = next(marks, n)
        if found + len(END) + len(VERSION) <= end:
            end = found + len(END) + 4
            found = next(marks, n)
        if end < n and (body[end:end + len(VERSION)] == VERSION or body[end:end + len(VERSION) + 2] == END[:2] + VERSION):
            end -= 1
        yield at, end
        at, room = end, size
        if at >= n:
            return


def _records(segment: int, date: str):
    def header(kind: str, *fields: tuple[str, object]) -> bytes:
        lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"WARC-Date: {date}"]
        return VERSION + "\r\n".join(lines).encode() + b"\r\n"

    def write(batches):
        for batch in batches:
            rows, held = [], 0
            for number, key, uri, body, digest, refers, origin in zip(*(batch.column(i) for i in range(7))):
                number, key = number.as_py(), key.as_py()
                digest, refers = digest.as_py(), refers.as_py()
                body = memoryview(body.as_buffer())
                uri, origin = _escaped(uri.as_py()), _escaped(origin.as_py())
                name = f"<urn:x-record:{number}>"
                common = (("WARC-Record-ID", name), ("X-Key", key), ("WARC-Target-URI", uri),
                          ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(body)),
                          ("Content-Type", "application/http; msgtype=response"))
                if refers is not None:
                    head = header("revisit", *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", origin), ("WARC-Refers-To-Date", date), ("X-Refers-To-Key", refers))
                    rows.append(head + b"Content-Length: %d" % len(HTTP) + END + HTTP + END[:-1])
                    continue
                running, several = hashlib.sha1(), len(HTTP) + len(body) > segment
                for i, (a, b) in enumerate(cuts(body, segment, len(HTTP)), 1):
                    part, last = body[a:b], b == len(body)
                    running.update(part)
                    several = several or not last
                    so_far = (("WARC-Segment-Number", i), ("X-Digest-So-Far", f"sha1:{running.hexdigest()}")) if several else ()
                    if i == 1:
                        head, first = header("response", *so_far, *common), HTTP
                    else:
                        total = ("WARC-Segment-Total-Length", len(HTTP) + len(body) if last else None)
                        head, first = header("continuation", *so_far, ("WARC-Record-ID", f"{name[:-1]}:{i}>"), ("WARC-Segment-Origin-ID", name), total), b""
                    rows.append(b"".join((head, b"Content-Length: %d" % (len(first) + b - a), END, first, part, END[:-1])))
                    held += b - a
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                        rows, held = [], 0
                if running.hexdigest() != digest:
                    raise ValueError(f"record {name}: written digest {running.hexdigest()}, not {digest}")
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    return write


def _escaped(uri: str | None) -> str | None:
    return uri and "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
                   least: int = 1000, segment: int = 1 << 20, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC record for each row.

    Of rows with equal payloads of at least ``least`` bytes the one with the
    largest key is a response and the others are revisits of it (every row
    that holds that key, if it occurs more than once).  Rows without a key and
    null payloads (empty) are responses.  Other columns are not read.
    """
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.col(uri).alias("_uri"), body.alias("_body")).withColumn("_digest", F.sha1("_body"))
    # narrow: only keys and digests are shuffled
    narrow = cut_lineage(rows.where((F.octet_length("_body") >= least) & F.col("_key").isNotNull()).select("_key", "_digest", "_uri"))
    newest = narrow.groupBy("_digest").agg(F.max(F.struct("_key", "_uri")).alias("_top"), F.min("_key").alias("_low"))
    newest = newest.where(F.col("_low") < F.col("_top._key")).select("_digest", F.col("_top._key").alias("_refers"), F.col("_top._uri").alias("_origin"))
    revisits = cut_lineage(narrow.select("_key", "_digest").join(newest, "_digest").where(F.col("_key") < F.col("_refers")).distinct())
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    rows = rows.join(revisits, ["_key", "_digest"], "left").select(
        F.monotonically_increasing_id().alias("_number"), "_key", "_uri", "_body", "_digest", "_refers", "_origin")
    records = rows.mapInArrow(sliced(_records(segment, date)), "value binary")
    records.select(F.col("value").cast("string")).write.text(path, lineSep="\n")


def _parsed(value: bytes) -> tuple[dict[str, str], int]:
    """Header fields of a record, and where its block starts."""
    start = len(VERSION) if value.startswith(VERSION) else 0
    end = value.index(END, start)
    fields = dict(line.split(": ", 1) for line in value[start:end].decode().split("\r\n"))
    end += len(END)
    rest = len(value) - end - int(fields["Content-Length"])
    if rest not in (0, len(END)):  # the last record of a file keeps its end
        raise ValueError(f"record {fields.get('WARC-Record-ID')} has {len(value) - end} bytes, not {fields['Content-Length']}")
    return fields, end


OUT = pa.schema([("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                 ("record_type", pa.string()), ("refers_to", pa.int64())])
PARTS = pa.schema([("record", pa.string()), ("chunk", pa.int64()), ("key", pa.int64()), ("total", pa.int64()),
                   ("declared", pa.string()), ("so_far", pa.string()), ("data", pa.binary())])


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _whole(batches):
    for batch in batches:
        rows = []
        for value in batch.column(0):
            value = value.as_py()
            fields, at = _parsed(value)
            key, digest = _number(fields, "X-Key"), fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "revisit":
                rows.append((key, int(fields["X-Payload-Length"]), digest, "revisit", int(fields["X-Refers-To-Key"])))
                continue
            body = memoryview(value)[value.index(END, at) + len(END):at + int(fields["Content-Length"])]
            if (own := hashlib.sha1(body).hexdigest()) != digest:
                raise ValueError(f"record {fields['WARC-Record-ID']}: payload digest {own}, not {digest}")
            rows.append((key, len(body), own, "response", None))
        yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, r)) for r in rows], OUT)


def _chunks(batches):
    for batch in batches:
        rows = []
        for value in batch.column(0):
            value = value.as_py()
            fields, at = _parsed(value)
            first = fields["WARC-Type"] == "response"
            if first:
                at = value.index(END, at) + len(END)
            end = value.index(END) + len(END) + int(fields["Content-Length"])
            rows.append((fields["WARC-Record-ID"] if first else fields["WARC-Segment-Origin-ID"], int(fields["WARC-Segment-Number"]),
                         _number(fields, "X-Key"), _number(fields, "WARC-Segment-Total-Length"),
                         fields["WARC-Payload-Digest"].removeprefix("sha1:") if first else None,
                         fields["X-Digest-So-Far"].removeprefix("sha1:"), value[at:end]))
        yield pa.RecordBatch.from_pylist([dict(zip(PARTS.names, r)) for r in rows], PARTS)


def _joined(batches):
    """Chunk rows sorted by record and chunk number, into a row per record."""
    record, digest, size, due, key, declared, total = None, None, 0, 0, None, None, None

    def closed():
        if total is None or size + len(HTTP) != total or digest.hexdigest() != declared:
            raise ValueError(f"record {record} is incomplete: {size} payload bytes, block of {total}")
        return {"key": key, "payload_bytes": size, "payload_digest": declared, "record_type": "response", "refers_to": None}

    for batch in batches:
        rows = []
        for name, chunk, k, end, said, so_far, data in zip(*(batch.column(i) for i in range(7))):
            if name.as_py() != record:
                if record is not None:
                    rows.append(closed())
                record, digest, size, due, total = name.as_py(), hashlib.sha1(), 0, 1, None
                key, declared = k.as_py(), said.as_py()
            if chunk.as_py() != due:
                raise ValueError(f"record {record}: chunk {due} is missing")
            due, total = due + 1, end.as_py()
            view = data.as_buffer()
            digest.update(view)
            size += view.size
            if digest.hexdigest() != so_far.as_py():
                raise ValueError(f"record {record}: chunk {chunk.as_py()} doesn't agree with the digest so far")
        yield pa.RecordBatch.from_pylist(rows, OUT)
    if record is not None:
        yield pa.RecordBatch.from_pylist([closed()], OUT)


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of archives: those of one segment, and the segments."""
    lines = spark.read.text(path, lineSep=(END + VERSION).decode())
    segmented = F.substring("value", 1, 100).contains("\r\nWARC-Segment-Number: ")
    value = F.col("value").cast("binary").alias("value")
    return lines.where(~segmented).select(value), lines.where(segmented).select(value)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of segmented records: record, chunk (from 1), key, total
    block bytes (last chunk), declared digest (first chunk), so_far (digest of
    the payload up to the chunk's end), data."""
    return _rows(spark, path)[1].mapInArrow(sliced(_chunks), "record string, chunk long, key long, total long, declared string, so_far string, data binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: key, payload_bytes, payload_digest,
    record_type, refers_to.  Lengths and digests are recomputed from the
    payloads; a record that doesn't agree with its header is an error."""
    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    chunks = read_chunks(spark, path).repartition("record").sortWithinPartitions("record", "chunk")
    return _rows(spark, path)[0].mapInArrow(sliced(_whole), schema).unionByName(chunks.mapInArrow(_joined, schema))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages", "page_id", "url", "html"), path, segment=SEGMENT)
    return read_archives(spark, path).withColumnRenamed("key", "page_id")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, lower(sha1(coalesce(html, ''))) AS digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top > page_id THEN top END AS refers_to
FROM m"""
