"""WARC archives: writing with revisits, reading back with segment reassembly.

Writing: every payload becomes one record, a `response` holding an HTTP message in chunked transfer
framing, or, for a repeated payload, a `revisit` that names the record it repeats. A block longer
than `segment_bytes` is cut into a first record and `continuation` records, which may land in other
files. Records go to gzipped archives through Spark's text sink as raw bytes, so any Hadoop path will do.

Reading: files are parsed record by record; segments are dealt out by origin identifier, sorted by
segment number and streamed: a payload is decoded and hashed as its segments pass, so no task
gathers a whole group. The total length is verified and the chunk framing decoded on the way.

Every record has an identifier of its own, whatever its page_id; a page's target names its page_id and
the SHA-1 of its payload, and that is what a revisit refers to. So rows that repeat a page_id, with
equal or other payloads, and rows without one keep their own records and figures.

Results for odd input: a null payload is empty; payloads below `least` bytes are never revisits; of
equal payloads the largest page_id is the response and the others, those without page_id as well, refer
to it (rows that repeat its page_id are responses, and so are all rows where none has a page_id); a
record whose segments are missing or whose length differs is returned with `error` set; an empty table
writes no archive and gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import shared_dir, small_batches, table

#: Payloads from this size on are written once; blocks are cut at this many bytes; chunk size.
LEAST_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 1000, 1 << 16, 4096
#: Rows that name one record are dealt out over so many tasks.
SALTS = 64
CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def target_uri(page: int | None, sha: str) -> str:
    """What a page's payload is known by."""
    return f"urn:tessel:page:{'none' if page is None else page}:{sha}"


def _record(kind: str, uri: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{uri}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + block


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join(parts) + b"0\r\n\r\n"


class Unchunker:
    """Decodes an HTTP message with chunked framing, fed in pieces of any size; keeps no payload."""

    def __init__(self):
        self.pending, self.state, self.left, self.size, self.sha, self.plain = b"", "head", 0, 0, hashlib.sha1(), False

    def _take(self, data: bytes) -> None:
        self.sha.update(data)
        self.size += len(data)

    def feed(self, data: bytes) -> None:
        data = self.pending + data
        self.pending = b""
        while data:
            if self.state == "head":
                at = data.find(b"\r\n\r\n")
                if at < 0:
                    self.pending = data
                    return
                self.plain = b"transfer-encoding: chunked" not in data[:at].lower()
                self.state, data = "body" if self.plain else "size", data[at + 4 :]
            elif self.state == "body":
                self._take(data)
                return
            elif self.state == "size":
                at = data.find(CRLF)
                if at < 0:
                    self.pending = data
                    return
                self.left = int(data[:at].split(b";")[0], 16)
                self.state, data = "data" if self.left else "trailer", data[at + 2 :]
            elif self.state == "data":
                piece = data[: self.left]
                self._take(piece)
                self.left -= len(piece)
                data = data[len(piece) :]
                if not self.left:
                    self.state = "gap"
            elif self.state == "gap":
                if len(data) < 2:
                    self.pending = data
                    return
                if data[:2] != CRLF:
                    raise ValueError("chunk without its end")
                self.state, data = "size", data[2:]
            elif self.state == "trailer":
                at = data.find(CRLF)
                if at < 0:
                    self.pending = data
                    return
                self.state, data = "done" if at == 0 else "trailer", data[at + 2 :]
            else:
                raise ValueError("bytes after the last chunk")

    def end(self) -> str | None:
        ok = self.state == "done" or self.state == "body" or self.plain
        return None if ok and not self.pending else "the transfer framing is cut short"


def parse_records(stream):
    """(fields, block) of the records of one archive, read from a binary stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:20]!r}")
        fields = {}
        while (line := stream.readline()) not in (CRLF, b""):
            k, _, v = line.partition(b":")
            fields[k.decode().lower()] = v.strip().decode()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a record is cut short")
        yield fields, block


def open_archive(data: bytes):
    """A binary stream of an archive's records, unpacked as they are read where it is gzipped."""
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload, n, sha, refers_to: the largest page_id of equal payloads, where that is another row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    # Partial sums make a hot payload one row per task; only groups that repeat are joined back.
    first = rows.where(F.col("n") >= least).groupBy("n", "sha").agg(F.max("page_id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1").select(F.col("n").alias("f_n"), F.col("sha").alias("f_sha"), "first_id")
    joined = rows.join(first, (F.col("n") == F.col("f_n")) & (F.col("sha") == F.col("f_sha")), "left")
    return joined.select("page_id", "payload", "n", "sha", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to"))


def write_archive(rows: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write rows (page_id, payload, n, sha, refers_to) as WARC files below `path`."""

    def build(batches):
        for batch in batches:
            out = []
            for page, payload, sha, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "payload", "sha", "refers_to")), strict=True):
                # Segments are gathered by this identifier; all those of a row are written by one task.
                uri, digest = f"urn:uuid:{uuid.uuid4()}", [("WARC-Target-URI", target_uri(page, sha)), ("WARC-Payload-Digest", f"sha1:{sha}")]
                if refers is not None:
                    out.append(_record("revisit", uri, b"", [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", target_uri(refers, sha)), *digest]))
                    continue
                block = HTTP_HEAD + chunked(payload)
                if len(block) <= segment_bytes:
                    out.append(_record("response", uri, block, digest))
                    continue
                pieces = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
                out.append(_record("response", uri, pieces[0], [*digest, ("WARC-Segment-Number", "1")]))
                for k, piece in enumerate(pieces[1:], 2):
                    last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(pieces) else []
                    out.append(_record("continuation", f"{uri}:segment:{k}", piece, [("WARC-Segment-Origin-ID", f"<{uri}>"), ("WARC-Segment-Number", str(k)), *last]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.select("page_id", "payload", "sha", "refers_to").mapInArrow(build, "record binary")
    # A cast keeps the bytes as they are; each record ends with two line ends.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 2000).option("compression", "gzip").text(path)


_RECORD = [("origin", pa.string()), ("target", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("segmented", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary()), ("size", pa.int64()), ("sha1", pa.string()), ("error", pa.string())]
_PAYLOAD = [("target", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("error", pa.string())]


def _ddl(fields) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{k} {names[t]}" for k, t in fields)


def _batch(rows, fields):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [k for k, _ in fields])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record below `path`. Whole responses are decoded here (size, sha1, error); segments keep their block."""

    def parse(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, held = [], 0
                for f, block in parse_records(open_archive(data)):
                    bare = lambda k: f.get(k, "").strip("<>") or None  # noqa: B023, E731
                    number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                    segmented, size, sha, error = "warc-segment-number" in f, None, None, None
                    if not segmented and f["warc-type"] == "response":
                        body = Unchunker()
                        try:
                            body.feed(block)
                            error = body.end()
                        except ValueError as e:
                            error = str(e)
                        if error is None:
                            size, sha = body.size, body.sha.hexdigest()
                    rows.append((bare("warc-segment-origin-id") or bare("warc-record-id"), bare("warc-target-uri"), number("warc-segment-number") or 1, number("warc-segment-total-length"), segmented, f["warc-type"], bare("warc-refers-to-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, block if segmented else None, size, sha, error))
                    held += len(block) if segmented else 0
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield _batch(rows, _RECORD)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, _RECORD)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _ddl(_RECORD))


def reassemble(records: DataFrame) -> DataFrame:
    """target, record_type, refers_to, digest, payload_bytes, payload_sha1, error: one row per record, its segments joined."""
    at = {k: i for i, (k, _) in enumerate(_RECORD)}

    def stream(batches):
        origin, body, first, seen, length, total, wrong = None, None, None, 0, 0, None, None
        done: list[tuple] = []

        def close():
            if origin is None:
                return
            error = wrong
            if first is None:
                error = error or "the first segment is missing"
            elif total is None:
                error = error or "the last segment is missing"
            elif total != length:
                error = error or "the total length differs"
            error = error or body.end()
            ok = error is None
            named = tuple(first[at[k]] if first else None for k in ("target", "record_type", "refers_to", "digest"))
            done.append((named[0], named[1] or "continuation", *named[2:], body.size if ok else None, body.sha.hexdigest() if ok else None, error))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not row[at["segmented"]]:
                    done.append(tuple(row[at[k]] for k in ("target", "record_type", "refers_to", "digest", "size", "sha1", "error")))
                    continue
                number, block = row[at["segment"]], row[at["block"]]
                if row[0] != origin:
                    close()
                    origin, body, first, seen, length, total, wrong = row[0], Unchunker(), None, 0, 0, None, None
                if number == seen:
                    continue  # a segment archived twice
                if number != seen + 1:
                    wrong = wrong or "a segment is missing"
                seen, length, total = number, length + len(block), row[at["total"]] if row[at["total"]] is not None else total
                if row[at["record_type"]] != "continuation":
                    first = row
                if wrong is None:
                    try:
                        body.feed(block)
                    except ValueError as e:
                        wrong = str(e)
            if done:
                yield _batch(done, _PAYLOAD)
                done = []
        close()
        if done:
            yield _batch(done, _PAYLOAD)

    return records.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(stream, _ddl(_PAYLOAD))


def page_number(column: str):
    """The page_id in a target, null where it has none."""
    return F.element_at(F.split(F.col(column), ":"), 4).try_cast("long")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, error of every record; revisits take size and digest from what they refer to."""
    whole = reassemble(read_records(spark, path))
    # Many revisits may name one target: its figures are copied to as many salts as name it.
    whole = whole.withColumn("salt", F.pmod(F.xxhash64("target"), F.lit(SALTS)))
    used = whole.where("refers_to is not null").select(F.col("refers_to").alias("u_id"), F.col("salt").alias("r_salt")).distinct()
    responses = whole.where("record_type = 'response'").groupBy(F.col("target").alias("r_id")).agg(F.first("payload_bytes").alias("r_bytes"), F.first("payload_sha1").alias("r_sha1"))
    named = used.join(responses, F.col("u_id") == F.col("r_id")).drop("u_id")
    joined = whole.join(named, (F.col("refers_to") == F.col("r_id")) & (F.col("salt") == F.col("r_salt")), "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        page_number("target").alias("page_id"),
        F.when(revisit, F.col("r_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("r_sha1")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type",
        page_number("refers_to").alias("refers_to"),
        F.coalesce("error", F.when(revisit & F.col("r_sha1").isNull(), F.lit("the record it refers to is missing")), F.when(F.coalesce(F.when(revisit, F.col("r_sha1")), F.col("payload_sha1")) != F.col("digest"), F.lit("the digest differs"))).alias("error"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 256)
    path = shared_dir(spark)
    write_archive(with_revisits(table(spark, sf_dir, "pages")), path)
    return read_payloads(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
m AS (SELECT n, h, max(page_id) AS first_id FROM d WHERE n >= 1000 GROUP BY n, h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN m.first_id IS DISTINCT FROM d.page_id AND m.first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.first_id IS DISTINCT FROM d.page_id THEN m.first_id END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM d LEFT JOIN m ON m.n = d.n AND m.h = d.h
"""
