"""WARC archives with segmented records: writing, and reassembly on reading.

Payloads are framed as chunked HTTP responses.  A block longer than ``segment_bytes`` is cut
into a first record and continuation records.  Reading parses the files record by record,
groups continuations by their origin, puts them in order of segment number, verifies the
total length and takes off the chunked framing.
"""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm.batches import slices
from tapewire.operators.scale import checkpointed
from tapewire.session import shared_dir

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 512  # with the segment size this bounds a file to 16 MB and its headers
# fixed values: the RFC 4648 alphabet, and the digits that conv() writes in base 32
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
END = b"\r\n\r\n"

RECORD = "origin string, segment int, total long, kind string, page_id string, refers_to string, digest string, block binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, in built-in functions: 5 bytes are 8 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def classify(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows (rid, page_id, payload, digest, kind, refers_to): which record holds each payload.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id (NULL is
    the least; then the last by position) is the response, the others revisit it.  The largest id is found by
    map-side combining; only payloads that several pages share come back, by a join that adaptive execution can split.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("page_id"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    mine = F.struct(F.col("page_id").alias("page_id"), F.col("rid").alias("rid"))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max(mine).alias("__first"), F.count("*").alias("__n"))
    first = first.where(F.col("__n") > 1).select("digest", "__first")  # only shared payloads come back
    out = rows.join(first, "digest", "left")
    revisit = (F.octet_length("payload") >= least_bytes) & F.coalesce(F.col("__first.rid") != F.col("rid"), F.lit(False))
    return out.select(
        "rid",
        F.col("page_id").cast("string").alias("page_id"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("__first.rid")).alias("first_rid"),
    )


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) for p in [payload[i : i + size]]]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        n = int(body[at:stop].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + n])
        at = stop + 2 + n
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is not followed by a line end")
        at += 2


def _urn(rid: int, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{rid}/{segment}')}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records(rid: int, page_id: str | None, payload: bytes | None, digest: str, kind: str, first_rid: int | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page: one, or a first one and its continuations."""
    own = [("X-Page-Id", page_id)] if page_id is not None else []
    own += [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        block = b"HTTP/1.1 200 OK\r\n\r\n"
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(rid)), ("WARC-Refers-To", _urn(first_rid)), *own], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload or b"", chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", _urn(rid)), *own]
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(rid, n)), ("WARC-Segment-Origin-ID", _urn(rid)), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(more, part))
    return out


def write_archives(classified: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write the rows of :func:`classify` as WARC files into ``folder``.

    The files are gzipped.  Every record is a row of Spark's text writer and the writer's line separator is the empty
    lines that end a record, so any file system Spark can reach will do.  The records of one page may land in
    different files.
    """

    def task(batches):
        for batch in slices(batches, "payload"):
            made = [r for row in batch.to_pylist() for r in records(**row, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    rows = classified.select("rid", "page_id", "payload", "digest", "kind", "first_rid").mapInArrow(task, "record binary")
    text = rows.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).mode("overwrite").text(folder)


def parsed(content: bytes) -> list[dict]:
    """The records of one archive, by their content lengths."""
    out, at = [], 0
    while at < len(content):
        stop = content.index(END, at)
        lines = content[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {at}")
        field = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        begin = stop + len(END)
        end = begin + int(field["content-length"])
        total = field.get("warc-segment-total-length")
        out.append(
            {
                "origin": field.get("warc-segment-origin-id", field["warc-record-id"]),
                "segment": int(field.get("warc-segment-number", 0)),
                "total": None if total is None else int(total),
                "kind": field["warc-type"],
                "page_id": field.get("x-page-id"),
                "refers_to": field.get("warc-refers-to"),
                "digest": field.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                "block": content[begin:end],
            }
        )
        if content[end : end + len(END)] != END:
            raise ValueError(f"the record at {at} is cut short")
        at = end + len(END)
    return out


def read_records(spark, folder: str) -> DataFrame:
    """All records of the archives in ``folder``; segment 0 marks a whole record."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary())])

    def task(batches):
        for batch in slices(batches, "content"):
            for content in batch.column("content").to_pylist():
                yield from pa.Table.from_pylist(parsed(gzip.decompress(content)), schema).to_batches(max_chunksize=RECORDS_PER_FILE)

    return files.mapInArrow(task, RECORD)


def reassembled(found: DataFrame) -> DataFrame:
    """One row per response or revisit: origin, kind, page_id, refers_to, digest, block.

    Segments are grouped by origin (the segments of one record, never more), ordered by number and
    joined; a missing segment or a wrong total length fails the job.  Whole records are not shuffled.
    """
    whole = found.where(F.col("segment") == 0)
    part = F.struct("segment", "block")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    groups = found.where(F.col("segment") > 0).groupBy("origin").agg(
        F.max("total").alias("total"),
        F.max("segment").alias("n"),
        F.sort_array(F.collect_list(part)).alias("parts"),
        *[first(c) for c in ("kind", "page_id", "refers_to", "digest")],
    )
    block = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["block"]))
    joined = groups.withColumn("block", block)
    right = F.coalesce((F.octet_length("block") == F.col("total")) & (F.size("parts") == F.col("n")), F.lit(False))
    checked = F.when(right, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments do not add up: "), "origin")))
    columns = ["origin", "kind", "page_id", "refers_to", "digest"]
    return whole.select(*columns, "block").unionByName(joined.select(*columns, checked.alias("block")))


def _payload(batches):
    for batch in slices(batches, "block"):
        bodies = []
        for block, kind in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist()):
            if kind == "revisit":
                bodies.append(None)
                continue
            head, _, body = block.partition(END)
            bodies.append(dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body)
        at = batch.schema.names.index("block")
        yield batch.set_column(at, "payload", pa.array(bodies, pa.binary()))


def payloads(whole: DataFrame) -> DataFrame:
    """The reassembled rows with ``payload`` in place of the block; NULL for a revisit."""
    return whole.mapInArrow(_payload, "origin string, kind string, page_id string, refers_to string, digest string, payload binary")


def resolved(read: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to); a revisit takes them from the response it refers to.

    The digest is worked out from the payload that was read and must equal the header's.
    """
    seen = read.select(
        "origin", "kind", "page_id", F.col("refers_to").alias("__to"), "digest",
        F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha"),
    )
    seen = checkpointed(seen)  # narrow; the archives are parsed once
    own = seen.where(F.col("kind") == "response").select(F.col("origin").alias("__to"), F.col("bytes").alias("__b"), F.col("sha").alias("__s"), F.col("page_id").alias("__p"))
    again = seen.where(F.col("kind") == "revisit").join(own, "__to", "left")
    response = seen.where(F.col("kind") == "response").select("page_id", "bytes", "sha", "kind", F.lit(None).cast("string").alias("refers_to"), "digest")
    revisit = again.select("page_id", F.col("__b").alias("bytes"), F.col("__s").alias("sha"), "kind", F.col("__p").alias("refers_to"), "digest")
    rows = response.unionByName(revisit)
    sha = F.when(F.coalesce(F.col("sha") == F.col("digest"), F.lit(False)), F.col("sha")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    return rows.select("page_id", F.col("bytes").alias("payload_bytes"), sha.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def archive(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", **options) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder, read them back and resolve revisits.

    NULL html is an empty payload; equal rows each get their own record; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(classify(pages, id_col, html_col), folder, **options)
    return resolved(payloads(reassembled(read_records(spark, folder))))
