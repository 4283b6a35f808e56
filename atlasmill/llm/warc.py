"""WARC archives: responses in segments with chunked transfer framing, revisits, and their reassembly.

Writing gives each payload's first record the full HTTP response, framed in chunks and cut into segments where it is
long, and every later record of an equal payload a revisit that refers to it. Each record is a gzip member of its own.
A task writes archives of its own, and the manifest lists those of tasks that ended. Reading streams the members of
each archive, groups the segments of a record by its identifier, orders them by number, verifies their count and total
length, and decodes the framing; a record that fails a check comes out with the reason in ``error``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.llm.shared import new_dir, stored

#: Bytes at which an archive is closed, bytes of a record's block in one segment, bytes of a chunk of transfer framing.
ROLL_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 32 << 20, 16 << 10, 4 << 10
READ_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
#: Equal rows of a page whose records are written in one run.
COPIES = 10_000
EPOCH = "1970-01-01T00:00:00Z"
SEGMENTS = "record_id string, type string, id string, segment int, total long, digest string, target string, block binary"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframe(body: bytes) -> bytes:
    """The payload of chunked transfer framing, trailers and chunk extensions left out; ValueError if it is cut or malformed."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut")
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, record: str, block: bytes, **headers: str | int) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record}", f"WARC-Date: {EPOCH}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n") + packed.flush()


def record_name(page: str, sha1: str, copy: int) -> str:
    """What names the record of the copy-th of a page's equal rows; sha1: the payload's digest in hex."""
    return f"urn:page:{copy}:{sha1}:{page}"


def records(page: str, payload: bytes, segment_bytes: int, copy: int = 1) -> Iterator[bytes]:
    """The response record of a payload and, where its block is over segment_bytes, its continuations."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    sha1 = hashlib.sha1(payload)
    name = record_name(page, sha1.hexdigest(), copy)
    origin = f"<{name}>"
    about = {"WARC_Target_URI": f"urn:page:{page}", "WARC_Payload_Digest": f"sha1:{base64.b32encode(sha1.digest()).decode()}"}
    yield _record("response", origin, parts[0], **about, Content_Type="application/http; msgtype=response", **({"WARC_Segment_Number": 1} if len(parts) > 1 else {}))
    for i, part in enumerate(parts[1:], 2):
        yield _record("continuation", f"<{name}:{i}>", part, WARC_Segment_Origin_ID=origin, WARC_Segment_Number=i, **({"WARC_Segment_Total_Length": len(block)} if i == len(parts) else {}))


def revisit(page: str, sha1: str, n_bytes: int, refers_to: str, copy: int = 1) -> bytes:
    """The revisit record of a payload that page refers_to's first record holds; like a server's answer, its block has headers only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % n_bytes
    payload_digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    return _record("revisit", f"<{record_name(page, sha1, copy)}>", block, WARC_Target_URI=f"urn:page:{page}", WARC_Payload_Digest=f"sha1:{payload_digest}", WARC_Refers_To=f"<{record_name(refers_to, sha1, 1)}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", Content_Type="application/http; msgtype=response")


def write_warcs(pages: DataFrame, path: str, id_col: str, html_col: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, roll_bytes: int = ROLL_BYTES) -> None:
    """Archives of pages below path, with a manifest. Payloads of at least min_bytes are written once, as one row of the least id's.

    Rows are counted by page and payload without their texts; revisits are written from those counts, in runs of at most
    COPIES, so that copies, however many, are neither shuffled with their texts nor meet in one task. A page is named p
    and its id, or n where that is null; null ids come after all others.
    """
    page = F.coalesce(F.concat(F.lit("p"), F.col(id_col).cast("string")), F.lit("n")).alias("page")
    text = F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    html = pages.select(F.col(id_col).alias("id"), page, text).withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    counted = stored(html.groupBy("page", "id", "sha1", F.octet_length("html").cast("long").alias("n_bytes")).agg(F.count(F.lit(1)).alias("n")), "warc-pages")
    first = counted.where(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "page")).alias("first")).select("sha1", F.col("first.page").alias("first"))
    told = counted.join(first, "sha1", "left").drop("id")
    own = told.where("first is null or first = page").select("page", "sha1", F.when(F.col("first").isNull(), F.col("n")).otherwise(1).alias("n"))
    # of equal rows of a page one text is kept before the shuffle
    whole = html.groupBy("page", "sha1").agg(F.max("html").alias("html")).join(own, ["page", "sha1"])
    least = F.when(F.col("first") == F.col("page"), 2).otherwise(1).cast("long")
    later = told.where("first is not null").withColumn("least", least).where("least <= n")
    runs = later.select("*", F.explode(F.sequence("least", "n", F.lit(COPIES).cast("long"))).alias("from"))
    last = F.least(F.col("from") + (COPIES - 1), F.col("n"))
    rows = whole.select("page", "sha1", "html", F.lit(None).cast("string").alias("refers_to"), F.octet_length("html").cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("from"), F.col("n").alias("to"))
    rows = rows.unionByName(runs.select("page", "sha1", F.lit(None).cast("string").alias("html"), F.col("first").alias("refers_to"), "n_bytes", "from", last.alias("to")))
    where, name = fs.FileSystem.from_uri(path)
    where.create_dir(name, recursive=True)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(path)
        done, sink = [], None
        for b in it:
            for row in b.to_pylist():
                for copy in range(row["from"], row["to"] + 1):
                    if sink is None:
                        label = f"{uuid.uuid4().hex}.warc.gz"
                        sink = where.open_output_stream(f"{base}/{label}", compression=None)
                        done.append(label)
                    if row["refers_to"] is None:
                        for r in records(row["page"], row["html"].encode(), segment_bytes, copy):
                            sink.write(r)
                    else:
                        sink.write(revisit(row["page"], row["sha1"], row["n_bytes"], row["refers_to"], copy))
                    if sink.tell() >= roll_bytes:
                        sink.close()
                        sink = None
        if sink is not None:
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    rows.mapInArrow(batches, "archive string").write.parquet(f"{path}/manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of gzip members."""
    rest, more = b"", True
    while more or rest:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not rest:
                rest = stream.read(READ_BYTES)
                if not rest:
                    more = False
                    break
            parts.append(member.decompress(rest))
            rest = member.unused_data if member.eof else b""
        data = b"".join(parts)
        if not data:
            continue
        if not member.eof:
            raise ValueError("a record is cut")
        head, _, block = data.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield headers, block[: int(headers["Content-Length"])]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in path's manifest."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("target", pa.string()), ("block", pa.binary())])
        where, base = fs.FileSystem.from_uri(path)
        for b in it:
            for archive in b.column(0):
                rows, held = [], 0
                for h, block in parse(where.open_input_stream(f"{base}/{archive.as_py()}", compression=None)):
                    number = h.get("WARC-Segment-Number")
                    total = h.get("WARC-Segment-Total-Length")
                    rows.append((h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), number and int(number), total and int(total), h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, h.get("WARC-Refers-To"), block))
                    held += len(block)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    archives = spark.read.schema("archive string").parquet(f"{path}/manifest")
    return archives.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(batches, SEGMENTS)


def reassemble(segments: DataFrame) -> DataFrame:
    """(id, type, digest, target, payload, error): each origin's segments in order, their lengths verified, unframed.

    A record without a segment number is whole. Only records in segments are shuffled, by their origin's identifier.
    """
    segment = F.struct("segment", "block")
    whole = segments.where("segment is null").select("id", "type", "digest", "target", F.array(segment).alias("parts"), F.lit(None).cast("string").alias("error"))
    parts = segments.where("segment is not null").groupBy("id").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("type", "digest", "target"))).alias("first"),
        F.max("total").alias("total"), F.array_sort(F.collect_list(segment)).alias("parts"),
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    error = F.when(numbers != F.sequence(F.lit(1), F.size("parts")), "segments are missing or repeated").when(F.col("total").isNull(), "no last segment").when(length != F.col("total"), "total length")
    joined = parts.select("id", "first.*", "parts", error.alias("error"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            payloads, errors = [], []
            for kind, want, segments, error in zip(*(b.column(i).to_pylist() for i in (1, 2, 4, 5))):
                payload = None
                if error is None and kind == "response":
                    head, _, body = b"".join(s["block"] for s in segments).partition(b"\r\n\r\n")
                    try:
                        payload = unframe(body) if b"transfer-encoding: chunked" in head.lower() else body
                        error = None if want in (None, digest(payload)) else "payload digest"
                    except ValueError as e:
                        error = f"transfer framing: {e}"
                payloads.append(payload)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], ["id", "type", "digest", "target", "payload", "error"])

    return whole.unionByName(joined).mapInArrow(batches, "id string, type string, digest string, target string, payload binary, error string")


def archive_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", path: str | None = None, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes pages as WARC archives below path (a new shared folder if None), reads them back, and returns, for each
    page, (id_col, payload_bytes, payload_digest, record_type, refers_to), computed from what was read.

    A null html is an empty payload; payloads of at least min_bytes (0: empty ones too) that are equal are one response,
    of the least id, and revisits of it. Every row has a record of its own, rows that repeat an id or are equal too. Null
    ids come after all others: a row without an id is a response where no row with one has its payload, and what refers
    to such a response has a null refers_to. A record that can't be put together again raises. An empty table gives an
    empty result. Other columns are not read.
    """
    path = path or new_dir(pages.sparkSession, "warc")
    write_warcs(pages, path, id_col, html_col, min_bytes, segment_bytes)
    read = reassemble(read_segments(pages.sparkSession, path))
    kind = pages.schema[id_col].dataType.simpleString()
    name = r"(?s)^<urn:page:\d+:[0-9a-f]*:p(.*)>$"
    page = lambda c: F.when(F.col(c).rlike(name), F.regexp_extract(c, name, 1)).cast(kind)
    checked = read.select("id", "type", "digest", "target", F.octet_length("payload").cast("long").alias("n"), F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat("id", F.lit(": "), "error"))).alias("ok"))
    checked = stored(checked.where("ok").drop("ok"), "warc-records")  # archives are read once
    responses = checked.where("type = 'response'")
    sizes = responses.select(F.col("id").alias("target"), F.col("n").alias("full"), F.col("digest").alias("stored"))
    again = checked.where("type = 'revisit'").join(sizes.hint("merge"), "target", "left").select(page("id").alias(id_col), F.col("full").alias("payload_bytes"), F.col("stored").alias("payload_digest"), F.lit("revisit").alias("record_type"), page("target").alias("refers_to"))
    return responses.select(page("id").alias(id_col), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to")).unionByName(again)
