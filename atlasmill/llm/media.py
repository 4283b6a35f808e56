"""Media columns: payloads kept as images in archives, and a Spark data source that reads them by byte ranges.

The writer stores each payload as a lossless 8-bit grey PNG, 64 samples wide, as a member of ZIP archives; a task
rolls to a new archive at ``roll_bytes``, and only archives of tasks that ended are listed in the manifest, so a
retried or lost task leaves nothing that is read. The reader plans (archive, first byte, end byte) ranges from the
manifest alone. Each range's task reads the archive's central directory and takes the members whose header starts in
its range, in order of offset, so no list of members passes through the driver. A member that can't be read or whose
checksum is wrong is tried again by its offset, alone, on a newly opened stream; if it stays wrong, its row carries the
error in place of the payload, or the task fails with ``on_error`` = ``fail``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from atlasmill.llm.shared import new_dir

WIDTH = 64
#: Bytes at which a task closes an archive, and bytes of a range that one task reads.
ROLL_BYTES, RANGE_BYTES = 128 << 20, 32 << 20
#: Rows and bytes of payloads in a batch handed to Arrow.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
TRIES = 3
PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes, level: int = 6) -> bytes:
    """padded(data) as an 8-bit grey PNG, rows unfiltered; its text chunk keeps the unpadded length."""
    rows = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> tuple[bytes, int]:
    """(padded samples, unpadded length) of a PNG that encode_png made; ValueError if it is damaged."""
    if image[:8] != PNG:
        raise ValueError("not a PNG")
    at, length, height, body = 8, None, 0, zlib.decompressobj()
    raw = []
    while at + 12 <= len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        data = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            height = struct.unpack_from(">II", data)[1]
        elif kind == b"tEXt" and data.startswith(b"Length\0"):
            length = int(data[7:])
        elif kind == b"IDAT":
            raw.append(body.decompress(data))
        at += 12 + n
    rows = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WIDTH + 1)
    if length is None or len(rows) != height or rows[:, 0].any():
        raise ValueError("not a whole image of this writer")
    return rows[:, 1:].tobytes(), length


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation and a 64-bit average hash over the columns' and rows' means of an image."""
    rows = samples.reshape(-1, WIDTH)
    columns = rows.mean(axis=0)
    bits = np.packbits(columns > columns.mean()).tobytes().hex()
    return f"{WIDTH}x{len(rows)} mean={rows.mean():.3f} std={rows.std():.3f} hash={bits}"


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path)
    return where, name


def write_archives(docs: DataFrame, path: str, id_col: str, text_col: str, roll_bytes: int = ROLL_BYTES, level: int = 6) -> None:
    """Archives of docs' texts below path, and a manifest of them; a null text is empty. Members are named by id."""
    dirs, name = _open(path)
    dirs.create_dir(name, recursive=True)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(path)
        done, sink, zipped, n, label = [], None, None, 0, ""
        for b in it:
            for key, text in zip(b.column(0), b.column(1)):
                if sink is None:
                    label = f"{uuid.uuid4().hex}.zip"
                    sink, n = where.open_output_stream(f"{base}/{label}"), 0
                    zipped = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                key, text = key.as_py(), text.as_py()
                zipped.writestr(zipfile.ZipInfo(f"{n}-{'null' if key is None else key}.png"), encode_png((text or "").encode(), level))
                n += 1
                if sink.tell() >= roll_bytes:
                    zipped.close()
                    sink.close()
                    done.append((label, n, where.get_file_info(f"{base}/{label}").size))
                    sink = None
        if sink is not None:
            zipped.close()
            sink.close()
            done.append((label, n, where.get_file_info(f"{base}/{label}").size))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], ["archive", "members", "bytes"])

    docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(batches, "archive string, members long, bytes long").write.parquet(f"{path}/manifest")


@dataclass
class ByteRange(InputPartition):
    archive: str
    first: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes, self.fail = options["path"], int(options.get("range_bytes", RANGE_BYTES)), options.get("on_error", "fail") == "fail"

    def partitions(self) -> list[ByteRange]:
        import pyarrow.parquet as pq

        where, base = _open(self.path)
        files = [f.path for f in where.get_file_info(fs.FileSelector(f"{base}/manifest")) if f.base_name.endswith(".parquet")]
        found = [r for f in files for r in pq.read_table(f, filesystem=where).to_pylist()]
        return [ByteRange(r["archive"], at, min(at + self.range_bytes, r["bytes"])) for r in sorted(found, key=lambda r: r["archive"]) for at in range(0, r["bytes"], self.range_bytes)] or [ByteRange("", 0, 0)]

    def _member(self, stream, info: zipfile.ZipInfo) -> bytes:
        """The stored bytes of a member, found by its offset alone and checked against the directory."""
        stream.seek(info.header_offset)
        head = stream.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member starts here")
        names, extra = struct.unpack_from("<HH", head, 26)
        stream.seek(info.header_offset + 30 + names + extra)
        data = stream.read(info.file_size)
        if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise ValueError("checksum of a member")
        return data

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        where, base = _open(self.path)
        name = f"{base}/{part.archive}"
        stream = where.open_input_file(name)
        rows, held = [], 0
        for info in sorted(zipfile.ZipFile(stream).infolist(), key=lambda i: i.header_offset):
            if not part.first <= info.header_offset < part.end:
                continue
            media, error = None, None
            for again in range(TRIES):
                try:
                    media, error = self._member(stream, info), None
                    break
                except (OSError, ValueError) as e:
                    error = str(e)
                    if again < TRIES - 1:
                        stream = where.open_input_file(name)
            if error and self.fail:
                raise OSError(f"{part.archive} at {info.header_offset}: {error}")
            rows.append((part.archive, info.header_offset, info.filename, media, error))
            held += len(media or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["archive", "offset", "member", "media", "error"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(path)``: one row for each member of the archives that write_archives made."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(path)


def media_features(media: DataFrame, id_type: str = "long") -> DataFrame:
    """Of each member that could be read: its id, the payload's sizes and digests, the stored form's, and a feature."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for member, image in zip(b.column(0), b.column(1)):
                image = image.as_py()
                data, n = decode_png(image)
                key = member.as_py().split("-", 1)[1].removesuffix(".png")
                rows.append((None if key == "null" else key, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(np.frombuffer(data, np.uint8))))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    made = media.where("error is null").select("member", "media").mapInArrow(batches, "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return made.withColumn("id", F.col("id").cast(id_type))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Stores every text of docs as a media payload below path (a new shared folder if None), reads all back, and
    returns (id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    One row comes out for each row in, repeated ids and null ids included; a null text is an empty one, whose payload
    is 64 bytes 0. Texts of any length are one image, 64 samples wide. Equal texts have equal values. An empty table
    makes no archive and gives an empty result; other columns are not read.
    """
    path = path or new_dir(docs.sparkSession, "media")
    write_archives(docs, path, id_col, text_col)
    return media_features(read_archives(docs.sparkSession, path), docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
