import base64
import hashlib
import zlib

import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from atlasmill.llm import media, warc

DOCS = "doc_id long, text string, n_bytes string, media string"
TEXTS = [(1, None), (2, ""), (3, "a"), (4, "é" * 32), (5, "x" * 64), (6, "long " * 100_000), (7, "a"), (7, "b"), (None, "n")]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "?", "?") for i, t in texts], DOCS)


def test_png_round_trip():
    for n in (0, 1, 63, 64, 65, 1000):
        data = bytes(i * 7 % 256 for i in range(n))
        image = media.encode_png(data)
        assert media.decode_png(image) == (media.padded(data), n)
        assert len(media.padded(data)) % 64 == 0 and media.padded(data)
    with pytest.raises(ValueError):
        media.decode_png(image[:60] + b"\0" + image[61:])


def test_media_columns(spark):
    got = media.media_columns(docs(spark)).collect()
    want = []
    for i, t in TEXTS:
        data = (t or "").encode()
        p = media.padded(data)
        want.append((i or 0, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media.encode_png(data)), hashlib.sha256(media.encode_png(data)).hexdigest()))
    assert sorted((r.doc_id or 0, *tuple(r)[1:7]) for r in got) == sorted(want)
    assert len({r.feature for r in got if r.doc_id in (1, 2)}) == 1
    assert media.media_columns(docs(spark).limit(0)).count() == 0


def test_byte_ranges_cover_every_member_once(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    media.write_archives(docs(spark).repartition(2), path, "doc_id", "text", roll_bytes=500)
    for size in (100, 1000, 1 << 30):
        rows = media.read_archives(spark, path, range_bytes=size).collect()
        assert len(rows) == len(TEXTS) and len({(r.archive, r.offset) for r in rows}) == len(TEXTS)


def test_a_damaged_member_is_alone_in_error(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    media.write_archives(docs(spark).coalesce(1), path, "doc_id", "text")
    (archive,) = (tmp_path / "a").glob("*.zip")
    row = media.read_archives(spark, path).where("member like '%-5.png'").first()
    data = bytearray(archive.read_bytes())
    data[row.offset + 60] ^= 255
    archive.write_bytes(data)
    rows = media.read_archives(spark, path, on_error="keep").collect()
    assert [r.member for r in rows if r.error] == [row.member] and len(rows) == len(TEXTS)
    with pytest.raises(Exception, match="checksum"):
        media.read_archives(spark, path).collect()


def test_members_are_tried_again_by_offset(tmp_path):
    reader = media.ArchiveReader({"path": f"file://{tmp_path}"})
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("0-1.png", b"payload")
    info = zipfile.ZipFile(tmp_path / "x.zip").infolist()[0]
    failed = []

    class Flaky(media.ArchiveReader):
        def _member(self, stream, info):
            if not failed:
                failed.append(1)
                raise OSError("lost")
            return reader._member(stream, info)

    batch = next(Flaky({"path": f"file://{tmp_path}"}).read(media.ByteRange("x.zip", 0, 1 << 20)))
    assert batch.column("media")[0].as_py() == b"payload" and info.header_offset == 0 and failed


PAGES = "page_id long, html string, digest string, id string"


def pages(spark, rows):
    return spark.createDataFrame([(i, h, "?", "?") for i, h in rows], PAGES)


def test_warc_round_trip(spark):
    rows = [(9, "same"), (3, "same"), (4, None), (5, ""), (6, "é" * 50_000), (7, "z" * 16_384), (8, "same"), (10, "\r\n\r\n0\r\n")]
    for segment in (100, 1 << 14):
        got = {r.page_id: r for r in warc.archive_pages(pages(spark, rows), segment_bytes=segment).collect()}
        first = {}
        for i, h in sorted(rows):
            data = (h or "").encode()
            r = got[i]
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert (r.record_type, r.refers_to) == (("revisit", first[data]) if data in first else ("response", None))
            first.setdefault(data, i)
        assert len(got) == len(rows)


def test_small_payloads_can_stay_responses(spark):
    got = warc.archive_pages(pages(spark, [(1, ""), (2, ""), (3, "abc"), (4, "abc")]), min_bytes=1).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.archive_pages(pages(spark, [(1, "a")]).limit(0)).count() == 0
    got = warc.archive_pages(pages(spark, [(None, "a"), (1, "b"), (None, "b"), (None, "a"), (None, None)])).collect()
    want = [(1, 1, "response", None), (None, 1, "revisit", 1), (None, 1, "response", None), (None, 1, "revisit", None), (None, 0, "response", None)]
    assert sorted(repr((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in got) == sorted(map(repr, want))


def test_framing():
    for n in (0, 1, 4096, 4097, 20_000):
        data = bytes(range(256)) * (n // 256 + 1)
        assert warc.unframe(warc.frame(data[:n])) == data[:n]
    assert warc.unframe(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.unframe(bad)


def test_broken_segments_are_named(spark):
    rows = [("a", "response", "a", 1, None, None, None, b"x"), ("a2", "continuation", "a", 3, 3, None, None, b"y"), ("b", "response", "b", 1, None, None, None, b"x"), ("b2", "continuation", "b", 2, 9, None, None, b"y"), ("c", "response", "c", 1, None, None, None, b"x")]
    got = {r.id: r.error for r in warc.reassemble(spark.createDataFrame(rows, warc.SEGMENTS)).collect()}
    assert got == {"a": "segments are missing or repeated", "b": "total length", "c": "no last segment"}


def test_records_stand_alone_as_gzip_members(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warcs(pages(spark, [(1, "a" * 50_000), (2, "b")]), path, "page_id", "html", segment_bytes=1000)
    where, base = fs.FileSystem.from_uri(path)
    found = [h for f in (tmp_path / "w").glob("*.warc.gz") for h, _ in warc.parse(where.open_input_stream(str(f), compression=None))]
    assert sum(h["WARC-Type"] == "continuation" for h in found) == 50 and sum("WARC-Segment-Total-Length" in h for h in found) == 1
    assert F is not None


@pytest.mark.parametrize("copies", [10_000, 1])
def test_warc_of_repeated_rows(spark, monkeypatch, copies):
    """Rows that repeat a page, short and long, alone and with other texts, come out once each."""
    monkeypatch.setattr(warc, "COPIES", copies)
    long = "long " * 8_000
    rows = [(1, "short"), (1, "short"), (2, "short"), (3, long), (3, long), (4, long), (4, long), (5, "one"), (5, "another")]
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages(spark, rows)).collect()]
    n = len(long)
    want = [(1, 5, "response", None), (1, 5, "revisit", 1), (2, 5, "revisit", 1), (3, n, "response", None), (3, n, "revisit", 3), (4, n, "revisit", 3), (4, n, "revisit", 3), (5, 3, "response", None), (5, 7, "response", None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    whole = [(r.page_id, r.payload_bytes, r.record_type) for r in warc.archive_pages(pages(spark, rows), min_bytes=1 << 20).collect()]
    assert sorted(whole) == sorted((i, len(h), "response") for i, h in rows)
