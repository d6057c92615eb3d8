import io

import zstandard

from eventloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def test_round_trip_keeps_payloads(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/", big), (2, None, big), (2, None, big), (3, "http://c/\r\nX: y", "s"), (4, "u", None), (5, "u", "s"), (None, "n", big), (6, "u", "a" * 999), (7, "u", "a" * 999), (8, "u", "x" * 3_000_000)]
    got = warc.warc_round_trip(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    by = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload).decode()) for r in got)
    n = len(big.encode())
    assert by == sorted([
        (1, "revisit", 2, n, ""), (2, "response", None, n, big), (2, "response", None, n, big), (0, "revisit", 2, n, ""), (3, "response", None, 1, "s"), (4, "response", None, 0, ""),
        (5, "response", None, 1, "s"), (6, "response", None, 999, "a" * 999), (7, "response", None, 999, "a" * 999), (8, "response", None, 3_000_000, "x" * 3_000_000),
    ])


def test_archive_is_seekable_and_plain_zstandard():
    w = warc.BundleWriter()
    for i in range(2000):
        w.add(str(i), warc.record_bytes(i, f"http://x/{i}", b"y" * i, i, "d", None, "1970-01-01T00:00:00Z"))
    archive = w.finish()
    frames = warc.seek_table(archive)
    assert len(frames) > 5 and sum(f[1] for f in frames) < len(archive)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(archive), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 2000
    name, frame, at, size = w.index[1234]
    fields, payload, n = warc.parse_record(warc.read_frame(archive, frames[frame])[at : at + size])
    assert name == "1234" and fields["WARC-Record-ID"] == "<urn:page:1234>" and payload == b"y" * 1234 and n == 1234


def test_fetch_by_record(spark):
    df = spark.createDataFrame([(i, "u", f"page {i}", "") for i in range(50)], SCHEMA)
    bundles = spark.read.parquet(warc.write_archives(df))
    assert sorted(r.page_id for r in warc.unpack(warc.fetch(bundles, ["7", "33", "99"])).collect()) == [7, 33]
