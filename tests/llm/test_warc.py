import hashlib
import os

import pytest
import zstandard

from sightline.llm import warc
from sightline.llm.tables import materialise

BIG = "<html>" + "long page é " * 40 + "</html>"


@pytest.fixture(scope="module")
def page_rows():
    return [
        (5, "http://a/5", BIG, "x"),
        (2, "http://a/2", BIG, "x"),
        (2, "http://a/2", BIG, "x"),  # repeated row
        (9, None, BIG, None),
        (None, "http://a/n", BIG, "x"),
        (3, "http://a/3\r\nX-Bad: 1", "short", "x"),
        (4, "http://a/4", "short", "x"),
        (6, "http://a/6", None, "x"),
        (7, "http://a/7", "", "x"),
        (8, "http://a/8", "WARC/1.1\r\n\r\n" * 60_000, "x"),  # longer than a frame
        (None, None, "only null id " * 20, None),
    ]


@pytest.fixture(scope="module")
def pages(spark, page_rows):
    return spark.createDataFrame(page_rows, "page_id bigint, url string, html string, refers_to string").repartition(2)


@pytest.fixture(scope="module")
def bundles(pages):
    return materialise(warc.bundles(pages), "test-warc", **warc.TABLE_OPTIONS)[0]


def test_round_trip(bundles, page_rows):
    records = warc.read_all(bundles).collect()
    expected = []
    for page, url, html, _ in page_rows:
        data = (html or "").encode()
        first = min((p for p, _, h, _ in page_rows if p is not None and h == html), default=None)
        revisit = len(data) >= 100 and first is not None and page != first
        expected.append((
            str(page), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
            str(first if revisit else None), None if revisit else data,
        ))
    got = [
        (str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to),
         None if r.payload is None else bytes(r.payload))
        for r in records
    ]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    urls = {r.page_id: r.url for r in records}
    assert urls[9] is None and urls[3] == "http://a/3%0D%0AX-Bad:%201"


def test_frames_are_independent_and_seekable(bundles):
    row = max(bundles.collect(), key=lambda r: len(r.entries))
    content = bytes(row.content)
    whole = b"".join(warc.read_frame(content, f) for f in warc.seek_table(content))
    # a plain decoder reads the frames one after the other and skips the table
    assert zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read() == whole
    for e in row.entries:
        frame = warc.read_frame(content, warc.seek_table(content)[e.frame])
        record, end = warc.parse_record(frame[e.frame_offset : e.frame_offset + e.length])
        assert record["record_id"] == e.record_id and end == e.length


def test_damage_is_noticed(bundles):
    content = bytearray(bundles.first().content)
    with pytest.raises(ValueError):
        warc.seek_table(bytes(content[:-1]))
    content[20] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.read_frame(bytes(content), warc.seek_table(bytes(content))[0])


def test_fetch_by_identifier(spark, bundles):
    index = warc.index(bundles)
    wanted = index.orderBy("record_id").limit(3).select("record_id")
    ids = {r.record_id for r in wanted.collect()}
    found = warc.fetch(bundles, wanted.unionByName(spark.createDataFrame([("urn:none",)], "record_id string")))
    assert {r.record_id for r in found.collect()} == ids


def test_small_frames_and_bundles(monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    writer = warc.BundleWriter("b")
    for i in range(20):
        digest = hashlib.sha256(b"%d" % i).hexdigest()
        writer.add(warc.record_id(i, digest), warc.build_record(i, "u", b"%d" % i, digest, None))
    bundle = writer.finish()
    table = warc.seek_table(bundle["content"])
    assert len(table) == 20
    e = bundle["entries"][13]
    assert warc.parse_record(warc.read_frame(bundle["content"], table[e["frame"]]), e["frame_offset"])[0]["page_id"] == 13


def test_export(bundles, tmp_dir):
    warc.export(bundles, f"file://{tmp_dir}/out")
    names = sorted(os.listdir(f"{tmp_dir}/out"))
    assert names == sorted(f"{r.bundle_id}.warc.zst" for r in bundles.collect())


def test_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.bundles(none).count() == 0
    assert warc.read_all(warc.bundles(none)).count() == 0
