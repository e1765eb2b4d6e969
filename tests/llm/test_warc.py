"""WARC archives: round trips at any split, foreign bytes, revisits."""

import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from pyarrow import fs

from tidelog.llm.warc import END, member, op1_warc_round_trip, page_record, read_archives, records, whole, write_archives

HARD = b"\x1f\x8b\x08\x00WARC/1.0\r\n\r\n" * 20


def rows():
    rng = random.Random(4)
    out = []
    for i in range(60):
        kind = i % 6
        html = [None, "", "short é", "same" * 400, "".join(rng.choice("abcé<>") for _ in range(3000)), HARD.decode("latin-1")][kind]
        out.append((i if i % 17 else None, [None, "", "http://x/é b\r\nY: 1", "http://y/"][i % 4], html, "clash"))
    return [*out, out[3], out[57]]


def want(table):
    first = {}
    for page, _, html, _ in table:
        b = (html or "").encode()
        first[b] = max((x for x in (first.get(b), page) if x is not None), default=None)
    out = []
    for page, _, html, _ in table:
        b = (html or "").encode()
        refers = None if len(b) < 1000 or page == first[b] else first[b]
        out.append((str(page), len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", str(refers)))
    return sorted(out)


@pytest.mark.parametrize("split", [61, 900, 1 << 25])
def test_round_trip(spark, tmp_path, split):
    table = rows()
    pages = spark.createDataFrame(table, "page_id long, url string, html string, payload string").repartition(3)
    manifest = write_archives(spark, pages, f"file://{tmp_path}/w", max_file=8000)
    assert manifest.agg({"records": "sum"}).first()[0] == len(table)
    found = read_archives(spark, manifest, split).filter("type <> 'warcinfo'").collect()
    number = lambda x: "None" if x is None or not x[10:-1].isdigit() else x[10:-1]
    assert sorted((number(r.record_id), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to)) for r in found) == want(table)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in found if r.type == "response")
    for row in manifest.collect():
        gzip.decompress(open(row.path.removeprefix("file://"), "rb").read())


@pytest.mark.parametrize("most", [100_000, 0])
def test_mostly_equal_pages_and_a_very_long_one(spark, tmp_path, most):
    rng = random.Random(6)
    long = rng.randbytes(25 << 20).hex()
    table = [(i, "u", "copy " * 400, 1) for i in range(450)] + [(1000 + i, None, f"page {i} " * 200, 1) for i in range(50)] + [(2000, "u", long, 1), (2001, "u", long, 1)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string, digest int").repartition(4)
    manifest = write_archives(spark, pages, f"file://{tmp_path}/w", most=most)
    found = read_archives(spark, manifest, 1 << 20, payload=False).filter("type <> 'warcinfo'").collect()
    number = lambda x: "None" if x is None or not x[10:-1].isdigit() else x[10:-1]
    assert sorted((number(r.record_id), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to)) for r in found) == want(table)


@pytest.mark.parametrize("split", [150, 1000, 1 << 25])
def test_an_archive_within_a_record_is_no_record(spark, tmp_path, split):
    rng = random.Random(7)
    inner = b"".join(page_record(100 + i, "u", p := rng.randbytes(300), hashlib.sha1(p).hexdigest(), None) for i in range(5))
    outer = [gzip.compress(gzip.decompress(page_record(i, "u", p, hashlib.sha1(p).hexdigest(), None)), 0) for i, p in enumerate([b"a", inner, b"b", inner, b"c"])]
    raw = b"".join(outer)
    open(tmp_path / "a.warc.gz", "wb").write(raw)
    assert raw.count(inner) == 2, "the archive inside has to be stored as it is"
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(raw))], "path string, bytes long")
    found = read_archives(spark, manifest, split).collect()
    assert sorted(r.record_id for r in found) == [f"<urn:page:{i}>" for i in range(5)]
    assert [r.payload for r in sorted(found, key=lambda r: r.offset)][1::2] == [inner, inner]


def test_foreign_bytes_and_broken_records(tmp_path):
    good = [page_record(i, "u", b"p" * i * 100, hashlib.sha1(b"p" * i * 100).hexdigest(), None) for i in range(5)]
    stored = gzip.compress(b"not a record", 0)
    broken = member([("WARC-Type", "response")], b"x" * 500)[:-20]
    raw = b"junk\x1f\x8b" + good[0] + b"\x1f\x8b\x08" + stored + good[1] + good[2] + broken + good[3] + gzip.compress(HARD, 0) + good[4] + b"\x1f"
    path = str(tmp_path / "a.gz")
    open(path, "wb").write(raw)
    for split in (1, 13, 1000, 10**6):
        found = []
        with fs.LocalFileSystem().open_input_file(path) as file:
            for start in range(0, len(raw), split):
                found += [h["warc-record-id"] for _, _, h, _ in records(file, start, start + split)]
        assert found == [f"<urn:page:{i}>" for i in range(5)], split


def test_a_header_of_any_length(spark, tmp_path):
    rng = random.Random(5)
    url = "data:," + "".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(3 << 20))
    spark.createDataFrame([(1, url, "x"), (2, "http://x/", "y")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(r.page_id for r in op1_warc_round_trip(spark, str(tmp_path)).collect()) == [1, 2]


def test_missing_records_are_an_error(spark):
    manifest = spark.createDataFrame([("a", 10, 2), ("b", 10, 1)], "path string, bytes long, records long")
    assert whole(manifest, spark.range(3)).count() == 3
    with pytest.raises(ValueError, match="2 records were read, 3 written"):
        whole(manifest, spark.range(2))


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(spark, write_archives(spark, pages, f"file://{tmp_path}/e")).count() == 0
    assert END and pa
