import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexforge.llm import _shared, warc

SCHEMA = "page_id long, url string, html string, original int"


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    groups = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            groups.setdefault(data, []).append(i)
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        ids = [x for x in groups.get(data, []) if x is not None]
        again = len(groups.get(data, [])) > 1 and ids and i != min(ids)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


def written(spark, rows, **options):
    path = _shared.new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, **options)
    return path


def test_write_and_read_back(spark):
    big, near = "<p>" + "é" * 60, "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" + "x" * 100
    rows = [(5, "http://a/ b\r\nX: y", big, 1), (3, None, big, 1), (9, "u", big, 1), (4, "u", "short", 1), (6, "u", "short", 1), (7, "u", None, 1)]
    rows += [(8, "u", near, 1), (None, "u", near, 1), (3, None, big, 1), (11, "u", "", 1), (None, "u", "z" * 200, 1), (None, "v", "z" * 200, 1)]
    read = warc.read_archives(spark, written(spark, rows), with_payload=True)
    payloads = sorted(((r.page_id or -1, r.payload.decode()) for r in read.collect() if r.record_type == "response"), key=str)
    assert payloads == sorted([(3, big), (3, big), (4, "short"), (6, "short"), (7, ""), (8, near), (11, ""), (-1, "z" * 200), (-1, "z" * 200)], key=str)
    assert sorted((tuple(r) for r in warc.resolve(read).collect()), key=str) == brute(rows)
    assert {r.refers_to_target for r in read.collect() if r.page_id == 5} == {"about:blank"}


@pytest.mark.parametrize("bits", [64, 1 << 25])
def test_many_rows_and_files_with_filters_that_stop_too_much(spark, monkeypatch, bits):
    monkeypatch.setattr(warc, "MOST_BITS", bits)
    rng = random.Random(5)
    bodies = [f"<p>{k}" + "word " * rng.randint(1, 60) for k in range(60)]
    rows = [(i if rng.random() > 0.02 else None, f"http://h/{i}", bodies[0] if rng.random() < 0.3 else rng.choice(bodies), 0) for i in range(400)] + [(1000, "u", "m" * (5 << 20), 0)]
    path = written(spark, rows, archive_bytes=4096)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    assert files.count() > 5
    read = warc.read_archives(spark, path)
    assert sorted((tuple(r) for r in warc.resolve(read).collect()), key=str) == brute(rows)


def test_a_record_can_be_read_at_its_offset(spark):
    path = written(spark, [(i, "u", f"page {i}", 0) for i in range(20)])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()
    found = []
    for f in files:
        for offset, _ in warc.members(memoryview(f.content)):
            _, data = next(warc.members(memoryview(f.content)[offset:]))
            ((head, block),) = warc.parse(data)
            found.append((warc._page(head["WARC-Record-ID"]), bytes(warc.http_payload(block)[1]).decode()))
    assert sorted(found) == [(i, f"page {i}") for i in range(20)]


def test_http_heads_of_any_length_and_large_members():
    block = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 5000 + b"\r\n\r\nbody"
    assert bytes(warc.http_payload(memoryview(block))[1]) == b"body"
    raw = warc.member(b"\x01" * (17 << 20)) + warc._NOTHING
    assert raw[-1] == 0 and [len(x) for _, x in warc.members(memoryview(raw))] == [17 << 20]
    with pytest.raises(ValueError):
        list(warc.members(memoryview(raw[: len(raw) // 2])))


def test_foreign_records_are_passed_over(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    own = warc.record(4, "u", hashlib.sha256(b"pay").hexdigest(), 3, "2024-01-01T00:00:00Z", None, None, None, b"pay")
    (tmp_path / "part-0").write_bytes(warc.member(info) + warc.member(own + own))
    assert [(r.page_id, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path)).collect()] == [(4, 3), (4, 3)]


def test_headers_alone_are_shuffled(spark):
    pages = spark.createDataFrame([(i, "u", "x" * 300 if i % 3 else f"{i}" * 200, 0) for i in range(50)], SCHEMA)
    made = warc.records(pages, F.lit("2024-01-01T00:00:00Z"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 50 and "Exchange hashpartitioning(payload_digest" not in plan


def test_empty_table(spark):
    path = written(spark, [])
    assert warc.resolve(warc.read_archives(spark, path)).count() == 0
