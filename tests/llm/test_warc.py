"""The content-addressed archive: exact round trips, equal payloads stored once, damage found."""

import gzip
import hashlib

import pytest

from shorepix.llm import warc

PAGES = "page_id long, url string, html string, digest string, record_type string"


def _rows():
    long, copy = "é<p>" * 40, "x" * 100
    texts = [(9, copy), (3, copy), (3, copy), (7, copy), (4, long), (2, long), (5, "short"), (6, "short"), (8, ""), (1, None), (12, "y" * 99), (11, "y" * 99),
             (None, long), (None, "z" * 200), (13, "z" * 200), (14, "w" * 3_000_000), (15, "only 漢 once" * 20)]
    return [(p, None if k % 5 == 0 else f"http://a.example/{k}\r\nX: y {k}", t, "clash", "clash") for k, (p, t) in enumerate(texts)]


def _want(rows):
    kept = {}
    for page, _, text, *_ in rows:
        key = (page is None, page or 0)
        kept[text] = min(kept.get(text, key), key)
    out = []
    for page, _, text, *_ in rows:
        raw = (text or "").encode()
        long = len(raw) >= 100
        first = not long or (page is None, page or 0) == kept[text]
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), first, None if first else kept[text][1]))
    return out


def test_records_of_all_cases(spark):
    rows = _rows()
    folder = warc.write_archive(spark.createDataFrame(rows, PAGES).repartition(3))
    out = warc.record_facts(warc.read_archive(spark, folder)).collect()
    assert len(out) == len(rows)
    # Of the repeated row one is the response, the other revisits its own page.
    twins = sorted((r.record_type, r.refers_to) for r in out if r.page_id == 3)
    assert twins == [("response", None), ("revisit", 3)]
    plain = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type == "response", r.refers_to) for r in out if r.page_id != 3]
    assert sorted(plain, key=str) == sorted((w for w in _want(rows) if w[0] != 3), key=str)
    stored = spark.read.parquet(f"{folder}/payloads").collect()
    assert sorted(r.digest for r in stored) == sorted({hashlib.sha256((t or "").encode()).hexdigest() for _, _, t, *_ in rows})


def test_least_bytes_is_a_parameter(spark):
    frame = spark.createDataFrame([(1, None, "ab", None, None), (2, None, "ab", None, None)], PAGES)
    out = warc.record_facts(warc.read_archive(spark, warc.write_archive(frame, least_bytes=2))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in out) == [(1, "response", None), (2, "revisit", 1)]


def test_headers_are_exact_and_files_read_back(spark, tmp_path):
    rows = _rows()
    folder = warc.write_archive(spark.createDataFrame(rows, PAGES))
    records = {r.record_no: (bytes(r.header), bytes(r.payload)) for r in warc.read_archive(spark, folder).collect()}
    headers = {r.record_no: bytes(r.header) for r in spark.read.parquet(f"{folder}/records").collect()}
    assert {k: h for k, (h, _) in records.items()} == headers
    for header, payload in records.values():
        lines = header.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and lines[-2:] == ["", ""] and all(": " in line for line in lines[1:-2])
        assert f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}" in lines
    ids = [line for h in headers.values() for line in h.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(ids)) == len(rows)
    files = warc.export_warc(spark, folder, str(tmp_path / "out"), parts=2)
    assert files.count() == 2 and files.agg({"n_records": "sum"}).first()[0] == len(rows)
    back = sorted((bytes(r.header), bytes(r.body)) for r in warc.read_warc(files).collect())
    assert back == sorted((h, b"" if b"Type: revisit\r\n" in h else p) for h, p in records.values())
    with gzip.open(files.first().path) as stream:
        assert stream.read(8) == b"WARC/1.1"


def test_hot_payload_is_stored_once(spark):
    frame = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id % 3 = 0 THEN repeat('hot', 100) ELSE concat(repeat('cold', 50), id) END AS html")
    folder = warc.write_archive(frame)
    out = warc.record_facts(warc.read_archive(spark, folder)).toPandas()
    assert (out.record_type == "revisit").sum() == 999 and out.refers_to.dropna().eq(0).all() and out.page_id.nunique() == 3000
    assert spark.read.parquet(f"{folder}/payloads").count() == 2001


def test_empty_table_and_damage(spark):
    frame = spark.createDataFrame(_rows(), PAGES)
    assert warc.read_archive(spark, warc.write_archive(frame.limit(0))).count() == 0
    folder = warc.write_archive(frame)
    payloads = spark.read.parquet(f"{folder}/payloads").collect()
    swapped = [(a.digest, a.payload_bytes, b.packed) for a, b in zip(payloads, payloads[1:] + payloads[:1], strict=True)]
    other = spark.createDataFrame(swapped, "digest string, payload_bytes long, packed binary")
    other.write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="is damaged"):
        warc.read_archive(spark, folder).collect()
    other.limit(1).write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="no payload is stored"):
        warc.read_archive(spark, folder).collect()
    with pytest.raises(ValueError):
        list(warc.parse_records(__import__("io").BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
