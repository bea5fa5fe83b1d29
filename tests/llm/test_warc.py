import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_query_equals_its_sql(spark, sf_dir, duck, rows_of):
    got = queries.QUERIES["op12_warc"](spark, sf_dir).toPandas()
    assert rows_of(got) == rows_of(duck.sql(queries.ORACLES["op12_warc"]).df())


PAGES = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, "same"), (7, "http://a/ \r\nX: y", ""), (5, "u", None), (9, "u", "ü" * 70_000), (9, "u", "twice"), (9, "u", "twice"), (None, "n", "same"), (None, "n", "only null"), (None, "n", "only null"), (4, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc")]


@pytest.fixture(params=["gzip", "none"])
def archive(request, spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, id string").coalesce(3)
    path = f"file://{tmp_path}/w"
    warc.archive(pages, path, compression=request.param, max_bytes=500, date="2024-01-02T03:04:05Z")
    return path


def test_awkward_pages_come_back(spark, archive):
    got = warc.page_digests(spark, archive).collect()
    assert sorted((str(r.page_id), r.payload_digest) for r in got) == sorted((str(p), digest((h or "").encode())) for p, _, h in PAGES)
    assert sorted((r.page_id or -1, r.payload_bytes) for r in got) == sorted((p or -1, len((h or "").encode())) for p, _, h in PAGES)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_digest == digest(b"same"))
    assert kinds == [("1", "response", None), ("2", "revisit", 1), ("3", "revisit", 1), ("None", "revisit", 1)]
    assert sorted(r.record_type for r in got if r.payload_digest == digest(b"twice")) == ["response", "revisit"]
    assert sorted((r.record_type, r.refers_to) for r in got if r.payload_digest == digest(b"only null")) == [("response", None), ("revisit", None)]
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 0} == {(5, "response", None), (7, "revisit", 5)}


def test_payloads_and_headers_come_back(spark, archive):
    rows = warc.read(spark, archive).where("warc_type = 'response'").collect()
    assert sorted(bytes(r.payload).decode() for r in rows) == sorted({h or "" for _, _, h in PAGES})
    for r in rows:
        assert r.payload_digest == "sha1:" + digest(r.payload) and r.http_status == 200 and r.payload_bytes == len(r.payload)
        assert r.headers["warc-date"] == r.warc_date == "2024-01-02T03:04:05Z"
    revisits = warc.read(spark, archive).where("warc_type = 'revisit'").collect()
    assert all(r.payload is None and r.payload_bytes == len(PAGES[0][2]) for r in revisits if r.payload_digest == "sha1:" + digest(b"same"))
    assert {r.target_uri for r in warc.read(spark, archive).where("record_id LIKE '%:7>'").collect()} == {"http://a/ %0D%0AX: y"}


def test_filters_reach_the_reader(spark, archive):
    plan = warc.read(spark, archive).where("warc_type = 'response' AND target_uri LIKE 'http://a/%' AND payload_bytes > 1")._jdf.queryExecution().toString()
    assert "EqualTo(warc_type,response)" in plan or "warc_type = response" in plan
    reader = warc.Reader(None, {})
    kept = list(reader.pushFilters([warc.ds.EqualTo(("warc_type",), "response"), warc.ds.GreaterThan(("payload_bytes",), 1), warc.ds.Not(warc.ds.In(("target_uri",), ("a",)))]))
    assert [f.attribute for f in kept] == [("payload_bytes",)] and [c for c, _ in reader.filters] == ["warc_type", "target_uri"]


@pytest.mark.parametrize("where", ["warc_type = 'revisit'", "warc_type <> 'response'", "warc_type IN ('warcinfo', 'revisit')", "target_uri IS NULL", "NOT target_uri = 'u'", "target_uri LIKE 'http%'", "content_length > 200", "refers_to IS NOT NULL AND payload_digest LIKE '%A%'"])
def test_pushed_filters_equal_unpushed_ones(spark, archive, where):
    columns = [c for c in warc.read(spark, archive).columns if c not in ("headers", "payload")]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    every = warc.read(spark, archive).cache()
    assert every.count() > len(PAGES)
    assert key(warc.read(spark, archive).where(where)) == key(every.where(F.expr(where)))


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    big = bytes(range(256)) * 40_000
    data = b"".join(warc.member(warc.record({"warc_type": "response", "record_id": f"<urn:x:{k}>", "payload": big}, "2024"), 1) for k in range(3))
    source = warc.Members(io.BytesIO(data), len(data))
    seen = []
    for _ in range(3):
        while source.out[:2] == b"\r\n":
            source.skip(2)
        fields = warc.parse_fields(source.until(b"\r\n\r\n"))
        seen.append((fields["warc-record-id"], source.given < len(big)))
        length = int(fields["content-length"]) + 4
        assert source.skip(length) == length
    assert seen == [(f"<urn:x:{k}>", True) for k in range(3)] and not source.more()


def test_foreign_archives(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    chunked = b"HTTP/1.1 404 No\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    body = gzip.compress(b"hello")
    block = chunked + b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (body[:7], body[7:])) + b"0\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <b>\r\nX-Folded: one\r\n two\r\nContent-Length: 4\r\n\r\nmeta\r\n\r\n"
    records = one % (len(block), block) + two
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.warc").write_bytes(records)
    (tmp_path / "f/b.warc.gz").write_bytes(gzip.compress(records))  # one member for both
    (tmp_path / "f/_c.warc").write_bytes(b"not to be read")
    rows = warc.read(spark, f"file://{tmp_path}/f").orderBy("file", "offset", "record_id").collect()
    assert [(r.record_id, bytes(r.payload), r.http_status) for r in rows] == [("<a>", b"hello", 404), ("<b>", b"meta", None)] * 2
    assert rows[1].headers["x-folded"] == "one two" and rows[1].payload_digest is None
    (tmp_path / "cut.warc").write_bytes(records[:-30])
    with pytest.raises(Exception, match="cut.warc"):
        warc.read(spark, f"file://{tmp_path}/cut.warc").collect()


def test_empty_table_and_threshold(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert warc.round_trip(pages.limit(0)).collect() == []
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages, least=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_overwriting_shows_only_the_new_files(spark, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/o"
    for text in ("first", "second"):
        spark.createDataFrame([("resource", text.encode())], "warc_type string, payload binary").write.format("warc").mode("overwrite").save(path)
    assert [bytes(r.payload) for r in warc.read(spark, path).where("warc_type = 'resource'").collect()] == [b"second"]
    assert not [p for p in (tmp_path / "o").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
