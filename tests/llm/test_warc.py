"""The WARC source and sink: round trips, pushdown, what is skipped, and files that are cut short."""

import gzip
import io
import zlib

import pytest
from conftest import DATA, multiset
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not

from nestquery.llm import warc
from nestquery.llm.queries import ORACLE, op1_warc


def record(kind, uri, block, extra=(), level=6, compressed=True):
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{uri}>"), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), *extra]
    if compressed:
        return warc.member(headers, block, level)
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nX-A: 1\r\n\r\nbody"
COLUMNS = set(warc.ARROW.names)


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("compressed", [True, False])
def test_records(compressed):
    import os

    big = os.urandom(300_000)
    data = b"".join([record("request", "a", big, compressed=compressed), record("response", "b", HTTP, [("X-Own", "é")], compressed=compressed), record("metadata", "c", b"", compressed=compressed)])
    got = list(warc.records(io.BytesIO(data), "f", [], COLUMNS))
    assert [r["type"] for r in got] == ["request", "response", "metadata"]
    assert got[1]["http_status"] == 200 and got[1]["payload"] == b"body" and dict(got[1]["headers"])["x-own"] == "é" and dict(got[1]["http_headers"]) == {"x-a": "1"}
    assert got[2]["payload"] == b"" and got[0]["content_length"] == 300_000
    stream = Counting(data)
    only = list(warc.records(stream, "f", [EqualTo(("type",), "response")], COLUMNS))
    assert [r["target_uri"] for r in only] == ["b"] and stream.taken < 200_000  # the large block is passed over
    assert [r["target_uri"] for r in warc.records(io.BytesIO(data), "f", [In(("target_uri",), ("a", "c")), Not(EqualTo(("type",), "metadata"))], {"target_uri"})] == ["a"]
    assert [r["target_uri"] for r in warc.records(io.BytesIO(data), "f", [GreaterThan(("content_length",), 100)], {"target_uri"})] == ["a"]
    assert list(warc.records(io.BytesIO(data), "f", [IsNull(("type",))], COLUMNS)) == []


def test_members_of_other_writers():
    """Without skip lengths, with chunked and compressed bodies, folded headers."""
    chunked = b"HTTP/1.1 404 No\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\n"
    packed = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"page")
    data = b"".join(gzip.compress(record("response", u, b, [("X-Long", "a\r\n b")], compressed=False)) for u, b in (("x", chunked), ("y", packed)))
    got = list(warc.records(io.BytesIO(data), "f", [], COLUMNS))
    assert [(r["http_status"], r["payload"]) for r in got] == [(404, b"abcde"), (200, b"page")]
    assert dict(got[0]["headers"])["x-long"] == "a b"
    assert [r["target_uri"] for r in warc.records(io.BytesIO(data), "f", [EqualTo(("target_uri",), "y")], {"target_uri"})] == ["y"]


@pytest.mark.parametrize("data", [record("response", "b", HTTP)[:-30], record("response", "b", HTTP, compressed=False)[:-20], b"no record at all", record("response", "b", HTTP) + b"junk"])
def test_broken_files(data):
    with pytest.raises((ValueError, EOFError)):
        list(warc.records(io.BytesIO(data), "f", [], COLUMNS))
    assert len(list(warc.records(io.BytesIO(data), "f", [], COLUMNS, strict=False))) == (1 if data.endswith(b"junk") else 0)


def test_filters_that_stay():
    reader = warc.WarcReader({"path": "/nowhere"})
    assert list(reader.pushFilters([EqualTo(("type",), "response"), EqualTo(("http_status",), 200), EqualTo(("headers", "x"), "y")])) == [EqualTo(("http_status",), 200), EqualTo(("headers", "x"), "y")]
    assert reader.filters == [EqualTo(("type",), "response")]


def test_pages_of_the_table(spark, oracle):
    df = op1_warc(spark, DATA)
    names, rows = oracle(ORACLE["op1_warc"])
    assert df.columns == names
    assert multiset(map(tuple, df.collect())) == multiset(rows)


def test_awkward_pages(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>é</p>", "k"), (1, "http://a/x", "<p>é</p>", "k"), (2, None, "x", None), (3, "http://b", None, None), (4, "http://b", "", None), (None, "http://c", "<p>", None), (5, "u\nv", "y" * 3_000_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.pages_as_records(pages.repartition(3)), path)
    got = [(r.page_id, r.url, r.html) for r in warc.pages_from_records(spark, path).collect()]
    assert multiset(got) == multiset([(i, u if u is None else u.replace("\n", " "), h) for i, u, h, _ in rows])
    assert warc.read_warc(spark, path, ["type"]).filter("type = 'request'").count() == len(rows)
    small = warc.read_warc(spark, path, ["record_id"], partitionBytes="1")
    assert small.rdd.getNumPartitions() == 3 and small.count() == 2 * len(rows)
    empty = f"file://{tmp_path}/e"
    warc.write_warc(warc.pages_as_records(pages.limit(0)), empty)
    assert warc.pages_from_records(spark, empty).collect() == []
    assert not [f for f in (tmp_path / "w").iterdir() if f.name.startswith("_0")]


def test_records_that_share_a_member():
    kinds = [("request", "a", b"x" * 500_000), ("response", "b", HTTP), ("metadata", "c", b""), ("response", "d", HTTP)]
    whole = gzip.compress(b"".join(record(k, u, b, compressed=False) for k, u, b in kinds))
    for data, want in ((whole, "abcd"), (whole + record("response", "e", HTTP), "abcde"), (whole * 2, "abcdabcd")):
        got = list(warc.records(io.BytesIO(data), "f", [], COLUMNS))
        assert "".join(r["target_uri"] for r in got) == want and got[1]["payload"] == b"body" and got[0]["content_length"] == 500_000
        only = warc.records(io.BytesIO(data), "f", [EqualTo(("type",), "response")], {"target_uri"})
        assert "".join(r["target_uri"] for r in only) == want.replace("a", "").replace("c", "")
    broken = gzip.compress(record("response", "a", HTTP, compressed=False) + b"junk")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(broken), "f", [], COLUMNS))
    assert len(list(warc.records(io.BytesIO(broken), "f", [], COLUMNS, strict=False))) == 1


def test_overwriting(spark, tmp_path):
    pages = lambda k: spark.createDataFrame([(i, f"http://{k}/{i}", "<p>", None) for i in range(2)], "page_id long, url string, html string, key string")
    path = f"file://{tmp_path}/w"
    for k in range(2):
        warc.write_warc(warc.pages_as_records(pages(k)), path, mode="overwrite")
        assert sorted(r.url for r in warc.pages_from_records(spark, path).collect()) == [f"http://{k}/0", f"http://{k}/1"]
    warc.write_warc(warc.pages_as_records(pages(5)), path)
    assert warc.pages_from_records(spark, path).count() == 4


@pytest.mark.parametrize("compressed", [True, False])
def test_reading_on_behind_damage(compressed):
    """With ``strict`` off the record that is damaged is lost, and no other."""
    parts = [record("response", u, HTTP + u.encode() * 50, compressed=compressed) for u in "abcd"]
    hurt = parts[1][:40] + b"\x00" * 30 + parts[1][70:]
    if not compressed:
        hurt = parts[1].replace(b"Content-Length: ", b"Content-Length: x")
    # a plain record that is cut within its headers can't be told from one whose headers go on in the next
    for hurt_or_cut in (hurt, parts[1][:60]) if compressed else (hurt,):
        data = parts[0] + hurt_or_cut + parts[2] + parts[3]
        assert [r["target_uri"] for r in warc.records(io.BytesIO(data), "f", [], {"target_uri", "payload"}, strict=False)] == ["a", "c", "d"]
        with pytest.raises((ValueError, EOFError, zlib.error)):
            list(warc.records(io.BytesIO(data), "f", [], {"target_uri", "payload"}))


def test_files_are_shared_among_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://a/{i}", "<p>" + "x" * 1000, None) for i in range(400)], "page_id long, url string, html string, key string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.pages_as_records(rows.repartition(9)), path)
    df = warc.pages_from_records(spark, path)
    assert df.rdd.getNumPartitions() >= min(4, spark.sparkContext.defaultParallelism) and df.count() == 400
