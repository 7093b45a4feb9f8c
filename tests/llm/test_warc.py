import hashlib

import pytest

from corpusweave.llm import warc
from corpusweave.session import new_table_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
HTML = {
    1: "x" * 150, 2: "x" * 150, 3: None, 4: "", 5: "pre WARC/1.0 post " * 40, 6: FAKE * 30, 7: "y" * 5000, 8: "short", 9: "short", 10: FAKE,
    11: "é" * 300 + "WARC/1.", 12: "x" * 150, 13: "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n" * 5, 14: "WARC/1." * 300,
}


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(k, f"http://h.example/{k}\r\nX: y", v) for k, v in HTML.items()], "page_id long, url string, html string")


@pytest.fixture
def split_size(spark):
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def expected():
    seen, out = {}, set()
    for k in sorted(HTML):
        raw = (HTML[k] or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        first = seen.setdefault(digest, k) if len(raw) >= 100 else k
        out.add((k, len(raw), digest, "revisit" if first != k else "response", first if first != k else None))
    return out


@pytest.mark.parametrize(("compression", "size"), [("gzip", "128m"), ("none", "128m"), ("none", "700"), ("none", "211")])
def test_round_trip_over_splits(spark, pages, split_size, compression, size):
    split_size(size)
    path = new_table_path(spark, "warc-test")
    warc.records(warc.with_revisits(pages)).coalesce(2).write.option("lineSep", "\r\n").option("compression", compression).text(path)
    found = warc.read_back(spark, path).collect()
    assert {tuple(r) for r in found} == expected() and len(found) == len(HTML)


def test_payloads_are_put_together(spark, pages):
    path = new_table_path(spark, "warc-test")
    warc.write_archives(pages, path)
    index, parts = warc.index(spark, path)
    got = warc.payloads(spark, path, index.select("file", "start"), parts)
    texts = sorted(bytes(r.payload) for r in got.collect())
    revisits = {r[0] for r in expected() if r[3] == "revisit"}
    assert texts == sorted(b"" if k in revisits else (v or "").encode() for k, v in HTML.items())


def test_what_follows_a_broken_link_and_a_cut_off_end_is_left_out(spark, pages, split_size):
    split_size("300")
    raw = [bytes(r[0]) + b"\r\n" for r in warc.records(warc.with_revisits(pages.filter("page_id IN (7, 8, 9)").coalesce(1))).selectExpr("cast(value AS binary)").collect()]
    whole = b"".join(raw)
    for name, content, n in (("cut", whole[:-10], 2), ("broken", raw[0] + b"junk" + raw[1] + raw[2], 1), ("junk", b"junk" + whole, 0), ("empty", b"", 0), ("whole", whole, 3)):
        path = new_table_path(spark, f"warc-{name}")
        spark.createDataFrame([(content.decode(),)], "value string").coalesce(1).write.option("lineSep", "\0").text(path)
        # the writer's separator is one byte more at the end: trailing junk, which ends the chain after the last record
        assert warc.read_back(spark, path).count() == n, name


def test_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None), (1, "u", "z" * 200), (1, "u", "z" * 200), (None, "u", "z" * 200), (5, "u", "z" * 200)], "page_id long, url string, html string")
    odd = odd.selectExpr("*", "'x' AS payload", "1 AS first", "'y' AS digest", "2 AS bytes")
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.round_trip(odd).collect())
    assert kinds == [("1", "response", None), ("1", "response", None), ("5", "revisit", 1), ("None", "response", None), ("None", "response", None)]
    assert warc.round_trip(odd.limit(0)).count() == 0
