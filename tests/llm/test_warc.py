import gzip
import hashlib
import glob

import pytest
from pyspark.sql import types as T

from sluiceway.llm import warc as A

SCHEMA = T.StructType([T.StructField("record_type", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def pages(spark, rows):
    return spark.createDataFrame([("clash", *r) for r in rows], SCHEMA).repartition(3)


ROWS = [(i, f"http://x/{i}", "same payload é " * 10) for i in range(1, 6)]
ROWS += [(6, None, None), (7, "u: v", ""), (8, "a\r\nb", "x\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", "é" * 50_000), (10, "u", "short"), (11, "u", "short"), (12, "u", "same payload é " * 10 + " "), (9, "u", "é" * 50_000), (None, "u", "é" * 50_000)]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(A, "BROADCAST_ROWS", broadcast)
    got = A.round_trip(pages(spark, ROWS), least=20).collect()
    assert sorted((repr(r.page_id), r.payload) for r in got) == sorted((repr(p), h or "") for p, _, h in ROWS)
    by = {}
    for r in got:
        assert r.sha1 == hashlib.sha1(r.payload.encode()).hexdigest()
        by.setdefault(r.page_id, []).append(r)
    for i in range(1, 5):
        assert (by[i][0].record_type, by[i][0].refers_to) == ("revisit", 5)
    assert by[None][0].record_type == "revisit" and by[None][0].refers_to == 9
    assert all(r.record_type == "response" and r.refers_to is None for k in (5, 6, 7, 8, 9, 10, 11, 12) for r in by[k])
    assert by[8][0].url == "a%0D%0Ab" and by[6][0].url is None and by[7][0].url == "u: v"


@pytest.mark.parametrize("hot", [1, 256])
def test_restored_records_equal_the_written_bytes(spark, monkeypatch, hot):
    """Whatever the sizes of files and however hot a payload; each payload is in the store once."""
    monkeypatch.setattr(A, "HOT_PAYLOAD", hot)
    path = A.scratch(spark) + f"/test-{hot}"
    docs = pages(spark, ROWS)
    A.write(docs, path, least=20, files=((600, 2), (2000, 1), (1 << 63, 1)))
    headers, payloads = A.store(A.materialize(A.read(spark, path), "archive"))
    assert "payload" not in headers.columns and headers.count() == len(ROWS)
    kept = [r.payload for r in payloads.collect()]
    assert sorted(kept) == sorted({h or "" for _, _, h in ROWS})
    got = sorted(r[0] for r in A.restore(headers, payloads).select(A.record_text()).collect())
    assert got == sorted(r.record for r in A.records(docs, least=20).collect()) and len(got) == len(ROWS)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", "x" * (100 if i % 4 else 5000) + str(i)) for i in range(40)]
    A.write(spark.createDataFrame([("c", *r) for r in rows], SCHEMA).coalesce(1), str(tmp_path / "w"), files=((2000, 7), (1 << 63, 1)))
    sizes = [[len(r[8]) for r in A.parse(gzip.open(x).read())] for x in glob.glob(str(tmp_path / "w/*.gz"))]
    assert sum(map(len, sizes)) == 40 and all(len(s) <= (7 if max(s, default=0) < 2000 else 1) for s in sizes)


def test_the_bound_of_a_record_holds(spark):
    docs = pages(spark, [*ROWS, (2**63 - 1, "\r" * 500, "é" * 50_000), (-(2**63), "é\n" * 500, "é" * 50_000)])
    got = A.records(docs, least=20).selectExpr("octet_length(record) as n", "room").collect()
    assert len(got) == len(ROWS) + 2 and all(r.n <= r.room for r in got)


def test_files_are_warc(spark, tmp_path):
    A.write(pages(spark, ROWS), str(tmp_path / "w"), least=20)
    n = 0
    for name in glob.glob(str(tmp_path / "w/*.gz")):
        data = gzip.open(name).read()
        assert not data or data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
        n += len(list(A.parse(data)))
    assert n == len(ROWS)


def test_a_changed_payload_is_noticed(spark, tmp_path):
    A.write(pages(spark, [(1, "u", "payload")]), str(tmp_path / "w"))
    data = b"".join(gzip.open(x).read() for x in glob.glob(str(tmp_path / "w/*.gz")))
    with pytest.raises(ValueError):
        list(A.parse(data.replace(b"\r\n\r\npayload", b"\r\n\r\npaYload")))


def test_empty(spark):
    assert A.round_trip(pages(spark, [])).collect() == []
