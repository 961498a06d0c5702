import hashlib
import io

import pytest
from pyspark.sql import functions as F

from checks.compare import difference, duck
from zonecast.llm import warc as W

SCHEMA = "page_id long, url string, html string"
LONG = "<p>ü" + "x" * 200
PAGES = [(3, "http://a/ü?%20 b", LONG), (1, "http://b", LONG), (9, None, LONG), (4, "u", "small"), (5, "u", "small"), (6, "u", None),
         (7, "u", ""), (8, "u", "y" * 700_000 + "é"), (10, "u", "WARC/1.1\r\n\r\n" * 20), (11, "u", "y" * 700_000 + "é")]


def plain(rows):
    digest = [hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows]
    out = []
    for (i, _, h), d in zip(rows, digest):
        size = len((h or "").encode())
        first = min((j for (j, _, _), e in zip(rows, digest) if e == d and j is not None), default=None)
        revisit = size >= 100 and first is not None and i != first
        out.append((i, size, d, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_rows(spark):
    rows = [*PAGES, (1, "again", LONG), (None, "n", LONG)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit(1)).withColumn("chunk", F.lit(2)).repartition(3)
    assert sorted(map(tuple, W.report(pages).collect()), key=repr) == plain(rows)
    assert W.report(pages.limit(0)).collect() == []


def test_chunk_rows_carry_the_digest_so_far(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    index = W.write(W.chunked(pages, chunk=1000), f"file:{tmp_path}/warc", file_bytes=100_000)
    assert index.select("path").distinct().count() > 1
    rows = W.read(index, chunk=4096).orderBy("path", "record_no", "chunk_no").collect()
    whole = {}
    for r in rows:
        whole.setdefault(r.page_id, []).append(r)
    for i, url, html in PAGES:
        own, data = whole[i], (html or "").encode()
        assert own[0].url == (url or "")
        if own[0].record_type == "response":
            assert b"".join(r.chunk for r in own) == data and max(len(r.chunk) for r in own) <= 4096
            for r in own:
                assert r.digest_so_far == hashlib.sha256(data[: r.bytes_so_far]).hexdigest()
        assert [r.is_last for r in own] == [False] * (len(own) - 1) + [True]


def test_damaged_archives_fail():
    for data in (b"WARC/1.1\r\nWARC-Type: response\r\n", b"HTTP/1.1 200\r\n\r\n",
                 W.headers(1, "u", 50, "d", None, False) + b"short"):
        with pytest.raises(W.DamagedArchive):
            list(W.parse(io.BufferedReader(io.BytesIO(data)), 16))


def test_same_as_sql(spark):
    from zonecast.llm.queries import op8_warc

    con = duck("/root/testdata/sf0.01")
    df = op8_warc(spark, "/root/testdata/sf0.01")
    cur = con.execute(W.ORACLE)
    want = ([c[0] for c in cur.description], cur.fetchall())
    assert difference((df.columns, [tuple(r) for r in df.collect()]), want) is None
