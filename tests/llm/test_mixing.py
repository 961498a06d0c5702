import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks.compare import difference, duck
from zonecast.llm import mixing as M


def docs_of(spark, sizes, words=5):
    rows = [(f"{s}{i}", " ".join(["w"] * (words + i % 3)), s) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string")


SIZES = {"hot": 900, "mid": 120, "small": 30}


def by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r.source, []).append(r)
    return out


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_repetition_limit_and_prefixes(spark, block):
    docs = docs_of(spark, SIZES)
    rows = M.report(docs, repetition_limit=2.0, block=block).collect()
    assert len(rows) == sum(SIZES.values())
    for source, own in by_source(rows).items():
        tokens, spent = sum(r.n_tokens for r in own), sum(r.n_tokens * r.copies for r in own)
        assert spent <= own[0].quota < spent + 8  # the next document would not fit
        assert own[0].quota / tokens <= 2.001 and min(r.copies for r in own) >= 1
        last = max((r.block for r in own if r.copies > own[0].quota // tokens), default=-1)
        assert all(r.copies == own[0].quota // tokens + (r.block <= last) for r in own if r.block != last)
    assert {r.copies for r in rows if r.source == "hot"} == {1}
    assert sum(r.weight for r in {r.source: r for r in rows}.values()) == pytest.approx(1, abs=1e-8)


def test_entropy_target_and_budget(spark):
    docs = docs_of(spark, SIZES)
    rows = M.report(docs, repetition_limit=None, target_entropy=0.8, budget=3000).collect()
    weights = [own[0].weight for own in by_source(rows).values()]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(0.8 * math.log(3), abs=1e-4)
    assert abs(sum(r.n_tokens * r.copies for r in rows) - 3000) <= 8 * 3
    assert min(r.copies for r in rows if r.source == "hot") == 0
    with pytest.raises(ValueError):
        M.report(docs, target_entropy=0.5)


def test_mixed_rows(spark):
    docs = docs_of(spark, SIZES).withColumn("mix", F.lit(1)).withColumn("row", F.lit("r")).withColumn("copies", F.lit(9))
    want = {r.doc_id: r.copies for r in M.report(docs).collect()}
    got = M.mixed(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == want


def test_edges(spark, documents):
    docs = documents([None, "", "a b c", "long " * 40_000, "a b c", "a b"]).union(documents([(2, "a b c"), (None, "x")]))
    docs = docs.withColumn("source", F.when(F.col("doc_id") == 0, None).otherwise(F.col("source")))
    rows = M.report(docs).collect()
    assert len(rows) == 8 and all(r.copies >= 1 for r in rows)
    assert {r.source for r in rows if r.doc_id == 0} == {""}
    assert M.report(docs.limit(0)).collect() == [] and M.mixed(docs.limit(0)).collect() == []
    only = documents([None, ""])
    assert [r.copies for r in M.report(only).collect()] == [1, 1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    from zonecast.llm.queries import op7_source_mixing

    con = duck(f"/root/testdata/{sf}")
    df = op7_source_mixing(spark, f"/root/testdata/{sf}")
    cur = con.execute(M.ORACLE)
    want = ([c[0] for c in cur.description], cur.fetchall())
    assert difference((df.columns, [tuple(r) for r in df.collect()]), want) is None
