import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import difference, duck
from zonecast.llm import knn_join as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, is_query, k=5):
    """Every query against every other distinct row of its length."""
    seen, points = set(), []
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)
        if (i, ints) not in seen:
            seen.add((i, ints))
            points.append((i, ints))
    out = set()
    for i, q in points:
        if is_query(i):
            scored = {(-sum(a * b for a, b in zip(q, x)), j) for j, x in points if j != i and len(x) == len(q)}
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scored)[:k])}
    return out


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("pivots,data_block,query_block", [(1, 10, 3), (6, 25, 8), (24, 4096, 1024)])
def test_clusters_with_ties_as_brute_force(spark, pivots, data_block, query_block):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 8)) * 3
    rows = [(i, [float(x) for x in np.round(centres[i % 5] + rng.normal(size=8) * 0.2, 2)], 0) for i in range(300)]
    rows += [(300 + i, rows[7][1], 0) for i in range(60)] + [(400 + i, [0.0] * 8, 0) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = result(K.top_k(df, F.col("vec_id") % 10 == 0, 5, pivots, data_block, query_block))
    assert got == plain(rows, lambda i: i % 10 == 0)


def test_far_cells_are_not_copied():
    pivots = np.array([[1000.0, 0], [0, 1000.0], [-1000.0, 0]])
    members, queries = {0: 50, 1: 50, 2: 50}, {0: (5, 3.0, 1003.0)}
    _, copies = K.needs(pivots, members, queries, {c: [1.0] * 6 for c in range(3)}, 5, 100, 100)
    least = {c[0]: c[4] for c in copies}
    assert least[0] <= 0 and least[1] > 900 and least[2] > 1900


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 0), (3, [], 0), (4, [None, 1.0], 0), (5, [nan, 1.0], 0),
            (6, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (1, [1.0, 2.0], 0), (8, [3.0, 1.0, 2.0], 0), (10, [1.0, 1.0, 1.0], 0),
            (12, [-0.001, -0.5], 0), (20, [7.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit(1)).withColumn("v", F.lit(2)).withColumn("dist", F.lit(3))
    got = result(K.top_k(df, F.col("vec_id") % 2 == 0))
    assert got == plain(rows, lambda i: i % 2 == 0)
    assert K.top_k(df.limit(0), F.col("vec_id") % 2 == 0).collect() == []
    assert K.top_k(df, F.col("vec_id") < 0).collect() == []


def test_large_components_stay_exact():
    x = np.array([[2.0**20, 1.0], [2.0**20, 2.0], [-1.0, 5.0]])
    for big, held in ((2.0**35, 2**55), (2.0**62, None)):
        (queries, found, scores), = K.best_of(np.array([9]), np.array([[big, 3.0]]), np.array([3, 1, 2]), x, 2)
        assert queries.tolist() == [9, 9] and found.tolist() == [1, 3]
        assert scores.tolist() == ([held + 6, held + 3] if held else [2**63 - 1] * 2)


def test_same_as_sql(spark):
    from zonecast.llm.queries import op2_knn_join

    con = duck("/root/testdata/sf0.01")
    df = op2_knn_join(spark, "/root/testdata/sf0.01")
    cur = con.execute(K.ORACLE)
    want = ([c[0] for c in cur.description], cur.fetchall())
    assert difference((df.columns, [tuple(r) for r in df.collect()]), want) is None
