"""Exact top-k by inner product: a k-nearest-neighbour join over Voronoi cells.

Vectors become integers and fall into the cells of a few pivots. A summary per cell (sizes, radii, largest norms, the
distances of its closest members) bounds the k-th best score of every query cell from below: a member at distance d of
its pivot p scores at least q.p - |q| d with a query q. A vector is copied to a query group only if its own bound from
above, q.p + |q| d, reaches that. Groups and cells are cut into blocks of bounded size by a hash, every pair of blocks is
solved locally by a matrix product, and the best of all blocks are ranked. A crowded cell only has more blocks.

Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with a null id; repeated
rows count once. Vectors of another length than the pivots' are compared among themselves, by length. Components and
scores beyond 64 bits are held at the ends of that range; scores are ranked exactly before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIVOTS, DATA_BLOCK, QUERY_BLOCK = 24, 4096, 1024
ODD = -1  # the cell of vectors whose length is not the pivots'


def integers(vectors: DataFrame, vector_col: str, id_col: str, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component, for the rows that take part."""
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return (vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
            .where("vec_id is not null and size(v) > 0").where(finite)
            .select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def placed(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell, distance to its pivot and norm."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            cell = np.full(batch.num_rows, ODD)
            dist, norm = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            fit = np.flatnonzero(np.asarray(v.value_lengths()) == width)
            if len(fit):
                x = _matrix(v.take(pa.array(fit)), width)
                square = (x * x).sum(1)
                away = square[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
                cell[fit] = away.argmin(1)
                dist[fit] = np.sqrt(np.maximum(away.min(1), 0))
                norm[fit] = np.sqrt(square)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), v, pa.array(cell, pa.int32()), pa.array(dist), pa.array(norm)],
                names=["vec_id", "v", "cell", "dist", "norm"])

    return points.mapInArrow(run, "vec_id long, v array<bigint>, cell int, dist double, norm double")


def _summaries(points: DataFrame, k: int) -> tuple[dict, dict, dict]:
    """Per cell, at most one row per pivot: members, radius; queries, radius, largest norm; closest distances."""
    rows = points.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("dist").alias("radius"), F.count(F.when(F.col("is_query"), 1)).alias("queries"),
        F.max(F.when(F.col("is_query"), F.col("dist"))).alias("query_radius"),
        F.max(F.when(F.col("is_query"), F.col("norm"))).alias("query_norm")).collect()
    nearest = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    close = points.select("cell", "dist").withColumn("at", nearest).where(F.col("at") <= k + 1).collect()
    members = {r.cell: r.n for r in rows}
    queries = {r.cell: (r.queries, r.query_radius, r.query_norm) for r in rows if r.queries}
    closest: dict[int, list[float]] = {}
    for r in close:
        closest.setdefault(r.cell, []).append(r.dist)
    return members, queries, closest


def needs(pivots: np.ndarray, members: dict, queries: dict, closest: dict, k: int, query_block: int,
          data_block: int) -> tuple[list[tuple], list[tuple]]:
    """Query groups ``(cell, part, parts)`` and copies ``(cell, part, parts, blocks, least distance)`` of data cells.

    Small query cells share a part (up to ``query_block`` queries); a large one has a part with several sub-parts.
    """
    size = np.sqrt((pivots * pivots).sum(1))
    inner = pivots @ pivots.T
    groups, room, part = {}, 0, -1
    for cell in sorted(c for c in queries if c != ODD):
        if part < 0 or room + queries[cell][0] > query_block:
            part, room = part + 1, 0
        groups.setdefault(part, []).append(cell)
        room += queries[cell][0]
    if ODD in queries:
        groups[part + 1] = [ODD]
    of_cells, copies = [], []
    for part, cells in groups.items():
        parts = -(-sum(queries[c][0] for c in cells) // query_block)
        of_cells += [(c, part, parts) for c in cells]
        for j, n in members.items():
            if (j == ODD) != (cells == [ODD]):
                continue
            least = 0.0
            if j != ODD:
                least = min(_least_distance(i, j, inner, size, queries[i], closest, k) for i in cells)
            copies.append((j, part, parts, -(-n // data_block), float(least)))
    return of_cells, copies


def _least_distance(i: int, j: int, inner, size, query: tuple, closest: dict, k: int) -> float:
    """Distance from pivot j below which a vector cannot be among the k best of any query of cell i."""
    _, radius, norm = query
    low = sorted((inner[i, c] - radius * size[c] - norm * d for c, ds in closest.items() if c != ODD for d in ds),
                 reverse=True)
    if len(low) <= k or norm == 0:  # one of the k + 1 may be the query itself
        return 0.0
    return (low[k] - inner[i, j] - radius * size[j]) / norm - 1e-6 * (1 + norm)


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple]:
    """Best k rows of ``x`` for each query by inner product, ties to the smaller id, never the query's own id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    n, top = len(ids), max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * x.shape[1]
    exact = np.float64 if top * (n + 1) < 2.0**52 else object
    tie = np.arange(n - 1, -1, -1)
    for at in range(0, len(q), 256):
        own, rows = q_ids[at : at + 256], q[at : at + 256]
        if exact is object:
            score = rows.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
        else:
            score = rows @ x.T
        key = score * n + tie
        own_place = own[:, None] == ids[None, :]
        key[own_place] = -(2.0**60) if exact is not object else -(2**200)
        take = min(k, n)
        best = np.argpartition(-key, take - 1, axis=1)[:, :take] if exact is not object else np.argsort(-key, axis=1)[:, :take]
        keep = ~np.take_along_axis(own_place, best, 1)
        top_scores = np.take_along_axis(score, best, 1)[keep]
        if exact is object:
            top_scores = np.clip(top_scores, -(2**63), 2**63 - 1)
        yield np.repeat(own, keep.sum(1)), ids[best][keep], top_scores.astype(np.int64)


def solve(k: int):
    """Local solution of one pair of blocks, by length of the vectors."""
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        parts = []
        if queries.num_rows and data.num_rows:
            qv, xv = queries["v"].combine_chunks(), data["v"].combine_chunks()
            q_len, x_len = np.asarray(qv.value_lengths()), np.asarray(xv.value_lengths())
            q_ids, x_ids = queries["vec_id"].to_numpy(), data["vec_id"].to_numpy()
            for width in np.unique(q_len):
                a, b = np.flatnonzero(q_len == width), np.flatnonzero(x_len == width)
                if len(b):
                    parts += best_of(q_ids[a], _matrix(qv.take(pa.array(a)), int(width)), x_ids[b],
                                     _matrix(xv.take(pa.array(b)), int(width)), k)
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(dict(zip(out.names, columns)), schema=out)

    return run


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id"), blocks).cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, data_block: int = DATA_BLOCK,
          query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query (a condition on ``vec_id``).

    The pivots are the rows with the smallest hashed ids; they and the cells' summaries (some rows per pivot) are all
    that the driver sees, and the tables broadcast have at most the square of their number.
    """
    spark = vectors.sparkSession
    points = stored(integers(vectors, vector_col, id_col), "integer-vectors")
    chosen = [r.v for r in points.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()]
    result = "query_id long, rank int, vec_id long, score long"
    if not chosen:
        return spark.createDataFrame([], result)
    width = len(chosen[0])
    at = np.array([v for v in chosen if len(v) == width], np.float64)
    points = stored(placed(points, at).withColumn("is_query", is_query), "placed-vectors")
    members, queries, closest = _summaries(points, k)
    if not queries:
        return spark.createDataFrame([], result)
    groups, copies = needs(at, members, queries, closest, k, query_block, data_block)
    groups = spark.createDataFrame(groups, "cell int, part int, parts int")
    copies = spark.createDataFrame(copies, "data_cell int, part int, parts int, blocks int, least double")
    data = (points.join(F.broadcast(copies), F.col("cell") == F.col("data_cell")).where("dist >= least")
            .select("vec_id", "v", "part", "data_cell", _dealt(F.col("blocks")).alias("block"),
                    F.explode(F.expr("sequence(0, parts - 1)")).alias("sub")))
    asked = (points.where("is_query").join(F.broadcast(groups), "cell")
             .select("vec_id", "v", "part", _dealt(F.col("parts")).alias("sub"))
             .join(F.broadcast(copies.select("part", "data_cell", "blocks")), "part")
             .select("vec_id", "v", "part", "sub", "data_cell", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block")))
    keys = ["part", "sub", "data_cell", "block"]
    asked, data = asked.toDF(*asked.columns), data.select("vec_id", "v", *keys).toDF("vec_id", "v", *keys)
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
