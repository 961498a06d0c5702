"""SimHash fingerprints and links within a Hamming radius by meeting in the middle.

Two 64-bit fingerprints that differ in at most r bits (r even) share a variant: flip half of the differing bits of the
one and the other half of the other. Emitting all variants within r/2 flips and shuffling on them finds every link, and
a shared variant is a link by the triangle inequality, so the members of a variant hang on its smallest one instead of
forming pairs. For r = 4 that are 2081 variants each.

The same holds inside segments: in one of two 32-bit halves a link differs in at most r/2 bits, so the variants of both
halves within r/4 flips (66 for r = 4) meet as well, but may meet without being a link. ``links`` therefore meets in
the halves first: the members of a half are held against its smallest one, then against one drawn for it, and what that
links is contracted. Only halves that still hold different components go on. Up to ``crowd`` fingerprints in one are
compared with each other across components; all fingerprints in more crowded ones emit their full ball of 2081 variants,
which needs no pairs, and hang on one member of a variant if that is of another component. A link is found in one of
these ways or lies within a component already, whatever the sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slabs, stored, text_of
from .components import components

#: Fingerprints sharing a half variant up to which they are compared with each other.
CROWD = 8


def fingerprint(text: bytes, width: int, seed: int = 42) -> int:
    """Fingerprint of the word shingles of one text, as a signed 64-bit integer; no words give zero."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII blanks separate
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    count = max(1, len(words) - width + 1)
    first, last = (ends - sizes)[:count].tolist(), ends[-count:].tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, first, last)), repeat(seed)),
                         np.uint64, count).astype("<u8", copy=False)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (long) of every row; null texts count as empty, other columns are ignored."""
    rows = docs.select(F.col(id_col), text_of(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", 1 << 22):
            fps = [fingerprint(t, width) for t in slab.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp long")


def masks(bits: int, flips: int) -> list[int]:
    """All patterns of at most ``flips`` ones among ``bits`` places, as signed 64-bit integers."""
    found = [sum(1 << p for p in c) for n in range(flips + 1) for c in combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _flipped(value: Column, patterns: list[int]) -> Column:
    return F.transform(F.lit(patterns), lambda m: value.bitwiseXOR(m))


def half_variants(fp: Column, radius: int) -> Column:
    """Variants of both halves within a quarter of the radius; the upper half's ones are told apart by bit 32."""
    near = masks(32, -(-(radius // 2) // 2))
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32))
    return F.concat(_flipped(low, near), _flipped(high, near))


def near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def _dealt(rows: DataFrame) -> DataFrame:
    """Dealt evenly, as every row is about to become many."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _linked(pairs: DataFrame, radius: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` that are links, the larger one first, each once."""
    good = pairs.where("a <> b").where(near("a", "b", radius))
    return good.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _met(fps: DataFrame, radius: int, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First edges ``(a, b)``, their components ``(fp, root)``, and the links that are left between different ones.

    The last table has one link ``(a, b)`` with its components ``(root, other)`` for what joins them.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    met = _dealt(fps.select("fp")).select("fp", F.explode(half_variants(F.col("fp"), radius)).alias("key"))
    shared = stored(met.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"),
        F.min_by("fp", F.xxhash64("fp", "key")).alias("drawn")).where("n > 1"), "shared-halves")
    # The table of shared halves grows with the data, so it is never broadcast.
    more = stored(met.join(shared.where("n > 2").select("key", "n", "a", "drawn").hint("merge"), "key"), "met-halves")
    fp = F.col("fp").alias("b")
    pairs = shared.where("n = 2").select("a", "b").union(more.select("a", fp)).union(more.select("drawn", fp))
    edges = stored(_linked(pairs, radius), "links")
    roots = stored(components(edges), "roots").withColumnRenamed("node", "fp")
    named = stored(more.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    left = stored(named.join(mixed.hint("merge"), "key"), "split")
    few = left.where(F.col("n") <= crowd).select("key", "fp", "root")
    right = few.select("key", F.col("fp").alias("b"), F.col("root").alias("other"))
    compared = few.withColumnRenamed("fp", "a").join(right, "key").where("root < other").where(near("a", "b", radius))
    many = left.where(F.col("n") > crowd).select("fp", "root").distinct()
    ball = _dealt(many).select("fp", "root", F.explode(_flipped(F.col("fp"), masks(64, radius // 2))).alias("key"))
    least, most = F.min(F.struct("root", F.col("fp").alias("b"))).alias("least"), F.max("root").alias("most")
    centre = ball.groupBy("key").agg(least, most).where("least.root <> most")
    # A table on both sides of the join lets Spark split a crowded variant.
    centre = stored(centre.select("key", F.col("least.root").alias("other"), "least.b"), "centres")
    # Spark takes the exploded balls for as small as the fingerprints, so the join is told not to broadcast them.
    hung = ball.withColumnRenamed("fp", "a").hint("merge").join(centre, "key").where("root <> other").where(near("a", "b", radius))
    found = compared.select("a", "b", "root", "other").union(hung.select("a", "b", "root", "other"))
    found = found.groupBy("root", "other").agg(F.min(F.struct("a", "b")).alias("link")).select("link.*", "root", "other")
    return edges, roots, stored(found, "late-links")


def links(fps: DataFrame, radius: int = 4, crowd: int = CROWD) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp``, that connect exactly what the radius connects."""
    edges, _, late = _met(fps, radius, crowd)
    return edges.union(_linked(late.select("a", "b"), radius))


def linked_roots(fps: DataFrame, radius: int = 4, crowd: int = CROWD) -> DataFrame:
    """``(fp, root)`` of the fingerprints with a link; the components of the first edges are joined by the late links."""
    _, roots, late = _met(fps, radius, crowd)
    joined = stored(components(late.select(F.col("root").alias("a"), F.col("other").alias("b"))), "joined-roots")
    # A fingerprint without a first edge is its own root, and is in no table but that of the late links.
    every = roots.unionByName(joined.select(F.col("node").alias("fp"), F.col("node").alias("root"))).distinct()
    further = joined.select(F.col("node").alias("root"), F.col("root").alias("last"))
    return every.join(further, "root", "left").select("fp", F.coalesce("last", "root").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4, crowd: int = CROWD,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, ``fp`` and ``component_id``: the smallest id reachable over links of at most ``radius`` bits.

    Equal fingerprints are one node, so copies never meet each other; links and components are sought between distinct
    fingerprints only. Rows with a null id take part in no minimum and get their component's id.
    """
    prints = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    linked = stored(linked_roots(distinct, radius, crowd).join(distinct, "fp"), "linked")
    groups = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(groups, "root").select("fp", "component_id")
    by_print = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    by_print = stored(by_print, "component-of-fingerprint")  # so that Spark may split a fingerprint with many copies
    return prints.join(by_print, "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group: that of the smallest ``doc_id`` (rows without one come last), of equal ids that whose
    columns have the smallest hash. Rows that are equal in all columns count as one. Columns stay as they are."""
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    groups = near_duplicates(named.select("key", "row.text"), width, radius, id_col="key")
    first = groups.where(F.col("key") == F.col("component_id")).select("key").distinct()
    return named.join(first.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def report(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """doc_id, the fingerprint as 16 hexadecimal digits, component_id."""
    return near_duplicates(docs, width, radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
