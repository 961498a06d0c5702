"""Quality rules: hard limits on document statistics, then gradient-boosted trees over them.

The trees are grown in numpy on a bounded sample of labelled documents, on histograms of the statistics. Chosen
statistics are constrained: a split on one is only taken if the side that should be better is, and the middle of the
two leaf values bounds everything below either side. The forest is flattened into arrays of nodes, so that scoring
walks all rows of a batch down a tree at once.

Null texts are empty: they have no words, so the limits reject them. Rows are judged one by one; repeated rows give
repeated results, other columns are kept or ignored as the function says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slabs, text_of

#: Labelled documents the trees are fitted to at most, and the share of good ones they may reject.
TRAIN_ROWS, LOST = 20_000, 0.002
LEAST_WORDS, MOST_REPEATED = 50, 50  # percent

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
            "digit_share", "shout_share", "bar_share", "line_words", "foreign_share", "mark_share"]
#: Direction in which the probability of being good may move with a statistic.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "shout_share": -1}

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:'\"()-"
_FOREIGN = bytes(range(128, 256))


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that the text has twice or more, and the number of distinct words."""
    place: dict[bytes, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
    if len(ids) < 4:
        return 0, len(place)
    pairs = ids[:-1] * len(place) + ids[1:]
    if len(place) > 1 << 20:  # keeps the key of three words within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(place) + ids[2:]
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0, len(place)
    twice = np.isin(keys, again)
    inside = np.zeros(len(ids), bool)
    for shift in range(3):
        inside[shift : shift + len(keys)] |= twice
    return int(inside.sum()), len(place)


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the statistics of one text, as BASE and FEATURES name them."""
    data = text.encode()
    words = data.split()  # bytes: ASCII blanks only
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, size = len(words), max(1, len(data))
    chars = len(text) - sum(data.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(data.count(b) for b in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    repeats, distinct = repeated_words(words)
    again = len(lines) - len(set(lines))

    def share(of: bytes) -> float:
        return (len(data) - len(data.translate(None, of))) / size

    many = max(1, n)
    return [n, chars, symbols, again, repeats], [
        float(np.log1p(n)), chars / many, symbols / max(1, chars), again / max(1, len(lines)), repeats / many,
        distinct / many, share(_UPPER), share(_DIGITS), (data.count(b"!") + data.count(b"?")) / many,
        data.count(b"|") / many, n / max(1, len(lines)), share(_FOREIGN), share(_MARKS) / 1.0]


@dataclass
class Trees:
    """Flattened forest: node arrays, the root of each tree, and the level that a good document reaches."""

    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: list[int] = field(default_factory=list)
    depth: int = 0
    cut: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of being good for each row of statistics; leaves point to themselves."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 60, depth: int = 4, rate: float = 0.15,
        bins: int = 64, ridge: float = 2.0, least: float = 4.0, lost: float = LOST) -> Trees:
    """Boosted trees for the log-odds of ``y`` (0/1), with +1 / -1 / 0 in ``monotone`` per column.

    ``cut`` becomes the score below which at most a share ``lost`` of the good rows lies. Without rows of both classes
    there is nothing to learn: the forest is empty and keeps everything.
    """
    if len(y) == 0 or y.min() == y.max():
        return Trees(base=4.0)
    columns = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    flat = binned + np.arange(columns) * bins
    out, nodes = Trees(base=float(np.log(y.mean() / (1 - y.mean()))), depth=depth), []
    raw = np.full(len(y), out.base)

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        """Best allowed split of a node: (gain, column, bin, left value, right value)."""
        keys = flat[rows].ravel()
        sums = [np.bincount(keys, np.repeat(v[rows], columns), columns * bins).reshape(columns, bins).cumsum(1)
                for v in (g, h)]
        gl, hl = sums
        gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
        vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)

        def gain(gs, hs, v):
            return -(2 * gs * v + (hs + ridge) * v * v)

        whole = np.clip(-gl[:, -1:] / (hl[:, -1:] + ridge), low, high)
        won = gain(gl, hl, vl) + gain(gr, hr, vr) - gain(gl[:, -1:], hl[:, -1:], whole)
        way = np.array(monotone)[:, None]
        won[(hl < least) | (hr < least) | (way * (vr - vl) < 0)] = -np.inf
        j, b = np.unravel_index(int(np.argmax(won)), won.shape)
        return float(won[j, b]), int(j), int(b), float(vl[j, b]), float(vr[j, b])

    def grow(rows, g, h, level, low, high, value) -> int:
        at = len(nodes)
        nodes.append([0, np.inf, at, at, rate * value])
        raw[rows] = start[rows] + rate * value
        if level < depth and len(rows) > 1:
            won, j, b, vl, vr = split(rows, g, h, low, high)
            if won > 1e-6 and b < len(edges[j]):
                side = binned[rows, j] <= b
                middle = (vl + vr) / 2
                bounds = ((low, high), (low, high)) if not monotone[j] else (
                    ((low, middle), (middle, high)) if monotone[j] > 0 else ((middle, high), (low, middle)))
                nodes[at][:2] = [j, edges[j][b]]
                nodes[at][2] = grow(rows[side], g, h, level + 1, *bounds[0], vl)
                nodes[at][3] = grow(rows[~side], g, h, level + 1, *bounds[1], vr)
        return at

    everything = np.arange(len(y))
    for _ in range(rounds):
        start = raw.copy()
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        root = float(np.clip(-g.sum() / (h.sum() + ridge), -8, 8))
        out.roots.append(grow(everything, g, h, 0, -8.0, 8.0, root))
    out.feature = np.array([n[0] for n in nodes], np.int32)
    out.limit = np.array([n[1] for n in nodes])
    out.left, out.right = (np.array([n[k] for n in nodes], np.int32) for k in (2, 3))
    out.value = np.array([n[4] for n in nodes])
    out.cut = min(0.5, float(np.quantile(out.score(x)[y == 1], lost, method="lower")))
    return out


def _rows(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(text_col).alias("text"))


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of ``keep``), ``base`` (array of BASE) and ``x`` (array of FEATURES) of every row."""
    rows = _rows(docs, keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", 1 << 22):
            got = [statistics(t) for t in slab.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [slab.column(0), pa.array([b for b, _ in got], pa.list_(pa.int64())),
                 pa.array([x for _, x in got], pa.list_(pa.float64()))], names=["row", "base", "x"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, base array<long>, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted to at most ``rows`` labelled documents, those of the smallest hashed ids.

    ``labels`` has doc_id and quality (0/1; null is no label). The sample's ids are broadcast: at most ``rows`` longs.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    order = F.xxhash64("doc_id")
    sample = known.orderBy(order, "doc_id").limit(rows)
    found = measure(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "y"])
    got = found.select("row.doc_id", "row.y", "x").orderBy(order, "doc_id", "x").limit(rows).collect()
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([float(r.y) for r in got]), [MONOTONE.get(f, 0) for f in FEATURES])


def base_failed(base: str = "base") -> Column:
    """The hard limits: too few words, or too many of them in repeated windows."""
    n, repeats = F.get(F.col(base), F.lit(0)), F.get(F.col(base), F.lit(4))
    return (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)


def judge(docs: DataFrame, trees: Trees, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of ``keep``), ``base``, ``score``, ``base_failed`` and ``kept`` of every row."""
    rows = _rows(docs, keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", 1 << 22):
            got = [statistics(t) for t in slab.column(1).to_pylist()]
            score = trees.score(np.array([x for _, x in got]))
            yield pa.RecordBatch.from_arrays(
                [slab.column(0), pa.array([b for b, _ in got], pa.list_(pa.int64())), pa.array(score)],
                names=["row", "base", "score"])

    judged = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, base array<long>, score double")
    return judged.select("row", "base", "score", base_failed().alias("base_failed"),
                         (~base_failed() & (F.col("score") >= float(trees.cut))).alias("kept"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the trees' score."""
    counts = [F.get("base", F.lit(i)).alias(c) for i, c in enumerate(BASE)]
    return judge(docs, train(docs, labels), ["doc_id"]).select("row.doc_id", *counts, "base_failed", "kept", "score")
