"""Toxicity: a convolutional text classifier trained on all labelled texts, with thresholds calibrated by language.

Words (runs of letters, digits and non-ASCII bytes, A-Z in lower case) are hashed into an embedding table, and their
first letters into another, so that inflected forms share a part. Filters of several widths run over the sum of both,
the largest response of each filter over the whole text is kept, and a logistic layer makes the score. Hashes of all
words of a batch come from one running sum of byte powers, so no word is ever an object.

Every labelled text that may be fitted is in every round of training. Their words are stored once in shards of bounded
size; in each round every shard goes on from the same network by itself, and what the shards have learned is averaged
on Spark. The driver holds one network, whatever the data; a single shard is plain training in sequence.

Only texts and labels reach the model; language serves the thresholds alone, which are set on labelled rows that the
training did not see. Null texts are empty; a text without words has the score of the bias, and repeated rows repeat.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.session import run_together

from .common import slabs, stored, text_of

#: Labelled texts that a shard holds on average, and words at which one is cut. All texts are in shards.
SHARD_ROWS, SHARD_WORDS = 4000, 1 << 24
BUCKETS, STEM_BUCKETS, STEM, WIDTH, FILTERS, SPANS = 1 << 16, 1 << 15, 5, 8, 8, (1, 2, 3)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SMALL = np.arange(256, dtype=np.uint64)
_SMALL[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b)])) for b in (_ODD, inverse))
    return _powers


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (value >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int32)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, buckets of their first letters, and how many words each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.flatnonzero(np.diff(_WORD[data].view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers_of(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((_SMALL[data] + np.uint64(1)) * up[: len(data)])])
        words = (sums[ends] - sums[starts]) * down[starts]
        stems = (sums[np.minimum(ends, starts + STEM)] - sums[starts]) * down[starts]
        counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)])))
        return _bucket(words, BUCKETS), _bucket(stems, STEM_BUCKETS), counts


@dataclass
class Network:
    """Embeddings of words and stems, filters per span, and the logistic layer."""

    words: np.ndarray
    stems: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)  # (span * WIDTH, FILTERS)
    shift: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(SPANS), np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(SPANS), np.float32))
    bias: float = 0.0

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def some(rows, columns, scale):
            return rng.normal(0, scale, (rows, columns)).astype(np.float32)

        # Small embeddings keep words that training never saw from firing a filter.
        return Network(some(BUCKETS, WIDTH, 0.01), some(STEM_BUCKETS, WIDTH, 0.01),
                       [some(s * WIDTH, FILTERS, (2 / (s * WIDTH)) ** 0.5) for s in SPANS],
                       out=rng.normal(0, 0.3, FILTERS * len(SPANS)).astype(np.float32))

    def pooled(self, words: np.ndarray, stems: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of each filter per text (zero at least), the padded inputs, and all responses of each span.

        Each text is followed by as many zero rows as the widest span, so that filters see one text only.
        """
        gap = max(SPANS)
        total = int(counts.sum())
        shift = np.repeat(np.arange(len(counts)) * gap, counts)
        x = np.zeros((total + gap * len(counts), WIDTH), np.float32)
        place = np.arange(total) + shift
        x[place] = self.words[words] + self.stems[stems]
        firsts = np.cumsum(counts + gap) - counts - gap
        blank = np.ones(len(x), bool)
        blank[place] = False
        best, where = [], []
        for s, f in zip(SPANS, self.filters):
            rows = len(x) - s + 1
            r = np.zeros((len(x), FILTERS), np.float32)
            for j in range(s):
                r[:rows] += x[j : j + rows] @ f[j * WIDTH : (j + 1) * WIDTH]
            r[blank] = 0  # a filter that starts between two texts would see the next one
            top = np.maximum.reduceat(r, firsts)
            best.append(top)
            where.append((r, firsts, top))
        pooled = np.concatenate(best, 1) + self.shift
        return pooled, x, where

    def score(self, words: np.ndarray, stems: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        pooled = self.pooled(words, stems, counts)[0]
        return 1 / (1 + np.exp(-(np.maximum(pooled, 0) @ self.out + self.bias).astype(np.float64)))

    def score_texts(self, texts: list[bytes]) -> np.ndarray:
        return self.score(*hashed_words(texts))


def _peaks(r: np.ndarray, firsts: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The first row of each text where each filter has its largest response."""
    sizes = np.diff(np.append(firsts, len(r)))
    rows, filters = np.nonzero(r == np.repeat(top, sizes, axis=0))
    key, index = np.unique(np.repeat(np.arange(len(firsts)), sizes)[rows] * FILTERS + filters, return_index=True)
    at = np.repeat(firsts, FILTERS)
    at[key] = rows[index]
    return at.reshape(-1, FILTERS)


class Learner:
    """A network in training: Adam for filters and the logistic layer, sums of squares for the embeddings."""

    def __init__(self, seed: int):
        net = self.network = Network.fresh(seed)
        self.dense = [*net.filters, net.shift, net.out, np.zeros(1, np.float32)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.dense]
        self.squares = [np.zeros(len(net.words), np.float32), np.zeros(len(net.stems), np.float32)]
        self.step = 0

    def learn(self, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, often: list[np.ndarray],
              order: np.ndarray, batch: int, rate: float) -> list[np.ndarray]:
        """One round over ``texts`` ((words, stems) each) on the log loss; returns which embeddings have changed.

        Words and stems that are not marked in ``often`` keep their small start.
        """
        net, dense = self.network, self.dense
        changed = [np.zeros(len(q), bool) for q in self.squares]
        for rows in np.array_split(order, max(1, len(y) // batch)):
            self.step += 1
            words = np.concatenate([texts[i][0] for i in rows])
            stems = np.concatenate([texts[i][1] for i in rows])
            counts = np.array([len(texts[i][0]) for i in rows])
            pooled, x, where = net.pooled(words, stems, counts)
            active = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-(active @ net.out + dense[-1][0])))
            g = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            back = g[:, None] * net.out[None, :] * (pooled > 0)
            grads, dx, moved = [], np.zeros_like(x), []
            for k, (s, (r, firsts, top)) in enumerate(zip(SPANS, where)):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                i, f = np.nonzero(part)
                at = _peaks(r, firsts, top)[i, f][:, None] + np.arange(s)
                df = np.zeros((FILTERS, s * WIDTH), np.float32)
                np.add.at(df, f, part[i, f][:, None] * x[at].reshape(-1, s * WIDTH))
                np.add.at(dx, at.ravel(), (part[i, f][:, None] * net.filters[k].T[f]).reshape(-1, WIDTH))
                moved.append(at.ravel())
                grads.append(df.T)
            grads += [back.sum(0), active.T @ g, np.array([g.sum()], np.float32)]
            for (m, v), param, grad in zip(self.moments, dense, grads):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                param -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
            hit = np.unique(np.concatenate(moved))
            hit = hit[np.abs(dx[hit]).sum(1) != 0]
            place = np.arange(len(words)) + np.repeat(np.arange(len(counts)) * max(SPANS), counts)
            of = np.searchsorted(place, hit)
            real = (of < len(place)) & (place[np.minimum(of, len(place) - 1)] == hit) if len(place) else np.zeros(0, bool)
            of, hit = of[real], hit[real]
            for table, ids, square, known, new in zip((net.words, net.stems), (words[of], stems[of]), self.squares, often, changed):
                step_of, ids = dx[hit][known[ids]], ids[known[ids]]
                np.add.at(square, ids, (step_of**2).mean(1))
                np.add.at(table, ids, -0.1 * step_of / (np.sqrt(square[ids]) + 1e-6)[:, None])
                new[ids] = True
        return changed

    def vector(self) -> np.ndarray:
        """Dense parameters, their moments and the step."""
        parts = [*self.dense, *(m for pair in self.moments for m in pair)]
        return np.concatenate([*(p.ravel() for p in parts), [self.step]]).astype(np.float64)

    def put(self, vector: np.ndarray) -> None:
        """The opposite of ``vector``."""
        at = 0
        for p in [*self.dense, *(m for pair in self.moments for m in pair)]:
            p[...] = vector[at : at + p.size].reshape(p.shape)
            at += p.size
        self.step = int(round(vector[at]))


#: Embeddings whose changes go through the shuffle as one row; the stems' numbers follow the words'.
BLOCK = 1 << 12
_BLOCKS = "block int, part long, ids binary, cells binary"


def _blocks(part: int, ids: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    edges = np.searchsorted(ids, np.arange(0, BUCKETS + STEM_BUCKETS + 1, BLOCK))
    for block, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if a < b:
            yield block, part, (ids[a:b] - block * BLOCK).astype(np.int32).tobytes(), cells[a:b].astype(np.float32).tobytes()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    named = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), named)], names=[n for n, _ in named])


def _added(rows: DataFrame) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """``_BLOCKS`` rows added up on Spark: block -1 (one row of doubles; none without rows), then the numbers of all
    embeddings in the others, their sums, and in how many rows each was.

    Rows of a block are added in the order of their parts, so that the sums do not depend on the order of arrival. What
    the driver gets has at most as many numbers as the network.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw, data in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "cells"))):
                ids = np.frombuffer(raw, np.int32)
                cells = np.frombuffer(data, np.float64 if block < 0 else np.float32).reshape(len(ids), -1)
                if block not in sums:
                    size = 1 if block < 0 else BLOCK
                    sums[block], seen[block] = np.zeros((size, cells.shape[1])), np.zeros(size, np.int32)
                sums[block][ids] += cells
                seen[block][ids] += 1
        for block, total in sums.items():
            ids = np.flatnonzero(seen[block])
            yield _batch([(block, ids.astype(np.int32).tobytes(), total[ids].tobytes(), seen[block][ids].tobytes())],
                         "block int, ids binary, cells binary, seen binary")

    got = (rows.repartition(8, "block").sortWithinPartitions("block", "part")
           .mapInArrow(run, "block int, ids binary, cells binary, seen binary").collect())
    first = [np.frombuffer(r.cells) for r in got if r.block < 0]
    rest = sorted((r for r in got if r.block >= 0), key=lambda r: r.block)
    ids = [np.frombuffer(r.ids, np.int32) + r.block * BLOCK for r in rest]
    cells = [np.frombuffer(r.cells).reshape(len(i), -1) for r, i in zip(rest, ids)]
    none = np.zeros(0, np.int32)
    return (first[0] if first else None, np.concatenate([none, *ids]), np.concatenate(cells) if cells else np.zeros((0, 1)),
            np.concatenate([none, *(np.frombuffer(r.seen, np.int32) for r in rest)]))


def _texts(shard: dict) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(words, stems) of each text of a shard, labels, and which are kept for the thresholds: every fifth."""
    words, stems = np.frombuffer(shard["words"], np.uint16), np.frombuffer(shard["stems"], np.uint16)
    counts, y = np.frombuffer(shard["counts"], np.int64), np.frombuffer(shard["y"], np.uint8).astype(float)
    ends = np.cumsum(counts)
    return [(words[a:b], stems[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())], y, np.arange(len(y)) % 5 == 4


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _marked(ids: DataFrame) -> np.ndarray:
    """A bit for the ``slot`` of each id, 16 MB at most; an id without a bit is not among them."""
    size = min(1 << 27, 1 << max(15, (16 * ids.count()).bit_length()))
    slot = _slot(size) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bits = np.zeros((size >> 15, 1 << 12), np.uint8)
    for r in rows:
        bits[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return bits.ravel()


def _slot(size: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(size))


def shards(docs: DataFrame, labels: DataFrame, fitted: Column, rows: int = SHARD_ROWS) -> DataFrame:
    """All labelled texts, hashed, as stored shards of about ``rows`` texts; one row per shard.

    ``fitted`` is a condition on ``doc_id``: rows where it is false never enter. Documents that cannot have a label are
    left before their texts are hashed; the join with the labels decides. How texts are dealt out depends on their ids and
    number alone; a shard that repeated ids or long texts make too large is cut.
    """
    known = (labels.where("toxic is not null and doc_id is not null").where(fitted)
             .groupBy("doc_id").agg(F.max("toxic").alias("y")).where("y = 1 or y = 0").withColumn("y", F.col("y").cast("int")))
    own = docs.where("doc_id is not null").where(fitted)
    pieces = max(1, -(-own.select("doc_id").join(known, "doc_id").count() // rows))
    bits = _marked(known)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(marked(batches), "text", 1 << 20):
            words, stems, counts = hashed_words(slab.column("text").to_pylist())
            ends = np.cumsum(counts)
            words, stems = words.astype(np.uint16), stems.astype(np.uint16)
            cut = list(zip((ends - counts).tolist(), ends.tolist()))
            yield pa.RecordBatch.from_arrays(
                [slab.column("doc_id"), slab.column("lang"), pa.array([words[a:b].tobytes() for a, b in cut], pa.binary()),
                 pa.array([stems[a:b].tobytes() for a, b in cut], pa.binary())], names=["doc_id", "lang", "words", "stems"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cut, held, size = None, 0, [], 0

        def shard() -> pa.RecordBatch:
            y, langs, words, stems, _ = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([(cut << 32) + now]), pa.array([np.array(y, np.uint8).tobytes()], pa.binary()),
                 pa.array([list(langs)], pa.list_(pa.string())),
                 pa.array([np.array([len(w) // 2 for w in words], np.int64).tobytes()], pa.binary()),
                 pa.array([b"".join(words)], pa.binary()), pa.array([b"".join(stems)], pa.binary())],
                names=["part", "y", "langs", "counts", "words", "stems"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("y", "lang", "words", "stems", "shard"))):
                if held and (row[4] != now or len(held) >= 2 * rows or size + len(row[2]) // 2 > SHARD_WORDS):
                    yield shard()
                    cut, held, size = cut + 1 if row[4] == now else 0, [], 0
                now = row[4]
                held.append(row)
                size += len(row[2]) // 2
        if held:
            yield shard()

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = own.select("doc_id", _slot(8 * len(bits)).alias("slot"), lang.alias("lang"), text_of().cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang string, words binary, stems binary")
    found = hashed.join(known, "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).cast("int"))
    order = ["shard", F.xxhash64("doc_id"), "doc_id", "words", "stems", "lang"]
    packed = found.repartitionById(pieces, "shard").sortWithinPartitions(*order).mapInArrow(
        pack, "part long, y binary, langs array<string>, counts binary, words binary, stems binary")
    return stored(packed, "toxicity-shards")


@dataclass
class Totals:
    """Of all rows that are fitted: how many, how many toxic, and which words and stems are in enough texts."""

    rows: int
    toxic: int
    often: list[np.ndarray]


def totals(shards: DataFrame, least_texts: int = 3) -> tuple[Totals, Totals]:
    """Those of four fifths of the texts, and those of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _each(batches):
            texts, y, held = _texts(shard)
            texts_of = []
            for keep in (~held, held):
                pairs = [t for t, k in zip(texts, keep) if k]
                texts_of.append(np.concatenate([np.bincount(
                    np.concatenate([np.zeros(0, np.uint16), *(np.unique(t[k]) for t in pairs)]), minlength=size)
                    for k, size in enumerate((BUCKETS, STEM_BUCKETS))]))
            cells = np.stack(texts_of, 1)
            ids = np.flatnonzero(cells.any(1))
            sums = np.array([(~held).sum(), y[~held].sum(), held.sum(), y[held].sum()], np.float64)
            yield _batch([(-1, shard["part"], np.zeros(1, np.int32).tobytes(), sums.tobytes()),
                          *_blocks(shard["part"], ids, cells[ids])], _BLOCKS)

    sums, ids, cells, _ = _added(shards.mapInArrow(run, _BLOCKS))
    sums = np.zeros(4) if sums is None else sums
    found = np.zeros((BUCKETS + STEM_BUCKETS, 2))
    found[ids] = cells
    out = []
    for n, toxic, texts in ((sums[0], sums[1], found[:, 0]), (sums[0] + sums[2], sums[1] + sums[3], found.sum(1))):
        often = texts >= least_texts
        out.append(Totals(int(n), int(toxic), [often[:BUCKETS], often[BUCKETS:]]))
    return out[0], out[1]


def train(shards: DataFrame, total: Totals, whole: bool = True, rounds: int = 6, batch: int = 64, rate: float = 0.02,
          seed: int = 7) -> Network:
    """Fit by Adam on the log loss, rows of both classes weighing the same, to all shards or (not ``whole``) to four fifths.

    Each round starts every shard from the same learner. Filters and the logistic layer become the mean over all rows, an
    embedding the mean over the shards that changed it: most words are in few shards, and a mean over all would hold them
    back. Words and stems of too few texts keep their small start, or else the network would learn texts by their rarest words.
    Without rows of both classes nothing is learned and every text gets the same score.
    """
    learner = Learner(seed)
    net = learner.network
    if total.toxic in (0, total.rows):
        net.out[:], net.bias = 0, -4.0
        return net
    context, share = shards.sparkSession.sparkContext, total.toxic / total.rows
    for done in range(rounds):
        shared = context.broadcast((learner, total.often))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, done=done) -> Iterator[pa.RecordBatch]:
            for shard in _each(batches):
                start, often = shared.value
                own = copy.deepcopy(start)
                texts, y, held = _texts(shard)
                if not whole:
                    texts, y = [t for t, h in zip(texts, held) if not h], y[~held]
                rng = np.random.default_rng(seed)
                order = [rng.permutation(len(y)) for _ in range(done + 1)][-1]
                changed = own.learn(texts, y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), often, order, batch, rate)
                ids = np.flatnonzero(np.concatenate(changed))
                cells = np.concatenate([np.concatenate([own.network.words, own.network.stems]),
                                        np.concatenate(own.squares)[:, None]], 1)[ids]
                mean = np.concatenate([[1], own.vector()]) * len(y)
                yield _batch([(-1, shard["part"], np.zeros(1, np.int32).tobytes(), mean.tobytes()),
                              *_blocks(shard["part"], ids, cells)], _BLOCKS)

        sums, ids, cells, seen = _added(shards.mapInArrow(run, _BLOCKS))
        shared.destroy()
        learner.put(sums[1:] / sums[0])
        cells = cells / seen[:, None] if len(ids) else cells
        for table, square, mine, low in ((net.words, learner.squares[0], ids < BUCKETS, 0),
                                         (net.stems, learner.squares[1], ids >= BUCKETS, BUCKETS)):
            if mine.any():
                table[ids[mine] - low], square[ids[mine] - low] = cells[mine, :-1], cells[mine, -1]
    net.bias = float(learner.dense[-1][0])
    return net


#: Scores are cut at thousandths.
_CUTS = np.arange(1001) / 1000


def thresholds(shards: DataFrame, network: Network, least_toxic: int = 10) -> dict[str, float]:
    """The cut of best F1 (nearest to 0.5, of the smallest) of each language, over all texts that are kept for it.

    Languages with fewer toxic texts there have none. Texts are counted by language and thousandth on Spark, where each
    language is one small group.
    """
    shared = shards.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _each(batches):
            texts, y, held = _texts(shard)
            kept = np.flatnonzero(held)
            for some in np.array_split(kept, -(-len(kept) // 64) or 1):
                if len(some):
                    p = shared.value.score(np.concatenate([texts[i][0] for i in some]), np.concatenate([texts[i][1] for i in some]),
                                           np.array([len(texts[i][0]) for i in some]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard["langs"][i] for i in some], pa.string()),
                         pa.array(np.searchsorted(_CUTS, p, side="right") - 1, pa.int32()),
                         pa.array(np.rint(p * 1000), pa.int32()), pa.array(y[some], pa.int64())],
                        names=["lang", "below", "near", "y"])

    def best(found: pa.Table) -> pa.Table:
        below, near, toxic, n = (found.column(c).to_numpy() for c in ("below", "near", "toxic", "n"))
        cuts = np.unique([500, *near])
        f1 = [2 * toxic[below >= c].sum() / max(1, n[below >= c].sum() + toxic.sum()) for c in cuts]
        cut = min((abs(c - 0.5), c) for c, f in zip(_CUTS[cuts], f1) if f >= max(f1) - 1e-9)[1]
        return pa.table({"lang": found.column("lang")[:1], "cut": [float(cut)]})

    counts = (shards.mapInArrow(run, "lang string, below int, near int, y long")
              .groupBy("lang", "below", "near").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")))
    enough = counts.groupBy("lang").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least_toxic).select("lang")
    got = counts.join(enough, "lang").groupBy("lang").applyInArrow(best, "lang string, cut double").collect()
    return {r["lang"]: r["cut"] for r in sorted(got)}


@dataclass
class Model:
    network: Network
    thresholds: dict[str, float]


def fit(docs: DataFrame, labels: DataFrame, fitted: Column, rows: int = SHARD_ROWS) -> Model:
    """Network fitted to all labelled texts; thresholds per language with the best F1 on the fifth of them that a network
    fitted to the rest has not seen. ``rows`` is the size of a shard.

    A language with fewer than ten toxic texts there keeps the threshold 0.5.
    """
    parts = shards(docs, labels, fitted, rows)
    rest, every = totals(parts)
    cuts, network = run_together([lambda: thresholds(parts, train(parts, rest, whole=False)), lambda: train(parts, every)])
    return Model(network, cuts)


def score(docs: DataFrame, network: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of ``keep``) and ``score``; the network (a few MB, whatever the data) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(shared.value.score_texts(slab.column(1).to_pylist()))],
                                             names=["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def report(docs: DataFrame, labels: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.5 or more), flagged (the language's own threshold or more)."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")), rows)
    lang = F.coalesce(F.col("row.lang").cast("string"), F.lit(""))
    limit = F.lit(0.5)
    for name, cut in model.thresholds.items():
        limit = F.when(lang == name, cut).otherwise(limit)
    return score(docs, model.network, ["doc_id", "lang"]).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))
