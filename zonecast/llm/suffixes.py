"""Benchmark decontamination by suffix arrays over the training documents.

Documents are cut into shards of a few megabytes. A shard's suffix array orders all its word positions by the words that
follow, made by doubling: positions equal in h words are ordered by the ranks of the positions h words further, until
they differ or are equal in as many words as the longest item has. All suffixes of all items are then searched in it at
once: an interval of the array holds the places of a prefix, and binary search narrows it word by word. Where it gets
empty the longest verbatim match ends; the interval at the window's length holds all places of the window.

A shard lives in one task and only results leave it, so nothing is shuffled and no passage, however common, gathers
anywhere. The items are the query set: they come in blocks of bounded size, each broadcast by itself.

Texts: null has no words. Rows are independent, so repeated rows give repeated results. A document beyond a shard is
worked through in pieces that overlap by the longest item, so memory is bounded by the text itself. An item without
an id goes by the empty string, items of one id count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slabs, stored, text_of

#: Words of a window; bytes of text in a shard, and of items that are searched at once.
WINDOW, SHARD, BLOCK = 10, 1 << 22, 1 << 24

_word = np.zeros(256, bool)
_word[ord("0") : ord("9") + 1] = _word[ord("a") : ord("z") + 1] = _word[0x80:] = True


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts in one string, start and end of every word in it, and the number of words of each text."""
    joined = b" " + b" ".join(texts).lower() + b" "
    own = _word[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(own[1:] != own[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
    return joined, starts, ends, np.diff(upto, prepend=0)


def numbered(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, equal ones for equal words, and the different words in the order of their numbers.

    Words are told apart by a hash, then compared with the first one of that hash byte by byte; a number that stands for
    different words (never seen) is dealt anew.
    """
    data, sizes = np.frombuffer(joined, np.uint8), ends - starts
    hashes = np.empty(len(starts), np.uint64)
    parts = _parts(sizes)
    with np.errstate(over="ignore"):
        weights = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, np.uint64(0x9E3779B97F4A7C15)))
        for a, b in parts:
            within, place = _places(starts[a:b], sizes[a:b])
            own = (data[place].astype(np.uint64) + np.uint64(1)) * weights[within]
            hashes[a:b] = np.add.reduceat(own, np.cumsum(sizes[a:b]) - sizes[a:b])
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    _, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    same = (sizes[at][number] == sizes).all()
    for a, b in parts if same else ():
        shift = np.repeat(starts[at][number[a:b]] - starts[a:b], sizes[a:b])
        place = _places(starts[a:b], sizes[a:b])[1]
        same &= (data[place] == data[place + shift]).all()
    if not same:
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(joined[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())])
        return number, list(known)
    return number, [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]


def _parts(sizes: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of words that make up about ``limit`` bytes."""
    upto, out, a = np.cumsum(sizes), [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit)))
        out.append((a, b))
        a = b
    return out


def _places(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of ranges: within their range, and overall."""
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return within, within + np.repeat(starts, sizes)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``words`` (numbers) ordered by the ``depth`` or more words that follow; the last one is unique."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    unsettled, key = np.arange(n), words[order]
    h = 1
    while True:
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        places = order[unsettled]
        rank[places] = unsettled[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        alone = head.copy()
        alone[:-1] &= head[1:]
        unsettled = unsettled[~alone]
        if h >= depth or not len(unsettled):
            return order
        places = order[unsettled]
        key = rank[places] * n + rank[places + h]  # equal so far, so the unique last word is still ahead of them
        inner = np.argsort(key, kind="stable")
        key, order[unsettled] = key[inner], places[inner]
        h *= 2


class Items:
    """A block of items, ready to be searched: their words as numbers, and their ids in string order."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int) -> None:
        self.ids = sorted({i for i, _ in rows})
        place = {x: n for n, x in enumerate(self.ids)}
        joined, starts, ends, counts = words_of([t for _, t in rows])
        self.words, self.known = numbered(joined, starts, ends)
        self.item = np.repeat(np.array([place[i] for i, _ in rows], np.int64), counts)
        firsts = np.repeat(np.cumsum(counts) - counts, counts)
        self.word = np.arange(len(firsts)) - firsts  # place within the item
        own = np.repeat(counts, counts)
        self.left = own - self.word  # words from here to the item's end
        self.need = np.minimum(own, window)  # words of this item's windows
        self.depth = int(counts.max(initial=0))


class Shard:
    """Words of some texts, each followed by a separator of its own, and their suffix array."""

    def __init__(self, texts: list[bytes], depth: int) -> None:
        joined, starts, ends, self.counts = words_of(texts)
        number, vocabulary = numbered(joined, starts, ends)
        self.place = {w: i + len(texts) for i, w in enumerate(vocabulary)}
        self.begins = np.concatenate([[0], np.cumsum(self.counts + 1)[:-1]])
        self.words = np.empty(len(number) + len(texts), np.int64)
        own = np.ones(len(self.words), bool)
        own[self.begins + self.counts] = False
        self.words[own] = number + len(texts)
        self.words[~own] = np.arange(len(texts))
        self.order = suffix_array(self.words, depth)

    def _narrowed(self, low: np.ndarray, high: np.ndarray, k: int, word: np.ndarray, right: bool) -> np.ndarray:
        """First place in each interval whose word k places on is not less than (with ``right``: greater than) ``word``."""
        a, b = low.copy(), high.copy()
        go = np.flatnonzero(a < b)
        while len(go):
            mid = (a[go] + b[go]) >> 1
            found = self.words[self.order[mid] + k]
            less = found <= word[go] if right else found < word[go]
            a[go[less]] = mid[less] + 1
            b[go[~less]] = mid[~less]
            go = go[a[go] < b[go]]
        return a

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every word of every item: the longest match from there on, its interval, and the one of its window.

        Intervals are pairs of places in the suffix array, (0, 0) if there is none.
        """
        at = np.array([self.place.get(w, -1) for w in items.known], np.int64)
        word = at[items.words] if len(at) else np.zeros(0, np.int64)
        first = self.words[self.order]
        low, high = np.searchsorted(first, word), np.searchsorted(first, word, side="right")
        length = np.zeros(len(word), np.int64)
        best, window = np.zeros((len(word), 2), np.int64), np.zeros((len(word), 2), np.int64)
        live = np.flatnonzero(low < high)
        low, high = low[live], high[live]
        k = 1
        while len(live):
            length[live], best[live, 0], best[live, 1] = k, low, high
            full = items.need[live] == k
            window[live[full], 0], window[live[full], 1] = low[full], high[full]
            go = items.left[live] > k
            live, low, high = live[go], low[go], high[go]
            next_ = word[live + k]
            low, high = (self._narrowed(low, high, k, next_, right) for right in (False, True))
            go = low < high
            live, low, high = live[go], low[go], high[go]
            k += 1
        return length, best, window

    def hits(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of hit words as (text, first, end), and the different pairs (text, item) that share a window."""
        _, _, window = self.search(items)
        met = np.flatnonzero(window[:, 1] > window[:, 0])
        if not len(met):
            return (np.zeros(0, np.int64),) * 5
        # A window that several items have is one interval; its places are gone through once.
        spans, which = np.unique(np.column_stack([window[met], items.need[met]]), axis=0, return_inverse=True)
        (low, high, size), which = spans.T, which.ravel()
        places = self.order[_places(low, high - low)[1]]
        owner = np.repeat(np.arange(len(low)), high - low)
        change = np.bincount(places, minlength=len(self.words) + 1)
        change -= np.bincount(places + size[owner], minlength=len(self.words) + 1)
        hit = np.zeros(len(self.words) + 2, bool)
        hit[1:] = np.cumsum(change) > 0
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        text = np.searchsorted(self.begins, edges[::2], side="right") - 1
        first, end = edges[::2] - self.begins[text], edges[1::2] - self.begins[text]
        texts = np.searchsorted(self.begins, places, side="right") - 1
        pairs = np.unique(owner * len(self.begins) + texts)
        owner, texts = pairs // len(self.begins), pairs % len(self.begins)
        own = np.unique(which * len(items.ids) + items.item[met])  # interval and item
        of, item = own // len(items.ids), own % len(items.ids)
        begin = np.searchsorted(of, owner)
        count = np.searchsorted(of, owner, side="right") - begin
        both = np.unique(np.repeat(texts, count) * len(items.ids) + item[_places(begin, count)[1]])
        return text, first, end, both // len(items.ids), both % len(items.ids)


def _pieces(text: bytes, overlap: int, limit: int) -> Iterator[tuple[int, bytes]]:
    """A long text in pieces of about ``limit`` bytes that begin ``overlap`` words before the end of the last one.

    Each comes with the number of words before it.
    """
    at, before = 0, 0
    while True:
        end = at + limit
        while end < len(text) and _word[text[end : end + 1].lower()[0]]:
            end += 1
        piece = text[at:end]
        yield before, piece
        if end >= len(text):
            return
        _, starts, _, counts = words_of([piece])
        again = min(overlap, int(counts[0]) - 1) if counts[0] else 0
        before += int(counts[0]) - again
        at = at + int(starts[len(starts) - again]) - 1 if again else end


def _searched(shared, shard: int):
    """Rows of documents with their number of words, the ids of the items met, and runs of hit words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for slab in slabs(batches, "text", shard):
            texts = slab.column("text").to_pylist()
            counts = np.zeros(len(texts), np.int64)
            runs: list[list[dict]] = [[] for _ in texts]
            met: list[set[int]] = [set() for _ in texts]
            long = len(texts) == 1 and len(texts[0] or b"") > 2 * shard
            for before, part in _pieces(texts[0], items.depth, shard) if long else [(0, None)]:
                held = Shard([part] if long else [t or b"" for t in texts], items.depth)
                counts = np.maximum(counts, before + held.counts)
                text, first, end, owner, item = held.hits(items)
                for t, a, b in zip(text.tolist(), (first + before).tolist(), (end + before).tolist()):
                    runs[t].append({"first": a, "end": b})
                for t, i in zip(owner.tolist(), item.tolist()):
                    met[t].add(i)
            yield pa.RecordBatch.from_arrays(
                [slab.column("doc_id"), slab.column("copy"), pa.array(counts),
                 pa.array([[items.ids[i] for i in sorted(m)] for m in met], pa.list_(pa.string())),
                 pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "copy", "n_words", "items", "runs"])

    return run


def _item_blocks(benchmark: DataFrame, block: int) -> tuple[DataFrame, int]:
    """The different items with a ``block`` number, and how many blocks of about ``block`` bytes there are."""
    rows = stored(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"),
                                   text_of().cast("binary").alias("text")).distinct(), "benchmark-items")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, -(-total // block))
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count))), count


def _each_block(docs: DataFrame, benchmark: DataFrame, window: int, block: int, task, shape: str) -> Iterator[DataFrame]:
    """``task(items)`` over all documents for one block of items after the other; only one is on the driver at a time."""
    rows = docs.select("doc_id", F.md5(F.col("text").cast("string")).alias("copy"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    dealt, count = _item_blocks(benchmark, block)
    for b in range(count):
        items = Items([(r.id, bytes(r.text)) for r in dealt.where(F.col("block") == b).collect()], window)
        shared = docs.sparkSession.sparkContext.broadcast(items)
        found = rows.mapInArrow(task(shared), shape)
        if count == 1:
            yield found
        else:
            yield stored(found, "block-of-items")
            shared.destroy()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD,
                  block: int = BLOCK) -> DataFrame:
    """A row for each document: ``doc_id``, ``n_words``, ``items`` (sorted ids of the items it shares a window with) and
    ``runs`` of hit words (first, end), which may overlap in long documents or if the items came in several blocks."""
    return _found(docs, benchmark, window, shard, block).drop("copy")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, shard: int, block: int) -> DataFrame:
    """``contamination`` with ``copy``, a digest of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, copy string, n_words long, items array<string>, runs array<struct<first:long,end:long>>"
    found = list(_each_block(docs, benchmark, window, block, lambda shared: _searched(shared, shard), shape))
    if len(found) == 1:
        return found[0]
    # Copies of a document have equal results in a block, so the first one stands for them until the end.
    one = [f.groupBy("doc_id", "copy").agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("n_words", "items", "runs")])
           for f in found]
    whole = reduce(DataFrame.union, one).groupBy("doc_id", "copy").agg(
        F.first("rows").alias("rows"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("runs")).alias("runs"))
    each = whole.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.drop("rows", "row")


def covered(runs: Column) -> Column:
    """Number of words in a set of runs that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(
        F.array_sort(runs), start,
        lambda a, r: F.struct((a.total + F.greatest(F.lit(0), r.end - F.greatest(r.first, a.reach))).alias("total"),
                              F.greatest(a.reach, r.end).alias("reach")), lambda a: a.total)


def _longest(shared, shard: int, least: int):
    """For each word of each item with a match of ``least`` words or more: its length, places, and the first of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for slab in slabs(batches, "text", shard):
            texts, ids = slab.column("text").to_pylist(), slab.column("doc_id").to_pylist()
            long = len(texts) == 1 and len(texts[0] or b"") > 2 * shard
            for before, part in _pieces(texts[0], items.depth, shard) if long else [(0, None)]:
                held = Shard([part] if long else [t or b"" for t in texts], items.depth)
                length, best, _ = held.search(items)
                out = []
                for w in np.flatnonzero(length >= least).tolist():
                    places = held.order[best[w, 0] : best[w, 1]]
                    owner = np.searchsorted(held.begins, places, side="right") - 1
                    known = [(ids[t], int(p - held.begins[t]) + before) for t, p in zip(owner.tolist(), places.tolist())]
                    first = min(known, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
                    out.append((items.ids[items.item[w]], int(items.word[w]), int(length[w]), *first))
                names = ["item_id", "item_word", "length", "doc_id", "doc_word"]
                kinds = [pa.string(), pa.int64(), pa.int64(), slab.schema.field("doc_id").type, pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, shard: int = SHARD,
                    block: int = BLOCK) -> DataFrame:
    """Longest verbatim matches: ``item_id``, ``item_word`` (where in the item), ``length`` in words, and the place with
    the smallest ``doc_id`` and ``doc_word`` at which it stands, for all places of items with ``least`` words or more.

    Several items of one id count as one; of their matches at one word the longest is told.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"item_id string, item_word long, length long, doc_id {kind}, doc_word long"
    found = reduce(DataFrame.union, _each_block(docs, benchmark, least, block, lambda s: _longest(s, shard, least), shape))
    best = F.min(F.struct((-F.col("length")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "doc_word"))
    return found.groupBy("item_id", "item_word").agg(best.alias("best")).select(
        "item_id", "item_word", (-F.col("best.less")).alias("length"), "best.doc_id", "best.doc_word")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those that share a window with an item; rows and columns as they are.

    A row goes by its own text: of rows of one id, or without an id, only those that share a window go.
    """
    bad = (_found(docs, benchmark, window, SHARD, BLOCK).where(F.size("items") > 0)
           .select(F.col("doc_id").alias("bad id"), F.col("copy").alias("bad copy")).distinct())
    same = docs["doc_id"].eqNullSafe(bad["bad id"]) & F.md5(docs["text"].cast("string")).eqNullSafe(bad["bad copy"])
    return docs.join(bad.hint("merge"), same, "left_anti")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row for each row of ``docs``."""
    hit = covered(F.col("runs"))
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


#: The same rows in DuckDB: windows as joined words, looked up among the windows of the items.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM dw CROSS JOIN (SELECT DISTINCT size FROM items) WHERE len(w) >= size)),
found AS (SELECT p.doc_id, p.i, p.size, t.item_id FROM places p JOIN items t ON p.size = t.size AND p.gram = t.gram),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
