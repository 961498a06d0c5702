"""Byte-level BPE without regex: boundaries from a scan over transition functions, pieces merged through a cache.

A text is an array of code points. Every code point has a class, and a bounded look at its right neighbours turns the
class into a symbol, so the pre-tokeniser becomes a small automaton that only looks left. Each symbol is a function
from states to states; these functions and their products form a finite set, so the composition of two is one table
look-up. Composition is associative: blocks are reduced side by side, block products are scanned, and the states inside
all blocks follow side by side. No step depends on how long a text or a piece is.

Texts: null counts as empty; empty texts give no ids. Rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slabs, text_of

#: Characters per numpy pass, and pieces a worker keeps in each of its two cache generations.
SLAB, CACHE = 1 << 19, 100_000

# The code points of Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

OTHER, LETTER, NUMBER, SPACE_LAST, WHITE_LAST, WHITE, SHORT, LONG, END = range(9)  # symbols
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, SPACED, ONE_MORE, TWO_MORE = range(8)  # states


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether the character starts a piece.

    SPACE_LAST / WHITE_LAST: the last white space before something else; WHITE: any other white space.
    SHORT / LONG: an apostrophe that one / two letters complete to a contraction. END: between two texts.
    """
    if symbol == END:
        return FRESH, True
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    if symbol == SPACE_LAST:
        return SPACED, True
    if symbol == WHITE_LAST:
        return FRESH, True
    if symbol == WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol in (SHORT, LONG) and state not in (IN_OTHER, SPACED):
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(symbol, IN_OTHER)
    return run, state not in (run, SPACED)


class Automaton:
    """Tables of the automaton: steps, piece starts, and the closed set of transition functions."""

    def __init__(self) -> None:
        states, symbols = range(8), range(9)
        self.next = np.array([[_step(s, c)[0] for c in symbols] for s in states], np.uint8)
        self.starts = np.array([[_step(s, c)[1] for c in symbols] for s in states], bool)
        known = {tuple(states): 0}
        for c in symbols:
            known.setdefault(tuple(int(x) for x in self.next[:, c]), len(known))
        grown = True
        while grown:
            grown = False
            for f in list(known):
                for c in symbols:
                    if (both := tuple(int(self.next[x, c]) for x in f)) not in known:
                        known[both] = len(known)
                        grown = True
        functions = list(known)
        self.size = len(functions)
        self.of_symbol = np.array([known[tuple(int(x) for x in self.next[:, c])] for c in symbols], np.uint16)
        # Products of products stay in the set, as it holds every word over the symbols.
        self.product = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)
        self.from_fresh = np.array([f[FRESH] for f in functions], np.uint8)

    def _prefix(self, f: np.ndarray) -> np.ndarray:
        """Products of all functions before each place."""
        n = len(f)
        if n <= 32:
            out, acc = np.zeros(n, np.uint16), 0
            for i in range(n):
                out[i] = acc
                acc = self.product[acc, f[i]]
            return out
        width = max(8, int(n**0.5))
        blocks = -(-n // width)
        grid = np.zeros(blocks * width, np.uint16)
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
        flat, size = self.product.ravel(), np.uint32(self.size)
        out, acc = np.zeros_like(grid), np.zeros(blocks, np.uint16)
        for t in range(width):
            out[t] = acc
            acc = flat[acc * size + grid[t]]
        head = self._prefix(acc)
        return flat[head[None, :] * size + out].T.ravel()[:n]

    def piece_starts(self, symbols: np.ndarray, width: int = 512) -> np.ndarray:
        """Whether each symbol starts a piece; the scan begins in the fresh state."""
        n = len(symbols)
        blocks = -(-n // width)
        grid = np.full(blocks * width, END, np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
        flat, size = self.product.ravel(), np.uint32(self.size)
        acc = np.zeros(blocks, np.uint16)
        for t in range(width):
            acc = flat[acc * size + self.of_symbol[grid[t]]]
        state = self.from_fresh[self._prefix(acc)]
        steps, starts, nine = self.next.ravel(), self.starts.ravel(), np.uint8(9)
        out = np.empty((width, blocks), bool)
        for t in range(width):
            at = state * nine + grid[t]
            out[t] = starts[at]
            state = steps[at]
        return out.T.ravel()[:n]


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


@lru_cache(1)
def code_classes() -> np.ndarray:
    """Symbol of each code point before its neighbours are seen; one place more stands between texts."""
    out = np.full(0x110001, OTHER, np.uint8)
    names = "".join(map(unicodedata.category, map(chr, range(0x110000))))  # two letters each
    major = np.frombuffer(names.encode(), np.uint8)[::2]
    out[:0x110000][major == ord("L")] = LETTER
    out[:0x110000][major == ord("N")] = NUMBER
    out[WHITE_SPACE] = WHITE_LAST
    out[32], out[0x110000] = SPACE_LAST, END
    return out


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Places where pieces start; 0x110000 separates texts and counts as a piece of its own."""
    symbols = code_classes()[codes]
    white = (symbols == SPACE_LAST) | (symbols == WHITE_LAST)
    follows = np.ones(len(codes), bool)
    follows[:-1] = white[1:] | (symbols[1:] == END)
    symbols[white & follows] = WHITE
    marks = np.flatnonzero(codes == 39)
    if len(marks):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        symbols[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = one.astype(np.int64) * 0x200000 + two
        symbols[marks[np.isin(pairs, [ord(a) * 0x200000 + ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    return np.flatnonzero(automaton().piece_starts(symbols))


def piece_table(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, the start and size of every piece in them, and how many pieces each text has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1  # the separator after each text
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    widths = np.ones(len(codes), np.uint8)
    for least in (0x80, 0x800, 0x10000):
        widths += codes >= least
    codes[ends] = 0x110000
    starts = boundaries(codes)
    joined = joined.encode()
    places = (np.cumsum(widths, dtype=np.int64) - widths)[starts]
    upto = np.searchsorted(starts, ends)  # separators are pieces of their own
    own = np.ones(len(starts), bool)
    own[upto] = False
    counts = np.diff(np.concatenate([[-1], upto])) - 1
    return joined, places[own], np.diff(np.append(places, len(joined)))[own], counts


_weights = np.ones(1, np.uint64)


def _weights_of(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64."""
    global _weights
    if len(_weights) < n:
        _weights = np.cumprod(np.full(1 << int(n).bit_length(), np.uint64(0x9E3779B97F4A7C15)))
    return _weights


def distinct(joined: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different piece, and for every piece which of those it equals.

    Pieces are grouped by a hash and then compared byte by byte, so equal hashes of different pieces do no harm.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(joined, np.uint8)
    first = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    place = within + np.repeat(starts, sizes)
    own = data[place]
    with np.errstate(over="ignore"):
        weights = _weights_of(int(sizes.max()))
        hashes = np.add.reduceat((own.astype(np.uint64) + np.uint64(1)) * weights[within], first)
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    at, inverse = np.unique(hashes, return_index=True, return_inverse=True)[1:]
    same = sizes[at][inverse] == sizes
    if same.all():
        same = (data[within + np.repeat(starts[at][inverse], sizes)] == own).all()
    if not np.all(same):
        known: dict[bytes, int] = {}
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist())]
        inverse = np.array([known.setdefault(p, len(known)) for p in pieces])
        at = np.zeros(len(known), np.int64)
        at[inverse[::-1]] = np.arange(len(pieces))[::-1]
    return at, inverse


def encoded(texts: list[str], cache: Cache, kind: str) -> list[np.ndarray]:
    """Ids of each text, from the cache's packed ids (of numpy type ``kind``) of the different pieces among them all."""
    if not texts:
        return []
    joined, starts, sizes, counts = piece_table(texts)
    at, inverse = distinct(joined, starts, sizes)
    packed = cache.all_of([joined[a:b] for a, b in zip(starts[at].tolist(), (starts + sizes)[at].tolist())])
    lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(kind).itemsize
    pool, begins, own = np.frombuffer(b"".join(packed), kind), np.cumsum(lengths) - lengths, lengths[inverse]
    before = np.cumsum(own) - own
    ids = pool[np.repeat(begins[inverse] - before, own) + np.arange(int(own.sum()))]
    upto = np.concatenate([[0], np.cumsum(own)])[np.cumsum(counts)]
    return np.split(ids, upto[:-1])


class Cache:
    """Values by piece in two generations of bounded size; ``fresh`` computes those of a list of new, different pieces."""

    def __init__(self, fresh, limit: int = CACHE) -> None:
        self.fresh, self.limit, self.young, self.old = fresh, limit, {}, {}

    def all_of(self, pieces: list[bytes]) -> list[bytes]:
        """Values of different pieces."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        out = list(map(self.young.get, pieces))
        gaps = [i for i, v in enumerate(out) if v is None]
        asked = [pieces[i] for i in gaps]
        found = list(map(self.old.get, asked))
        new = iter(self.fresh([p for p, v in zip(asked, found) if v is None]))
        found = [next(new) if v is None else v for v in found]
        for i, value in zip(gaps, found):
            out[i] = value
        self.young.update((p, v) for p, v in zip(asked, found) if len(p) <= 64)  # longer ones are not kept
        return out


class Vocabulary:
    """Ranks of byte sequences, pair merging, and the bytes of every id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        width = max(ranks.values(), default=-1) + 1
        by_id = [b""] * width
        for k, v in ranks.items():
            by_id[v] = k
        self.lengths = np.fromiter(map(len, by_id), np.int64, width)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.cache = Cache(self.merge_all)
        pairs = np.fromiter(self._pairs(), [("key", np.int64), ("rank", np.int32)])
        pairs.sort(order="key")
        self.pair_keys, self.pair_ranks = pairs["key"].copy(), pairs["rank"].copy()
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def _pairs(self) -> Iterator[tuple[int, int]]:
        """Every split of a byte sequence into two known ones, as one number, with the rank of the whole."""
        find, width = self.ranks.get, len(self.lengths)
        for whole, rank in self.ranks.items():
            for i in range(1, len(whole)):
                left, right = find(whole[:i]), find(whole[i:])
                if left is not None and right is not None:
                    yield left * width + right, rank

    @staticmethod
    def parse(data: bytes) -> Vocabulary:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)})

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined bytes of two ids, or the number of ids if they have none."""
        none = len(self.lengths)
        keys = left.astype(np.int64) * none + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], none) if len(self.pair_keys) else at + none

    def _merge_grid(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Join the pair of least rank, the left one of equals, in every piece at once until none has one left."""
        none, count = len(self.lengths), len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, count)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        ids, cols = self.of_byte[data], np.arange(width)
        order = np.full((count, width), none, np.int32)
        order[:, :-1] = self._pair(ids[:, :-1], ids[:, 1:])
        order[cols[None, :] >= sizes[:, None] - 1] = none
        done: list[bytes] = [b""] * count
        live = np.arange(count)
        while len(live):
            at = order.argmin(1)
            row = np.arange(len(live))
            least = order[row, at]
            ended = least == none
            if ended.any():
                packed = ids.astype("<u4")
                for i in np.flatnonzero(ended).tolist():
                    done[live[i]] = packed[i, : sizes[i]].tobytes()
                go = ~ended
                live, ids, order, sizes, at, least = live[go], ids[go], order[go], sizes[go], at[go], least[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            ids[row, at] = least
            shift = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, 1)
            order = np.take_along_axis(order, np.minimum(shift + (cols[None, :] == at[:, None]), width - 1), 1)
            sizes = sizes - 1
            order[cols[None, :] >= sizes[:, None] - 1] = none
            some = np.flatnonzero(at < sizes - 1)
            order[some, at[some]] = self._pair(ids[some, at[some]], ids[some, at[some] + 1])
            some = np.flatnonzero(at > 0)
            order[some, at[some] - 1] = self._pair(ids[some, at[some] - 1], ids[some, at[some]])
        return done

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {8: [], 12: [], 16: [], 24: [], 48: []}
        for p in pieces:
            if (whole := self.ranks.get(p)) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) > 48:
                out[p] = np.array(self._merge_long(p), "<u4").tobytes()
            else:
                by_width[next(w for w in by_width if len(p) <= w)].append(p)
        for width, group in by_width.items():
            if group:
                out.update(zip(group, self._merge_grid(group, width)))
        return [out[p] for p in pieces]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same order of joins by a heap over a linked list, for pieces of any length."""
        n, find = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := find(piece[i : i + 2])) is not None]
        heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := find(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := find(piece[k:stop])) is not None:
                heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [x.tobytes() for x in encoded(texts, self.cache, "<u4")]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each id's bytes start in the decoded text."""
        sizes = self.lengths[ids]
        return np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of the ids: every byte finds its id by the offsets and its source in the vocabulary."""
        if not len(ids):
            return b""
        return self.blob[np.repeat(self.begins[ids] - offsets, self.lengths[ids])
                         + np.arange(offsets[-1] + self.lengths[ids[-1]])].tobytes()


_READY: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The parsed vocabulary of this worker process."""
    if (key := hash(shared.value)) not in _READY:
        _READY.clear()
        _READY[key] = Vocabulary.parse(shared.value)
    return _READY[key]


def _encoding(shared, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(shared)
        for slab in slabs(batches, "text", SLAB):
            ids = words.encode(slab.column(1).to_pylist())
            at = [words.offsets(np.frombuffer(x, "<u4")).astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(ids, pa.binary()), pa.array(at, pa.binary())],
                                             names=[id_col, "ids", "offsets"])
        pa.default_memory_pool().release_unused()  # the worker process lives on

    return run


def _decoding(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(shared)
        for slab in slabs(batches, "ids", 2 * SLAB):
            ids, at = ([x or b"" for x in slab.column(c).to_pylist()] for c in ("ids", "offsets"))
            text = [words.decode(np.frombuffer(x, "<u4"), np.frombuffer(o, "<u4").astype(np.int64))
                    for x, o in zip(ids, at)]
            yield pa.RecordBatch.from_arrays([*[slab.column(c) for c in keep], pa.array(text, pa.binary())],
                                             names=[*keep, "decoded"])

    return run


def _shared(spark: SparkSession, vocabulary: str):
    """The rank file (about 1 MB) as a broadcast."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    return rows, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}"


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts: ``id_col``, ``ids`` and ``offsets`` (little-endian unsigned 32-bit integers in a binary).

    ``vocabulary`` is the path of a rank file on the driver. ``offsets`` has the byte at which each id starts in the
    text's UTF-8 bytes. Other columns of ``docs`` are ignored; null texts are empty.
    """
    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(_encoding(_shared(docs.sparkSession, vocabulary), id_col), f"{kind}, ids binary, offsets binary")


def decode(coded: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """Bytes of encoded rows: the columns ``keep`` and ``decoded`` (binary); null ids decode to no bytes."""
    rows = coded.select(*dict.fromkeys([*keep, "ids", "offsets"]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_decoding(_shared(coded.sparkSession, vocabulary), keep), kinds + ", decoded binary")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, decode, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256. Both steps run in one worker."""
    rows, kind = _rows(docs, "doc_id", "text")
    shared = _shared(docs.sparkSession, vocabulary)
    there, back = _encoding(shared, "doc_id"), _decoding(shared, ["doc_id", "ids"])
    return rows.mapInArrow(lambda batches: back(there(batches)), f"{kind}, ids binary, decoded binary").select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
