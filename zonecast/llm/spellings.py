"""Spelling variants: words that one edit turns into each other, grouped under their most frequent form.

Letters are hashed to a few symbols. The reduced words are far fewer than the words, and an edit of a word is an edit of
its reduced word or leaves it as it is. So each different reduced word emits its full neighbourhood (itself, and every
string that one deleted, replaced or inserted symbol makes of it) as hashes, these are joined to the hashes of the
reduced vocabulary, the words behind both are joined back, and a pair counts if one edit parts the words themselves.

The number of symbols follows the vocabulary (``symbols_for``), so the words behind a reduced word stay few at any size;
it changes costs only. Equal hashes of different reduced words add candidates that the words then refuse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slabs, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Of the runs of letters in a text, one in ``SLIP`` (by a hash) loses a letter.
SLIP, SHORTEST, LEAST = 97, 5, 3
#: Variants of a slab of reduced words are made at once: its bytes.
SLAB = 1 << 17
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def words(docs: DataFrame, slip: int = SLIP, shortest: int = SHORTEST) -> DataFrame:
    """``word`` of every run of letters with at least ``shortest`` ones, after the slips; a row per occurrence.

    Null texts have no words; a null id is written as nothing in the hash that decides on slips.
    """
    lower = F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())
    run = F.regexp_extract_all(lower, F.lit("[a-zÀ-ÿ]{%d,}" % shortest), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % slip == 0, slipped).otherwise(F.col("run")) if slip else F.col("run")
    return runs.select(word.alias("word")).where(F.length("word") >= shortest)


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``word``, ``n``: the different words of ``words`` with at least ``least`` occurrences."""
    return words(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def symbols_for(count: int) -> int:
    """Symbols of which eight letters make about twice as many reduced words as there are words; six at least."""
    return max(6, int(np.ceil((2 * max(count, 1)) ** 0.125)))


def reduce(word: str, symbols: int) -> np.ndarray:
    """Symbols of the letters of a word, from 1."""
    return np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(_MIX)
    return keys ^ (keys >> np.uint64(29))


def keys_of(grid: np.ndarray) -> np.ndarray:
    """Hashes of reduced words of one length, a row each: polynomials modulo 2**64."""
    return _mixed((grid * _powers(grid.shape[1])[:-1][::-1]).sum(1, dtype=np.uint64))


def neighbourhoods(grid: np.ndarray, symbols: int) -> np.ndarray:
    """Hashes of the full one-edit neighbourhood of each row, itself first; a variant made twice is there twice."""
    count, n = grid.shape
    power = _powers(n + 1)
    head = np.zeros((count, n + 1), np.uint64)  # hash of the first i symbols
    for i in range(n):
        head[:, i + 1] = head[:, i] * power[1] + grid[:, i]
    tail = head[:, n:] - head * power[n::-1][: n + 1]  # hash of the symbols from i on
    own = head[:, n:]
    parts = [own, head[:, :n] * power[n - 1 :: -1][:n] + tail[:, 1:]]
    for s in range(1, symbols + 1):
        parts.append(own + (np.uint64(s) - grid) * power[n - 1 :: -1][:n])
        parts.append(head * power[n + 1 : 0 : -1] + np.uint64(s) * power[n::-1] + tail)
    return _mixed(np.concatenate(parts, 1))


def _grids(batch: pa.RecordBatch, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and symbols of the words of each length."""
    codes = [reduce(w, symbols) for w in batch.column("word").to_pylist()]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, np.stack([codes[i] for i in at.tolist()])


def reduced(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """``word``, ``n`` and ``key``, the hash of the reduced word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "word", SLAB):
            keys = np.zeros(slab.num_rows, np.uint64)
            with np.errstate(over="ignore"):
                for at, grid in _grids(slab, symbols):
                    keys[at] = keys_of(grid)
            yield slab.append_column("key", pa.array(keys.view(np.int64)))

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, key long")


def variants(keyed: DataFrame, symbols: int) -> DataFrame:
    """``key`` of each different reduced word and the ``variant`` hashes of its neighbourhood, each once."""
    one = keyed.groupBy("key").agg(F.first("word").alias("word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "word", SLAB):
            with np.errstate(over="ignore"):
                for _, grid in _grids(slab, symbols):
                    for at in range(0, len(grid), 1 << 12):
                        around = neighbourhoods(grid[at : at + (1 << 12)], symbols)
                        own = around[:, :1].copy()
                        around.sort(1)
                        new = np.ones(around.shape, bool)
                        new[:, 1:] = around[:, 1:] != around[:, :-1]
                        keys = np.broadcast_to(own, around.shape)[new]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.view(np.int64)), pa.array(around[new].view(np.int64))], names=["key", "variant"])

    return one.select("key", "word").mapInArrow(run, "key long, variant long")


def one_edit(a: str, b: str) -> Column:
    """Exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def near_words(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """``word``, ``near`` and ``near_n`` for all pairs of words that one edit parts, in both directions."""
    keyed = stored(reduced(vocabulary, symbols), "reduced-words")
    # Every row becomes a hundred, so Spark is told not to broadcast what looks small.
    around = variants(keyed, symbols).hint("merge")
    targets = keyed.select(F.col("key").alias("variant"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = stored(around.join(targets, "variant").select("key", "near", "near_n"), "met-words")
    pairs = keyed.select("key", "word").hint("merge").join(met, "key")
    return pairs.where(one_edit("word", "near")).select("word", "near", "near_n")


def forms(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``: the near word of most occurrences, if they are ``ratio`` times
    its own; of equals the smallest in code point order. A form makes the word's chain one longer, so chains end."""
    vocabulary = stored(vocabulary, "vocabulary")
    near = near_words(vocabulary, symbols_for(vocabulary.count()))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = vocabulary.hint("merge").join(best, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                         F.when(formed, F.col("best.near")).alias("form"),
                         F.when(formed, -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``formed`` with ``root``: the last word that forms lead to from a word, itself if it has none.

    Each round doubles the steps that are known of every chain; a chain is no longer than the logarithm of the largest
    count, as counts double from form to form.
    """
    formed = stored(formed, "forms")
    up = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    open_ = True
    while open_:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stored(up.join(further.hint("merge"), "root", "left")
                    .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        open_ = not up.where("moved").isEmpty()
        up = up.select("word", "root")
    return formed.hint("merge").join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary of ``docs``.

    An empty table, and one without a word that is frequent enough, gives no rows; columns other than ``doc_id`` and
    ``text`` are ignored; repeated rows count again.
    """
    return roots(forms(vocabulary(docs))).select("word", "form", "root", "n", "n_near", "form_n")
