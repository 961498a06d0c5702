"""Secrets in texts: known shapes, and strings that a battery of randomness tests tells from ordinary text.

One pass over the texts finds the known shapes and the candidates: runs of 16 or more characters of the base64 alphabets
with at least two kinds among lower-case letters, upper-case letters and digits. For each candidate the narrowest
alphabet that holds it is inferred (hexadecimal, base32, base36, base62, base64), and three statistics say whether it
may be uniform there: chi-squared of the symbol counts, runs above and below the middle of the alphabet, and the serial
correlation of neighbours. Whoever fails one is no random string.

The others are tested against ordinary text, the null hypothesis of the false-discovery control: there, kinds seldom
change from one character to the next and characters often repeat. The rates of both are fixed values of prose: rates
estimated over the candidates of the corpus would be set by its secrets and its longest runs, and hide them. The
evidence is the Chernoff bound of the number of changes and of coincident pairs, combined by Fisher's rule. Both bounds depend on the length, so a short string cannot be significant by chance, and the Benjamini-Hochberg
rule runs in each class of lengths over a histogram of the p-values: a bounded table, whatever the corpus.

Null texts are empty. A text without spans has empty lists.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slabs, stored, text_of

#: Kinds of spans in the order in which they are listed; the last is the method's own.
KINDS = ["assign", "access", "hex", "random"]
LEAST = 16
#: Share of false discoveries allowed, and the largest deviation (in standard deviations) of a uniform string.
FALSE_SHARE, DEVIATION = 0.001, 3.5
#: Rates of ordinary text, a little on the side of random strings: candidates in the test tables' prose have changes at
#: 0.062 to 0.064 of their places and coincidences in 0.067 to 0.078 of their pairs, base62 strings 0.62 and 0.016.
CHANGE_RATE, PAIR_RATE = 0.08, 0.06
LENGTH_CLASSES = [24, 32, 48, 96]
BINS = 4000  # of a hundredth of a decade of the p-value; what is beyond falls in the last

_NAMES = "password passwd secret token apikey api_key"
_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in _NAMES.split()[:4])
ASSIGN = re.compile(rf"""({_ANY_CASE}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HINTS = [w.encode() for w in _NAMES.split()]

LOWER, UPPER, DIGIT, SIGN = 1, 2, 4, 8
_KIND = np.zeros(128, np.uint8)
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
                      ("0123456789", DIGIT), ("+/-_", SIGN)):
    _KIND[[ord(c) for c in _chars]] = _kind
_HEX = np.zeros(128, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True

# The alphabets of the encodings, each in the order of its values.
ALPHABETS = [
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
]
_VALUES = np.full((len(ALPHABETS) + 1, 128), -1, np.int64)
for _i, _a in enumerate(ALPHABETS):
    _VALUES[_i, [ord(c) for c in _a]] = range(len(_a))
_VALUES[-1] = np.arange(128)  # of no single encoding
_SIZES = np.array([*map(len, ALPHABETS), 66])

SPAN = "struct<start:int,kind:int,stop:int>"
CANDIDATE = "struct<start:int,stop:int,pairs:double,changes:int,deviation:double>"
FOUND = f"base array<{SPAN}>, candidates array<{CANDIDATE}>"


def _runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of at least ``least`` places."""
    edges = np.flatnonzero(np.diff(member.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def battery(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of the candidates ``codes[start:end]``: kinds seen, coincident pairs, changes of kind, deviation."""
    sizes = ends - starts
    total, count = int(sizes.sum()), len(sizes)
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(count), sizes)
    chars = codes[np.arange(total) - np.repeat(first - starts, sizes)].astype(np.int64)
    kinds = _KIND[chars]
    seen = np.bitwise_or.reduceat(kinds, first)
    inner = np.ones(total, bool)
    inner[first] = False
    changes = np.bincount(of[1:][inner[1:] & (kinds[1:] != kinds[:-1])], minlength=count)
    coding = np.full(count, len(ALPHABETS))
    for i in range(len(ALPHABETS) - 1, -1, -1):
        coding[np.logical_and.reduceat(_VALUES[i][chars] >= 0, first)] = i
    keys, times = np.unique(of * 128 + chars, return_counts=True)
    pairs = np.bincount(keys // 128, times * (times - 1) / 2, count)
    squares = np.bincount(keys // 128, times.astype(float) ** 2, count)
    size, n = _SIZES[coding].astype(float), sizes.astype(float)
    uneven = (size / n * squares - n - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n)
    value = _VALUES[coding[of], chars].astype(float)
    high = value >= size[of] / 2
    above = np.bincount(of[high], minlength=count).astype(float)
    runs = 1 + np.bincount(of[1:][inner[1:] & (high[1:] != high[:-1])], minlength=count)
    both = 2 * above * (n - above)
    spread = np.sqrt(np.maximum(both * (both - n) / (n * n * (n - 1)), 1e-9))
    odd = np.where(both > 0, np.abs(runs - 1 - both / n) / np.maximum(spread, 0.1), np.sqrt(n))
    mean = np.bincount(of, value, count) / n
    off = value - mean[of]
    power = np.maximum(np.bincount(of, off * off, count), 1e-9)
    lagged = np.bincount(of[1:][inner[1:]], (off[1:] * off[:-1])[inner[1:]], count)
    serial = np.abs(lagged / power + 1 / n) * np.sqrt(n)
    return {"seen": seen, "pairs": pairs, "changes": changes, "deviation": np.maximum(uneven, np.maximum(odd, serial))}


def known_shapes(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """Spans (start, kind, stop) of the assignments and access keys of one text, in code points."""
    out = []
    small = data.lower()
    if any(h in small for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out


def scan(texts: list[bytes]) -> tuple[list[list[dict]], list[list[dict]]]:
    """Known spans and candidates of each text, in code points; candidates that touch a known span are left out."""
    words = [t.decode() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    firsts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    small = np.where(codes < 128, codes, 0)
    base: list[list[tuple]] = [known_shapes(w, t) for w, t in zip(words, texts)]
    for a, b in zip(*_runs(_HEX[small], 24)):
        i = int(np.searchsorted(firsts, a, side="right")) - 1
        base[i].append((int(a - firsts[i]), 2, int(b - firsts[i])))
    found: list[list[dict]] = [[] for _ in words]
    starts, ends = _runs(_KIND[small] > 0, LEAST)
    if len(starts):
        got = battery(small, starts, ends)
        mixed = np.flatnonzero(np.bitwise_count(got["seen"] & np.uint8(LOWER | UPPER | DIGIT)) >= 2)
        of = np.searchsorted(firsts, starts[mixed], side="right") - 1
        for i, k in zip(of.tolist(), mixed.tolist()):
            a, b = int(starts[k] - firsts[i]), int(ends[k] - firsts[i])
            if not any(x < b and a < y for x, _, y in base[i]):
                found[i].append({"start": a, "stop": b, "pairs": float(got["pairs"][k]),
                                 "changes": int(got["changes"][k]), "deviation": float(got["deviation"][k])})
    return [[{"start": a, "kind": k, "stop": b} for a, k, b in sorted(x)] for x in base], found


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``base`` spans and ``candidates`` of every row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(text_col).cast("binary").alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    tested = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("pairs", pa.float64()),
                                 ("changes", pa.int32()), ("deviation", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", 1 << 20):
            base, found = scan(slab.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(base, span), pa.array(found, tested)],
                                             names=["row", "base", "candidates"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {FOUND}")


def _bound(times: Column, expected: Column, upper: bool) -> Column:
    """Logarithm of the Chernoff bound of a Poisson tail at ``times``."""
    tail = times - expected - F.when(times > 0, times * F.ln(times / expected)).otherwise(0.0)
    return F.when(times > expected if upper else times < expected, tail).otherwise(0.0)


def _evidence(c: Column) -> Column:
    """-log10 of the p-value of one candidate under ordinary text; zero if it cannot be a uniform string."""
    n = (c["stop"] - c["start"]).cast("double")
    u = (_bound(c["changes"].cast("double"), (n - 1) * CHANGE_RATE, True)
         + _bound(c["pairs"], n * (n - 1) / 2 * PAIR_RATE, False))
    return F.when(c["deviation"] <= DEVIATION, -(u + F.ln(1 - u)) / math.log(10)).otherwise(0.0)


def _length_class(c: Column) -> Column:
    n = c["stop"] - c["start"]
    return sum(((n >= x).cast("int") for x in LENGTH_CLASSES), F.lit(0))


def thresholds(found: DataFrame) -> list[float]:
    """The least significant evidence of each class of lengths."""
    one = found.select(F.explode("candidates").alias("c"))
    strength = _evidence(F.col("c"))
    bins = (one.select(_length_class(F.col("c")).alias("k"),
                       F.least(F.floor(strength * 100), F.lit(BINS)).cast("int").alias("bin"))
            .groupBy("k", "bin").agg(F.count("*").alias("n")).collect())
    limits = [math.inf] * (len(LENGTH_CLASSES) + 1)
    for k in range(len(limits)):
        own = sorted(((r.bin, r.n) for r in bins if r.k == k), reverse=True)
        total, so_far = sum(x for _, x in own), 0
        for at, x in own:
            so_far += x
            if at > 0 and total * 10 ** (-at / 100) <= FALSE_SHARE * so_far:
                limits[k] = at / 100
    return limits


def find(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of ``keep``), ``base`` and ``spans``: sorted arrays of (start, kind, stop), kinds as in KINDS."""
    found = stored(candidates(docs, keep, text_col), "secret-candidates")
    least = F.lit([float(min(x, 1e9)) for x in thresholds(found)])

    def significant(c: Column) -> Column:
        return F.floor(_evidence(c) * 100) / 100 >= F.get(least, _length_class(c))

    added = F.transform(F.filter("candidates", significant),
                        lambda c: F.struct(c["start"], F.lit(KINDS.index("random")).alias("kind"), c["stop"]))
    return found.select("row", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.lit(KINDS)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kind(kind: int):
    return lambda span: span["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find(docs, ["doc_id"])
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("row.doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"),
                        written("spans").alias("spans"))


def redacted(text: Column, spans: str, mark: str = "[secret]") -> Column:
    """The text with every span replaced by a mark; overlapping spans share one."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        new = F.when(s["start"] >= acc["at"], F.concat(
            acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["done"])
        return F.struct(new.alias("done"), F.greatest(acc["at"], s["stop"]).alias("at"))

    end = F.aggregate(spans, start, cut, lambda acc: F.concat(
        acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)
