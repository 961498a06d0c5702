"""Fill-in-the-middle: texts cut at two token boundaries and put together in another order, by memoised chunks.

A rolling hash over 16 bytes cuts texts where it ends in zeros, so equal passages fall into equal chunks wherever they
stand. A chunk's boundary summary (tokens that end inside it, whether it begins and ends with white space, characters,
places of the ends) is found once and kept in a cache that is addressed by the chunk's bytes, so no hash decides what is
equal. Summaries combine: a token ends at a chunk's last byte if the next one begins with white space. Running sums of
the counts give the tokens of a text, and a search in them the chunk and the place of a cut.

Tokens are words with the white space before them; white space at the end of a text is a token of its own.

Texts: null is empty, an empty text stays plain. Rows are independent, so repeated rows give repeated results; a null id
is written as nothing in the hash that decides on form and cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, slabs, text_of

# The marks, and of 100 documents those that are cut, and of 100 cut ones those with the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CUT, SUFFIX_FIRST, SEED = 50, 80, 42

#: Bytes of texts at once; window of the rolling hash, zeros that end a chunk (512 bytes on average), longest chunk.
SLAB, SPAN, ZEROS, LONGEST = 1 << 22, 16, 9, 1 << 13
#: Bytes of chunks in each of the two generations of a worker's cache.
CACHE = 1 << 25

_blank = np.zeros(256, bool)
_blank[[ord(c) for c in BLANKS]] = True
_gear = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def chunk_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts that lie one after the other and end at ``ends``; no chunk spans two texts.

    The first ``SPAN`` bytes of a text hold no cut, so its chunks depend on nothing before it. Chunks beyond ``LONGEST``
    bytes are cut in steps of it from their start.
    """
    found = []
    for at in range(0, len(data), 1 << 20):
        first = max(0, at - SPAN + 1)
        h = _gear[data[first : at + (1 << 20)]]
        for step in (1, 2, 4, 8):
            further = h.copy()
            further[step:] += h[:-step] << np.uint32(step)
            h = further
        found.append(np.flatnonzero(h[at - first :] >> np.uint32(32 - ZEROS) == 0) + at + 1)
    cuts = np.concatenate([*found, np.zeros(0, np.int64)])
    begins = np.concatenate([[0], ends[:-1]])
    text = np.searchsorted(ends, cuts, side="left")  # a cut at a text's end belongs to it
    cuts = cuts[cuts - begins[text] >= SPAN]
    cuts = np.unique(np.concatenate([cuts, ends[ends > begins]]))
    before = np.concatenate([[0], cuts[:-1]])
    extra = (cuts - before - 1) // LONGEST
    if extra.any():
        more = np.repeat(before, extra) + LONGEST * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
        cuts = np.sort(np.concatenate([cuts, more]))
    return cuts


def summaries(chunks: list[bytes]) -> list[tuple[int, int, bool, bool, bytes]]:
    """Of each chunk: ends of words inside, characters, blank first byte, blank last byte, places of the ends."""
    if not chunks:
        return []
    data = np.frombuffer(b"".join(chunks), np.uint8)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    blank = _blank[data]
    inner = ~blank
    inner[:-1] &= blank[1:]
    inner[ends - 1] = False  # the next chunk decides on these
    chars = np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int64), begins)
    at = np.flatnonzero(inner)
    upto = np.searchsorted(at, ends)
    counts = np.diff(upto, prepend=0)
    within = (at - np.repeat(begins, counts)).astype(np.uint16).tobytes()
    return [(n, c, f, e, within[2 * (u - n) : 2 * u]) for n, c, f, e, u in zip(
        counts.tolist(), chars.tolist(), blank[begins].tolist(), blank[ends - 1].tolist(), upto.tolist())]


class Cache:
    """Boundary summaries by the chunk itself, in two generations of bounded size."""

    def __init__(self, limit: int = CACHE) -> None:
        self.limit, self.size, self.young, self.old = limit, 0, {}, {}

    def all_of(self, chunks: list[bytes]) -> list[tuple]:
        if self.size > self.limit:
            self.young, self.old, self.size = {}, self.young, 0
        young, old = self.young, self.old
        missing = [c for c in dict.fromkeys(chunks) if c not in young]
        new = [c for c in missing if c not in old]
        young.update((c, old[c]) for c in missing if c in old)
        young.update(zip(new, summaries(new)))
        self.size += sum(map(len, missing))
        return [young[c] for c in chunks]


@lru_cache(1)
def _cache() -> Cache:
    """One for each worker process."""
    return Cache()


class Cuts:
    """Token counts of texts and the places of their cuts, from combined chunk summaries."""

    def __init__(self, texts: list[bytes], cache: Cache) -> None:
        self.data = b"".join(texts)
        self.codes = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.chunks = chunk_ends(self.codes, self.ends)
        self.firsts = np.concatenate([[0], self.chunks[:-1]]) if len(self.chunks) else self.chunks
        parts = cache.all_of([self.data[a:b] for a, b in zip(self.firsts.tolist(), self.chunks.tolist())])
        inner, chars, first, last, self.places = zip(*parts) if parts else ((),) * 5
        self.inner = np.array(inner, np.int64)
        first, last = np.array(first, bool), np.array(last, bool)
        closes = np.isin(self.chunks, self.ends)
        closes[:-1] |= first[1:]
        # Sums before each chunk; a text's chunks lie between those at its begin and at its end.
        self.tokens = np.concatenate([[0], np.cumsum(self.inner + (closes & ~last))])
        self.chars = np.concatenate([[0], np.cumsum(np.array(chars, np.int64))])
        self.low, self.high = (np.searchsorted(self.chunks, x, side="right") for x in (self.begins, self.ends))
        full = sizes > 0
        trailing = np.zeros(len(texts), bool)
        trailing[full] = last[self.high[full] - 1]
        self.words = self.tokens[self.high] - self.tokens[self.low]
        self.counts = self.words + trailing

    def place(self, text: int, units: int) -> tuple[int, int]:
        """Byte and character within the text after its first ``units`` tokens."""
        begin, low, high = int(self.begins[text]), int(self.low[text]), int(self.high[text])
        if units <= 0:
            return 0, 0
        if units > self.words[text]:
            return int(self.ends[text]) - begin, int(self.chars[high] - self.chars[low])
        c = int(np.searchsorted(self.tokens[low + 1 : high + 1], self.tokens[low] + units)) + low
        rank = int(self.tokens[low] + units - self.tokens[c])
        if rank > self.inner[c]:
            return int(self.chunks[c]) - begin, int(self.chars[c + 1] - self.chars[low])
        at = int(self.firsts[c])
        end = at + int.from_bytes(self.places[c][2 * rank - 2 : 2 * rank], "little") + 1
        part = self.codes[at:end]
        return end - begin, int(self.chars[c] - self.chars[low]) + int(np.count_nonzero((part & 0xC0) != 0x80))


def decided(key: str, text: bytes, n: int, seed: int, cut: int, suffix_first: int) -> tuple[str, int, int]:
    """Form of a document, and the tokens before and up to the end of its middle."""
    h = sha256(f"{seed}:{key}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    marked = b"<" in text and any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or h3 % 100 >= cut:
        return "plain", a, b
    return ("spm" if h4 % 100 < suffix_first else "psm"), a, b


def rebuilt(output: bytes, form: str) -> bytes:
    """The text of an output; its parts hold no mark and none arises where two parts meet."""
    if form == "plain":
        return output
    if form == "psm":
        s = output.index(SUFFIX)
        m = output.index(MIDDLE, s)
        return output[3:s] + output[m + 3 :] + output[s + 3 : m]
    p = output.index(PREFIX)
    m = output.index(MIDDLE, p)
    return output[p + 3 : m] + output[m + 3 :] + output[3:p]


def _cutting(seed: int, cut: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", SLAB):
            keys, texts = slab.column("key").to_pylist(), slab.column("text").to_pylist()
            cuts = Cuts(texts, _cache())
            forms, heads, middles, outputs = [], [], [], []
            for i, (key, text, n) in enumerate(zip(keys, texts, cuts.counts.tolist())):
                form, a, b = decided(key, text, n, seed, cut, suffix_first)
                forms.append(form)
                if form == "plain":
                    heads.append(None)
                    middles.append(None)
                    outputs.append(text)
                    continue
                (x, before), (y, upto) = cuts.place(i, a), cuts.place(i, b)
                heads.append(before)
                middles.append(upto - before)
                head, middle, tail = text[:x], text[x:y], text[y:]
                outputs.append(PREFIX + head + SUFFIX + tail + MIDDLE + middle if form == "psm" else
                               SUFFIX + tail + PREFIX + head + MIDDLE + middle)
            yield pa.RecordBatch.from_arrays(
                [slab.column(0), pa.array(cuts.counts), pa.array(forms, pa.string()), pa.array(heads, pa.int64()),
                 pa.array(middles, pa.int64()), pa.array(outputs, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _restoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else rebuilt(x, f) for x, f in
                 zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
        yield batch.append_column("restored", pa.array(texts, pa.binary()))


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
                       text_of().cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"


def transformed(docs: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id``, ``n`` tokens, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output`` (binary)."""
    rows, kinds = _rows(docs)
    return rows.mapInArrow(_cutting(seed, cut, suffix_first), kinds)


def restored(rows: DataFrame) -> DataFrame:
    """Rows of ``transformed`` with ``restored``: the text (binary) rebuilt from ``output`` and ``form`` alone."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_restoring, f"{kinds}, restored binary")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; a row for each row.

    Texts are cut and rebuilt in one worker.
    """
    rows, kinds = _rows(docs)
    cutting = _cutting(SEED, CUT, SUFFIX_FIRST)
    return rows.mapInArrow(lambda batches: _restoring(cutting(batches)), f"{kinds}, restored binary").select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The same rows in DuckDB: tokens by a regular expression, the parts as list slices.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
         sha256('42:' || doc_id) AS h FROM documents),
g AS (
  SELECT doc_id, text, t, len(t) AS n,
         list_transform([0, 1, 2, 3], lambda i: list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda j:
           (strpos('0123456789abcdef', substr(h, 8 * i + j, 1)) - 1)::BIGINT)), lambda a, x: 16 * a + x)) AS q FROM d),
f AS (
  SELECT doc_id, text, t, n, least(q[1] % (n + 1), q[2] % (n + 1)) AS a, greatest(q[1] % (n + 1), q[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR q[3] % 100 >= 50
              THEN 'plain' WHEN q[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(t[1:a], ''), '') AS pre,
         coalesce(array_to_string(t[a + 1:b], ''), '') AS mid, coalesce(array_to_string(t[b + 1:n], ''), '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
