"""Token ids in length-delimited binary records with masked checksums, and an offset index for shuffled reads.

Fixed format of a shard file, numbers little-endian:

    header   4 bytes "TKR1", 4 bytes width of an id (2 or 4)
    record   8 bytes length of the payload, 4 bytes masked CRC-32C of those 8 bytes,
             the payload, 4 bytes masked CRC-32C of the payload
    payload  1 byte (1: has a document id, 0: null), 8 bytes document id, 8 bytes ids before it in the shard, the ids

A checksum c is masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32, so that checksums of data that holds checksums
stay sound. Documents are dealt to shards by ranges of their id, so shards in order of their first id hold ascending
ids. A task writes a file whose name no other attempt uses, and its index rows only count if the attempt does: a lost
executor leaves an unlisted file at most.

Texts: null is empty. Rows with the same id keep the order of their texts; a null id comes first.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Cache, encoded
from .common import shared_path, slabs, stored, text_of

MAGIC, HEAD, FRAME = b"TKR1", 17, 12
#: Rows of a shard, and bytes of a checksum lane.
SHARD_ROWS, LANE = 8_000, 256
#: Characters encoded at once, and pieces in each of the two generations of a worker's cache.
SLAB, CACHE = 1 << 20, 250_000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Look-ups of eight bytes at once, and those that move a checksum over a lane of zeros."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0x82F63B78), first >> 1)  # the reflected polynomial
    tables = [first]
    for _ in range(7):
        tables.append(first[tables[-1] & 255] ^ (tables[-1] >> 8))
    tables = np.stack(tables)
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(LANE):
        unit = first[unit & 255] ^ (unit >> 8)
    moved = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            moved[byte] ^= np.where(np.arange(256) >> bit & 1, unit[8 * byte + bit], 0).astype(np.uint32)
    return tables, moved


def _lanes(words: np.ndarray) -> np.ndarray:
    """Checksum, from zero, of each row of 64-bit words."""
    tables, _ = _tables()
    crc = np.zeros(len(words), np.uint64)
    for t in range(words.shape[1]):
        mixed = words[:, t] ^ crc
        out = tables[7][mixed & np.uint64(255)]
        for i in range(1, 8):
            out = out ^ tables[7 - i][(mixed >> np.uint64(8 * i)) & np.uint64(255)]
        crc = out.astype(np.uint64)
    return crc.astype(np.uint32)


def checksums(payloads: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each payload of at least four bytes: lanes side by side, then the lanes of each in order."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    counts = -(-sizes // LANE)
    ends = np.cumsum(counts)
    data = np.zeros(int(counts.sum()) * LANE, np.uint8)  # leading zeros don't change a checksum that starts at zero
    for payload, end, size in zip(payloads, (ends * LANE).tolist(), sizes.tolist()):
        data[end - size : end] = np.frombuffer(payload, np.uint8)
    starts = ends * LANE - sizes
    for k in range(4):  # the initial value of all ones
        data[starts + k] ^= 255
    lanes = _lanes(data.view("<u8").reshape(-1, LANE // 8))
    _, moved = _tables()
    firsts, crc = ends - counts, np.zeros(len(payloads), np.uint32)
    order = np.argsort(-counts, kind="stable")
    for j in range(int(counts.max(initial=0))):
        order = order[counts[order] > j]
        c = crc[order]
        c = moved[0][c & 255] ^ moved[1][c >> 8 & 255] ^ moved[2][c >> 16 & 255] ^ moved[3][c >> 24]
        crc[order] = c ^ lanes[firsts[order] + j]
    return masked(~crc)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def length_checksums(sizes: np.ndarray) -> np.ndarray:
    words = sizes.astype("<u8") ^ np.uint64(0xFFFFFFFF)
    return masked(~_lanes(words.reshape(-1, 1)))


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path within it of a URI that all executors reach."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)


class Encoder:
    """Ids by the tokenizers library, asked once for each new piece of text while its cache lasts."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it has
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.added = [a.content for a in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        # A character of a byte-level token stands for one byte.
        names = self.library.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(names.values(), default=0) + 1, np.int64)
        self.lengths[list(names.values())] = [len(x) for x in names]
        self.cache = Cache(self._ask, CACHE)

    def _ask(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of new pieces: those with more than white space in one text, the others one by one.

        Most pieces start with a space, which parts them from the one before; any other one is put on a line of its own.
        A line feed never joins what follows or precedes it, so the library finds the same pieces again.
        """
        out: list[bytes] = [b""] * len(pieces)
        blank = [i for i, p in enumerate(pieces) if (p[0] <= 32 or p[0] > 127) and p.decode().isspace()]
        for i, x in zip(blank, self._ids([pieces[i].decode() for i in blank])):
            out[i] = x.astype(f"<u{self.width}").tobytes()
        alone = set(blank)
        lines = [i for i in range(len(pieces)) if i not in alone]
        if lines:
            # A space that starts a piece is followed by something else, unless the piece is white space.
            parts = [pieces[i] if pieces[i][0] == 32 else b"\n" + pieces[i] + b"\n" for i in lines]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            upto = np.cumsum(sizes)
            own = np.fromiter((pieces[i][0] != 32 for i in lines), np.int64, len(lines))
            ids = self._ids([b"".join(parts).decode()])[0]
            ends = np.cumsum(self.lengths[ids])
            first = np.searchsorted(ends, upto - sizes + own, side="right")
            last = np.searchsorted(ends, upto - own, side="left") + 1
            packed, w = ids.astype(f"<u{self.width}").tobytes(), self.width
            for i, a, b in zip(lines, (first * w).tolist(), (last * w).tolist()):
                out[i] = packed[a:b]
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int64) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Packed ids of each text. One that holds the string of an added token goes to the library as a whole."""
        end, kind = end_id.to_bytes(self.width, "little"), f"<u{self.width}"
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        plain = texts
        if whole:
            plain = list(texts)
            for i in whole:
                plain[i] = ""
        out = [x.tobytes() + end for x in encoded(plain, self.cache, kind)]
        for i, x in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = x.astype(kind).tobytes() + end
        return out


_READY: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    if (key := hash(shared.value)) not in _READY:
        _READY.clear()
        _READY[key] = Encoder(shared.value)
    return _READY[key]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Encode ``doc_id``, ``text`` and write shards below ``folder`` (a shared one); returns the stored offset index.

    ``tokenizer`` is the path of a definition on the driver (a few MB), which must split texts by the byte-level pattern
    of ``bpe``, as its pieces are encoded one by one. Index: doc_id, path, offset (of the record), size (of its payload),
    n_tokens.
    """
    with open(tokenizer) as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    shards = max(1, -(-docs.count() // shard_rows))
    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, files, base = _encoder(shared), *opened(folder)
        files.create_dir(base, recursive=True)
        name, out, at, before = f"{uuid.uuid4().hex}.tokens", None, 8, 0
        try:
            for slab in slabs(batches, "text", SLAB):
                if out is None:
                    out = files.open_output_stream(f"{base}/{name}")
                    out.write(MAGIC + coder.width.to_bytes(4, "little"))
                ids = coder.encode(slab.column(1).to_pylist(), end_id)
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // coder.width
                firsts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                payloads = [bytes([d is not None]) + (d or 0).to_bytes(8, "little", signed=True) + b.to_bytes(8, "little") + x
                            for d, b, x in zip(slab.column(0).to_pylist(), firsts.tolist(), ids)]
                sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
                for size, a, payload, c in zip(sizes.tolist(), length_checksums(sizes).tolist(), payloads,
                                               checksums(payloads).tolist()):
                    out.write(size.to_bytes(8, "little") + a.to_bytes(4, "little") + payload + c.to_bytes(4, "little"))
                ends = at + np.cumsum(sizes + FRAME + 4)
                yield pa.RecordBatch.from_arrays(
                    [slab.column(0), pa.array([f"{folder}/{name}"] * len(ids)), pa.array(ends - sizes - FRAME - 4),
                     pa.array(sizes), pa.array(counts)], names=["doc_id", "path", "offset", "size", "n_tokens"])
                at = int(ends[-1])
        finally:
            if out is not None:
                out.close()

    return stored(dealt.mapInArrow(run, "doc_id long, path string, offset long, size long, n_tokens long"), "token-index")


class DamagedRecord(ValueError):
    """A record's length, checksum or header is not what the index says."""


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the index rows (path, offset, size), one open file at a time, verified."""
    path, source, width = None, None, 0
    try:
        for slab in (part for batch in batches for part in _by_size(batch, 1 << 23)):
            payloads, widths = [], []
            lengths, marks, heads = [], [], []
            for p, at, size in zip(*(slab.column(c).to_pylist() for c in ("path", "offset", "size"))):
                if p != path:
                    if source is not None:
                        source.close()
                    files, inner = opened(p)
                    path, source = p, files.open_input_file(inner)
                    head = source.read(8)
                    if head[:4] != MAGIC:
                        raise DamagedRecord(f"{p} is no shard")
                    width = int.from_bytes(head[4:], "little")
                source.seek(at)
                frame = source.read(FRAME + size + 4)
                if len(frame) != FRAME + size + 4:
                    raise DamagedRecord(f"{p} ends within the record at {at}")
                heads.append(int.from_bytes(frame[:8], "little"))
                marks.append(int.from_bytes(frame[8:12], "little"))
                lengths.append(size)
                payloads.append(frame[FRAME:])
                widths.append(width)
            sizes = np.array(lengths, np.int64)
            bodies = [x[:-4] for x in payloads]
            tails = np.array([int.from_bytes(x[-4:], "little") for x in payloads], np.uint32)
            if (np.array(heads) != sizes).any() or (length_checksums(sizes) != np.array(marks, np.uint32)).any() or (
                    checksums(bodies) != tails).any():
                raise DamagedRecord(f"a checksum in {path} fails")
            ids = [int.from_bytes(x[1:9], "little", signed=True) if x[0] else None for x in bodies]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), slab.column("path"), pa.array([int.from_bytes(x[9:17], "little") for x in bodies]),
                 pa.array(widths, pa.int32()), pa.array([x[HEAD:] for x in bodies], pa.binary())],
                names=["doc_id", "path", "before", "width", "ids"])
    finally:
        if source is not None:
            source.close()


def read(index: DataFrame) -> DataFrame:
    """The records that index rows name, in any order of the rows: doc_id, path, before (ids in the shard), width, ids.

    Both checksums of each record are verified. Index rows in file order are read in one sweep of the file; shuffle the
    index for a shuffled read.
    """
    return index.select("path", "offset", "size").mapInArrow(
        _fetched, "doc_id long, path string, before long, width int, ids binary")


def _by_size(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of index rows whose payloads make up about ``limit`` bytes."""
    ends, at = np.cumsum(batch.column("size").to_numpy()), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def summary(index: DataFrame) -> DataFrame:
    """Of the records read: doc_id, path, before, n_tokens, CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _READY.clear()  # an encoder that this worker wrote with
        for batch in _fetched(batches):
            ids = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in
                   zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("path"), batch.column("before"), pa.array(map(len, ids), pa.int64()),
                 pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                names=["doc_id", "path", "before", "n_tokens", "ids_crc32"])

    return index.select("path", "offset", "size").mapInArrow(
        run, "doc_id long, path string, before long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write and read back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    index = write(docs, tokenizer, folder or shared_path(docs.sparkSession, "token-records"))
    got = stored(summary(index), "token-records-read")
    # One row per shard: their order is that of their first documents.
    shards = got.groupBy("path").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"),
                                     F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("first", "path").rowsBetween(Window.unboundedPreceding, -1))
    bases = stored(shards.select("path", F.coalesce(before, F.lit(0)).alias("base")), "token-shards")
    return got.join(bases, "path").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
