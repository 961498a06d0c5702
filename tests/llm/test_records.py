import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zonecast.llm import records as R

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    assert plain_crc32c(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    rng = np.random.default_rng(1)
    data = [rng.bytes(n) for n in (4, 5, 17, 255, 256, 257, 512, 3000, 17)]
    assert R.checksums(data).tolist() == [plain_crc32c(x) for x in data]
    sizes = np.array([0, 17, 1 << 40])
    assert R.length_checksums(sizes).tolist() == [plain_crc32c(int(n).to_bytes(8, "little")) for n in sizes]


def reference():
    library = Tokenizer.from_file(PATH)
    return lambda t: library.encode(t or "", add_special_tokens=False).ids + [0]


def want_of(rows):
    own, out, start = reference(), [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = own(t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_rows(spark, documents):
    texts = ["it's a  test\n\n of words", None, "", "é" * 50_000 + " end", "<|endoftext|> x", "same", "same",
             "a <|endoftext|> b", "<|endoftext|>" * 3, "<|endoftext", " \u2003é \x1c\u00a0x\n\n  'll 's", "ab\n cd\n\nef \n"]
    rows = [*enumerate(texts), (5, "same"), (-3, "negative"), (None, "none")]
    docs = documents(rows).withColumn("ids", F.lit(1)).withColumn("path", F.lit("p")).repartition(3)
    got = R.report(docs, PATH).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want_of(rows)
    assert R.report(docs.limit(0), PATH).collect() == []


def test_shards_shuffled_reads_and_damage(spark, documents, tmp_path):
    docs = documents([f"text number {i} of some" for i in range(300)])
    index = R.write(docs, PATH, f"file:{tmp_path}/out", shard_rows=40)
    assert index.select("path").distinct().count() > 3
    own = reference()
    shuffled = index.orderBy(F.rand(3)).limit(50)
    for r in R.read(shuffled).collect():
        assert np.frombuffer(r.ids, f"<u{r.width}").tolist() == own(f"text number {r.doc_id} of some")
    victim = index.orderBy("doc_id").first()
    path = victim.path.removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[victim.offset + R.FRAME + 20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        R.read(index).collect()


def test_whole_table(spark):
    from zonecast.llm.queries import op3_token_records

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op3_token_records(spark, sf).collect())) == want_of(rows)
