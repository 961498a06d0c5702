import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from zonecast.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_random_texts_as_the_library_encodes_them():
    rng, own = random.Random(3), reference()
    letters = list("aZ9 '  \n\t's't're'll've'd'mreslvdt!?#é日١²  \x85\x1c🙂́٣Ⅷ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(5000)]
    texts += ["", "a" * 5000, "=" * 3000 + " " * 2000, "\n" * 600 + "x", "it's we'll 's 're'' ''s 'sx", "'", "é" * 300]
    words = bpe.Vocabulary.parse(open(PATH, "rb").read())
    got = words.encode(texts)
    assert [ids(x) for x in got] == [own.encode_ordinary(t) for t in texts]
    for text, x in zip(texts, got):
        n = np.frombuffer(x, "<u4")
        assert words.decode(n, words.offsets(n)) == text.encode()


def test_scan_equals_a_walk_for_any_block_width():
    auto, rng = bpe.automaton(), np.random.default_rng(5)
    symbols = rng.integers(0, 9, 4000).astype(np.uint8)
    state, want = 0, []
    for c in symbols.tolist():
        state, starts = bpe._step(state, c)
        want.append(starts)
    for width in (1, 7, 64, 5000):
        assert auto.piece_starts(symbols, width).tolist() == want


def test_small_cache_gives_the_same_ids():
    words = bpe.Vocabulary.parse(open(PATH, "rb").read())
    words.cache.limit = 2
    texts = ["one two three four five six", "one two one two", "six five four"]
    assert [words.encode([t])[0] for t in texts * 2] == bpe.Vocabulary(words.ranks).encode(texts * 2)


def test_equal_hashes_of_different_pieces_do_no_harm(monkeypatch):
    words, texts = bpe.Vocabulary.parse(open(PATH, "rb").read()), ["ab cd", "cd ab ef", "", "ef" * 40]
    want = words.encode(texts)
    monkeypatch.setattr(bpe, "_weights_of", lambda n: np.zeros(n, np.uint64))
    assert words.encode(texts) == want and words.encode([]) == []


def test_encode_and_decode_apart(spark, documents):
    docs = documents(["Two words", None, "é"])
    coded = bpe.encode(docs, PATH)
    rows = {r.doc_id: r for r in bpe.decode(coded, PATH, ["doc_id"]).collect()}
    assert {i: bytes(r.decoded) for i, r in rows.items()} == {0: b"Two words", 1: b"", 2: "é".encode()}
    first = coded.where("doc_id = 0").first()
    assert np.frombuffer(first.offsets, "<u4").tolist() == [0, 3]


def test_rows(spark, documents):
    texts = ["Hello there's a text\n\n  of two  lines ", None, "", "x" * 200_000 + " end", "Hello again", "Hello again"]
    docs = documents([(i, t) for i, t in enumerate(texts)] + [(4, "Hello again"), (None, "no id")])
    docs = docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))  # names that clash are ignored
    rows = bpe.digests(docs, PATH).collect()
    own = reference()
    want = []
    for i, t in [*enumerate(texts), (4, "Hello again"), (None, "no id")]:
        n = own.encode_ordinary(t or "")
        want.append((i, len(n), hashlib.sha256(np.array(n, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def test_whole_table(spark):
    from zonecast.llm.queries import op1_byte_bpe

    own = reference()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op1_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        n = own.encode_ordinary(d.text)
        assert got[d.doc_id].n_tokens == len(n)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(n, "<u4").tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
