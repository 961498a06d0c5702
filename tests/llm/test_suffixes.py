import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonecast.llm import suffixes as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, window=10):
    """Rows by looking up every window of every document."""
    grams = {}
    for i, t in items:
        w = plain_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            grams.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, met = plain_words(t), set(), set()
        for n, known in grams.items():
            for k in range(len(w) - n + 1):
                if (ids := known.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    met |= ids
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def plain_longest(docs, items, least):
    out = {}
    held = [(d, plain_words(t)) for d, t in docs]
    for i, t in items:
        w = plain_words(t)
        for p in range(len(w)):
            best = (0, None, None)
            for d, x in held:
                for q in range(len(x)):
                    k = 0
                    while p + k < len(w) and q + k < len(x) and w[p + k] == x[q + k]:
                        k += 1
                    if k > best[0] or k == best[0] and k and (d, q) < best[1:]:
                        best = (k, d, q)
            if best[0] >= least:
                out[str(i), p] = best
    return out


def table(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, text string")


def key(rows):
    return sorted(map(str, rows))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ünï", "x9", "the"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randint(12, 40))) for i in range(12)]
    items += [(20, "short one here"), (21, items[0][1]), (5, text(15)), (22, ""), (23, None), (24, "...!"), (None, text(11)),
              (25, "The same the same the same the same the same the same the same")]
    docs = []
    for i in range(40):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "x").split()
            a = rng.randrange(len(w) or 1)
            parts += [", ".join(w[a : a + rng.randint(3, 30)]).upper(), text(rng.randint(0, 9))]
        docs.append((i, " ".join(parts)))
    docs += [(50, None), (51, ""), (52, " .. "), (53, "the same " * 40), (3, docs[3][1]), (3, "short ONE\x00here"),
             (None, docs[7][1]), (None, docs[7][1])]
    return docs, items


def test_suffix_array():
    rng = np.random.default_rng(3)
    words = np.concatenate([np.tile(rng.integers(1, 4, 50), 6), rng.integers(1, 3, 100), np.ones(80, np.int64), [0]])
    order = S.suffix_array(words, 1 << 10)
    want = sorted(range(len(words)), key=lambda i: words[i:].tolist())
    assert order.tolist() == want
    shallow = S.suffix_array(words, 8)
    assert [words[i : i + 8].tolist() for i in shallow] == [words[i : i + 8].tolist() for i in want]


def test_equal_hashes_of_different_words(monkeypatch):
    joined, starts, ends, _ = S.words_of([b"aa bb aa", b"bb a\xc3\xa9 aa"])
    number, words = S.numbered(joined, starts, ends)
    assert [words[i] for i in number] == [b"aa", b"bb", b"aa", b"bb", "aé".encode(), b"aa"]
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **k: unique(np.zeros_like(x), **k))
    number, words = S.numbered(joined, starts, ends)
    assert [words[i] for i in number] == [b"aa", b"bb", b"aa", b"bb", "aé".encode(), b"aa"]


@pytest.mark.parametrize("shard,block", [(S.SHARD, S.BLOCK), (300, S.BLOCK), (120, 500)])
def test_rows_are_those_of_all_windows(spark, corpus, shard, block):
    docs, items = corpus
    frame = table(spark, docs, "doc_id").withColumn("items", F.lit(1)).withColumn("copy", F.lit(2)).repartition(3)
    bench = table(spark, items, "item_id").withColumn("block", F.lit("b"))
    got = S.contamination(frame, bench, shard=shard, block=block).select(
        "doc_id", "n_words", S.covered(F.col("runs")).alias("hit"), "items").collect()
    listed = [(r.doc_id, r.n_words, r.hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.hit > 0)
              for r in got]
    assert key(listed) == key(plain(docs, items))


def test_longest_matches(spark, corpus):
    docs, items = corpus
    docs = [(d, t) for d, t in docs[:20] if d is not None]
    some = [(i, t) for i, t in items if i in (0, 1, 2, 3, 20, 22)]
    for shard in (S.SHARD, 200):
        got = S.longest_matches(table(spark, docs, "doc_id"), table(spark, some, "item_id"), 3, shard=shard).collect()
        assert {(r.item_id, r.item_word): (r.length, r.doc_id, r.doc_word) for r in got} == plain_longest(docs, some, 3)


def test_long_document_in_pieces(spark):
    rng = random.Random(8)
    words = [f"v{rng.randrange(300)}" for _ in range(3000)]
    items = [(i, " ".join(words[a : a + 25])) for i, a in enumerate(range(5, 2900, 137))] + [(99, "v1")]
    docs = [(1, "-".join(words)), (2, "z" * 5000 + " " + " ".join(words[100:140])), (3, ". " * 3000 + " ".join(words[:40]))]
    got = S.contamination(table(spark, docs, "doc_id"), table(spark, items, "item_id"), shard=700)
    listed = [(r.doc_id, r.n_words, r.hit, len(r["items"])) for r in
              got.select("doc_id", "n_words", "items", S.covered(F.col("runs")).alias("hit")).collect()]
    assert key(listed) == key(r[:4] for r in plain(docs, items))


def test_clean_and_empty(spark, corpus):
    docs, items = corpus
    frame, bench = table(spark, docs, "doc_id").withColumn("row", F.lit(1)), table(spark, items, "item_id")
    bad = {i for i, r in enumerate(plain(docs, items)) if r[5]}
    got = S.clean(frame, bench)
    assert got.columns == frame.columns and 0 < len(bad) < len(docs)
    assert key((r.doc_id, r.text) for r in got.collect()) == key(r for i, r in enumerate(docs) if i not in bad)
    assert S.report(frame.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in S.report(frame, bench.limit(0)).collect())
    assert S.longest_matches(frame.limit(0), bench).collect() == []


def test_whole_table(spark):
    from zonecast.llm.queries import op11_suffix_decontamination

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, op11_suffix_decontamination(spark, sf).collect())) == sorted(plain(docs, items))
