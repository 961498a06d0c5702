import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonecast.llm import spellings as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_vocabulary(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_rows(docs):
    """All words compared with all words of about their length."""
    words = plain_vocabulary(docs)
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    form, near = {}, {}
    for w, n in words.items():
        others = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if one_edit(w, v)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return out


def key(rows):
    return sorted(map(str, map(tuple, rows)))


def test_neighbourhood_is_that_of_all_edits():
    for word, symbols in (("cabbage", 3), ("aaaaa", 2), ("zéro", 6)):
        s = S.reduce(word, symbols)
        with np.errstate(over="ignore"):
            got = set(S.neighbourhoods(np.stack([s, s]), symbols)[1].tolist())
            want = {tuple(s)}
            for i in range(len(s) + 1):
                want |= {(*s[:i], c, *s[i:]) for c in range(1, symbols + 1)}
                if i < len(s):
                    want |= {(*s[:i], c, *s[i + 1 :]) for c in range(1, symbols + 1)} | {(*s[:i], *s[i + 1 :])}
            keys = {int(S.keys_of(np.array([w], np.uint64))[0]) for w in want}
        assert got == keys and len(keys) == len(want)


def test_symbols_follow_the_vocabulary():
    assert [S.symbols_for(n) for n in (0, 800_000, 10**7, 10**9)] == [6, 6, 9, 15]


@pytest.mark.parametrize("symbols", [2, 6, 30])
def test_near_words_are_those_of_all_pairs(spark, symbols):
    rng = random.Random(5)
    words = {"".join(rng.choices("abcé", k=rng.randint(5, 7))) for _ in range(300)} | {"a" * n for n in range(5, 80, 3)}
    words |= {"b" * n for n in range(5, 30)} | {"straße", "strasse", "École", "école", "÷÷÷÷÷"}
    frame = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    got = sorted((r.word, r.near) for r in S.near_words(frame, symbols).collect())
    assert got == sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))


def test_rows(spark, documents):
    rng = random.Random(6)
    base = ["banana", "orange", "papaya", "cherry", "École", "étoile", "cafés", "straße"]
    texts = []
    for i in range(250):
        words = rng.choices(base, [40, 9, 9, 5, 5, 3, 3, 2], k=40)
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(40)
            a = rng.randrange(len(words[k]))
            words[k] = words[k][:a] + rng.choice("abcnr") * rng.randint(0, 2) + words[k][a + 1 :]
        texts.append(rng.choice([" ", "1", "一", "-"]).join(words).upper() if i % 9 == 0 else " ".join(words))
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4]), (900, None), (901, ""), (902, "banana" * 20_000)]
    docs = documents(rows).withColumn("word", F.lit("w")).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    got = S.report(docs).collect()
    want = plain_rows(rows)
    assert key(got) == key(want)
    chains = {w: f for w, f, *_ in want}
    assert any(chains[f] is not None for f in chains.values() if f is not None)  # chains of two steps are there
    assert S.report(docs.limit(0)).collect() == [] and S.report(docs.where("doc_id = 900")).collect() == []


def test_long_chains(spark):
    words = [("x" * (i + 5), 3 * 2**i) for i in range(20)]
    frame = spark.createDataFrame(words, "word string, n long")
    got = {r.word: (r.form, r.root) for r in S.roots(S.forms(frame)).collect()}
    last = words[-1][0]
    assert got == {w: (words[i + 1][0] if w != last else None, last) for i, (w, _) in enumerate(words)}


def test_whole_table(spark):
    from zonecast.llm.queries import op12_spelling_variants

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert key(op12_spelling_variants(spark, sf).collect()) == key(plain_rows(docs))
