import random

import pytest
import xxhash
from pyspark.sql import functions as F

from zonecast.llm import simhash
from zonecast.llm.components import components

BLANKS = " \t\n\x0b\x0c\r"


def plain_words(text):
    out, word = [], ""
    for c in text:
        if c in BLANKS:
            out, word = out + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out + [word] * bool(word)


def plain_fingerprint(text, width=4):
    words = plain_words(text)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs, radius=4):
    """Smallest reachable id by comparing all with all."""
    root = {i: i for i, _ in pairs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in pairs:
        for j, y in pairs:
            if i < j and (x ^ y).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in pairs}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("crowd", [0, 32])
def test_links_connect_what_the_radius_connects(spark, crowd):
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(fps)[:6]:  # clouds, chains and pairs just inside and outside the radius
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
        for d in (4, 5):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), d)))
        x = centre
        for _ in range(5):
            fps.add(x := x ^ sum(1 << b for b in rng.sample(range(64), 4)))
    nodes = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in nodes], "fp long"), 4, crowd).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 4 and r.a > r.b for r in edges)
    root = {signed(x): signed(x) for x in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in edges:
        a, b = find(r.a), find(r.b)
        root[max(a, b)] = min(a, b)
    want = plain_components([(i, x) for i, x in enumerate(nodes)])
    groups = {}
    for i, x in enumerate(nodes):
        groups.setdefault(find(signed(x)), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_masks():
    assert len(simhash.masks(64, 2)) == 2081 and len(set(simhash.masks(32, 1))) == 33
    with pytest.raises(ValueError):
        simhash.links(None, radius=3)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (205, 203), (203, 204)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {203: 203, 204: 203, 205: 203}
    assert got == want
    assert components(df.limit(0)).collect() == []


def test_rows(spark, documents):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base + " tail", base.upper(), None, "", " \n ", "one two", "one two three four five", "one\x0btwo",
             "é\x85x é y É z", "x " * 30_000, base, "other text of some words entirely"]
    docs = documents([(i + 5, t) for i, t in enumerate(texts)] + [(5, base), (None, "one two")])
    docs = docs.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("root", F.lit(3))
    rows = simhash.report(docs, 4, 4).collect()
    prints = {i + 5: plain_fingerprint(t or "") for i, t in enumerate(texts)}
    want = plain_components(sorted(prints.items()))
    known = [r for r in rows if r.doc_id is not None]
    assert len(rows) == len(texts) + 2 and len(known) == len(texts) + 1
    for r in known:
        assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert [r.component_id for r in rows if r.doc_id is None] == [11]
    assert simhash.report(docs.limit(0), 4, 4).collect() == []


def test_large_clouds_of_near_copies(spark):
    """Clouds whose members lie up to eight bits apart, two of them touching in one pair only."""
    rng = random.Random(12)
    flipped = lambda x, d: x ^ sum(1 << b for b in rng.sample(range(64), d))
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {flipped(c, rng.randint(0, 4)) for c in centres for _ in range(150)}
    far = flipped(centres[0], 9)
    fps |= {flipped(far, rng.randint(0, 3)) for _ in range(60)}
    nodes = sorted(fps)
    want = plain_components(list(enumerate(nodes)))
    docs = spark.createDataFrame([(signed(x),) for x in nodes], "fp long")
    for crowd in (0, 8):
        got = {r.fp: r.root for r in simhash.linked_roots(docs, 4, crowd).collect()}
        groups = {}
        for i, x in enumerate(nodes):
            groups.setdefault(got.get(signed(x), signed(x)), set()).add(want[i])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_one_row_of_each_group(spark, documents):
    base = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"other{i}" for i in range(300))
    rows = [(4, base), (9, base + " tail"), (9, other), (9, other), (4, other + " x"), (None, base), (None, "alone of all here"),
            (None, None), (3, ""), (3, "")]
    docs = documents(rows).withColumn("key", F.lit(1)).withColumn("row", F.lit("r")).withColumn("fp", F.lit(2))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(
        map(str, [(4, base), (4, other + " x"), (None, "alone of all here"), (3, "")]))
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_whole_table(spark):
    from zonecast.llm.queries import op10_simhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    want = plain_components(sorted(prints.items()))
    got = op10_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {
        i: (prints[i], want[i]) for i in prints}
