import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonecast.llm import fill_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text):
    """Form and output of one document from the list of its tokens."""
    text = text or ""
    t = TOKEN.findall(text)
    n, h = len(t), hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want_of(rows):
    return sorted((str((i, *p[:4], digest(p[4]), digest(t or ""))) for i, t in rows for p in [plain(i, t)]))


def texts():
    rng = random.Random(9)
    words = ["é", "word", " ", "日本語", "a<", "<", "P>", "x" * 30, "\x85", "S>m"]
    blanks = [" ", "  ", "\n", "\t ", "\x0b", "\r\n"]
    out = [None, "", " ", " \n ", "one", " one", "one ", "a<P>b", "x <S> y", "z<M>", "<" * 9, "a" * 40_000, " " * 30_000,
           "é" * 30_000, "ab " * 20_000]
    for n in [*range(60), 3000, 9000]:
        out.append("".join(rng.choice(words) + rng.choice(blanks) * rng.randint(0, 1) for _ in range(n)))
    shared = " ".join(f"shared{i}" for i in range(2000))
    return out + [f"head {i} " + shared + " " * (i % 3) for i in range(6)]


def test_rows(spark, documents):
    rows = [(i, t) for i, t in enumerate(texts() * 2)] + [(None, "without an id at all"), (7, "same"), (7, "same")]
    docs = documents(rows).withColumn("key", F.lit(1)).withColumn("output", F.lit("o")).withColumn("n", F.lit(2)).repartition(3)
    assert sorted(str(tuple(r)) for r in M.report(docs).collect()) == want_of(rows)
    forms = {r.form for r in M.report(docs).collect()}
    assert forms == {"plain", "spm", "psm"}
    assert M.report(docs.limit(0)).collect() == []
    some = M.restored(M.transformed(docs, cut=100).where("doc_id > 7")).collect()
    assert all(r.restored.decode() == (dict(rows)[r.doc_id] or "") for r in some) and len({r.form for r in some}) == 3


def test_cuts_at_every_token():
    for span in (M.CACHE, 0):
        cache = M.Cache(span)
        held = [(t or "").encode() for t in texts()]
        cuts = M.Cuts(held, cache)
        for i, raw in enumerate(held):
            tokens = TOKEN.findall(raw.decode())
            assert cuts.counts[i] == len(tokens)
            for k in {0, 1, 2, len(tokens) // 3, len(tokens) // 2, len(tokens) - 1, len(tokens)} - {-1}:
                if k <= len(tokens):
                    head = "".join(tokens[:k])
                    assert cuts.place(i, k) == (len(head.encode()), len(head))


def test_shared_chunks_are_found_once(monkeypatch):
    rng = random.Random(2)
    shared = " ".join(f"s{rng.getrandbits(40)}" for _ in range(5000)).encode()
    asked = []
    own = M.summaries
    monkeypatch.setattr(M, "summaries", lambda chunks: asked.extend(chunks) or own(chunks))
    cache = M.Cache()
    M.Cuts([b"first " + shared], cache)
    before = len(asked)
    M.Cuts([b"a much longer second beginning of it " + shared], cache)
    assert before > 80 and len(asked) - before <= 2


def test_chunks_depend_on_their_text_only():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 256, 3_000_000).astype(np.uint8), rng.integers(0, 256, 50_000).astype(np.uint8)
    alone = M.chunk_ends(two, np.array([50_000]))
    both = M.chunk_ends(np.concatenate([one, two]), np.array([3_000_000, 3_050_000]))
    assert (both[both > 3_000_000] - 3_000_000).tolist() == alone.tolist()
    assert np.diff(both).max() <= M.LONGEST and 3_000_000 in both and 300 < 3_000_000 / len(both) < 700
    assert M.chunk_ends(np.zeros(20_000, np.uint8), np.array([0, 20_000, 20_000]))[-1] == 20_000


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_parts_that_look_like_marks(form):
    for head in ("<", "<P", "<S", "<M", "P>", ""):
        for middle in ("S>", ">", "<", "M>x", ""):
            for tail in ("P>", "<P", "<", ">", ""):
                p, m, s = head.encode(), middle.encode(), tail.encode()
                if any(x in p + m + s for x in (b"<P>", b"<S>", b"<M>")):
                    continue
                out = b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m
                assert M.rebuilt(out, form) == p + m + s


def test_whole_table(spark):
    from zonecast.llm.queries import op13_fill_middle

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(str(tuple(r)) for r in op13_fill_middle(spark, sf).collect()) == want_of(rows)
