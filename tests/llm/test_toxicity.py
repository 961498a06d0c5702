import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from zonecast.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"


def test_hashes_follow_the_words_alone():
    texts = [b"One two, TWO one", b"", b"two", "é é-x".encode(), b"one" * 5 + b" " + b"one" * 5, b" ", b"x"]
    words, stems, counts = T.hashed_words(texts)
    assert counts.tolist() == [4, 0, 1, 3, 2, 0, 1] and counts.sum() == len(words) == len(stems)
    assert words[0] == words[3] and words[1] == words[2] == words[4] and words[0] != words[1]
    assert words[5] == words[6] and words[8] == words[9]
    alone = [T.hashed_words([t]) for t in texts]
    assert np.concatenate([a[0] for a in alone]).tolist() == words.tolist()
    a, b = T.hashed_words([b"loweient"]), T.hashed_words([b"loweischaft"])
    assert a[1][0] == b[1][0] and a[0][0] != b[0][0]


def corpus(n, seed):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    bad = ["grumblx", "snarlo", "hissk"]
    out = []
    for i in range(n):
        words, toxic = rng.choices(calm, k=rng.randint(1, 80)), i % 5 == 0
        if toxic:
            for w in rng.choices(bad, k=2):
                words.insert(rng.randrange(len(words) + 1), w)
        out.append((" ".join(words), toxic))
    return out


def test_scores_do_not_depend_on_the_batch():
    net = T.Network.fresh(3)
    texts = [t.encode() for t, _ in corpus(40, 1)] + [b"", b"one"]
    whole = net.score_texts(texts)
    assert np.allclose(whole, [net.score_texts([t])[0] for t in texts], atol=1e-6)
    assert len(net.score_texts([])) == 0


def test_learns_and_holds_out(spark):
    data = corpus(900, 8)
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(data)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, None, int(x)) for i, (_, x) in enumerate(data)], LABELS)
    rows = T.report(docs.withColumn("score", F.lit(9)).withColumn("words", F.lit("w")), labels).collect()
    assert {r.doc_id for r in rows if r.held_out} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [r for r in rows if r.held_out]
    right = [r.predicted == int(data[r.doc_id][1]) for r in held]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_are_never_read(spark):
    data = corpus(300, 5)
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(data)], "doc_id long, text string, lang string")
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1, int(x != (flip and zlib.crc32(str(i).encode()) % 5 == 0)))
                                        for i, (_, x) in enumerate(data)], LABELS)
        got = sorted((r.doc_id, r.score) for r in T.report(docs, labels).collect())
        if flip:
            assert got == before
        before = got


def rare_words(n):
    """Texts of which every fourth is toxic by one of 30 words; each of these is in some ten texts."""
    rng = random.Random(4)
    return [(text + (f" {rng.randrange(30):02d}grumbl" if i % 4 == 0 else ""), i % 4 == 0)
            for i, (text, _) in enumerate((" ".join(rng.choices(["calm", "sea", "and", "wind"], k=9)), 0) for _ in range(n))]


def tables(spark, data):
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else "de") for i, (t, _) in enumerate(data)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, None, int(x)) for i, (_, x) in enumerate(data)], LABELS)


def test_learns_from_every_labelled_row(spark):
    data = rare_words(1200)
    docs, labels = tables(spark, data)
    rows = T.report(docs, labels, 40).collect()  # 40 rows of either class know few of the words
    held = [r for r in rows if r.held_out]
    toxic = [r.predicted for r in held if data[r.doc_id][1]]
    calm = [r.predicted for r in held if not data[r.doc_id][1]]
    assert len(toxic) > 40 and np.mean(toxic) > 0.9 and np.mean(calm) < 0.1


def test_every_labelled_row_is_in_one_shard_however_rows_are_dealt(spark):
    data = rare_words(130)
    docs, labels = tables(spark, data)
    docs = docs.union(docs.where("doc_id = 8 or doc_id % 50 = 7")).union(docs.limit(1).selectExpr("null", "text", "null"))
    docs = docs.union(docs.where("doc_id = 8").select("doc_id", "text", F.explode(F.array_repeat("lang", 30)).alias("lang")))
    labels = labels.union(spark.createDataFrame([(999, 1, 1), (None, 1, 1), (3, 1, None), (5, 1, 7)], LABELS))
    fitted, keep = F.col("doc_id") % 10 != 0, spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts, width in ((1, "3"), (7, "50")):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            found.append([r.asDict() for r in T.shards(docs.repartition(parts), labels, fitted, 10).orderBy("part").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert found[0] == found[1] and len(found[0]) > 10 and max(len(r["y"]) for r in found[0]) <= 20
    ids = [r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id % 10 and r.doc_id != 5]
    got = [(w.tobytes(), y) for r in found[0] for (w, _), y in zip(*T._texts(r)[:2])]
    hashed = [(T.hashed_words([data[i][0].encode()])[0].astype(np.uint16).tobytes(), float(data[i][1])) for i in ids]
    assert sorted(got) == sorted(hashed) and all(len(r["langs"]) == len(r["y"]) for r in found[0])


def test_one_shard_is_training_in_sequence_and_thresholds_see_all_kept_rows(spark):
    data = [(t + (" 07grumbl" if i % 9 == 1 else ""), x) for i, (t, x) in enumerate(rare_words(400))]
    docs, labels = tables(spark, data)
    one, many = (T.shards(docs, labels, F.lit(True), n) for n in (400, 50))
    total = T.totals(one)[1]
    other = T.totals(many)[1]
    assert (total.rows, total.toxic) == (other.rows, other.toxic) == (400, 100)
    assert all(np.array_equal(a, b) for a, b in zip(total.often, other.often))
    texts, y, _ = T._texts(one.collect()[0].asDict())
    learner, rng = T.Learner(7), np.random.default_rng(7)
    for _ in range(3):
        learner.learn(texts, y, np.where(y == 1, 2.0, 0.5 / 0.75), total.often, rng.permutation(len(y)), 64, 0.02)
    net = T.train(one, total, rounds=3)
    assert np.array_equal(net.words, learner.network.words) and np.array_equal(net.out, learner.network.out)
    kept = []
    for r in (r.asDict() for r in many.collect()):
        texts, y, held = T._texts(r)
        kept += [(g, p, t) for g, p, t, h in zip(r["langs"], net.score(*(np.concatenate([x[k] for x in texts]) for k in (0, 1)),
                                                 np.array([len(x[0]) for x in texts])), y, held) if h]
    cuts = T.thresholds(many, net, 1)
    assert set(cuts) == {g for g, _, t in kept if t} and len(kept) > 60
    for lang, cut in cuts.items():
        p, t = np.array([p for g, p, _ in kept if g == lang]), np.array([t for g, _, t in kept if g == lang])
        f1 = {c: 2 * t[p >= c].sum() / max(1, (p >= c).sum() + t.sum()) for c in np.unique(np.round([0.5, *p], 3))}
        assert f1[cut] >= max(f1.values()) - 1e-9 and abs(cut - 0.5) == min(abs(c - 0.5) for c, f in f1.items() if f >= max(f1.values()) - 1e-9)


def test_edges(spark, documents):
    docs = documents([None, "", "x" * 100_000, "a b"]).union(documents([(3, "a b"), (None, "n")]))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 3, None).otherwise(F.col("lang")))
    labels = spark.createDataFrame([(0, 1, None), (None, 1, 1), (77, 1, 1)], LABELS)
    rows = T.report(docs, labels).collect()
    assert len(rows) == 6 and len({r.score for r in rows}) == 1 and not any(r.predicted for r in rows)
    assert T.report(docs.limit(0), labels.limit(0)).collect() == []


def test_whole_table(spark):
    from zonecast.llm.queries import op5_toxicity

    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op5_toxicity(spark, sf).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [i for i in truth if got[i].held_out]
    hits = sum(got[i].predicted and truth[i] for i in held)
    assert hits / sum(truth[i] for i in held) > 0.9 and hits / sum(got[i].predicted for i in held) > 0.9
