import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from zonecast.llm import mixing, quality_trees, secrets

from test_secrets import plain as plain_secrets
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Documents before and after each stage."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(P.stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_and_columns(stages):
    assert len(P.STAGES) == 5
    for df in stages[1:5]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_keeps_what_the_trees_keep(spark, stages):
    docs = texts(stages[0])
    trees = quality_trees.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for i, t in docs.items():
        base, x = quality_trees.statistics(t)
        if base[0] >= 50 and 100 * base[4] <= 50 * base[0] and trees.score(np.array([x]))[0] >= trees.cut:
            want.add(i)
    assert texts(stages[1]) == {i: docs[i] for i in want}


def test_one_document_of_each_group_stays(stages):
    docs = texts(stages[1])
    groups = plain_components(sorted((i, plain_fingerprint(t, P.SHINGLE)) for i, t in docs.items()), P.RADIUS)
    assert texts(stages[2]) == {i: docs[i] for i in set(groups.values())}


def test_secrets_are_replaced(spark, stages, documents):
    before, after = texts(stages[2]), {r.doc_id: r for r in stages[3].collect()}
    assert set(before) == set(after)
    listed = {r.doc_id: r.spans for r in secrets.report(stages[2]).collect()}
    for i, t in before.items():
        spans = plain_secrets(t)
        assert (after[i].text == t) == (listed[i] == "")
        for a, _, b in spans:
            assert t[a:b] not in after[i].text
        assert after[i].n_chars == len(after[i].text)
    planted = documents(['say token = "0641917ea4e9feb9cda83477b57ac2654884f485" here', "clean", None])
    got = {r.doc_id: (r.text, r.n_chars) for r in P.secret_scan(spark, planted, SF).collect()}
    assert got == {0: ('say [secret]" here', 18), 1: ("clean", 5), 2: (None, None)}


def test_mixture_repeats_small_sources(stages):
    want = {r.doc_id: r.copies for r in mixing.report(stages[3]).collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == want and min(want.values()) >= 1


def test_tokens(spark, stages):
    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, len(own.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest())
                   for r in stages[4].collect())
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages[5].collect()) == want
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


def test_edges(spark, documents):
    good = " ".join(f"w{i}" for i in range(80))
    docs = documents([good, good, None, "", good + " more", "short"]).union(documents([(0, good), (None, good), (None, "n " * 99)]))
    docs = docs.withColumn("spans", F.lit(1)).withColumn("mix", F.lit("m")).withColumn("fp", F.lit(2)).withColumn("row", F.lit(3))
    for frame in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            frame = P.stored(stage(spark, frame, SF), "test-edges")
            assert frame.columns == docs.columns
        P.STAGES[-1][1](spark, frame, SF).collect()
