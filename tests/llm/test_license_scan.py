import re

from pyspark.sql import functions as F

from checks.compare import difference, duck
from zonecast.llm import license_scan as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(text):
    words = WORD.findall(lowered(text))
    places = [(i, label) for label, phrase in L.PHRASES for p in [phrase.split()]
              for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


TEXTS = [
    "All rights reserved. ALL RIGHTS-RESERVED! all rights; not reserved", "cc by cc by-nc CC BY", None, "", "cc", " \n",
    "GNU General Public License, general public general public license", "é all rights reservedé Kcc by cc\x85by",
    "Licensed under the Apache License, Version 2.0.", "licensed under the Apache software License, Version 2 0",
    "Licensed under CC BY-NC 4.0. Released under the MIT License.", "all rights reserved " * 5000, "ccby c c by b",
]


def test_base_and_labels(spark, documents):
    docs = documents(TEXTS).withColumn("row", F.lit(1)).withColumn("words", F.lit("w")).withColumn("label", F.lit("x"))
    docs = docs.union(docs.where("doc_id = 0"))
    rows = L.report(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(TEXTS[r.doc_id] or "")
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert by[8].labels == "apache-2.0" and by[8].score == 1.0
    assert by[9].labels == "apache-2.0" and 0.7 <= by[9].score < 1
    assert by[10].labels == "cc-by,cc-by-nc-4.0,mit"
    assert L.report(docs.limit(0)).collect() == []


def test_an_inserted_word_moves_the_votes_to_a_near_diagonal(spark, documents):
    text = "x y Permission is hereby granted, free of any charge, to any person obtaining one copy of this software"
    votes = L.diagonals(L.hits(documents([text]))).where("label = 'mit'").collect()
    assert len({r.diagonal for r in votes}) > 1
    spans = [r for r in L.spans(L.diagonals(L.hits(documents([text + " and associated documentation files"])))).collect() if r.accepted]
    assert [(r.label, r.start, r.stop) for r in spans] == [("mit", 2, 23)]


NOTICES = {
    "released under the standard mit license": "mit", "Released under an MIT license.": "mit", "the mit license": "",
    "released under the apache license": "", "licensed under the cc by 4 0": "cc-by-4.0", "licensed under CC BY-SA 4.0": "cc-by-sa-4.0",
    "licensed under CC BY-NC-SA 4.0": "", "licensed under cc by nd 4 0": "", "licensed under cc by 3 0": "",
    "licensed under the GNU General Public License, version 3": "gpl-3.0",
    "licensed under the terms of the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license version 3": "", "licensed under the gnu affero general public license version 3": "",
    "licensed under the gnu general public license version 2": "", "licensed under the mit license version 2 0": "",
    "licensed under the apache software license version 2 0": "apache-2.0", "licensed under the apache license version 1 1": "",
}


def test_one_broken_place_and_deciding_words(spark, documents):
    texts = list(NOTICES)
    got = {r.doc_id: r for r in L.report(documents([f"x {t} by y" for t in texts])).collect()}
    assert {t: ",".join(x for x in got[i].labels.split(",") if x not in ("cc-by", "gpl", "reserved")) for i, t in enumerate(texts)} == NOTICES
    assert all((got[i].score > 0) == bool(got[i].labels) for i in got)


def test_sql_reads_broken_notices_alike(spark, documents):
    import duckdb

    docs = documents([*NOTICES, *[t for t in TEXTS if t is None or "K" not in t]])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    cur = con.execute(L.ORACLE)
    df = L.report(docs)
    assert difference((df.columns, [tuple(r) for r in df.collect()]), ([c[0] for c in cur.description], cur.fetchall())) is None


def test_same_as_sql(spark):
    from zonecast.llm.queries import op6_license_scan

    con = duck("/root/testdata/sf0.01")
    df = op6_license_scan(spark, "/root/testdata/sf0.01")
    cur = con.execute(L.ORACLE)
    want = ([c[0] for c in cur.description], cur.fetchall())
    assert difference((df.columns, [tuple(r) for r in df.collect()]), want) is None
    assert any(r[1] for r in want[1])
