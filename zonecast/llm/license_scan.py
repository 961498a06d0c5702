"""License notices by diagonal voting, in DataFrame and SQL functions only.

The hashes of all rolling word pairs of a text meet those of the templates. A pair at word i that equals the pair at
word j of a template votes for the diagonal i - j: a verbatim copy puts all votes on one diagonal, an inserted or
missing word moves the rest to a neighbouring one. Votes are counted per diagonal, diagonals of a template that are at
most ``DRIFT`` apart are merged, and a merged span is accepted if it is not much longer than the template, enough different
pairs are in it (more than ``SHARE``, or all but ``BROKEN`` with both ends, as one inserted or replaced word leaves them),
each deciding word of the notice is in a pair seen, and no deciding word of another licence stands beside a pair. Base
phrases need every pair on one diagonal.

Pairs that no template has are dropped before rows are made of them (a semi-join on a fixed set of hashes), so the
number of rows follows the number of hits; the join verifies the words themselves, not only their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of

#: Diagonals apart that still merge ("under the terms of the" moves them by three), share of the pairs that a notice must
#: exceed, pairs that one broken place costs, and how much longer than the notice its span may be.
DRIFT, SHARE, BROKEN, STRETCH = 3, 0.8, 2, 1.5

# The phrases of the base labels.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Well-known sentences of public license notices, as words.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

# Words that tell licences apart; a notice must show all of its own, and must not hold a foreign one.
OWN = ["apache", "by", "cc", "gnu", "mit", "mozilla", "nc", "sa", "0", "2", "3", "4"]
FOREIGN = ["affero", "lesser", "library", "nc", "nd", "sa"]

#: What stands between words once A-Z are lower case, and a letter that only lower-casing would turn into an ASCII one.
WORD, KELVIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "K"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; no other letter becomes an ASCII one."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit(KELVIN), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def templates() -> list[tuple]:
    """Pairs of all templates: template, label, is a base phrase, place, pairs of the template, both words, words beside."""
    out = []
    for t, (label, text) in enumerate([*PHRASES, *NOTICES]):
        words = text.split()
        out += [(t, label, t < len(PHRASES), j, len(words) - 1, a, b, words[j - 1] if j else None, (words[j + 2:] or [None])[0])
                for j, (a, b) in enumerate(zip(words, words[1:]))]
    return out


def own_pairs() -> list[tuple[int, int]]:
    """(template, bits of the pairs that hold a deciding word), one for each deciding word of a notice."""
    out = []
    for t, (_, text) in enumerate(NOTICES, len(PHRASES)):
        words = text.split()
        out += [(t, sum(1 << j for j in (i - 1, i) if 0 <= j < len(words) - 1)) for i, w in enumerate(words) if w in OWN]
    return out


def template_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(templates(), "template int, label string, phrase boolean, place int, pairs int, a string, b string, "
                                 "before string, after string")


def _hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1))


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, doc_id, n_words, at, word pair, foreign words beside it) of pairs that a template has.

    A text without any has one row with nulls.
    """
    known = sorted({(t[5], t[6]) for t in templates()})
    hashes = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in known])
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                        words_of(text_of(text_col)).alias("words"))
    words = F.col("words")
    places = F.sequence(F.lit(0), F.size(words) - 2)
    found = F.when(F.size(words) > 1, F.filter(places, lambda i: F.array_contains(hashes, _hash(words, i))))
    def foreign(i):
        return F.when(F.get(words, i).isin(FOREIGN), F.get(words, i))

    pairs = F.transform(found, lambda i: F.struct(i.alias("at"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"),
                                                  foreign(i - 1).alias("left"), foreign(i + 2).alias("right")))
    return texts.select("row", "doc_id", F.size(words).cast("long").alias("n_words"), F.explode_outer(pairs).alias("hit")).select(
        "row", "doc_id", "n_words", "hit.at", "hit.a", "hit.b", "hit.left", "hit.right")


def diagonals(found: DataFrame) -> DataFrame:
    """Votes per row, template and diagonal: start, stop (words), the pairs of the template seen as bits, foreign words."""
    key = F.xxhash64("a", "b")
    pairs = F.broadcast(template_pairs(found.sparkSession).withColumn("hash", key).withColumnsRenamed({"a": "x", "b": "y"}))
    voted = found.withColumn("key", key).join(
        pairs, (F.col("key") == F.col("hash")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left")
    return (voted.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "pairs",
                          (F.col("at") - F.col("place")).alias("diagonal"))
            .agg(F.min("at").alias("start"), (F.max("at") + 2).alias("stop"),
                 F.bit_or(F.expr("shiftleft(1L, place)")).alias("seen"),
                 F.bool_or(F.expr("coalesce(left <> before, false) OR coalesce(right <> after, false)")).alias("foreign")))


def _own_seen() -> Column:
    """Whether every deciding word of the template is in a pair seen."""
    seen = F.lit(True)
    for t, bits in own_pairs():
        seen = seen & ((F.col("template") != t) | (F.col("seen").bitwiseAND(F.lit(bits)) != 0))
    return seen


def spans(votes: DataFrame, drift: int = DRIFT, share: float = SHARE, broken: int = BROKEN, stretch: float = STRETCH) -> DataFrame:
    """Accepted spans of merged diagonals; ``accepted`` is false for what does not reach, also for rows without a hit."""
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > F.when(F.col("phrase"), 0).otherwise(drift)).cast("int")
    merged = (votes.withColumn("apart", F.coalesce(apart, F.lit(0)))
              .withColumn("island", F.sum("apart").over(by))
              .groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "pairs", "island")
              .agg(F.min("diagonal").alias("diagonal"), F.min("start").alias("start"), F.max("stop").alias("stop"),
                   F.bit_or("seen").alias("seen"), F.bool_or("foreign").alias("foreign"))
              .withColumn("got", F.bit_count("seen")))
    part = F.col("got") / F.col("pairs")
    ends = F.expr("seen & (1L | shiftleft(1L, pairs - 1)) = (1L | shiftleft(1L, pairs - 1))")
    enough = (part > share) | (ends & (F.col("got") >= F.col("pairs") - broken))
    fits = F.col("stop") - F.col("start") <= stretch * (F.col("pairs") + 1)
    accepted = F.when(F.col("phrase"), F.col("got") == F.col("pairs")).otherwise(enough & fits & _own_seen() & ~F.col("foreign"))
    return merged.withColumn("part", part).withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def report(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``score`` is the largest share of a notice or phrase that an accepted span holds. Null and empty texts have no words
    and no labels; repeated rows are reported each for itself.
    """
    base = F.col("accepted") & F.col("phrase")
    found = spans(diagonals(hits(docs, **columns)))
    joined = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("accepted"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("accepted"), F.col("part"))), F.lit(0.0)).alias("score"))
    return joined.drop("row")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
def _sql(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value).lower()


_VALUES = ", ".join("(" + ", ".join(map(_sql, t)) + ")" for t in templates())
_OWN = ", ".join(f"({i + len(PHRASES)}, '{w}')" for i, (_, text) in enumerate(NOTICES) for w in OWN if w in text.split())
# limits stand in the SQL as numbers of its own, and deciding words are looked up among the words seen
ORACLE = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '{WORD}') AS words
  FROM documents),
pairs AS (
  SELECT r, unnest(words[:-2]) AS a, unnest(words[2:]) AS b, unnest(range(len(words) - 1)) AS i,
         unnest(list_transform(range(len(words) - 1), lambda x: words[x])) AS w_before,
         unnest(list_transform(range(len(words) - 1), lambda x: words[x + 3])) AS w_after FROM texts),
templates(template, label, phrase, place, pairs, a, b, before, after) AS (VALUES {_VALUES}),
own(template, word) AS (VALUES {_OWN}),
votes AS (
  SELECT r, template, label, phrase, pairs, i - place AS diagonal, min(i) AS start, max(i) + 2 AS stop,
         bit_or(1::BIGINT << place) AS seen, list(a) || list(b) AS shown,
         bool_or(coalesce(w_before IN ('affero', 'lesser', 'library', 'nc', 'nd', 'sa') AND w_before <> before, false)
                 OR coalesce(w_after IN ('affero', 'lesser', 'library', 'nc', 'nd', 'sa') AND w_after <> after, false)) AS strange
  FROM pairs JOIN templates USING (a, b) GROUP BY ALL),
apart AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal)
                      > CASE WHEN phrase THEN 0 ELSE 3 END THEN 1 ELSE 0 END AS moved FROM votes),
islands AS (SELECT *, sum(moved) OVER (PARTITION BY r, template ORDER BY diagonal) AS island FROM apart),
merged AS (
  SELECT r, template, label, phrase, pairs, island, min(diagonal) AS diagonal, min(start) AS start, max(stop) AS stop,
         bit_or(seen) AS seen, flatten(list(shown)) AS shown, bool_or(strange) AS strange
  FROM islands GROUP BY ALL),
judged AS (
  SELECT *, bit_count(seen) AS got, EXISTS (SELECT 1 FROM own WHERE own.template = merged.template AND NOT list_contains(shown, word)) AS lacking
  FROM merged),
accepted AS (
  SELECT * FROM judged WHERE CASE WHEN phrase THEN got = pairs
    ELSE (got > 0.8 * pairs OR (got >= pairs - 2 AND seen & 1 = 1 AND (seen >> (pairs - 1)) & 1 = 1))
         AND stop - start <= 1.5 * (pairs + 1) AND NOT lacking AND NOT strange END)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, count(*) FILTER (phrase)::BIGINT AS n_base,
       (min(diagonal) FILTER (phrase))::BIGINT AS first_word, (max(diagonal) FILTER (phrase))::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (phrase))), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))), ','), '') AS labels,
       coalesce(max(got::DOUBLE / pairs), 0.0) AS score
FROM texts t LEFT JOIN accepted a ON t.r = a.r
GROUP BY t.r, t.doc_id, t.words
"""
