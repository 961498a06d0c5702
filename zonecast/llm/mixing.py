"""Temperature mixing of sources, in DataFrame and SQL functions only.

A source's weight is its token share to the power of an exponent between 0 (all sources equal) and 1 (as they are),
normalised. The exponent is bisected until the weights have a target entropy, or until no source is repeated more often
than a limit allows. With a budget of tokens, weights become whole token quotas. A quota is realised as full passes over
the source and a part of one more pass over a permutation: documents fall into blocks of about ``BLOCK`` by a hash, blocks
come in order, and inside a block documents come in the order of the rest of the hash. The part is a prefix of that
order, so it is described by one place per source, which is found by descending from blocks of blocks to the block and
to the document. No task sees more than about ``BLOCK`` rows of a source at once, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

BLOCK, STEPS = 1000, 50
REPETITION_LIMIT, SEED = 2.0, 17
WORD = r"[^\x20\x09-\x0D]+"


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _powers(tokens: Column, exponent: Column) -> Column:
    """Shares of the largest source to the power of the exponent; sources without tokens have none."""
    top = F.array_max(tokens)
    return F.transform(tokens, lambda t: F.when(t > 0, F.pow(t / top, exponent)).otherwise(0.0))


def _entropy(tokens: Column, exponent: Column) -> Column:
    powers = _powers(tokens, exponent)
    total = _total(powers)
    return _total(F.transform(powers, lambda p: F.when(p > 0, -(p / total) * F.ln(p / total)).otherwise(0.0)))


def _repetition(tokens: Column, exponent: Column, budget: Column | None) -> Column:
    """Passes over the source that is repeated most; without a budget the least repeated one has a single pass."""
    top, least = F.array_max(tokens), F.array_min(F.filter(tokens, lambda t: t > 0))
    most = F.pow(least / top, exponent - 1)
    return most if budget is None else most * budget / (top * _total(_powers(tokens, exponent)))


def _bisected(too_flat) -> Column:
    """Smallest exponent in [0, 1] that is not too flat, to six digits; ``too_flat`` maps an exponent to a condition."""
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        flat = too_flat(middle)
        return F.struct(F.when(flat, middle).otherwise(acc["low"]).alias("low"),
                        F.when(flat, acc["high"]).otherwise(middle).alias("high"))

    return F.when(~too_flat(F.lit(0.0)), 0.0).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda acc: F.round(acc["high"], 6)))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            seed: int = SEED) -> DataFrame:
    """doc_id, source (null: ''), n_tokens (words of the text; null: 0), and the hash that orders documents."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("n_tokens"),
                       hashed(F.col(id_col), seed).alias("place"))


def hashed(doc_id: Column, seed: int) -> Column:
    """Hash of an id, then the id itself, so that only rows of one id tie."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), F.lit(":"), name)


def block_of(place: Column, blocks: Column) -> Column:
    return F.conv(F.substring(place, 1, 8), 16, 10).cast("long") % blocks


def order_of(place: Column) -> Column:
    return F.substring(place, 9, 1 << 20)


def quotas(counts: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None,
           budget: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per source: docs, tokens, exponent, weight, quota, passes (full ones), rest (tokens of the last) and blocks.

    ``target_entropy`` is a share of the largest possible entropy. Without a ``budget`` the mixture is as small as it
    can be with every document in it. The per-source sums (one row each) are gathered in one row for the bisection.
    Sources without tokens get weight 0 and one pass.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either a target entropy or a repetition limit")
    sums = counts.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    one = sums.agg(F.array_sort(F.collect_list(F.struct("tokens", "docs", "source"))).alias("all"))
    one = one.withColumn("t", F.transform("all", lambda s: s["tokens"].cast("double")))
    tokens, spend = F.col("t"), None if budget is None else F.lit(float(budget))
    if repetition_limit is not None:
        exponent = _bisected(lambda e: _repetition(tokens, e, spend) > F.lit(float(repetition_limit)))
    else:
        positive = F.size(F.filter(tokens, lambda t: t > 0))
        goal = F.lit(float(target_entropy)) * F.ln(positive.cast("double"))
        exponent = _bisected(lambda e: _entropy(tokens, e) > goal)
    one = one.withColumn("exponent", exponent).withColumn("powers", _powers(F.col("t"), F.col("exponent")))
    one = one.withColumn("total", _total(F.col("powers")))
    one = one.withColumn("budget", spend if spend is not None else F.array_max("t") * F.col("total"))
    rows = one.select("exponent", "total", "budget", F.posexplode("all").alias("at", "s"), "powers").select(
        "s.source", "s.docs", "s.tokens", "exponent",
        F.when(F.col("total") > 0, F.get("powers", F.col("at")) / F.col("total")).otherwise(0.0).alias("weight"), "budget")
    whole = F.floor(F.col("quota") / F.col("tokens"))
    return (rows.withColumn("quota", F.round(F.col("weight") * F.coalesce("budget", F.lit(0.0))).cast("long"))
            .withColumn("passes", F.when(F.col("tokens") > 0, whole).otherwise(1).cast("long"))
            .withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
            .withColumn("blocks", F.ceil(F.col("docs") / block).cast("long"))
            .withColumn("weight", F.round("weight", 9)).drop("budget"))


def _crossing(parts: DataFrame, place: str) -> DataFrame:
    """The part of each source in which the rest runs out, and what is left of the rest there."""
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy(place)) - F.col("tokens")
    return (parts.withColumn("before", before).where("before <= rest and rest < before + tokens")
            .select("source", place, (F.col("rest") - F.col("before")).alias("rest")))


def cuts(counts: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per source with a rest: the block in which the last pass ends, and the order of its last document (or null)."""
    part = counts.join(plan.where("rest > 0").select("source", "blocks", "rest"), "source").select(
        "source", "rest", "n_tokens", "place", block_of(F.col("place"), F.col("blocks")).alias("block"))
    blocks = stored(part.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.max("rest").alias("rest"))
                    .withColumn("upper", F.floor(F.col("block") / block)), "blocks")
    upper = blocks.groupBy("source", "upper").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"))
    inside = stored(_crossing(upper, "upper"), "upper-crossing")
    last = _crossing(blocks.drop("rest").join(inside, ["source", "upper"]), "block")
    last = stored(last, "crossing")
    rows = part.drop("rest").join(last, ["source", "block"]).withColumn("order", order_of(F.col("place")))
    so_far = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("order"))
    ends = rows.withColumn("so_far", so_far).where("so_far <= rest").groupBy("source").agg(F.max("order").alias("cut"))
    return last.select("source", F.col("block").alias("cut_block")).join(ends, "source", "left")


def copies(rows: DataFrame, plan: DataFrame, place: Column, source: Column) -> DataFrame:
    """``rows`` with the columns of the plan in a struct ``mix`` and ``copies``, how often the mixture has the row."""
    small = plan.select(F.struct(*plan.columns).alias("mix"))
    out = rows.join(small, source == F.col("mix.source"))
    block, order = block_of(place, F.col("mix.blocks")), order_of(place)
    within = (block < F.col("mix.cut_block")) | ((block == F.col("mix.cut_block")) & (order <= F.col("mix.cut")))
    return out.withColumn("copies", F.col("mix.passes") + F.coalesce(within, F.lit(False)).cast("long"))


def planned(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = REPETITION_LIMIT,
            budget: int | None = None, block: int = BLOCK, seed: int = SEED, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Stored counts per document and the stored plan: quotas and cuts of each source."""
    counts = stored(counted(docs, seed=seed, **columns), "token-counts")
    plan = stored(quotas(counts, target_entropy, repetition_limit, budget, block), "quotas")
    return counts, stored(plan.join(cuts(counts, plan, block), "source", "left"), "mixing-plan")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, n_tokens, exponent, weight, quota, block and copies of every document."""
    counts, plan = planned(docs, **options)
    mixed = copies(counts.withColumnRenamed("source", "own"), plan, F.col("place"), F.col("own"))
    return mixed.select("doc_id", F.col("own").alias("source"), "n_tokens", "mix.exponent", "mix.weight", "mix.quota",
                        block_of(F.col("place"), F.col("mix.blocks")).alias("block"), "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has it, with the same columns."""
    seed, _plan = options.get("seed", SEED), planned(docs, **options)[1]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.coalesce(F.col("row.source").cast("string"), F.lit(""))
    out = copies(whole, _plan, hashed(F.col("row.doc_id"), seed), own)
    return (out.where("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
            .select("row.*"))


ORACLE = rf"""
WITH RECURSIVE counts AS (
  SELECT doc_id, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) || ':' || coalesce(doc_id::VARCHAR, '') AS place
  FROM documents),
sums AS (SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM counts GROUP BY source),
ends AS (SELECT max(tokens)::DOUBLE AS top, min(tokens) FILTER (tokens > 0)::DOUBLE AS least FROM sums),
halving AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1,
         CASE WHEN (SELECT pow(least / top, (low + high) / 2 - 1) FROM ends) > {REPETITION_LIMIT} THEN (low + high) / 2 ELSE low END,
         CASE WHEN (SELECT pow(least / top, (low + high) / 2 - 1) FROM ends) > {REPETITION_LIMIT} THEN high ELSE (low + high) / 2 END
  FROM halving WHERE step < {STEPS}),
found AS (
  SELECT CASE WHEN (SELECT pow(least / top, -1) FROM ends) > {REPETITION_LIMIT} THEN round(high, 6) ELSE 0.0 END AS exponent
  FROM halving WHERE step = {STEPS}),
powers AS (
  SELECT s.*, exponent, top, CASE WHEN tokens > 0 THEN pow(tokens / top, exponent) ELSE 0.0 END AS power
  FROM sums s, found, ends),
weights AS (SELECT *, power / sum(power) OVER () AS w, top * sum(power) OVER () AS budget FROM powers),
quotas AS (
  SELECT *, round(w * budget)::BIGINT AS quota, ceil(docs / {BLOCK}.0)::BIGINT AS blocks FROM weights),
passes AS (
  SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes,
         quota - CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END * tokens AS rest FROM quotas),
placed AS (
  SELECT c.*, p.* EXCLUDE (source), ('0x' || substr(place, 1, 8))::BIGINT % blocks AS block, substr(place, 9) AS ord
  FROM counts c JOIN passes p ON c.source = p.source),
running AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY block, ord) AS so_far FROM placed)
SELECT doc_id, source, n_tokens, exponent, round(w, 9) AS weight, quota, block,
       (passes + CASE WHEN rest > 0 AND so_far <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM running
"""
