"""Quantile boosting of all zones and quantiles at once on histograms that Spark sums.

A tree grows level by level. One aggregation gives the gradient, weight and row sums by (zone, quantile, node, feature,
bin); it combines before its shuffle, so a zone with most of the rows is spread over all tasks. Running sums over the bins
choose the best split of a node inside Spark, and the driver sees one row per node. The tree so far is a table with a row
per zone; rows find their node by walking down its arrays, so growing a level stores nothing per row. Leaf values are the
exact weighted quantiles of the current residuals.

Models are tables of the same form as those of ``zoneboost``, so ``save``, ``load``, ``predict`` and ``importance`` of
that module apply to them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scores as S
from zonecast.operators.blocks import add_row_position
from zonecast.operators.boosting import CATEGORIES, QUANTILES, category_means, ordered_target_mean
from zonecast.operators.features import MODEL_FEATURES
from zonecast.operators.modeltable import attach
from zonecast.operators.quantiles import exact_weighted_quantiles
from zonecast.operators.zoneboost import MODEL, BoostSettings
from zonecast.session import materialize, run_together

#: Trees and leaf values of one round are sent to every task up to this size; larger tables are joined by shuffle.
TABLE_BYTES = 64 << 20
CHECKPOINT_EVERY = 10
LEVELS = list(QUANTILES.values())

LGBM = BoostSettings(rounds=200, rate=0.1, depth=5, bins=64, early_stop=10)
XGB = replace(LGBM, depth=4, cap_half=True)
CAT = replace(LGBM, depth=4, l1=0.0, l2=3.0, cap_half=True)
SLOTS = {"lgbm": LGBM, "xgb": XGB, "cat": CAT}


@dataclass
class Tree:
    """Nodes in heap order: the children of k are 2k+1 and 2k+2; feature -1 is a leaf."""

    feature: list[int]
    cut: list[int]
    value: list[float]
    gain: list[float]

    @staticmethod
    def empty(depth: int) -> Tree:
        nodes = 2 ** (depth + 1) - 1
        return Tree([-1] * nodes, [0] * nodes, [0.0] * nodes, [0.0] * nodes)


@dataclass
class Growing:
    """Trees and losses of one zone and quantile; it stays open until its loss stalls."""

    trees: list[Tree] = field(default_factory=list)
    train_loss: list[float] = field(default_factory=list)
    val_loss: list[float] = field(default_factory=list)
    best: float = float("inf")
    rounds: int = 0
    open: bool = True

    def add(self, tree: Tree, train: float, val: float | None, early_stop: int) -> None:
        self.trees.append(tree)
        self.train_loss.append(train)
        if val is not None:
            self.val_loss.append(val)
        loss = train if val is None else val
        if loss < self.best:
            self.best, self.rounds = loss, len(self.trees)
        elif len(self.trees) - self.rounds >= early_stop:
            self.open = False


def _split(rows: DataFrame, s: BoostSettings) -> DataFrame:
    """``is_val`` for the last rows of each zone and ``w``, the recency weight of the others scaled to mean 1."""
    ranked = add_row_position(rows, ["zone"], "valid_time")
    n, pos = F.col("_n"), F.col("_pos")
    held = F.greatest(F.lit(s.val_least).cast("long"), F.floor(n * s.val_share)) if s.val_share > 0 else F.lit(0)
    held = F.least(held, F.floor(n / 2)) if s.cap_half else held
    fitted = n - held
    short = F.concat(F.lit("zone "), F.coalesce("zone", F.lit("null")), F.lit(": its rows leave none to fit after validation"))
    weight = F.lit(1.0)
    if s.half_life:
        r = 0.5 ** (1.0 / s.half_life)
        weight = F.pow(F.lit(r), fitted - pos) * fitted * (1.0 - r) / (1.0 - F.pow(F.lit(r), fitted))
    return (
        ranked.withColumn("is_val", F.when(fitted <= 0, F.raise_error(short).cast("boolean")).otherwise(pos > fitted))
        .withColumn("w", F.when(F.col("is_val"), 1.0).otherwise(weight)).drop("_n", "_pos")
    )


def _encode(rows: DataFrame, categories: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Target means next to the rows (strictly earlier rows for training rows, all training rows for the others), and
    the table of means by zone, category and code that scoring uses."""
    train, val = rows.where("NOT is_val"), rows.where("is_val")
    prior = rows.groupBy("zone").agg(F.avg(F.expr("IF(is_val, NULL, y)")).alias("_prior"))
    tables = []
    for c in categories:
        means = category_means(train, c, "y")
        tables.append(means.select("zone", F.lit(c).alias("name"), F.col(c).cast("int").alias("code"),
                                   F.col(f"{c}_target").alias("mean")))
        val = attach(val, means, ["zone", c])
        train = ordered_target_mean(train, c, "y")
    out = attach(train.unionByName(val), prior, ["zone"])
    out = out.withColumns({f"{c}_target": F.coalesce(f"{c}_target", "_prior") for c in categories})
    return out.drop("_prior"), reduce(DataFrame.unionByName, tables)


def _binned(rows: DataFrame, names: Sequence[str], bins: int) -> tuple[DataFrame, dict[str, list[list[float]]]]:
    """``b``, the bins of all features (how many edges of their zone lie below), and the edges: a row per zone."""
    probs = ", ".join(f"{i / bins}D" for i in range(1, bins))
    found = materialize(rows.where("NOT is_val").groupBy("zone").agg(F.array(*[
        F.array_sort(F.array_distinct(F.expr(f"percentile_approx(`{c}`, array({probs}), 10000)"))) for c in names
    ]).alias("_edges")))
    edges = {r["zone"]: r["_edges"] for r in found.collect()}
    place = [F.expr(f"size(filter(_edges[{i}], e -> e < `{c}`))") for i, c in enumerate(names)]
    return attach(rows, found, ["zone"]).select("zone", "valid_time", "y", "w", "is_val", F.array(*place).alias("b")), edges


def _table(spark, trees: dict[tuple[str, int], Tree], grown: dict[tuple[str, int], Growing], columns: Sequence[int],
           number: int, depth: int) -> DataFrame:
    """The trees of this round, a row per zone with arrays by quantile; sent to all tasks if it is small enough.

    What differs between rounds (drawn columns, number of the round) is data here, not a literal, so that all rounds run
    the same compiled code.
    """
    none = Tree.empty(depth)
    zones = sorted({z for z, _ in grown})
    by_zone = {z: [trees.get((z, i), none) for i in range(len(LEVELS))] for z in zones}
    rows = [(z, number, list(columns), [grown[z, i].open for i in range(len(LEVELS))], [t.feature for t in ts],
             [t.cut for t in ts], [t.value for t in ts]) for z, ts in by_zone.items()]
    table = spark.createDataFrame(rows, "zone string, _round int, _columns array<int>, _open array<boolean>, "
                                        "_feature array<array<int>>, _cut array<array<int>>, _value array<array<double>>")
    size = len(rows) * len(LEVELS) * len(none.feature) * 16
    return F.broadcast(table) if size <= TABLE_BYTES else table


def _node(q: str, depth: int, stop: str) -> str:
    """The node that a row reaches in ``depth`` steps down the tree of quantile ``q``; ``stop`` is what a leaf on the way
    gives."""
    if depth == 0:
        return "0"
    feature, cut = f"get(get(_feature, {q}), at)", f"get(get(_cut, {q}), at)"
    step = f"2 * at + 1 + IF(get(b, {feature}) > {cut}, 1, 0)"
    return f"aggregate(sequence(1, {depth}), 0, (at, step) -> IF(coalesce({feature}, -1) < 0, {stop}, {step}))"


def best_splits(rows: DataFrame, level: int, s: BoostSettings) -> DataFrame:
    """Per zone, quantile and node of this level the split with the largest gain: ``feature, cut, gain``.

    ``rows`` carry ``b, y, w, fits`` and the trees so far. Gains are compared in nine digits, so the order of summation
    does not decide; ties go to the first feature, then to the lowest cut.
    """
    levels = ", ".join(f"{p!r}D" for p in LEVELS)
    at = rows.selectExpr("zone", "b", "y", "w", "_open", "_feature", "_cut", "_columns", "posexplode(fits) AS (q, fit)").where("get(_open, q)")
    live = at.selectExpr(
        "zone", "q", f"{_node('q', level, '-1')} AS node", "w", "b", "_columns",
        f"(IF(y >= fit, 0D, 1D) - get(array({levels}), q)) * w AS g").where("node >= 0")
    pairs = "transform(_columns, c -> struct(c AS feature, get(b, c) AS bin))"
    sums = live.selectExpr("zone", "q", "node", "g", "w", f"inline({pairs})").groupBy(
        "zone", "q", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("w").alias("h"), F.count(F.lit(1)).alias("n"))
    whole = "(PARTITION BY zone, q, node, feature)"
    upto = "(PARTITION BY zone, q, node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cuts = sums.selectExpr("zone", "q", "node", "feature", "bin AS cut", *[
        f"sum({v}) OVER {w} AS {v}_{name}" for v in "ghn" for name, w in (("all", whole), ("left", upto))])

    def score(g: str, h: str) -> str:
        return f"pow(greatest(abs({g}) - {s.l1!r}D, 0D), 2) / ({h} + {s.l2!r}D + 1e-12D)"

    gain = f"{score('g_left', 'h_left')} + {score('g_all - g_left', 'h_all - h_left')} - {score('g_all', 'h_all')}"
    good = cuts.where(f"n_left >= {s.min_leaf} AND n_all - n_left >= {s.min_leaf}").selectExpr(
        "zone", "q", "node", "feature", "cut", f"round({gain}, 9) AS gain").where("gain > 1e-9D")
    best = good.groupBy("zone", "q", "node").agg(F.max(F.expr("struct(gain, -feature AS f, -cut AS c)")).alias("m"))
    return best.selectExpr("zone", "q", "node", "-m.f AS feature", "-m.c AS cut", "m.gain AS gain")


def _round(state: DataFrame, grown: dict, columns: Sequence[int], number: int, s: BoostSettings) -> dict[tuple[str, int], Tree]:
    """One tree for every open zone and quantile: a job per level, then one for the leaf values."""
    trees = {k: Tree.empty(s.depth) for k, g in grown.items() if g.open}

    def sample() -> DataFrame:
        rows = state.where("NOT is_val").join(_table(state.sparkSession, trees, grown, columns, number, s.depth), "zone")
        # drawn by hash, so a repeated task sees the same rows
        share = f"pmod(xxhash64(zone, valid_time, _round, {s.seed}), 1000000)"
        return rows.where(f"{share} < {int(s.row_share * 1_000_000)}") if s.row_share < 1 else rows

    for level in range(s.depth):
        found = best_splits(sample(), level, s).collect()
        for r in found:
            tree = trees[r["zone"], r["q"]]
            tree.feature[r["node"]], tree.cut[r["node"]], tree.gain[r["node"]] = r["feature"], r["cut"], r["gain"]
        if not found:
            break
    placed = sample().selectExpr(
        "zone", "b", "y", "w", "_open", "_feature", "_cut", "posexplode(fits) AS (q, fit)").where("get(_open, q)")
    residuals = placed.selectExpr("zone", "q", f"{_node('q', s.depth, 'at')} AS leaf", "y - fit AS r", "w")
    for r in exact_weighted_quantiles(residuals, ["zone", "q", "leaf"], "r", "w", QUANTILES, slices=8).collect():
        trees[r["zone"], r["q"]].value[r["leaf"]] = s.rate * r[list(QUANTILES)[r["q"]]]
    return trees


def _moved(state: DataFrame, table: DataFrame, depth: int) -> DataFrame:
    fits = f"transform(fits, (f, q) -> f + get(get(_value, q), {_node('q', depth, 'at')}))"
    return state.join(table, "zone").selectExpr("zone", "valid_time", "y", "w", "is_val", "b", f"{fits} AS fits")


def _losses(state: DataFrame) -> dict[tuple[str, int], tuple[float, float | None]]:
    terms = [S.pinball(F.col("y"), F.get("fits", F.lit(i)), p) for i, p in enumerate(LEVELS)]
    means = [F.avg(F.when(F.col("is_val") == side, t)).alias(f"{side}{i}") for i, t in enumerate(terms) for side in (False, True)]
    rows = state.groupBy("zone").agg(*means).collect()
    return {(r["zone"], i): (r[f"False{i}"], r[f"True{i}"]) for r in rows for i in range(len(LEVELS))}


def _model_row(g: Growing, edges: list[list[float]], width: int) -> dict:
    """Arrays of the kept trees: nodes level by level, real cuts, the right child after the left one."""
    out = {"feature": [], "cut": [], "child": [], "value": [], "roots": []}
    gain = np.zeros(width)
    for tree in g.trees[: g.rounds]:
        out["roots"].append(len(out["feature"]))
        queue, end = [0], len(out["feature"]) + 1
        for node in queue:
            f = tree.feature[node]
            out["feature"].append(max(f, 0))
            out["value"].append(tree.value[node])
            out["cut"].append(edges[f][tree.cut[node]] if f >= 0 else 0.0)
            out["child"].append(end if f >= 0 else -1)
            if f >= 0:
                gain[f] += tree.gain[node]
                queue += [2 * node + 1, 2 * node + 2]
                end += 2
    return out | {"rounds": g.rounds, "train_loss": g.train_loss, "val_loss": g.val_loss, "gain": (gain / (gain.sum() or 1)).tolist()}


def fit(matrix: DataFrame, settings: BoostSettings = LGBM, label: str = "price", features: Sequence[str] | None = None,
        prefix: str = "lgbm", categories: Sequence[str] = ()) -> DataFrame:
    """Model table of every zone and quantile, from rows whose label is observed and whose features are all known.

    ``categories`` (integer columns) also enter as target means. Rows without a zone take no part; a zone without enough
    rows fails the job; no rows at all give an empty table.
    """
    s, spark = settings, matrix.sparkSession
    wanted = [c for c in (MODEL_FEATURES if features is None else features) if c in matrix.columns]
    rows = matrix.na.drop("any", subset=["zone", "valid_time", *wanted, label]).select(
        "zone", "valid_time", F.col(label).cast("double").alias("y"),
        *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*wanted, *categories])])
    rows, names, codes = materialize(_split(rows, s)), list(wanted), {}
    prior = {r["zone"]: r["p"] for r in rows.where("NOT is_val").groupBy("zone").agg(F.avg("y").alias("p")).collect()}
    if categories and prior:
        rows, means = _encode(rows, categories)
        names += [f"{c}_target" for c in categories]
        for r in means.collect():
            codes.setdefault(r["zone"], []).append({"name": r["name"], "code": r["code"], "mean": r["mean"]})
    if not prior:
        return spark.createDataFrame([], MODEL)
    binned, edges = _binned(rows, names, s.bins)
    base = exact_weighted_quantiles(rows.where("NOT is_val"), ["zone"], "y", "w", QUANTILES)
    base = materialize(base.select("zone", F.array(*QUANTILES).alias("fits")))
    state = materialize(attach(binned, base, ["zone"], "inner"))
    start = {r["zone"]: r["fits"] for r in base.collect()}

    grown = {(z, i): Growing() for z in start for i in range(len(LEVELS))}
    rng, held = np.random.default_rng(s.seed), []
    for k in range(s.rounds):
        columns = np.arange(len(names))
        if s.column_share < 1:
            columns = np.sort(rng.choice(columns, max(1, int(s.column_share * len(columns))), replace=False))
        trees = _round(state, grown, columns.tolist(), k, s)
        moved = _moved(state, _table(spark, trees, grown, columns.tolist(), k, s.depth), s.depth)
        state = materialize(moved) if (k + 1) % CHECKPOINT_EVERY == 0 else moved.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
        losses = _losses(state)
        for key, tree in trees.items():
            grown[key].add(tree, *losses[key], s.early_stop)
        while len(held) > 2:
            held.pop(0).unpersist()
        if not any(g.open for g in grown.values()):
            break
    for df in held:
        df.unpersist()
    columns = [c.split()[0] for c in MODEL.split(", ")]
    out = [{"zone": z, "prefix": prefix, "quantile": list(QUANTILES)[i], "base": start[z][i], "rate": s.rate, "names": names,
            "codes": codes.get(z, []), "prior": prior[z]} | _model_row(g, edges[z], len(names)) for (z, i), g in grown.items()]
    return spark.createDataFrame([tuple(m[c] for c in columns) for m in out], MODEL)


def fit_slots(matrix: DataFrame, slots: dict[str, BoostSettings] | None = None, label: str = "price") -> DataFrame:
    """Model table of the three base slots, fitted side by side; the third also sees the calendar categories as target means."""
    tasks = [partial(fit, matrix, s, label, prefix=p, categories=CATEGORIES if p == "cat" else ())
             for p, s in (slots or SLOTS).items()]
    return reduce(DataFrame.unionByName, run_together(tasks))
