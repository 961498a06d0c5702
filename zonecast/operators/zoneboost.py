"""Quantile boosting per zone with stored models: every zone is fitted by one task, all zones side by side.

The hourly history of a zone has 8760 rows a year, so it fits into a task whatever the number of zones; the data of
different zones never meet. Trees grow level by level on histograms, with rows drawn anew and columns subset for each
tree, L1 and L2 penalties on the gradient sums of a split, and weighted residual quantiles as leaf values, which are
recomputed from the current residuals of every tree. Fitting stops when the loss on the last rows stalls.

A fitted model is a table with a row per zone and quantile: node arrays, encodings, losses. It is saved and loaded as
Parquet and applied to any rows of the zone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators.boosting import CATEGORIES, QUANTILES
from zonecast.operators.features import MODEL_FEATURES

MODEL = ("zone string, prefix string, quantile string, base double, rate double, rounds int, names array<string>, "
         "feature array<int>, cut array<double>, child array<int>, value array<double>, roots array<int>, "
         "train_loss array<double>, val_loss array<double>, gain array<double>, "
         "codes array<struct<name:string,code:int,mean:double>>, prior double")


#: Models sent to a task at a time.
MODEL_BYTES = 64 << 20


@dataclass
class BoostSettings:
    """Defaults of the first slot; ``XGB`` and ``CAT`` are the other two."""

    rounds: int = 3000
    rate: float = 0.03
    depth: int = 7
    min_leaf: int = 50
    bins: int = 255
    row_share: float = 0.7
    column_share: float = 0.6
    l1: float = 0.3
    l2: float = 0.3
    early_stop: int = 50
    val_share: float = 0.15
    val_least: int = 720
    #: Validation takes at most half of a short history; without it, a history that short is an error.
    cap_half: bool = False
    half_life: float | None = 8760.0
    seed: int = 42


LGBM = BoostSettings()
XGB = replace(LGBM, depth=6, cap_half=True)
CAT = replace(LGBM, depth=6, bins=128, l1=0.0, l2=3.0, cap_half=True)


def leaf_quantiles(leaf: np.ndarray, residual: np.ndarray, weight: np.ndarray, q: float, leaves: int) -> np.ndarray:
    """Weighted quantile of the residuals of each leaf: the first one at which the weight so far reaches the share."""
    order = np.lexsort((residual, leaf))
    leaf, residual, weight = leaf[order], residual[order], weight[order]
    total = np.bincount(leaf, weight, leaves)
    so_far = np.cumsum(weight)
    before = np.concatenate([[0.0], np.cumsum(total)[:-1]])
    reached = so_far - before[leaf] >= q * total[leaf] * (1 - 1e-12)
    first = np.flatnonzero(reached & np.concatenate([[True], (leaf[1:] != leaf[:-1]) | ~reached[:-1]]))
    out = np.zeros(leaves)
    out[leaf[first]] = residual[first]
    return out


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def grow(binned: np.ndarray, g: np.ndarray, w: np.ndarray, rows: np.ndarray, columns: np.ndarray, s: BoostSettings):
    """One tree, level by level: arrays of feature, cut (bin), child (the left one; the right one follows), gain."""
    feature, cut, child, gain = [0], [s.bins], [-1], [0.0]
    at, x = np.zeros(len(rows), np.int64), binned[np.ix_(rows, columns)].astype(np.int64)
    frontier, size = [0], len(columns) * s.bins
    offsets = np.arange(len(columns)) * s.bins
    for _ in range(s.depth):
        local = np.full(len(feature), -1)
        local[frontier] = np.arange(len(frontier))
        own = local[at]
        live = own >= 0
        keys = (own[live, None] * size + offsets + x[live]).ravel()
        shape = (len(frontier), len(columns), s.bins)
        n = np.bincount(keys, minlength=np.prod(shape)).reshape(shape).cumsum(2)
        gs, hs = (np.bincount(keys, np.repeat(v[rows][live], len(columns)), np.prod(shape)).reshape(shape).cumsum(2)
                  for v in (g, w))
        g_all, h_all, n_all = gs[:, :, -1:], hs[:, :, -1:], n[:, :, -1:]
        won = (_shrunk(gs, s.l1) ** 2 / (hs + s.l2 + 1e-12) + _shrunk(g_all - gs, s.l1) ** 2 / (h_all - hs + s.l2 + 1e-12)
               - _shrunk(g_all, s.l1) ** 2 / (h_all + s.l2 + 1e-12))
        won[(n < s.min_leaf) | (n_all - n < s.min_leaf)] = -np.inf
        best = won.reshape(len(frontier), -1).argmax(1)
        new = []
        for k, node in enumerate(frontier):
            value = won[k].flat[best[k]]
            if value > 1e-9:
                feature[node], cut[node] = int(columns[best[k] // s.bins]), int(best[k] % s.bins)
                child[node], gain[node] = len(feature), float(value)
                new += [len(feature), len(feature) + 1]
                feature += [0, 0]
                cut += [s.bins] * 2
                child += [-1, -1]
                gain += [0.0, 0.0]
        if not new:
            break
        down = np.array(child)[at]
        moves = down >= 0
        f, c = np.array(feature)[at[moves]], np.array(cut)[at[moves]]
        at[moves] = down[moves] + (binned[rows[moves], f] > c)
        frontier = new
    return np.array(feature), np.array(cut), np.array(child), np.array(gain)


def _leaf_of(values: np.ndarray, feature, cut, child, depth: int) -> np.ndarray:
    at, rows = np.zeros(len(values), np.int64), np.arange(len(values))
    for _ in range(depth):
        down = child[at]
        at = np.where(down >= 0, down + (values[rows, feature[at]] > cut[at]), at)
    return at


def pinball(y: np.ndarray, f: np.ndarray, q: float) -> float:
    d = y - f
    return float(np.maximum(q * d, (q - 1) * d).mean()) if len(y) else float("nan")


def fit_quantile(x: np.ndarray, y: np.ndarray, w: np.ndarray, is_val: np.ndarray, q: float, s: BoostSettings) -> dict:
    """Boosted trees for one quantile; ``x`` without missing values, in the order of time."""
    train = np.flatnonzero(~is_val)
    edges = [np.unique(np.quantile(x[train, j], np.linspace(0, 1, s.bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.int16)
    rng = np.random.default_rng(s.seed)
    base = float(leaf_quantiles(np.zeros(len(train), np.int64), y[train], w[train], q, 1)[0])
    fit = np.full(len(y), base)
    parts, roots, train_loss, val_loss, best, best_at, used = [], [], [], [], np.inf, 0, 0
    for k in range(s.rounds):
        g = np.where(y >= fit, -q, 1 - q) * w
        rows = train if s.row_share >= 1 else np.sort(rng.choice(train, max(1, int(s.row_share * len(train))), replace=False))
        columns = np.arange(x.shape[1])
        if s.column_share < 1:
            columns = np.sort(rng.choice(columns, max(1, int(s.column_share * len(columns))), replace=False))
        feature, cut, child, gain = grow(binned, g, w, rows, columns, s)
        leaf = _leaf_of(binned, feature, cut, child, s.depth)
        value = s.rate * leaf_quantiles(leaf[rows], (y - fit)[rows], w[rows], q, len(feature))
        fit = fit + value[leaf]
        real = np.array([edges[f][c] if d >= 0 else 0.0 for f, c, d in zip(feature, cut, child)])
        parts.append((feature, real, np.where(child >= 0, child + used, -1), value, gain))
        roots.append(used)
        used += len(feature)
        train_loss.append(pinball(y[train], fit[train], q))
        val_loss.append(pinball(y[is_val], fit[is_val], q))
        loss = val_loss[-1] if is_val.any() else train_loss[-1]
        if loss < best:
            best, best_at = loss, k + 1
        elif k + 1 - best_at >= s.early_stop:
            break
    end = roots[best_at] if best_at < len(roots) else used
    feature, cut, child, value, gain = (np.concatenate([p[i] for p in parts])[:end] for i in range(5))
    importance = np.bincount(feature[child >= 0], gain[child >= 0], x.shape[1])
    return {"base": base, "rate": s.rate, "rounds": best_at, "feature": feature.tolist(), "cut": cut.tolist(),
            "child": child.tolist(), "value": value.tolist(), "roots": roots[:best_at], "train_loss": train_loss,
            "val_loss": [v for v in val_loss if v == v], "gain": (importance / (importance.sum() or 1)).tolist()}


def _encoded(rows: pd.DataFrame, categories: Sequence[str], y: np.ndarray, is_val: np.ndarray):
    """Target means: over strictly earlier rows for training rows; for validation rows as at scoring, over training."""
    out, codes = {}, []
    train = ~is_val
    prior = float(y[train].mean())
    for c in categories:
        values = rows[c].to_numpy().astype(np.int64)
        part = pd.DataFrame({"c": values[train], "y": y[train]})
        grouped = part.groupby("c")["y"]
        earlier = (grouped.cumsum() - part["y"]) / grouped.cumcount().replace(0, np.nan)
        means = grouped.mean()
        column = pd.Series(values).map(means).fillna(prior).to_numpy()
        column[train] = earlier.fillna(prior).to_numpy()
        out[f"{c}_target"] = column
        codes += [{"name": c, "code": int(k), "mean": float(v)} for k, v in means.items()]
    return out, codes, prior


def fit(matrix: DataFrame, settings: BoostSettings = LGBM, label: str = "price", features: Sequence[str] | None = None,
        prefix: str = "lgbm", categories: Sequence[str] = ()) -> DataFrame:
    """Model table of every zone and quantile, from rows whose label is observed and whose features are all known.

    ``categories`` (integer columns) also enter as target means. A zone without enough rows fails the job.
    """
    wanted = [c for c in (MODEL_FEATURES if features is None else features) if c in matrix.columns]
    rows = matrix.na.drop("any", subset=[*wanted, label]).select(
        "zone", "valid_time", F.col(label).cast("double").alias("__y"),
        *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*wanted, *categories])])

    def one(zone_rows: pd.DataFrame) -> pd.DataFrame:
        zone_rows = zone_rows.sort_values("valid_time")
        y, n = zone_rows["__y"].to_numpy(), len(zone_rows)
        held = max(settings.val_least, int(n * settings.val_share)) if settings.val_share > 0 else 0
        held = min(held, n // 2) if settings.cap_half else held
        if n - held <= 0:
            raise ValueError(f"zone {zone_rows['zone'].iloc[0]}: {n} rows leave none to fit after {held} for validation")
        is_val = np.arange(n) >= n - held
        w = np.ones(n)
        if settings.half_life:
            w[: n - held] = 0.5 ** (np.arange(n - held)[::-1] / settings.half_life)
            w[: n - held] /= w[: n - held].mean()
        extra, codes, prior = _encoded(zone_rows, categories, y, is_val) if categories else ({}, [], float(y.mean()))
        names = [*wanted, *extra]
        x = np.column_stack([zone_rows[wanted].to_numpy(), *extra.values()]) if wanted or extra else np.zeros((n, 0))
        found = [fit_quantile(x, y, w, is_val, q, settings) | {"quantile": name} for name, q in QUANTILES.items()]
        return pd.DataFrame(found).assign(zone=zone_rows["zone"].iloc[0], prefix=prefix, prior=prior,
                                          names=[names] * len(found), codes=[codes] * len(found))

    return rows.groupBy("zone").applyInPandas(lambda rows: one(rows)[[c.split()[0] for c in MODEL.split(", ")]], MODEL)


def save(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def scores(x: np.ndarray, model) -> np.ndarray:
    """Sum of the base and the leaf values of all trees, a tree at a time for all rows."""
    feature, cut, child, value = (np.asarray(model[c]) for c in ("feature", "cut", "child", "value"))
    out, rows = np.full(len(x), float(model["base"])), np.arange(len(x))
    for root in model["roots"]:
        at = np.full(len(x), root)
        while len(at):
            down = child[at]
            if (down < 0).all():
                break
            at = np.where(down >= 0, down + (x[rows, feature[at]] > cut[at]), at)
        out += value[at]
    return out


def predict(matrix: DataFrame, models: DataFrame, prefixes: Sequence[str] = ("lgbm",)) -> DataFrame:
    """``zone, valid_time`` and the quantiles of every slot for each row: null where a feature or the zone's model is missing.

    Rows are scored where they lie, without a shuffle. Models travel to the tasks, as many zones at a time as
    ``MODEL_BYTES`` allows; more zones take further passes over the rows.
    """
    used = models.where(F.col("prefix").isin(list(prefixes)))
    sizes = used.groupBy("zone").agg(
        F.sum(F.size("feature") * 28 + F.size("codes") * 64 + 4096).alias("bytes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names")).orderBy("zone").collect()
    names = sorted({n for r in sizes for n in r["names"]})
    inputs = [c for c in dict.fromkeys([*names, *[n.removesuffix("_target") for n in names]]) if c in matrix.columns]
    rows = matrix.select("zone", "valid_time", *[F.col(c).cast("double").alias(c) for c in inputs])
    outputs = [f"{p}_{q}" for p in prefixes for q in QUANTILES]
    batches, room = [], 0
    for r in sizes:
        if r["bytes"] > room:
            batches.append([])
            room = MODEL_BYTES
        batches[-1].append(r["zone"])
        room -= r["bytes"]
    known = F.coalesce(F.col("zone").isin([r["zone"] for r in sizes]), F.lit(False)) if sizes else F.lit(False)
    got = rows.where(~known).select("zone", "valid_time", *[F.lit(None).cast("double").alias(o) for o in outputs])
    for batch in batches:
        sent = matrix.sparkSession.sparkContext.broadcast(used.where(F.col("zone").isin(batch)).toPandas())
        scored = rows.where(F.col("zone").isin(batch)).mapInPandas(
            _scorer(sent, outputs), "zone string, valid_time timestamp, " + ", ".join(f"{o} double" for o in outputs))
        got = got.unionByName(scored.select("zone", "valid_time", *[F.when(~F.isnan(o), F.col(o)).alias(o) for o in outputs]))
    return got


def _scorer(sent, outputs: Sequence[str]):
    """Function over batches of rows that applies the models of each zone to its rows."""

    def score(batches):
        by_zone = {z: m for z, m in sent.value.groupby("zone")}
        for rows in batches:
            out = rows[["zone", "valid_time"]].copy()
            for name in outputs:
                out[name] = np.nan
            for zone, at in rows.groupby("zone").indices.items():
                data = rows.iloc[at].copy()
                for _, m in by_zone[zone].iterrows():
                    for c in {k["name"] for k in m["codes"]}:
                        means = {k["code"]: k["mean"] for k in m["codes"] if k["name"] == c}
                        data[f"{c}_target"] = data[c].map(means).fillna(m["prior"]).where(data[c].notna())
                    x = data[list(m["names"])].to_numpy(float)
                    good = ~np.isnan(x).any(1)
                    column = np.full(len(x), np.nan)
                    column[good] = scores(x[good], m)
                    out.iloc[at, out.columns.get_loc(f"{m['prefix']}_{m['quantile']}")] = column
            yield out

    return score


def importance(models: DataFrame) -> DataFrame:
    """Share of the split gain per zone, quantile and feature."""
    return models.select("zone", "prefix", "quantile", F.explode(F.arrays_zip("names", "gain")).alias("f")).select(
        "zone", "prefix", "quantile", F.col("f.names").alias("feature"), F.col("f.gain").alias("importance"))


SLOTS = {"lgbm": LGBM, "xgb": XGB, "cat": CAT}


def capped(slots: dict[str, BoostSettings] | None = None) -> dict[str, BoostSettings]:
    """The slots with validation limited to half of each history, for series of less than two months."""
    return {p: replace(s, cap_half=True) for p, s in (slots or SLOTS).items()}


def fit_slots(matrix: DataFrame, slots: dict[str, BoostSettings] | None = None, label: str = "price") -> DataFrame:
    """Model table of the three base slots; the third also sees the calendar categories as target means."""
    slots = slots or SLOTS
    tables = [fit(matrix, s, label, prefix=p, categories=CATEGORIES if p == "cat" else ()) for p, s in slots.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
