"""Quantile gradient boosting and the categorical variant with ordered target statistics.

Each round fits a Spark decision tree to the pinball gradient and replaces its leaf values by weighted residual
quantiles. Leaf quantiles are read off a bounded histogram per leaf, so no leaf is ever gathered. All zones share one
model; the zone enters as a categorical feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions import scores as S
from zonecast.operators.blocks import BLOCK, block_of, block_prefix
from zonecast.operators.features import MODEL_FEATURES, scorable
from zonecast.operators.modeltable import attach
from zonecast.operators.splits import recency_weights, train_val_split
from zonecast.session import materialize, run_together

QUANTILES = {"q05": 0.05, "q50": 0.50, "q95": 0.95}
CATEGORIES = ["hour", "weekday", "month"]
HISTOGRAM_CUTS = 255


@dataclass
class BoostConfig:
    rounds: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    min_leaf: int = 50
    max_bins: int = 128
    early_stop: int = 10
    checkpoint_every: int = 5
    seed: int = 42


@dataclass
class QuantileBooster:
    quantile: float
    base: float
    learning_rate: float
    trees: list = field(default_factory=list)
    leaves: list = field(default_factory=list)
    best_rounds: int = 0
    history: list = field(default_factory=list)

    def score(self, assembled: DataFrame, name: str, features_col: str = "_x") -> DataFrame:
        out = assembled.withColumn(name, F.lit(self.base))
        for tree, values in list(zip(self.trees, self.leaves))[: self.best_rounds]:
            leafed = tree.copy().setLeafCol("_leaf").setPredictionCol("_unused").transform(out)
            out = leafed.withColumn(name, F.col(name) + self.learning_rate * _leaf_value(values)).drop("_leaf", "_unused")
        return out


@dataclass
class BoostedModel:
    """Boosters per quantile with their preparation."""

    features: list[str]
    boosters: dict[str, QuantileBooster]
    zone_index: object
    encodings: dict[str, DataFrame] = field(default_factory=dict)
    prior: DataFrame | None = None
    prefix: str = "lgbm"


def _leaf_value(values: list[float]) -> Column:
    # leaf numbers are dense from 0
    literal = ", ".join(repr(float(v)) + "D" for v in values)
    return F.expr(f"element_at(array({literal}), CAST(_leaf AS INT) + 1)")


def _assemble(df: DataFrame, features: Sequence[str], zone_index) -> DataFrame:
    indexed = zone_index.transform(df)
    cast = indexed.withColumns({f"_f{i}": F.col(c).cast("double") for i, c in enumerate(features)})
    inputs = [f"_f{i}" for i in range(len(features))] + ["_zone_ix"]
    return VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="keep").transform(cast).drop(
        *[f"_f{i}" for i in range(len(features))]
    )


def _weighted_leaf_quantiles(rows: list, q: float, n_leaves: int) -> list[float]:
    """Weighted quantile per leaf from (leaf, slice, weight, low, high), linear inside the slice."""
    values = [0.0] * n_leaves
    by_leaf: dict[int, list] = {}
    for row in rows:
        by_leaf.setdefault(int(row["_leaf"]), []).append(row)
    for leaf, parts in by_leaf.items():
        parts.sort(key=lambda p: p["_slice"])
        target = q * sum(p["w"] for p in parts)
        seen = 0.0
        for p in parts:
            if seen + p["w"] >= target:
                share = (target - seen) / p["w"] if p["w"] > 0 else 0.0
                values[leaf] = p["lo"] + share * (p["hi"] - p["lo"])
                break
            seen += p["w"]
        else:
            values[leaf] = parts[-1]["hi"]
    return values


def _cuts(df: DataFrame, col: str) -> list[float]:
    probs = [i / (HISTOGRAM_CUTS + 1) for i in range(1, HISTOGRAM_CUTS + 1)]
    inner = sorted(set(df.approxQuantile(col, probs, 0.001)))
    return [float("-inf"), *inner, float("inf")]


def fit_booster(data: DataFrame, quantile: float, config: BoostConfig) -> QuantileBooster:
    """``data`` has ``_x`` (features), ``y``, ``w`` (weight) and ``is_val``; stops when validation loss stalls."""
    train = ~F.col("is_val")
    start = data.where(train).approxQuantile("y", [quantile], 0.001)
    if not start:
        raise ValueError("No labelled rows with all features")
    base = start[0]
    booster = QuantileBooster(quantile, base, config.learning_rate)
    current = data.withColumn("_fit", F.lit(base))
    cuts = _cuts(current.where(train).select((F.col("y") - base).alias("r")), "r")
    best, stale, held = None, 0, []
    tree = DecisionTreeRegressor(
        featuresCol="_x", labelCol="_g", weightCol="w", predictionCol="_unused", leafCol="_leaf",
        maxDepth=config.max_depth, minInstancesPerNode=config.min_leaf, maxBins=config.max_bins, seed=config.seed,
    )
    for k in range(config.rounds):
        gradient = F.when(F.col("y") >= F.col("_fit"), quantile).otherwise(quantile - 1.0)
        model = tree.fit(current.where(train).withColumn("_g", gradient))
        leafed = model.transform(current).drop("_unused")
        sliced = Bucketizer(splits=cuts, inputCol="_r", outputCol="_slice").transform(
            leafed.where(train).withColumn("_r", F.col("y") - F.col("_fit"))
        )
        # at most leaves x slices rows reach the driver
        hist = sliced.groupBy("_leaf", "_slice").agg(
            F.sum("w").alias("w"), F.min("_r").alias("lo"), F.max("_r").alias("hi")
        ).collect()
        n_leaves = (model.numNodes + 1) // 2
        values = _weighted_leaf_quantiles(hist, quantile, n_leaves)
        booster.trees.append(model)
        booster.leaves.append(values)
        step = config.learning_rate * _leaf_value(values)
        updated = leafed.withColumn("_fit", F.col("_fit") + step).drop("_leaf")
        if (k + 1) % config.checkpoint_every == 0:
            updated = materialize(updated)
        else:
            updated = updated.persist(StorageLevel.MEMORY_AND_DISK)
        loss_col = S.pinball(F.col("y"), F.col("_fit"), quantile)
        loss = updated.agg(
            F.avg(F.when(F.col("is_val"), loss_col)).alias("val"), F.avg(F.when(train, loss_col)).alias("train")
        ).first()
        held.append(updated)
        if len(held) > 2:
            held.pop(0).unpersist()
        current = updated
        score = loss["val"] if loss["val"] is not None else loss["train"]
        booster.history.append((loss["train"], loss["val"]))
        if best is None or score < best:
            best, stale, booster.best_rounds = score, 0, k + 1
        else:
            stale += 1
            if stale >= config.early_stop:
                break
    for df in held:
        df.unpersist()
    return booster


def _prepare(matrix: DataFrame, features: Sequence[str], label: str, cap_half: bool) -> DataFrame:
    rows = matrix.na.drop("any", subset=[*features, label]).withColumn("y", F.col(label).cast("double"))
    split = train_val_split(rows, cap_half=cap_half)
    # weights decay within the training part; validation rows are not weighted
    train = recency_weights(split.where(~F.col("is_val")), name="w")
    return train.unionByName(split.where("is_val").withColumn("w", F.lit(1.0)))


def boosted_fit(matrix: DataFrame, label: str = "price", features: Sequence[str] | None = None,
                config: BoostConfig | None = None, cap_half: bool = False, prefix: str = "lgbm") -> BoostedModel:
    """One booster per quantile with recency weights and early stopping on the last rows of each zone."""
    config = config or BoostConfig()
    wanted = MODEL_FEATURES if features is None else features
    cols = [c for c in wanted if c in matrix.columns]
    rows = _prepare(matrix, cols, label, cap_half)
    zone_index = StringIndexer(inputCol="zone", outputCol="_zone_ix", handleInvalid="keep").fit(rows.select("zone"))
    data = materialize(_assemble(rows, cols, zone_index).select("_x", "y", "w", "is_val"))
    fits = run_together([partial(fit_booster, data, q, config) for q in QUANTILES.values()])
    boosters = dict(zip(QUANTILES, fits))
    return BoostedModel(cols, boosters, zone_index, prefix=prefix)


def boosted_predict(matrix: DataFrame, model: BoostedModel) -> DataFrame:
    """Every input row with ``{prefix}_q05/q50/q95``; rows with a missing feature stay unscored."""
    rows = apply_encodings(matrix, model.encodings, model.prior)
    ok = scorable(model.features)
    data = _assemble(rows, model.features, model.zone_index)
    names = []
    for q, booster in model.boosters.items():
        name = f"{model.prefix}_{q}"
        data = booster.score(data, name)
        names.append(name)
    return data.select(*matrix.columns, *[F.when(ok, F.col(n)).alias(n) for n in names])


def feature_importance(model: BoostedModel, spark) -> DataFrame:
    """Impurity gain per quantile and feature, normalised per booster (``quantile, feature, importance``)."""
    names = [*model.features, "zone"]
    rows = []
    for q, booster in model.boosters.items():
        total = [0.0] * len(names)
        for tree in booster.trees[: booster.best_rounds]:
            for i, v in enumerate(tree.featureImportances.toArray()):
                total[i] += float(v)
        whole = sum(total) or 1.0
        rows += [(q, n, v / whole) for n, v in zip(names, total)]
    return spark.createDataFrame(rows, "quantile string, feature string, importance double")


def mean_importance(importance: DataFrame, top: int = 15) -> DataFrame:
    return (
        importance.groupBy("feature").agg(F.avg("importance").alias("mean"))
        .orderBy(F.desc("mean"), "feature").limit(top)
    )


# --- categorical features ------------------------------------------------------------------------------------------


def ordered_target_mean(df: DataFrame, category: str, label: str = "price", keys: Sequence[str] = ("zone",),
                        time: str = "valid_time", name: str | None = None) -> DataFrame:
    """Mean label over the category's strictly earlier rows: block-local running sums plus per-block prefixes."""
    k = [*keys, category]
    name = name or f"{category}_target"
    known = F.col(label).isNotNull().cast("long")
    prefix = block_prefix(df, k, time, {"_ps": F.coalesce(F.col(label), F.lit(0.0)), "_pc": known}).drop(
        "_ps_total", "_pc_total"
    )
    w = Window.partitionBy(*k, BLOCK).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_ps") + F.coalesce(F.sum(label).over(w), F.lit(0.0))
    count = F.col("_pc") + F.count(label).over(w)
    return (
        df.withColumn(BLOCK, block_of(time))
        .join(prefix, [*k, BLOCK])
        .withColumn(name, F.when(count > 0, total / count))
        .drop("_ps", "_pc", BLOCK)
    )


def category_means(df: DataFrame, category: str, label: str = "price", keys: Sequence[str] = ("zone",)) -> DataFrame:
    return df.groupBy(*keys, category).agg(F.avg(label).alias(f"{category}_target"))


def apply_encodings(df: DataFrame, encodings: dict[str, DataFrame], prior: DataFrame | None = None) -> DataFrame:
    """Category means next to the rows; a category never seen in training gets its zone's mean."""
    if not encodings:
        return df
    if prior is not None:
        df = attach(df, prior, ["zone"])
    for category, table in encodings.items():
        df = attach(df, table, ["zone", category])
        if prior is not None:
            df = df.withColumn(f"{category}_target", F.coalesce(f"{category}_target", "_prior"))
    return df.drop("_prior")


def categorical_fit(matrix: DataFrame, label: str = "price", config: BoostConfig | None = None, prefix: str = "cat",
                    categories: Sequence[str] = CATEGORIES) -> BoostedModel:
    """Boosting with hour, weekday and month also as ordered target statistics.

    Training rows see only earlier labels of their category; scoring uses the category means of the training rows.
    """
    rows = matrix.withColumns({c: F.col(c).cast("int") for c in categories})
    base = [c for c in MODEL_FEATURES if c in matrix.columns]
    rows = rows.na.drop("any", subset=[*base, label])
    encoded, encodings = rows, {}
    for c in categories:
        encoded = ordered_target_mean(encoded, c, label)
        encodings[c] = materialize(category_means(rows, c, label))
    model = boosted_fit(encoded, label, [*base, *[f"{c}_target" for c in categories]], config, cap_half=True, prefix=prefix)
    model.encodings = encodings
    model.prior = materialize(rows.groupBy("zone").agg(F.avg(label).alias("_prior")))
    return model
