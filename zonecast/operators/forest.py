"""Quantile forest: a Spark random forest whose leaves answer with label quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.operators.boosting import _assemble
from zonecast.operators.features import MODEL_FEATURES, scorable
from zonecast.operators.quantiles import exact_weighted_quantiles
from zonecast.operators.splits import recency_weights
from zonecast.session import materialize

LEVELS = {"q05": 0.05, "q50": 0.50, "q95": 0.95}


@dataclass
class ForestConfig:
    trees: int = 50
    max_depth: int = 6
    min_leaf: int = 50
    max_bins: int = 64
    row_share: float = 0.7
    feature_share: str = "0.6"
    seed: int = 42


@dataclass
class ForestModel:
    features: list[str]
    forest: object
    zone_index: object
    # quantile -> tree -> leaf -> value
    values: dict[str, list[list[float]]]
    prefix: str = "xgb"


def forest_fit(matrix: DataFrame, label: str = "price", features: Sequence[str] | None = None,
               config: ForestConfig | None = None, prefix: str = "xgb") -> ForestModel:
    """Leaves keep the exact quantiles of their training labels under the recency weights (trees x leaves rows in total)."""
    config = config or ForestConfig()
    wanted = MODEL_FEATURES if features is None else features
    cols = [c for c in wanted if c in matrix.columns]
    rows = matrix.na.drop("any", subset=[*cols, label]).withColumn("y", F.col(label).cast("double"))
    rows = recency_weights(rows, name="w")
    zone_index = StringIndexer(inputCol="zone", outputCol="_zone_ix", handleInvalid="keep").fit(rows.select("zone"))
    data = materialize(_assemble(rows, cols, zone_index).select("_x", "y", "w"))
    if data.isEmpty():
        raise ValueError("No labelled rows with all features")
    forest = RandomForestRegressor(
        featuresCol="_x", labelCol="y", weightCol="w", leafCol="_leaves", predictionCol="_unused",
        numTrees=config.trees, maxDepth=config.max_depth, minInstancesPerNode=config.min_leaf, maxBins=config.max_bins,
        subsamplingRate=config.row_share, featureSubsetStrategy=config.feature_share, seed=config.seed,
    ).fit(data)
    leaves = materialize(forest.transform(data).select("y", "w", F.posexplode(_leaf_array("_leaves")).alias("tree", "leaf")))
    leaf_rows = exact_weighted_quantiles(leaves, ["tree", "leaf"], "y", "w", LEVELS, slices=8).collect()
    sizes = [(t.numNodes + 1) // 2 for t in forest.trees]
    values = {name: [[0.0] * n for n in sizes] for name in LEVELS}
    for r in leaf_rows:
        for name in LEVELS:
            values[name][r["tree"]][int(r["leaf"])] = r[name]
    return ForestModel(cols, forest, zone_index, values, prefix)


def _leaf_array(col: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(col))


def forest_predict(matrix: DataFrame, model: ForestModel) -> DataFrame:
    """Mean over trees of the leaf quantiles, looked up in literal arrays: no explode, no join."""
    data = model.forest.transform(_assemble(matrix, model.features, model.zone_index))
    data = data.withColumn("_leaf_no", _leaf_array("_leaves"))
    ok = scorable(model.features)
    out = []
    for q, per_tree in model.values.items():
        literal = ", ".join("array(" + ", ".join(f"{v!r}D" for v in leaves) + ")" for leaves in per_tree)
        n = len(per_tree)
        picked = f"transform(_leaf_no, (leaf, t) -> element_at(element_at(array({literal}), t + 1), CAST(leaf AS INT) + 1))"
        mean = F.expr(f"aggregate({picked}, 0D, (a, v) -> a + v) / {n}")
        out.append(F.when(ok, mean).alias(f"{model.prefix}_{q}"))
    return data.select(*matrix.columns, *out)
