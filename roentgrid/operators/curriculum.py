"""Error-driven sampling weights from evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sampling, stats

EPSILON = 1e-6


def _performance(metric_weights: dict[str, float]) -> Column:
    """Weighted sum if every metric is there, else the one that is."""
    return F.coalesce(stats.combined(metric_weights), *metric_weights)


def _error(metric_weights: dict[str, float]) -> Column:
    error = F.lit(1.0) - _performance(metric_weights)
    return F.when(error <= 0, F.lit(0.01)).otherwise(error)


def _normalised(df: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*(by or [F.lit(0)]))
    total = F.sum("error").over(w)
    weight = F.when(total > EPSILON, F.col("error") / total).otherwise(F.lit(1.0) / F.count("*").over(w))
    return df.withColumn("weight", weight)


def _checked(error: Column, what: str) -> Column:
    return F.coalesce(error, F.raise_error(F.concat(F.lit("no metrics for "), F.col(what))).cast("double"))


def dataset_weights(metrics: DataFrame, metric_weights: dict[str, float]) -> DataFrame:
    """(dataset, error, weight): share of the total error; a dataset without metrics is an error."""
    rows = metrics.withColumn("error", _checked(_error(metric_weights), "dataset"))
    return _normalised(rows, []).select("dataset", "error", "weight")


def category_weights(metrics: DataFrame, metric_weights: dict[str, float]) -> DataFrame:
    """(dataset, subtask, category, error, weight) within each dataset and subtask.

    A metric must exist for all categories of a group or for none.
    """
    by = ["dataset", "subtask"]
    if "subtask" not in metrics.columns:
        metrics = metrics.withColumn("subtask", F.lit(None).cast("string"))
    w = Window.partitionBy(*by)
    rows = metrics.withColumn("error", _checked(_error(metric_weights), "category"))
    for m in metric_weights:
        present = F.count(m).over(w)
        ok = (present == 0) | (present == F.count("*").over(w))
        rows = rows.withColumn("error", F.when(ok, F.col("error")).otherwise(F.raise_error(F.lit(f"{m} is missing for some categories")).cast("double")))
    return _normalised(rows, by).select(*by, "category", "error", "weight")


def clamp_weights(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights at or below 0 become 0.01, those above 1 become 1."""
    w = F.col(weight)
    return df.withColumn(weight, F.when(w <= 0, F.lit(0.01)).when(w > 1, F.lit(1.0)).otherwise(w))


def apply_weights(
    instances: DataFrame, dataset_w: dict | DataFrame | None, category_w: dict[str, dict] | DataFrame | None, n: int, key: list[str], seed=0
) -> DataFrame:
    """Sequence of n instances under the new weights; a missing level or class has weight 1.

    Weights are tables (dataset, weight) and (dataset, category, weight) or dictionaries.
    Categories belong to ``dataset``; give the anatomy corpus one dataset name per
    subtask with equal weights, as its subtasks are never re-weighted.
    """
    spark = instances.sparkSession
    if isinstance(dataset_w, dict):
        dataset_w = sampling.weight_table(spark, dataset_w, "dataset")
    if isinstance(category_w, dict):
        rows = [(d, c, float(x)) for d, w in category_w.items() for c, x in w.items()]
        category_w = spark.createDataFrame(rows, "dataset string, category string, weight double")
    groups = instances.select("dataset", "category").distinct()
    outer = _with_weights(groups.select("dataset").distinct(), dataset_w, ["dataset"])
    inner = _with_weights(groups, category_w, ["dataset", "category"])
    return sampling.nested_sequence(instances, outer, inner, "dataset", "category", key, n, seed)


def _with_weights(classes: DataFrame, weights: DataFrame | None, by: list[str]) -> DataFrame:
    if weights is None:
        return classes.withColumn("weight", F.lit(1.0))
    found = weights.select(F.struct(*by).alias("__g"), "weight")
    return classes.withColumn("__g", F.struct(*by)).join(found, "__g", "left").select(*by, F.coalesce("weight", F.lit(1.0)).alias("weight"))


def curriculum_weights(scored: DataFrame, metric_weights: dict[str, float], step: int) -> DataFrame:
    """One evaluation's weights in long form (global_step, dataset, subtask, category, weight).

    scored(dataset, category, one column per metric). Dataset rows have a null category.
    """
    metrics = list(metric_weights)
    # Both levels read the same sums, so the scored rows are aggregated once.
    sums = stats.metric_sums(scored, metrics)
    per_dataset = dataset_weights(stats.means_of(sums, ["dataset"], metrics), metric_weights)
    in_category = stats.means_of(sums.where(F.col("category").isNotNull()), ["dataset", "category"], metrics)
    per_category = category_weights(in_category, metric_weights)
    none = F.lit(None).cast("string")
    both = per_dataset.select("dataset", none.alias("subtask"), none.alias("category"), "weight").unionByName(
        per_category.select("dataset", "subtask", "category", "weight")
    )
    return clamp_weights(both).select(F.lit(step).cast("bigint").alias("global_step"), "*")


def curriculum_step(scored: DataFrame, metric_weights: dict[str, float], step: int, every: int, path: str) -> DataFrame | None:
    """Store this evaluation's weights in the history; return them when due for use.

    A step that is run again replaces its weights.
    """
    weights = curriculum_weights(scored, metric_weights, step)
    weights.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("global_step").parquet(path)
    if step % every:
        return None
    return scored.sparkSession.read.parquet(path).where(F.col("global_step") == step)
