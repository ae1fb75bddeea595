"""Counts, rates and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def phrase_stats(df: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """Per split: distinct images, phrases, categories, (image, phrase) pairs; pairs per category."""
    pairs = df.select(split, "dicom_id", "label_text", "category_name").distinct()
    overall = pairs.groupBy(split).agg(
        F.countDistinct("dicom_id").alias("num_images"),
        F.countDistinct("label_text").alias("num_phrases"),
        F.countDistinct("category_name").alias("num_categories"),
        F.countDistinct("dicom_id", "label_text").alias("num_instances"),
    )
    return overall, pairs.groupBy(split, "category_name").agg(F.count("*").alias("num_instances"))


def instance_stats(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per split: distinct images, phrases and groups, number of rows; rows per group."""
    overall = df.groupBy("split").agg(
        F.countDistinct("image_key").alias("num_images"),
        F.countDistinct("phrase").alias("num_phrases"),
        F.countDistinct("category").alias("num_label_groups"),
        F.count("*").alias("num_instances"),
    )
    return overall, df.groupBy("split", "category").agg(F.count("*").alias("num_instances"))




def location_stats(df: DataFrame, by: str = "location") -> DataFrame:
    """Counts and percentages per location of boxes, mini-reports, abnormalities and devices."""
    counts = {
        "with_box": F.col("has_box"),
        "without_box": ~F.col("has_box"),
        "with_report": F.col("has_report"),
        "without_report": ~F.col("has_report"),
        "abnormal": F.col("abnormality") == "yes",
        "not_abnormal": F.col("abnormality") == "no",
        "with_devices": F.col("devices") == "yes",
        "without_devices": F.col("devices") == "no",
        "missing_both": ~F.col("has_box") & ~F.col("has_report"),
    }
    out = df.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    return out.withColumns({f"{n}_pct": F.col(n) / F.col("total") * 100 for n in counts})


def combined(metric_weights: dict[str, float], columns: dict[str, str] | None = None) -> Column:
    """Weighted sum of metric columns; null as soon as one is null."""
    columns = columns or {}
    out = None
    for name, w in metric_weights.items():
        term = F.col(columns.get(name, name)) * F.lit(float(w))
        out = term if out is None else out + term
    return out


def metric_sums(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Sums and counts per dataset and category, from which all means follow."""
    return df.groupBy("dataset", "category").agg(
        *[f for m in metrics for f in (F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"))], F.count("*").alias("size")
    )


def means_of(sums: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Metric means and sizes per group of ``metric_sums``."""
    return sums.groupBy(*by).agg(
        *[F.try_divide(F.sum(f"sum_{m}"), F.sum(f"n_{m}")).alias(m) for m in metrics], F.sum("size").alias("size")
    )


def dataset_metrics(df: DataFrame, metric_weights: dict[str, float]) -> DataFrame:
    """Mean of each metric, their weighted sum and the number of rows per dataset."""
    means = df.groupBy("dataset").agg(*[F.avg(m).alias(m) for m in metric_weights], F.count("*").alias("size"))
    return means.withColumn("combined", combined(metric_weights))


def category_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric per dataset and category."""
    rows = df.where(F.col("category").isNotNull())
    return rows.groupBy("dataset", "category").agg(*[F.avg(m).alias(m) for m in metrics])


def prompt_type_metrics(df: DataFrame) -> DataFrame:
    """Location means over all prompts, shown per prompt type with the metric that applies.

    locate shows IoU, describe the text score, locate_and_describe both. A prompt of no
    type is an error.
    """
    rows = df.withColumn("subtask", text.prompt_type("prompt", strict=True))
    # One pass: means per location come from sums per (location, prompt type).
    parts = rows.groupBy("dataset", "category", "subtask").agg(
        F.sum("bbox_iou").alias("si"), F.count("bbox_iou").alias("ni"),
        F.sum("text_score").alias("st"), F.count("text_score").alias("nt"),
    )
    means = parts.groupBy("dataset", "category").agg(
        F.try_divide(F.sum("si"), F.sum("ni")).alias("iou"), F.try_divide(F.sum("st"), F.sum("nt")).alias("score")
    )
    return parts.select("dataset", "category", "subtask").join(means, ["dataset", "category"]).select(
        "dataset", "subtask", "category",
        F.when(F.col("subtask") != "describe", F.col("iou")).alias("bbox_iou"),
        F.when(F.col("subtask") != "locate", F.col("score")).alias("text_score"),
    )


def overall_metrics(metrics: DataFrame, metric_weights: dict[str, float]) -> DataFrame:
    """Size-weighted mean of the dataset means; datasets without a metric are skipped for it."""
    n = F.col("size")
    means = metrics.agg(
        *[
            F.try_divide(F.sum(F.col(m) * n), F.sum(F.when(F.col(m).isNotNull(), n)).cast("double")).alias(m)
            for m in metric_weights
        ]
    )
    return means.withColumn("combined", combined(metric_weights))


def weighted_score(df: DataFrame, weights: dict[str, float], name: str = "weighted_score") -> DataFrame:
    """Add sum(metric * weight) / sum(weight)."""
    total = sum(weights.values())
    if total == 0:
        raise ValueError("total weight cannot be zero")
    return df.withColumn(name, combined(weights) / F.lit(float(total)))


def flatten_metrics(df: DataFrame, report: str | None = None) -> DataFrame:
    """Struct columns become <name>_<field>; the classification report gives macro and micro F1."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name == report:
            out += [c["macro_avg"]["f1"].alias("macro_f1"), c["micro_avg"]["f1"].alias("micro_f1")]
        elif field.dataType.typeName() == "struct":
            out += [c[n].alias(f"{field.name}_{n}") for n in field.dataType.names]
        else:
            out.append(c)
    return df.select(*out)


def sampling_audit(df: DataFrame, window: int) -> DataFrame:
    """Samples per step window, dataset and category."""
    start = (F.floor(F.col("global_step") / window) * window).cast("bigint")
    return df.groupBy(start.alias("window_start"), "dataset_name", "category").agg(F.count("*").alias("n"))


def skip_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows per skip reason; kept rows have a null reason."""
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def hallucination_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of generated reports with hallucinated or correct content and contradictions."""

    def rate(c, value="yes"):
        return F.avg((F.col(c) == value).cast("double"))

    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        rate("gen_has_hallucinated_abnormalities").alias("hallucinated_abnormalities"),
        rate("gen_has_hallucinated_devices").alias("hallucinated_devices"),
        rate("nli_status", "contradiction").alias("contradictions"),
    )


def relative_reduction(rates: DataFrame, by: list[str], run: str, baseline: str, candidate: str, rate: str) -> DataFrame:
    """1 - candidate / baseline of a rate, per group; null where the baseline is 0."""
    sides = rates.groupBy(*by).agg(
        F.max(F.when(F.col(run) == baseline, F.col(rate))).alias("baseline"),
        F.max(F.when(F.col(run) == candidate, F.col(rate))).alias("candidate"),
    )
    return sides.withColumn("reduction", F.lit(1.0) - F.try_divide(F.col("candidate"), F.col("baseline")))


def metric_report_tables(df: DataFrame, metrics: list[str], key: str) -> DataFrame:
    """Long table (key, metric, value) of scalar metric columns, for plotting."""
    return df.unpivot([key], metrics, "metric", "value")
