"""Report labels and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_class(col, mode: str) -> Column:
    """Label of a predicted class id (0 blank, 1 positive, 2 negative, 3 uncertain).

    binary: positive and uncertain count as 1. tristate: 1, 0, -1 or null.
    """
    c = F.col(col) if isinstance(col, str) else col
    if mode == "binary":
        return F.when(c.isin(1, 3), 1).otherwise(0)
    if mode == "tristate":
        return F.when(c == 1, 1).when(c == 2, 0).when(c == 3, -1)
    raise ValueError(f"unknown mode: {mode}")


def merge_labels(sentences: DataFrame, report: str, classes: list[str], none_class: str) -> DataFrame:
    """Sentence labels to report labels.

    A class is 1 if any sentence has it. The no-finding class is 1 unless a sentence
    has 0 there; a report without sentences (one row of nulls) is 1 as well.
    """
    merged = [
        F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in classes if c != none_class
    ]
    none = F.coalesce(F.min((F.col(none_class) != 0).cast("int")), F.lit(1)).alias(none_class)
    return sentences.groupBy(report).agg(*merged, none)


def label_accuracy(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Element accuracy overall and per report, from rows (key, class, y_true, y_pred)."""
    same = F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy")
    return df.agg(same), df.groupBy(key).agg(same)


def _ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def _scores(df: DataFrame) -> DataFrame:
    """precision, recall, f1 from tp, fp, fn; 0 wherever a ratio is undefined."""
    df = df.withColumns({"__p": F.col("tp") + F.col("fp"), "__r": F.col("tp") + F.col("fn")})
    df = df.withColumns(
        {
            "precision": _ratio("tp", "__p"),
            "recall": _ratio("tp", "__r"),
            "f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)),
            "support": F.col("__r"),
        }
    )
    return df.drop("__p", "__r")


def _counts() -> list[Column]:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return [
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
    ]


def class_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and support per group."""
    return _scores(df.groupBy(*by).agg(*_counts()))


def classification_report(df: DataFrame, key: str, label: str = "class") -> DataFrame:
    """(label, precision, recall, f1, support): one row per class and the micro,
    macro, weighted and samples averages."""
    out = ["precision", "recall", "f1", "support"]
    per_class = class_scores(df, [label])
    micro = _scores(per_class.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    support = F.sum("support").alias("support")
    macro = per_class.agg(*[F.avg(c).alias(c) for c in out[:3]], support)
    weighted = per_class.agg(
        *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c) for c in out[:3]],
        support,
    )
    per_sample = class_scores(df, [key]).agg(*[F.avg(c).alias(c) for c in out[:3]], support)
    report = per_class.select(F.col(label).alias("label"), *out)
    for name, rows in (("micro avg", micro), ("macro avg", macro), ("weighted avg", weighted), ("samples avg", per_sample)):
        report = report.unionByName(rows.select(F.lit(name).alias("label"), *out))
    return report
