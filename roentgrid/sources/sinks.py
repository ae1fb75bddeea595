"""Sinks: JSONL, quarantine, generations cache, run partitions, metric and snapshot logs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables under a folder that all executors share.

    That is the session's ``spark.checkpoint.dir`` or, where none is named, its warehouse.
    On a cluster one of the two must be set.
    """
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", "") or conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local") and not conf.contains("spark.sql.warehouse.dir"):
            raise ValueError("set spark.checkpoint.dir or spark.sql.warehouse.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table and read it back: later steps neither recompute it nor lose it with an executor."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_jsonl(df: DataFrame, path: str, mode: str = "append", **options) -> None:
    """One JSON object per line, null fields kept, text written as UTF-8; options are those of Spark's writer."""
    df.write.mode(mode).options(**{"ignoreNullFields": "false"} | options).json(path)


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error; the latter as (entry JSON, error)."""
    entry = F.to_json(F.struct(*[c for c in df.columns if c != error]))
    ok = df.where(F.col(error).isNull()).drop(error)
    return ok, df.where(F.col(error).isNotNull()).select(entry.alias("entry"), error)


def write_with_quarantine(df: DataFrame, path: str, error_path: str, error: str = "error") -> None:
    """Append good rows to one log and failed rows to another."""
    ok, bad = split_errors(df, error)
    write_jsonl(ok, path)
    write_jsonl(bad, error_path)


def write_generations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(predictions, references, image_paths array) as CSV with the paths as a JSON list."""
    out = df.select("predictions", "references", F.to_json("image_paths").alias("image_paths"))
    out.write.mode(mode).csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def run_tag(model, revision, revisioned: str = "maira-2") -> Column:
    """Revision for models that carry one in their name, else 'base'."""
    m = F.col(model) if isinstance(model, str) else model
    r = F.col(revision) if isinstance(revision, str) else revision
    return F.when(m.contains(revisioned) & r.isNotNull() & (r != ""), r).otherwise("base")


def run_name(model, revision, adapter, dataset, split, task=None) -> Column:
    """Folder name of an evaluation run.

    With an adapter: <checkpoint>-on-<dataset>-<split>[-task]; otherwise
    <safe model>-<tag>-on-<dataset>-<split>[-task].
    """
    model, revision, adapter, dataset, split = [
        F.col(x) if isinstance(x, str) else x for x in (model, revision, adapter, dataset, split)
    ]
    task = F.lit(None).cast("string") if task is None else (F.col(task) if isinstance(task, str) else task)
    suffix = F.when(task.isNotNull() & (task != ""), F.concat(F.lit("-"), task)).otherwise("")
    plain = F.concat(safe_name(model), F.lit("-"), run_tag(model, revision))
    checkpoint = F.element_at(F.split(adapter, "/"), -1)
    head = F.when(adapter.isNotNull() & (adapter != ""), checkpoint).otherwise(plain)
    return F.concat(head, F.lit("-on-"), dataset, F.lit("-"), split, suffix)


def write_runs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Results partitioned by model, run tag, dataset, split and task."""
    out = df.withColumns({"run_tag": run_tag("model", "revision"), "model": safe_name("model")})
    out.write.mode(mode).partitionBy("model", "run_tag", "dataset", "split", "task").parquet(path)


def metrics_log(df: DataFrame, step: str, metrics: list[str], step_metric: str = "train/global_step") -> DataFrame:
    """Rows (value) holding {step_metric, step, metrics} as one JSON line each."""
    line = F.struct(
        F.lit(step_metric).alias("step_metric"),
        F.col(step).cast("bigint").alias("step"),
        F.struct(*[F.col(m) for m in metrics]).alias("metrics"),
    )
    return df.select(F.to_json(line).alias("value"))


def append_metrics_log(df: DataFrame, path: str, step: str, metrics: list[str]) -> None:
    metrics_log(df, step, metrics).write.mode("append").text(path)


def eval_snapshot(results: DataFrame, step: int | Column) -> DataFrame:
    """Evaluation rows stamped with their step and time."""
    step = F.lit(step) if isinstance(step, int) else step
    return results.withColumns({"global_step": step.cast("bigint"), "timestamp": F.current_timestamp()})


def append_eval_snapshot(results: DataFrame, weights: DataFrame, step: int, path: str) -> None:
    """Store the results and the weights of one evaluation, partitioned by step; a step that is run again replaces its own."""
    for rows, name in ((results, "results"), (weights, "weights")):
        out = eval_snapshot(rows, step).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("global_step").parquet(os.path.join(path, name))
