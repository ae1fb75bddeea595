"""Pluggable text models, memoised scoring, and metrics by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_key
from .metrics import labels as label_metrics
from .metrics import overlap, similarity


def text_model(fn: Callable, schema: str, batch_size: int = 256) -> Callable[[DataFrame], DataFrame]:
    """Wrap a batch function as a job over rows (key, text).

    ``fn`` takes a list of texts and returns one tuple per text, matching ``schema``.
    """
    names = [f.strip().split()[0].strip("`") for f in _fields(schema)]

    def run(df: DataFrame) -> DataFrame:
        def batches(frames):
            import pandas as pd

            for frame in frames:
                for start in range(0, len(frame), batch_size):
                    part = frame.iloc[start : start + batch_size]
                    rows = fn(part["text"].tolist())
                    out = pd.DataFrame(list(rows), columns=names)
                    out.insert(0, "key", part["key"].to_numpy())
                    yield out

        return df.select("key", "text").mapInPandas(batches, f"key string, {schema}")

    return run


def _fields(schema: str) -> list[str]:
    depth, start, out = 0, 0, []
    for i, ch in enumerate(schema):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def memoized(df: DataFrame, text: str, model: Callable[[DataFrame], DataFrame], cache: str) -> DataFrame:
    """Add a model's outputs, running it only on distinct texts missing from the cache table.

    New results are appended to ``cache`` (Parquet); a failed job leaves it unchanged.
    """
    spark = df.sparkSession
    keyed = df.withColumn("key", text_key(text))
    wanted = keyed.groupBy("key").agg(F.first(text).alias("text"))
    try:
        known = spark.read.parquet(cache)
        wanted = wanted.join(known.select("key"), "key", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    model(wanted).write.mode("append").parquet(cache)
    # Runs at the same time may have stored a text twice.
    return keyed.join(spark.read.parquet(cache).dropDuplicates(["key"]), "key").drop("key")


def _mean_row(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in df.columns if c != "pair_id"])


# Metric name -> function(pairs, **options) giving (pair_id, score columns).
METRICS: dict[str, Callable] = {}


def register_metric(name: str, fn: Callable) -> None:
    METRICS[name] = fn


for _n in (1, 2, 3, 4):
    register_metric(f"BLEU-{_n}", lambda pairs, n=_n: overlap.bleu(pairs, n).select("pair_id", f"bleu_{n}"))
for _n in (1, 2):
    register_metric(f"ROUGE-{_n}", lambda pairs, n=_n: overlap.rouge_n(pairs, (n,)))
register_metric("ROUGE-L", lambda pairs: overlap.rouge_l(pairs))
register_metric("ROUGE-Lsum", lambda pairs: overlap.rouge_lsum(pairs))
# Metrics over a model's outputs, which are given as options: labels(pair_id, class, y_true,
# y_pred), entities and items as in ``similarity``, or an extractor and an encoder.
register_metric("CheXbert", lambda pairs, labels: _of_pairs(pairs, label_metrics.label_accuracy(labels, "pair_id")[1], "chexbert"))
register_metric("RadGraph", lambda pairs, entities: _of_pairs(pairs, similarity.entity_rewards(entities, pairs), "radgraph"))
register_metric("RaTEScore", lambda pairs, items, affinity: _of_pairs(pairs, similarity.entity_affinity_f1(items, pairs, affinity), "ratescore"))
register_metric(
    "CXRFEScore",
    lambda pairs, extractor, encoder, folder=None: _of_pairs(pairs, similarity.fact_score(pairs, extractor, encoder, folder), "cxrfescore"),
)


def _of_pairs(pairs: DataFrame, scores: DataFrame, prefix: str) -> DataFrame:
    """One row per pair, its score columns named after the metric; null where there is none."""
    named = scores.select("pair_id", *[F.col(c).alias(f"{prefix}_{c}") for c in scores.columns if c != "pair_id"])
    return pairs.select("pair_id").join(named, "pair_id", "left")


def drop_empty_refs(pairs: DataFrame) -> DataFrame:
    """Pairs whose reference holds more than white space."""
    from ..functions.text import strip

    return pairs.where(strip("ref") != "")


def compute_metrics(pairs: DataFrame, config: list[str] | dict[str, dict]) -> DataFrame:
    """One column per score of each named metric, joined on the pair.

    BLEU and ROUGE-N orders that are asked for together share one pass.
    """
    options = dict.fromkeys(config) if not isinstance(config, dict) else config
    unknown = [m for m in options if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    left = dict(options)
    frames = []
    plain_bleu = [m for m in left if m.startswith("BLEU-") and not left[m]]
    if len(plain_bleu) > 1:
        top = max(int(m.split("-")[1]) for m in plain_bleu)
        frames.append(overlap.bleu(pairs, top).select("pair_id", *[f"bleu_{m.split('-')[1]}" for m in plain_bleu]))
        left = {m: o for m, o in left.items() if m not in plain_bleu}
    plain_rouge = [m for m in left if m in ("ROUGE-1", "ROUGE-2") and not left[m]]
    if len(plain_rouge) > 1:
        frames.append(overlap.rouge_n(pairs, tuple(sorted(int(m[-1]) for m in plain_rouge))))
        left = {m: o for m, o in left.items() if m not in plain_rouge}
    frames += [METRICS[m](pairs, **(o or {})) for m, o in left.items()]
    out = pairs.select("pair_id")
    for f in frames:
        out = out.join(f, "pair_id")
    return out


def summarize(scores: DataFrame) -> DataFrame:
    """Mean of every per-pair score."""
    return _mean_row(scores)
