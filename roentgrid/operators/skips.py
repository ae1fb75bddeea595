"""Skipped rows by reason, counted while a builder's own jobs run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def verdict(reasons: dict[str, Column]) -> Column:
    """The first reason whose condition holds; null for rows that are kept."""
    return F.coalesce(*[F.when(condition, F.lit(reason)) for reason, condition in reasons.items()])


class Skips:
    """Collects the counts of the builders it is given to.

    The counts ride along with the rows as observed metrics, so there is no second pass.
    They are there once an action has run on what a builder returned; ``counts`` waits
    for it. A builder that runs in several actions reports the first.
    """

    def __init__(self):
        self.observed: dict[str, tuple[Observation, list[str]]] = {}

    def keep(self, df: DataFrame, builder: str, reasons: dict[str, Column]) -> DataFrame:
        """Rows without a reason; the others are counted under the builder's name."""
        if builder in self.observed:
            raise ValueError(f"{builder} is counted already")
        seen = Observation(f"{builder}-{uuid.uuid4().hex}")
        self.observed[builder] = (seen, list(reasons))
        judged = df.withColumn("__skip", verdict(reasons))
        counts = [F.count_if(F.col("__skip") == reason).alias(f"n{i}") for i, reason in enumerate(reasons)]
        judged = judged.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
        return judged.where(F.col("__skip").isNull()).drop("__skip")

    def counts(self) -> list[tuple[str, str | None, int]]:
        """(builder, reason, rows), kept rows under a null reason; reasons without rows are left out."""
        out = []
        for builder, (seen, reasons) in self.observed.items():
            got = seen.get
            skipped = [(builder, reason, got[f"n{i}"]) for i, reason in enumerate(reasons)]
            out += [(builder, None, got["rows"] - sum(n for _, _, n in skipped)), *skipped]
        return [line for line in out if line[2]]

    def table(self, spark: SparkSession) -> DataFrame:
        """The counts as a table, one row for each builder and reason."""
        return spark.createDataFrame(self.counts(), "builder string, reason string, n bigint")


def kept(df: DataFrame, skips: Skips | None, builder: str, reasons: dict[str, Column]) -> DataFrame:
    """Rows without a reason, counted if ``skips`` is given."""
    if skips is not None:
        return skips.keep(df, builder, reasons)
    return df.where(verdict(reasons).isNull())
