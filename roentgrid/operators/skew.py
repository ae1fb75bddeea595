"""Ranks, running totals and grouped lists that hold up when one group is huge.

A plain window puts a whole group into one task. Here each group is cut into
ordered buckets: totals per bucket are pre-aggregated before the shuffle, a small
window adds up the buckets in front, and the row-level window only ever sees one
bucket of one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 16
# Items in one part of a list.
PART_ROWS = 4096


def _cols(names):
    return [F.col(n) for n in names]


def shuffle_partitions(df: DataFrame) -> int:
    """Configured number of shuffle partitions.

    Given explicitly to ``repartition``, it keeps adaptive execution from merging
    partitions that are small on the wire but expensive to process.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordinal_bucket(col, rows: int = BUCKET_ROWS) -> Column:
    """Bucket of a unique integer ordinal: at most ``rows`` rows each, in order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / rows).cast("bigint")


def running_totals(
    df: DataFrame, by: list[str], order: list, bucket: Column, at_most: int | DataFrame | None = None, few: bool = False, **values: Column
) -> DataFrame:
    """Add inclusive running sums within ``by`` along ``order``.

    ``bucket`` must never decrease along ``order``; together with ``by`` it bounds
    the rows a single window task sees. ``at_most`` (a number, or a table of group
    struct ``__rt_group`` and ``__limit``) drops the buckets in front of which the
    first sum has reached the limit already: their rows are never shuffled. ``few``
    states that the buckets left are few enough to broadcast.
    """
    # A struct key lets null group values match each other in a plain equi-join, so
    # the join and the window below share one partitioning.
    group = F.struct(*_cols(by)) if by else F.lit(0)
    base = df.withColumns({"__rt_group": group, "__rt_bucket": bucket, **{f"__v_{n}": v for n, v in values.items()}})
    keys = ["__rt_group", "__rt_bucket"]
    totals = base.groupBy(*keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = Window.partitionBy("__rt_group").orderBy("__rt_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in values]
    )
    first = F.col(f"__o_{next(iter(values))}")
    if isinstance(at_most, int):
        offsets = offsets.where(first < at_most)
    elif at_most is not None:
        limits = F.broadcast(at_most) if few else at_most
        offsets = offsets.join(limits, "__rt_group").where(first < F.col("__limit")).drop("__limit")
    if few:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = base.join(offsets, keys)
    out = out.withColumns({n: F.sum(f"__v_{n}").over(inside) + F.col(f"__o_{n}") for n in values})
    return out.drop(*keys, *[f"__v_{n}" for n in values], *[f"__o_{n}" for n in values])


def group_rank(
    df: DataFrame, by: list[str], order: list, bucket: Column, name: str = "rank", at_most: int | DataFrame | None = None, few: bool = False
) -> DataFrame:
    """Row number from 1 within ``by`` along ``order``; rows far beyond ``at_most`` may be dropped."""
    return running_totals(df, by, order, bucket, at_most, few, **{name: F.lit(1).cast("bigint")})


def collect_parts(
    df: DataFrame,
    by: list[str],
    ordinal: str,
    value: Column,
    part_size: int = PART_ROWS,
    name: str = "items",
    first: dict[str, str] | None = None,
    bucket: Column | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Ordered lists per group, in parts of at most ``part_size`` items.

    Gives (by..., part, n_parts, items). Ordinary groups have a single part 0; a larger
    one continues in parts 1, 2, ... and stays whole. ``ordinal`` must be unique within
    a group (an integer, unless ``bucket`` is given). ``first`` maps output names to
    columns whose value at the lowest ordinal is kept per group. ``groups`` (by..., values)
    is a table with one row for each group that is wanted; its values come with every part.

    All groups go the same way: one narrow row per group and bucket gives the items in
    front of the bucket, rows are ranked inside their bucket and listed part by part.
    """
    first = first or {}
    keys = ["__g", "__b"]
    base = df.select(
        F.struct(*_cols(by)).alias("__g"), (ordinal_bucket(ordinal) if bucket is None else bucket).alias("__b"),
        F.col(ordinal).alias("__o"), value.alias("__v"), *[F.col(c).alias(f"__f_{n}") for n, c in first.items()],
    )
    heads = base.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.min_by(f"__f_{n}", "__o").alias(f"__f_{n}") for n in first])
    group = Window.partitionBy("__g")
    offsets = heads.select(
        *keys, (F.sum("__n").over(group.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(group).alias("__all"),
        *[F.first_value(f"__f_{n}").over(group.orderBy("__b")).alias(f"__f_{n}") for n in first],
    )
    given = [c for c in groups.columns if c not in by] if groups is not None else []
    if groups is not None:
        known = groups.select(F.struct(*_cols(by)).alias("__g"), *[F.col(c).alias(f"__x_{c}") for c in given])
        offsets = offsets.join(known, "__g")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__o")) - 1 + F.col("__before")
    ranked = base.select(*keys, "__o", "__v").join(offsets, keys).withColumn("__rank", rank)
    listed = F.array_sort(F.collect_list(F.struct(F.col("__rank").alias("o"), F.col("__v").alias("v"))))
    parts = ranked.groupBy("__g", F.floor(F.col("__rank") / part_size).cast("bigint").alias("part")).agg(
        F.ceil(F.first("__all") / part_size).cast("bigint").alias("n_parts"),
        F.transform(listed, lambda x: x["v"]).alias(name), *[F.first(f"__f_{n}").alias(n) for n in first],
        *[F.first(f"__x_{c}").alias(c) for c in given],
    )
    return parts.select(*[F.col("__g")[c].alias(c) for c in by], "part", "n_parts", name, *first, *given)


def draws(df: DataFrame, by: list[str], count: str, name: str = "draw", block: int = 1 << 12) -> DataFrame:
    """One row per draw 0..count-1 of each input row, generated block by block.

    ``by`` identifies the input row; blocks are spread over the tasks.
    """
    step = F.lit(block).cast("bigint")
    starts = df.where(F.col(count) > 0).withColumn(
        "__start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1, step))
    )
    ends = F.least(F.col(count) - 1, F.col("__start") + block - 1)
    return (
        starts.repartition(shuffle_partitions(df), *_cols(by), "__start")
        .withColumn(name, F.explode(F.sequence(F.col("__start"), ends)))
        .drop("__start")
    )
