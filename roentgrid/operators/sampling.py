"""Reproducible sampling, ordering, schedules and top-k.

Randomness is an md5 of (seed, row key), so a sample does not depend on the
partitioning. A row drawn several times comes once with its number of ``copies``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, hash_int, hash_order
from ..sources.sinks import stored
from .skew import draws, group_rank

# Sequence positions a single data row may serve before it is replicated.
MAX_FAN_OUT = 1 << 16
# Most rows of a table of quotas that is broadcast.
MAX_BROADCAST = 1 << 17


def hash_rank(df: DataFrame, by: list[str], key: list[str], seed, name: str = "rank", at_most=None, few: bool = False) -> DataFrame:
    """Rank from 1 within ``by`` in hash order of the row key.

    Without groups there are only as many buckets as hash prefixes, which is few.
    """
    df = df.withColumn("__h", hash_order(seed, *key))
    bucket = hash_bucket(F.col("__h"))
    return group_rank(df, by, ["__h", *key], bucket, name, at_most, few or not by).drop("__h")


def group_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("size"))


def _round_up(n: int, multiple: int) -> int:
    return math.ceil(n / multiple) * multiple


def uniform_quotas(sizes: DataFrame, by: list[str], n: int | Column, within: list[str] | None = None) -> DataFrame:
    """Add ``quota``: n split evenly, the first n % g groups by name getting one more.

    Windows here run over one row per group.
    """
    n = F.lit(n) if isinstance(n, int) else n
    w = Window.partitionBy(*(within or [F.lit(0)]))
    place, g = F.row_number().over(w.orderBy(*by)), F.count("*").over(w)
    quota = F.floor(n / g) + F.when(place <= n % g, 1).otherwise(0)
    return sizes.withColumn("quota", quota.cast("bigint"))


def waterfill_quotas(sizes: DataFrame, by: list[str], n: int, multiple_of: int = 1) -> DataFrame:
    """Add ``quota``: levels filled over all groups, smallest first, until n is reached.

    At least one per group and a multiple of ``multiple_of``. Beyond the population
    every group gives all it has and the excess is spread evenly.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = every.orderBy("size", *by)
    g = F.count("*").over(every)
    target = F.ceil(F.greatest(F.lit(n), g) / multiple_of) * multiple_of
    s = sizes.select(
        "*",
        target.cast("bigint").alias("target"),
        g.alias("groups"),
        F.sum("size").over(every).alias("total"),
        F.row_number().over(ranked).alias("by_size"),
        F.row_number().over(every.orderBy(*by)).alias("by_name"),
        F.coalesce(F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
    )
    # Groups up to a size are used up; from the first group that is not, the rest of
    # the target is one level for all, plus one for the first few.
    left = F.col("groups") - F.col("by_size") + 1
    s = s.withColumn("open", F.col("below") + left * F.col("size") > F.col("target"))
    s = s.withColumns(
        {
            "first_open": F.min(F.when(F.col("open"), F.col("by_size"))).over(every),
            "rest": F.min(F.when(F.col("open"), F.struct("by_size", (F.col("target") - F.col("below")).alias("rest")))).over(every)["rest"],
        }
    )
    open_groups = F.col("groups") - F.col("first_open") + 1
    level = F.floor(F.col("rest") / open_groups)
    extra = F.when(F.col("by_size") - F.col("first_open") < F.col("rest") % open_groups, 1).otherwise(0)
    excess = F.col("target") - F.col("total")
    over = F.floor(excess / F.col("groups")) + F.when(F.col("by_name") <= excess % F.col("groups"), 1).otherwise(0)
    quota = (
        F.when(excess > 0, F.col("size") + over)
        .when(F.col("first_open").isNull() | (F.col("by_size") < F.col("first_open")), F.col("size"))
        .otherwise(level + extra)
    )
    return s.select(*by, "size", quota.cast("bigint").alias("quota"))


def take_quotas(df: DataFrame, by: list[str], key: list[str], quotas: DataFrame, seed, total: int | None = None) -> DataFrame:
    """Draw each group's quota; ``copies`` exceeds 1 only where the group is too small.

    At most ``total`` groups have a quota, so up to MAX_BROADCAST of them are broadcast.

    Without replacement the lowest hash ranks are taken; with replacement every draw
    picks a hashed rank.
    """
    q = quotas.where(F.col("quota") > 0).select(
        F.struct(*by).alias("__g"), F.col("size").alias("__size"), F.col("quota").alias("__quota")
    )
    # Every bucket up to a quota holds a row of the quota, so the buckets that matter
    # number at most total plus one per group.
    few = total is not None and 2 * total <= MAX_BROADCAST
    near = F.broadcast(q) if few else q
    short = draws(q.where(F.col("__quota") > F.col("__size")), ["__g"], "__quota")
    pick = hash_int(hash_order(seed, F.lit("draw"), *[F.col("__g")[c] for c in by], "draw")) % F.col("__size") + 1
    picks = short.groupBy("__g", pick.alias("__rank")).agg(F.count("*").alias("__copies"))
    limits = q.select(F.col("__g").alias("__rt_group"), F.col("__quota").alias("__limit"))
    ranked = hash_rank(df.withColumn("__g", F.struct(*by)), by, key, seed, "__rank", limits, few)
    rows = ranked.join(near, "__g").where(F.col("__rank") <= F.col("__quota"))
    rows = rows.join(picks, ["__g", "__rank"], "left")
    copies = F.when(F.col("__quota") <= F.col("__size"), F.lit(1).cast("bigint")).otherwise(F.col("__copies"))
    return rows.withColumn("copies", copies).where(F.col("copies").isNotNull()).select(*df.columns, "copies")


def expand_copies(df: DataFrame) -> DataFrame:
    """One row per copy."""
    return draws(df, df.columns, "copies", "copy").drop("copies")


def uniform_quota(df: DataFrame, n: int, by: list[str], key: list[str], seed) -> DataFrame:
    """n rows split evenly over the groups, with replacement where a group is short."""
    return take_quotas(df, by, key, uniform_quotas(group_sizes(df, by), by, n), seed, n)


def waterfill(df: DataFrame, n: int, by: list[str], key: list[str], multiple_of: int = 1, seed=0) -> DataFrame:
    """n rows by water-filling over the groups."""
    return take_quotas(df, by, key, waterfill_quotas(group_sizes(df, by), by, n, multiple_of), seed)


def random_subset(df: DataFrame, n: int, key: list[str], multiple_of: int = 1, seed=0) -> DataFrame:
    """n rows, rounded up to a multiple, without replacement; at most all rows."""
    size = _round_up(n, multiple_of)
    return hash_rank(df, [], key, seed, "__rank", size).where(F.col("__rank") <= size).drop("__rank")


def epoch_sample(df: DataFrame, batches: int, batch_size: int, key: list[str], seed=0) -> DataFrame:
    """batches * batch_size rows: without replacement if there are enough, else i.i.d."""
    whole = df.withColumn("__all", F.lit(0))
    quotas = group_sizes(whole, ["__all"]).withColumn("quota", F.lit(batches * batch_size).cast("bigint"))
    return take_quotas(whole, ["__all"], key, quotas, seed, batches * batch_size).drop("__all")


def shuffle(df: DataFrame, key: list[str], seed) -> DataFrame:
    """Add ``position``, the row's place from 0 in a seeded shuffle."""
    return hash_rank(df, [], key, seed, "position").withColumn("position", F.col("position") - 1)


def concat_shuffle(tables: list[DataFrame], key: list[str], seed) -> DataFrame:
    """All rows of all tables in one seeded shuffle (natural distribution)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return shuffle(out, key, seed)


def uniform_subset_tasks(df: DataFrame, n: int, task: str, location: str, key: list[str], multiple_of: int = 1, seed=0) -> DataFrame:
    """ceil(n / tasks) rows per task, at least one per location and a multiple, split evenly."""
    by = [task, location]
    sizes = group_sizes(df, by)
    places = F.count("*").over(Window.partitionBy(task))
    every = Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("__task_no", F.dense_rank().over(every.orderBy(task)))
    sizes = sizes.withColumn("__tasks", F.max("__task_no").over(every))
    per_task = F.greatest(F.ceil(F.lit(n) / F.col("__tasks")), places)
    sizes = sizes.withColumn("__n", F.ceil(per_task / multiple_of) * multiple_of)
    return take_quotas(df, by, key, uniform_quotas(sizes, by, F.col("__n"), [task]), seed)


# -- weighted schedules -------------------------------------------------------------------

def weight_table(spark: SparkSession, weights: dict, name: str) -> DataFrame:
    """Weights given as a dictionary, as a table (name, weight)."""
    return spark.createDataFrame([(c, float(w)) for c, w in weights.items()], f"{name} string, weight double")


def _turns_up_to(x: Column, c: Column) -> Column:
    """How many turns of class ``c`` stand in front of free place ``x`` + 1 of the places it left.

    Turn i took place floor(i * step) of those free before, so floor(i * step) - i of the places
    left are in front of it: turns count as long as that is at most x. The first turn
    beyond is (x + 1) * slots / spare, rounded up; rounding of the products can move it by one.
    """
    guess = F.ceil((x + 1) * c["slots"].cast("double") / c["spare"])
    beyond = sum((F.floor((guess + d) * c["step"]) - (guess + d) > x).cast("bigint") for d in (-1, 0, 1))
    return F.least(F.greatest(guess + 2 - beyond, F.lit(0)), c["slots"])


def _exact_sum(values: Column) -> Column:
    """Sum of an array of doubles in order, with the rounding errors added at the end.

    Slots are rounded down, so a total that is off by its last bit can cost a class a slot.
    """

    def add(a: Column, x: Column) -> Column:
        total = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - total) + x).otherwise((x - total) + a["s"])
        return F.struct(total.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, lambda a: a["s"] + a["c"])


def schedule(weights: DataFrame, name: str, within: list[str] | None = None, weight: str = "weight") -> DataFrame:
    """One period of turns: (within..., slot, name, before, per_period, period).

    Equal weights give every class one slot. Otherwise a class has max(20 w / w_min, 1)
    slots (rounded down), spread evenly over the slots still free, most frequent classes
    first, then by name; zero weights have none. ``before`` counts the earlier slots of
    the class in the period. Several schedules are made at once, one for each ``within``.

    Every turn works out its own slot: it starts from its place among the places free for
    its class and adds, for one more frequent class after the other, the turns in front of it.
    The weights of one schedule form one array; turns are spread over the tasks in blocks.
    """
    within = within or []
    group = F.struct(*within) if within else F.struct(F.lit(0).alias("all"))
    w = F.col(weight).cast("double")
    checked = F.when(w >= 0, w).otherwise(F.raise_error(F.lit("weights must be non-negative")).cast("double"))
    rows = weights.select(group.alias("__g"), F.struct(F.col(name).alias("c"), checked.alias("w")).alias("x"))
    listed = rows.groupBy("__g").agg(F.array_sort(F.collect_list("x")).alias("l")).select("__g", F.filter("l", lambda x: x["w"] > 0).alias("l"))
    none = F.raise_error(F.lit("no weight above 0")).cast(listed.schema["l"].dataType)
    listed = listed.select("__g", F.when(F.size("l") > 0, F.col("l")).otherwise(none).alias("l"))
    sums = listed.select(
        "__g", "l", _exact_sum(F.transform("l", lambda x: x["w"])).alias("total"),
        F.array_min(F.transform("l", lambda x: x["w"])).alias("least"), F.array_max(F.transform("l", lambda x: x["w"])).alias("most"),
    )

    def slots(x: Column) -> Column:
        share = F.lit(20) * (x["w"] / F.col("total")) / (F.col("least") / F.col("total"))
        return F.when(F.col("least") == F.col("most"), F.lit(1).cast("bigint")).otherwise(F.greatest(F.floor(share), F.lit(1).cast("bigint")))

    ordered = F.array_sort(F.transform("l", lambda x: F.struct((-slots(x)).alias("minus"), x["c"].alias("c"))))
    placed = sums.select("__g", F.posexplode(ordered).alias("place", "x")).select("__g", "place", F.col("x.c").alias("c"), (-F.col("x.minus")).alias("slots"))
    # One row per class.
    group_of = Window.partitionBy("__g")
    so_far = group_of.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    classes = placed.withColumns({"period": F.sum("slots").over(group_of), "spare": F.sum("slots").over(group_of) - F.sum("slots").over(so_far)})
    classes = classes.withColumn("step", (F.col("spare") + F.col("slots")) / F.col("slots"))
    above = classes.groupBy("__g").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("o"), "slots", "spare", "step"))).alias("above")
    )
    turns = draws(classes, ["__g", "c"], "slots", "before").join(above, "__g")
    more = F.slice("above", F.size("above") - F.col("place") + 1, F.col("place"))
    slot = F.aggregate(more, F.floor(F.col("before") * F.col("step")), lambda x, c: x + _turns_up_to(x, c))
    return turns.select(
        *[F.col("__g")[c].alias(c) for c in within], slot.alias("slot"), F.col("c").alias(name), "before", F.col("slots").alias("per_period"), "period"
    )


def _stored_schedule(weights: DataFrame, df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The schedules of the last column within the others, and their classes: (by..., per_period, period, size, length).

    ``length`` is that of the sequence which passes through every class. Both are stored
    tables, so their sizes are known when they are joined. A class without rows is an error.
    """
    *within, name = by
    plan = stored(schedule(weights, name, within), "schedule")
    sizes = group_sizes(df, by).select(F.struct(*by).alias("__g"), "size")
    classes = plan.where("before = 0").withColumn("__g", F.struct(*by)).join(sizes, "__g", "left")
    missing = F.raise_error(F.concat(F.lit("no rows of class "), F.to_json("__g"))).cast("bigint")
    periods = F.max(F.ceil(F.col("size") / F.col("per_period"))).over(Window.partitionBy(F.struct(*within) if within else F.lit(0)))
    classes = classes.withColumn("size", F.coalesce("size", missing)).select(*by, "per_period", "period", "size", (periods * F.col("period")).alias("length"))
    return plan, stored(classes, "classes")


def _positions(total: DataFrame) -> DataFrame:
    """Add ``position`` 0 .. n - 1 to a table of one row, block by block."""
    return draws(total, ["n"], "n", "position")


def _read_rows(positions: DataFrame, classes: DataFrame, load: Column, df: DataFrame, by: list[str], key: list[str], seed) -> DataFrame:
    # Fetch row number (turn mod size) of each class. A row of a tiny class may serve
    # very many positions: it is then replicated and its positions are spread. ``load``
    # bounds the positions of a class. Struct keys let null classes match.
    g = F.struct(*by).alias("__g")
    plan = classes.select(g, "size", F.ceil(load / F.col("size") / MAX_FAN_OUT).cast("bigint").alias("__salts"))
    at = positions.select("position", "turn", g).join(plan, "__g").select(
        "position", "__g", (F.col("turn") % F.col("size") + 1).alias("__row"),
        (F.floor(F.col("turn") / F.col("size")) % F.col("__salts")).alias("__salt"),
    )
    rows = df.withColumn("__g", g).join(plan.select("__g", "__salts"), "__g")
    ranked = hash_rank(rows, by, key, seed, "__row")
    ranked = ranked.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__salts") - 1))).drop("__salts")
    return at.join(ranked, ["__g", "__row", "__salt"]).drop("__g", "__row", "__salt")


def weighted_sequence(df: DataFrame, weights: dict | DataFrame, by: str, key: list[str], n: int | None = None, seed=0) -> DataFrame:
    """Positions 0..n-1, each filled from the class its slot is scheduled for.

    ``weights`` is a table (by, weight) or a dictionary. A class is read in hash order, over
    and over. By default n is the sequence length that passes through every class.
    """
    if isinstance(weights, dict):
        weights = weight_table(df.sparkSession, weights, by)
    plan, classes = _stored_schedule(weights, df, [by])
    length = F.max("length") if n is None else F.lit(n).cast("bigint")
    total = classes.agg(length.alias("n"), F.max("period").alias("__period"))
    positions = _positions(total).withColumn("slot", F.col("position") % F.col("__period")).join(plan, "slot")
    positions = positions.select("position", by, (F.floor(F.col("position") / F.col("period")) * F.col("per_period") + F.col("before")).alias("turn"))
    load = F.ceil((F.col("length") if n is None else F.lit(n)) / F.col("period")) * F.col("per_period")
    return _read_rows(positions, classes, load, df, [by], key, seed)


def nested_sequence(
    df: DataFrame, weights: dict | DataFrame, inner: dict[str, dict] | DataFrame, outer_by: str, inner_by: str, key: list[str], n: int, seed=0
) -> DataFrame:
    """Weighted sequence over datasets whose own rows follow weighted schedules too.

    ``weights`` holds the dataset weights (outer_by, weight), ``inner`` the category weights
    per dataset (outer_by, inner_by, weight); both may be dictionaries.
    """
    spark, by = df.sparkSession, [outer_by, inner_by]
    if isinstance(weights, dict):
        weights = weight_table(spark, weights, outer_by)
    if isinstance(inner, dict):
        rows = [(d, c, float(x)) for d, w in inner.items() for c, x in w.items()]
        inner = spark.createDataFrame(rows, f"{outer_by} string, {inner_by} string, weight double")
    outer = stored(schedule(weights, outer_by), "schedule")
    plan, classes = _stored_schedule(inner, df, by)
    o = F.struct(outer_by).alias("__o")
    lengths = classes.groupBy(o).agg(F.max("period").alias("inner_period"), F.max("length").alias("inner_length"))
    total = outer.agg(F.lit(n).cast("bigint").alias("n"), F.max("period").alias("__period"))
    positions = _positions(total).withColumn("slot", F.col("position") % F.col("__period")).join(outer, "slot")
    turn = F.floor(F.col("position") / F.col("period")) * F.col("per_period") + F.col("before")
    positions = positions.select("position", o, turn.alias("turn")).join(lengths, "__o")
    positions = positions.withColumn("at", F.col("turn") % F.col("inner_length")).select("position", "__o", "at", (F.col("at") % F.col("inner_period")).alias("slot"))
    positions = positions.join(plan.withColumn("__o", o), ["__o", "slot"])
    positions = positions.select("position", *by, (F.floor(F.col("at") / F.col("period")) * F.col("per_period") + F.col("before")).alias("turn"))
    # No class has more positions than the whole sequence.
    return _read_rows(positions, classes, F.lit(n), df, by, key, seed)


# -- evaluation samples --------------------------------------------------------------------

def _by_tier(df: DataFrame, by: list[str], tier: str, key: list[str], seed, name: str, n: int) -> DataFrame:
    # Ranks up to n within at most two groups.
    df = df.withColumn("__h", hash_order(seed, *key))
    bucket = F.concat(F.col(tier).cast("string"), hash_bucket(F.col("__h")))
    return group_rank(df, by, [tier, "__h", *key], bucket, name, n, 4 * n <= MAX_BROADCAST).drop("__h")


def _first_and_rest(df: DataFrame, first: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``first`` as tier 0 and all others as tier 1; no row but those of ``first`` has moved for it."""
    chosen = first.select(F.struct(*key).alias("__key"))
    rest = df.withColumn("__key", F.struct(*key)).join(chosen, "__key", "left_anti").drop("__key")
    return first.withColumn("__tier", F.lit(0)).unionByName(rest.withColumn("__tier", F.lit(1)))


def core_sample(df: DataFrame, n: int, key: list[str], seed=42, with_share: float = 0.70) -> DataFrame:
    """Stratified sample: a share of rows with a report, the rest without.

    Strata are (location, abnormality, devices) and (location). Each gives at most an
    equal quota; a shortfall is topped up and a surplus trimmed, both at random.
    """
    strata = ["has_report", "location", "abnormality", "devices"]
    rows = df.withColumns({c: F.when(F.col("has_report"), F.col(c)) for c in ("abnormality", "devices")})
    sizes = group_sizes(rows, strata)
    sizes = sizes.groupBy("has_report").agg(F.count("*").alias("groups"), F.sum("size").alias("rows"))
    every = Window.partitionBy(F.lit(0))
    with_rows = F.coalesce(F.max(F.when(F.col("has_report"), F.col("rows"))).over(every), F.lit(0))
    n_with = F.least(F.lit(int(n * with_share)), with_rows)
    sizes = sizes.withColumn(
        "take", F.when(F.col("has_report"), n_with).otherwise(F.least(n - n_with, F.col("rows"))).cast("bigint")
    ).withColumn("quota", F.ceil(F.col("take") / F.col("groups")).cast("bigint"))
    # One row with and one without reports.
    quotas = F.broadcast(sizes.select("has_report", "take", "quota"))
    limits = rows.select(*strata).distinct().join(quotas, "has_report").select(F.struct(*strata).alias("__rt_group"), F.col("quota").alias("__limit"))
    ranked = hash_rank(rows, strata, key, f"{seed}-stratum", "__in_stratum", limits)
    first = ranked.join(quotas, "has_report").where(F.col("__in_stratum") <= F.col("quota")).select(*rows.columns)
    ranked = _by_tier(_first_and_rest(rows, first, key), ["has_report"], "__tier", key, seed, "__rank", n)
    chosen = ranked.join(quotas, "has_report").where(F.col("__rank") <= F.col("take"))
    return chosen.select(*df.columns)


def location_core_sample(entries: DataFrame, location: str, n: int, key: list[str], image: str, seed=42) -> DataFrame:
    """Balanced sample for one location.

    n // 4 rows per (abnormality, devices) yes/no cell; then other rows of the
    location; then rows of other images that have a report and a box, one per image.
    """
    usable = F.col("has_report") | F.col("has_box")
    here = entries.where((F.col("location") == location) & usable)
    cell = F.col("abnormality").isin("yes", "no") & F.col("devices").isin("yes", "no")
    cells = ["abnormality", "devices"]
    # At most n rows of four cells.
    ranked = hash_rank(here.where(cell), cells, key, f"{seed}-cell", "__in_cell", n // 4, 4 * n <= MAX_BROADCAST)
    first = ranked.where(F.col("__in_cell") <= n // 4).drop("__in_cell")
    other = entries.where(F.col("has_report") & F.col("has_box")).join(here.select(image).distinct(), image, "left_anti")
    row = F.struct(*[c for c in entries.columns if c != image])
    other = other.groupBy(image).agg(F.min_by(row, F.struct(*key)).alias("r")).select(image, "r.*")
    pool = _first_and_rest(here, first, key).unionByName(other.withColumn("__tier", F.lit(2)))
    ranked = _by_tier(pool, [], "__tier", key, seed, "__rank", n)
    return ranked.where(F.col("__rank") <= n).withColumnRenamed("__tier", "tier").select(*entries.columns, "tier")


def extend_sample(core: DataFrame, entries: DataFrame, done: DataFrame, n: int, key: list[str], seed=42, core_only: bool = False) -> DataFrame:
    """Unprocessed core rows first, then random rows of the pool, n in all (or the core only)."""
    from .joins import sampling_pool, unprocessed

    left = unprocessed(core, done, key).withColumn("tier", F.lit(0))
    if core_only:
        return left
    pool = sampling_pool(entries, core, done, key).select(*core.columns).withColumn("tier", F.lit(1))
    ranked = _by_tier(left.unionByName(pool), [], "tier", key, seed, "__rank", n)
    return ranked.where(F.col("__rank") <= n).drop("__rank")


# -- runs ------------------------------------------------------------------------------------

def parse_run_name(col, metric: str) -> Column:
    """struct(step, value) of checkpoint-<step>-<metric>-<value>; null if it does not match."""
    c = F.col(col) if isinstance(col, str) else col
    pattern = r"checkpoint-(\d+)-\Q" + metric + r"\E-(-?\d+\.?\d*)"
    return F.when(
        c.rlike(pattern),
        F.struct(
            F.regexp_extract(c, pattern, 1).cast("bigint").alias("step"),
            F.regexp_extract(c, pattern, 2).cast("double").alias("value"),
        ),
    )


def top_k_runs(df: DataFrame, k: int, value: str, step: str, greater_is_better: bool = True) -> DataFrame:
    """The k best rows; among equals the earlier step is kept."""
    best = F.col(value).desc() if greater_is_better else F.col(value).asc()
    return df.where(F.col(value).isNotNull()).orderBy(best, F.col(step).asc()).limit(k)
