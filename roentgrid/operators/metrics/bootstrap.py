"""Bootstrap estimates by count splitting.

Rows are numbered and cut into blocks. The draws of an iteration are first split over the
blocks by binomial halving: a node of a tree over the blocks hands each of its draws to
its left or right half with the probability of their sizes, by comparing random bits
with the binary digits of that probability, whole words of bits at a time. Every block
then makes its own draws and adds up its rows. What moves between tasks is one count and
one line of sums for each iteration and block, never a row for each draw.

All randomness is a hash of the seed, the iteration and the place in the tree, so results
do not depend on partitioning and a lost task is repeated alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ...functions.hashing import hash_int, hash_order
from ..sampling import hash_rank
from ..skew import shuffle_partitions

BLOCK = 1 << 12
# Nodes of the tree that are split at once, words of random bits made at once, and cells of a block's table of draws.
NODES, WORDS, CELLS = 1 << 16, 1 << 20, 1 << 21

_STEP = np.uint32(0x9E3779B9)


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of 32-bit words."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def seed_words(seed) -> tuple[int, int]:
    """Two 32-bit words for any seed."""
    return zlib.crc32(f"{seed}|1".encode()), zlib.crc32(f"{seed}|2".encode())


def _keys(seed, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for a range of blocks in an iteration."""
    one, two = (np.uint32(x) for x in seed_words(seed))
    b, start, end = (x.astype(np.uint32) for x in (b, start, end))
    return _mix(_mix(one ^ b) ^ start), _mix(_mix(two ^ b) ^ end)


def _words(keys: tuple[np.ndarray, np.ndarray], step: int, j: np.ndarray) -> np.ndarray:
    """The j-th random words of a step."""
    return _mix(_mix(keys[0] + j.astype(np.uint32) * _STEP) ^ _mix(keys[1] + np.uint32(step)))


def _ones(keys: tuple[np.ndarray, np.ndarray], step: int, n: np.ndarray) -> np.ndarray:
    """How many of the first n random bits of each node are 1."""
    words = (n + 31) // 32
    ends, out = np.cumsum(words), np.zeros(len(n), np.int64)
    for first in range(0, int(ends[-1]), WORDS):
        at = np.arange(first, min(first + WORDS, int(ends[-1])))
        node = np.searchsorted(ends, at, "right")
        j = at - (ends - words)[node]
        w = _words((keys[0][node], keys[1][node]), step, j)
        spare = np.maximum(32 * (j + 1) - n[node], 0).astype(np.uint32)
        np.add.at(out, node, np.bitwise_count(w & (np.uint32(0xFFFFFFFF) >> spare)).astype(np.int64))
    return out


def binomial(keys: tuple[np.ndarray, np.ndarray], n: np.ndarray, part: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How many of n draws fall into the first ``part`` of ``total`` equal places, for each node.

    A draw is a random binary fraction, read digit by digit: it is below part / total if its
    first other digit is a 0. Draws whose digits are alike so far stay open, about half of
    them at every step.
    """
    below, left, rest = np.zeros(len(n), np.int64), n.copy(), part.copy()
    still, step = np.flatnonzero((n > 0) & (part > 0)), 1
    while len(still):
        rest[still] *= 2
        digit = rest[still] >= total[still]
        rest[still] -= np.where(digit, total[still], 0)
        ones = _ones((keys[0][still], keys[1][still]), step, left[still])
        zeros = left[still] - ones
        below[still] += np.where(digit, zeros, 0)
        left[still] = np.where(digit, ones, zeros)
        still = still[(left[still] > 0) & (rest[still] > 0)]
        step += 1
    return below


def split_draws(seed, b: np.ndarray, n: np.ndarray, rows: np.ndarray, block: int = BLOCK):
    """Arrays (iteration, block, draws): n draws from ``rows`` rows of every iteration, split over blocks of rows.

    Fewer than 2 ** 37 draws an iteration. Nodes are split in bounded pieces, deepest first.
    """
    zero = np.zeros(len(b), np.int64)
    stack = [(b, zero, -(-rows // block), n, rows)]
    while stack:
        b, start, end, n, rows = stack.pop()
        if len(b) > NODES:
            half = len(b) // 2
            stack += [tuple(x[half:] for x in (b, start, end, n, rows)), tuple(x[:half] for x in (b, start, end, n, rows))]
            continue
        leaf = (end - start == 1) & (n > 0)
        if leaf.any():
            yield b[leaf], start[leaf], n[leaf]
        more = (end - start > 1) & (n > 0)
        if more.any():
            b, start, end, n, rows = (x[more] for x in (b, start, end, n, rows))
            mid = (start + end) // 2
            left = binomial(_keys(seed, b, start, end), n, (mid - start) * block, np.minimum(end * block, rows) - start * block)
            stack.append(tuple(np.concatenate(x) for x in ((b, b), (start, mid), (mid, end), (left, n - left), (rows, rows))))


def block_draws(seed, b: np.ndarray, block: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, place): the places 0 .. size - 1 that n draws of each line fall on inside a block."""
    line = np.repeat(np.arange(len(b)), n)
    j = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    keys = _keys(seed, b, block, block)
    w = _words((keys[0][line], keys[1][line]), 0, j)
    return line, (w.astype(np.uint64) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def resampled_sums(entries: DataFrame, totals: DataFrame, stats: list[str], seed, sure: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(b, group, stats...): sums over the draws of every iteration, for the groups that were drawn.

    entries(idx, group, stats...) belong to rows numbered from 0; a row may have any number
    of entries, and a group any number of rows. totals(b, n, rows): iteration b makes n
    draws from ``rows`` rows, the same for all. sure(b, idx, rows): draws that an iteration
    makes besides.
    A task holds the entries of one block of rows.
    """
    group_type = entries.schema["group"].dataType
    empty = pa.schema([("b", pa.int64()), ("group", to_arrow_type(group_type)), *((s, pa.float64()) for s in stats)])
    out = f"b long, group {group_type.simpleString()}, " + ", ".join(f"{s} double" for s in stats)

    def split(batches):
        for batch in batches:
            b, n, rows = (batch.column(c).to_numpy().astype(np.int64) for c in ("b", "n", "rows"))
            if not len(b):
                continue
            for lines in split_draws(seed, b, n, rows, block):
                size = np.full(len(lines[0]), rows[0])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lines[1], lines[0], lines[2], size)], ["block", "b", "n", "rows"])

    def add_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        number, parts = key[0].as_py(), []
        if left.num_rows and right.num_rows:
            size = min(block, int(right.column("rows")[0].as_py()) - number * block)
            groups = pc.dictionary_encode(left.column("group").combine_chunks(), null_encoding="encode")
            order = np.argsort(groups.indices.to_numpy(zero_copy_only=False), kind="stable")
            code = groups.indices.to_numpy(zero_copy_only=False)[order]
            heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            place = left.column("place").to_numpy()[order]
            values = [left.column(s).to_numpy().astype(float)[order] for s in stats]
            b, n = right.column("b").to_numpy(), right.column("n").to_numpy()
            fixed = right.column("place").to_numpy(zero_copy_only=False)
            by_b = np.argsort(b, kind="stable")
            b, n, fixed = b[by_b], n[by_b], fixed[by_b]
            iterations, first = np.unique(b, return_index=True)
            at_once = max(1, CELLS // max(size, len(place)))
            for i in range(0, len(iterations), at_once):
                own = slice(first[i], first[i + at_once] if i + at_once < len(iterations) else len(b))
                number_of = np.searchsorted(iterations, b[own]) - i
                lines = min(at_once, len(iterations) - i)
                line, at = block_draws(seed, b[own], np.full(len(b[own]), number), n[own], size)
                given = np.flatnonzero(n[own] == 0)
                cells = np.r_[number_of[line] * size + at, number_of[given] * size + fixed[own][given].astype(np.int64)]
                times = np.bincount(cells, minlength=lines * size).reshape(lines, size)[:, place]
                drawn = np.add.reduceat(times, heads, axis=1) > 0
                sums = [np.add.reduceat(times * v, heads, axis=1)[drawn] for v in values]
                x, y = np.nonzero(drawn)
                parts.append(pa.table([pa.array(iterations[i + x]), groups.dictionary.take(pa.array(code[heads][y])), *map(pa.array, sums)], names=["b", "group", *stats]))
        return pa.concat_tables(parts) if parts else empty.empty_table()

    number = F.floor(F.col("idx") / block)
    where = [number.alias("block"), (F.col("idx") % block).alias("place")]
    rows = entries.select(*where, "group", *stats)
    many = shuffle_partitions(entries)
    lines = totals.repartition(many, "b").select(*[F.col(c).cast("long") for c in ("b", "n", "rows")])
    counts = lines.mapInArrow(split, "block long, b long, n long, rows long").withColumn("place", F.lit(None).cast("long"))
    if sure is not None:
        given = sure.select(number.alias("block"), F.col("b").cast("long"), F.lit(0).cast("long").alias("n"), F.col("rows").cast("long"), where[1])
        counts = counts.unionByName(given)
    parts = rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(add_up, out)
    return parts.groupBy("b", "group").agg(*[F.sum(s).alias(s) for s in stats])


def _iterations(n_boot: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_boot - 1).cast("bigint")))


def _summary(value: str) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")]


def _numbered(df: DataFrame, key: list[str], seed, **columns: Column) -> tuple[DataFrame, list[str]]:
    """``columns`` of the rows and their numbers ``idx`` from 0 in hash order of the key; and the names of its copy."""
    names = [f"__k{i}" for i in range(len(key))]
    rows = df.select(*[F.col(k).alias(name) for k, name in zip(key, names, strict=True)], *[c.alias(name) for name, c in columns.items()])
    return hash_rank(rows, [], names, seed, "idx").withColumn("idx", F.col("idx") - 1), names


def bootstrap_mean(df: DataFrame, value: str, key: list[str], n_boot: int = 1000, seed=42) -> DataFrame:
    """(mean, std) of the means of n_boot resamples of the rows with a value."""
    rows = df.where(F.col(value).isNotNull())
    entries, _ = _numbered(rows, key, seed, group=F.lit(""), s=F.col(value), n=F.lit(1))
    size = rows.agg(F.count("*").alias("rows")).where("rows > 0")
    totals = size.select(_iterations(n_boot).alias("b"), F.col("rows").alias("n"), "rows")
    sums = resampled_sums(entries, totals, ["s", "n"], seed)
    return sums.select((F.col("s") / F.col("n")).alias("m")).agg(*_summary("m"))


def _first_digits(share: float) -> str:
    """The 15 hex digits of the smallest 60-bit hash that is, as a double, at least this share of 2 ** 60."""
    low, high = 0, 1 << 60
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if float(mid) / float(1 << 60) >= share else (mid + 1, high)
    return f"{low:015x}" if low < 1 << 60 else "g"


def poisson_bootstrap_mean(df: DataFrame, value: str, key: list[str], n_boot: int = 1000, seed=42) -> DataFrame:
    """(mean, std) like ``bootstrap_mean``, but every row's multiplicity in an iteration is
    an independent Poisson(1) draw: one pass over the rows, in as many tasks as a shuffle has, and no join."""
    # hash_order(seed, "poisson", b, *key) in pieces: what a row or an iteration adds to the hashed text is
    # worked out once. Few and narrow rows make much work, so they are dealt out however the input was cut.
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    lead = F.concat_ws("|", seed.cast("string"), F.lit("poisson"), F.lit(""))
    tail = F.concat_ws("|", F.lit(""), *[F.col(k).cast("string") for k in key])
    rows = df.where(F.col(value).isNotNull()).select(lead.alias("lead"), tail.alias("tail"), F.col(value).alias("v"))
    rows = rows.repartition(shuffle_partitions(df))
    rows = rows.select("lead", "tail", "v", F.posexplode(F.split(F.lit(" ".join(map(str, range(n_boot)))), " ")).alias("b", "name"))
    rows = rows.select("b", "v", F.md5(F.concat("lead", "name", "tail")).alias("h"))
    # Inverse distribution function of Poisson(1), until its sum in doubles no longer grows. Hash digits
    # sort like the numbers that they are, so they are compared with the digits of the sums.
    total, p, bounds = 0.0, 2.718281828459045**-1, []
    while total + p > total:
        total += p
        bounds.append(_first_digits(total))
        p /= len(bounds)
    count = reduce(lambda more, i: F.when(F.col("h") < bounds[i], i).otherwise(more), reversed(range(len(bounds))), F.lit(len(bounds)))
    rows = rows.select("b", "v", count.alias("k"))
    means = rows.groupBy("b").agg(F.try_divide(F.sum(F.col("v") * F.col("k")), F.sum("k")).alias("m"))
    return means.agg(*_summary("m"))


def _sure_draws(members: DataFrame, group: str, n_boot: int, seed) -> DataFrame:
    """(b, idx): one member of every group in every iteration, from members(group, place from 1, idx)."""
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).withColumn("b", _iterations(n_boot))
    pick = hash_int(hash_order(seed, F.lit("sure"), "b", group)) % F.col("size") + 1
    return sizes.select("b", group, pick.alias("place")).join(members, [group, "place"]).select("b", "idx")


def bootstrap_by_category(df: DataFrame, value: str, category: str, key: list[str], n_boot: int = 1000, seed=42) -> DataFrame:
    """(level, category, mean, std) with at least one draw per category and iteration.

    Levels: micro (all draws), macro (mean of category means), category.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(category).isNotNull())
    entries, names = _numbered(rows, key, seed, group=F.col(category), s=F.col(value), n=F.lit(1))
    members = hash_rank(entries, ["group"], names, seed, "place").select("group", "place", "idx")
    sizes = entries.groupBy("group").agg(F.count("*").alias("size")).agg(F.sum("size").alias("rows"), F.count("*").alias("groups")).where("rows > 0")
    totals = sizes.select(_iterations(n_boot).alias("b"), (F.col("rows") - F.col("groups")).alias("n"), "rows")
    sure = _sure_draws(members, "group", n_boot, seed).join(totals.select("b", "rows"), "b")
    sums = resampled_sums(entries, totals, ["s", "n"], seed, sure)
    sums = sums.withColumn("m", F.col("s") / F.col("n"))
    per_b = sums.groupBy("b").agg((F.sum("s") / F.sum("n")).alias("micro"), F.avg("m").alias("macro"))
    none = F.lit(None).cast("string").alias("category")
    micro = per_b.agg(*_summary("micro")).select(F.lit("micro").alias("level"), none, "mean", "std")
    macro = per_b.agg(*_summary("macro")).select(F.lit("macro").alias("level"), none, "mean", "std")
    each = sums.groupBy("group").agg(*_summary("m"))
    each = each.select(F.lit("category").alias("level"), F.col("group").alias("category"), "mean", "std")
    return micro.unionByName(macro).unionByName(each)


# -- multilabel metrics ------------------------------------------------------------------------


@dataclass(frozen=True)
class LabelMetric:
    """A score of multilabel predictions that can be resampled.

    ``statistics`` says what one label, from the columns y_true and y_pred (booleans),
    adds to its class; a sample drawn k times adds it k times. ``score`` is an aggregate
    over the classes of an iteration and their added statistics; a class that was not drawn
    is there with zeros.
    """

    statistics: Callable[[Column, Column], dict[str, Column]]
    score: Callable[[], Column]


def _errors(t: Column, p: Column) -> dict[str, Column]:
    return {"tp": t & p, "fp": ~t & p, "fn": t & ~p}


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(total: Callable = lambda c: c) -> Column:
    tp, fp, fn = (total(F.col(c)) for c in ("tp", "fp", "fn"))
    return _share(2 * tp, 2 * tp + fp + fn)


LABEL_METRICS: dict[str, LabelMetric] = {
    "micro": LabelMetric(_errors, lambda: _f1(F.sum)),
    "macro": LabelMetric(_errors, lambda: F.avg(_f1())),
    "weighted": LabelMetric(_errors, lambda: _share(F.sum(_f1() * (F.col("tp") + F.col("fn"))), F.sum(F.col("tp") + F.col("fn")))),
    "accuracy": LabelMetric(lambda t, p: {"same": t == p, "labels": F.lit(True)}, lambda: _share(F.sum("same"), F.sum("labels"))),
}


def register_label_metric(name: str, metric: LabelMetric) -> None:
    LABEL_METRICS[name] = metric


def bootstrap_label_scores(
    labels: DataFrame, key: str, metric: str | LabelMetric = "micro", n_boot: int = 1000, ensure_all_classes: bool = True,
    drop_empty_classes: bool = False, seed=42,
) -> DataFrame:
    """(b, score): the metric of every resample of the samples; labels(key, class, y_true, y_pred).

    Either every class that has positives gets one of them per iteration, or one sample with
    any positive does; a sample chosen twice that way counts once. ``drop_empty_classes``
    leaves out classes without positives; it is an error if there is no other.
    """
    if isinstance(metric, str):
        if metric not in LABEL_METRICS:
            raise ValueError(f"unknown metric: {metric}")
        metric = LABEL_METRICS[metric]
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    if drop_empty_classes:
        used = labels.groupBy("class").agg(F.max("y_true").alias("t")).where(F.col("t") > 0).select("class")
        labels = labels.join(used, "class", "left_semi")
    samples = hash_rank(labels.select(key).distinct(), [], [key], seed, "idx").withColumn("idx", F.col("idx") - 1)
    positive = labels.where(F.col("y_true") > 0).select(key, "class")
    if not ensure_all_classes:
        positive = positive.select(key).distinct().withColumn("class", F.lit("any"))
    members = hash_rank(positive.distinct(), ["class"], [key], seed, "place").join(samples, key)
    sure = _sure_draws(members.select("class", "place", "idx"), "class", n_boot, seed).distinct()
    some = F.when(F.col("positives") > 0, F.col("rows")).otherwise(F.raise_error(F.lit("no positive label")).cast("bigint"))
    size = samples.agg(F.count("*").alias("rows")).where("rows > 0").withColumn("positives", positive.agg(F.count("*")).scalar())
    rows = size.select(some.alias("rows") if drop_empty_classes or not ensure_all_classes else "rows")
    totals = rows.select(_iterations(n_boot).alias("b"), "rows").join(sure.groupBy("b").agg(F.count("*").alias("fixed")), "b", "left")
    totals = totals.select("b", (F.col("rows") - F.coalesce("fixed", F.lit(0))).alias("n"), "rows")
    statistics = {name: F.coalesce(column, F.lit(False)) for name, column in metric.statistics(t, p).items()}
    added = labels.select(key, F.col("class").alias("group"), *[c.cast("double").alias(name) for name, c in statistics.items()])
    # A label that adds nothing changes nothing; ``classes`` keeps its class present.
    adds = reduce(Column.__or__, [F.col(name) != 0 for name in statistics])
    entries = added.where(adds).join(samples, key).select("idx", "group", *statistics)
    sums = resampled_sums(entries, totals, list(statistics), seed, sure.join(totals.select("b", "rows"), "b"))
    classes = labels.select(F.col("class").alias("group")).distinct().withColumn("b", _iterations(n_boot))
    return classes.join(sums, ["b", "group"], "left").na.fill(0, list(statistics)).groupBy("b").agg(metric.score().alias("score"))


def bootstrap_multilabel(
    labels: DataFrame, key: str, average: str | LabelMetric = "micro", n_boot: int = 1000, ensure_all_classes: bool = True,
    drop_empty_classes: bool = False, seed=42,
) -> DataFrame:
    """(mean, std) of a label metric over n_boot resamples of the samples."""
    return bootstrap_label_scores(labels, key, average, n_boot, ensure_all_classes, drop_empty_classes, seed).agg(*_summary("score"))
