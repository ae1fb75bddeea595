import random

from pyspark.sql import functions as F

from roentgrid.functions.hashing import hash_bucket, hash_order
from roentgrid.operators import skew


def hot_rows(n=300):
    """A third of all rows in one group, a null group, and small ones."""
    rng = random.Random(2)
    return [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{rng.randint(0, 20)}", i, rng.randint(0, 9)) for i in range(n)]


def test_running_totals(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint")
    got = skew.running_totals(df, ["g"], ["i"], skew.ordinal_bucket("i", 16), s=F.col("v"), n=F.lit(1))
    sums, want = {}, {}
    for g, i, v in rows:
        s, n = sums.get(g, (0, 0))
        sums[g] = want[i] = (s + v, n + 1)
    assert {r["i"]: (r["s"], r["n"]) for r in got.collect()} == want
    assert got.columns == ["g", "i", "v", "s", "n"]


def test_group_rank_by_hash_ignores_partitioning(spark):
    df = spark.createDataFrame(hot_rows(), "g string, i bigint, v bigint").withColumn("h", hash_order(1, "i"))

    def ranks(d):
        out = skew.group_rank(d, ["g"], ["h"], hash_bucket(F.col("h"), 1))
        return {r["i"]: r["rank"] for r in out.collect()}

    first = ranks(df)
    assert first == ranks(df.repartition(7)) == ranks(df.coalesce(1))
    hot = sorted(v for (g, i, _), v in ((r, first[r[1]]) for r in hot_rows()) if g == "hot")
    assert hot == list(range(1, len(hot) + 1))


def test_collect_parts(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint")
    got = skew.collect_parts(df, ["g"], "i", F.col("v"), 13, "vs", first={"start": "i"}, bucket=skew.ordinal_bucket("i", 8)).collect()
    lists = {}
    for g, i, v in rows:
        lists.setdefault(g, []).append((i, v))
    for g, items in lists.items():
        parts = sorted((r for r in got if r["g"] == g), key=lambda r: r["part"])
        assert [r["part"] for r in parts] == list(range(-(-len(items) // 13)))
        assert all(r["n_parts"] == len(parts) and len(r["vs"]) <= 13 for r in parts)
        assert [x for r in parts for x in r["vs"]] == [v for _, v in items]
        assert {r["start"] for r in parts} == {items[0][0]}


def test_draws(spark):
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", 25)], "g string, n bigint")
    got = skew.draws(df, ["g"], "n", block=10).groupBy("g").agg(F.collect_list("draw").alias("d")).collect()
    assert {r["g"]: sorted(r["d"]) for r in got} == {"b": [0, 1, 2], "c": list(range(25))}


def test_collect_parts_takes_one_way(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint")
    out = skew.collect_parts(df.withColumns({"part": F.lit(7), "items": F.lit(8)}), ["g"], "i", F.col("v"), 13, first={"start": "i"})
    hot = sorted((r for r in out.collect() if r["g"] == "hot"), key=lambda r: r["part"])
    assert [x for r in hot for x in r["items"]] == [v for g, _, v in rows if g == "hot"]
    assert {(r["n_parts"], r["start"]) for r in hot} == {(8, 0)}
    assert skew.collect_parts(df.where("i < 0"), ["g"], "i", F.col("v")).count() == 0
    # The rows are read once for the lists and once for their narrow totals.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2


def test_rank_limits_keep_every_row_up_to_the_limit(spark):
    df = spark.createDataFrame(hot_rows(), "g string, i bigint, v bigint").withColumn("h", hash_order(1, "i"))
    bucket = hash_bucket(F.col("h"), 1)
    full = {r["i"]: r["rank"] for r in skew.group_rank(df, ["g"], ["h"], bucket).collect()}
    limits = spark.createDataFrame([(("hot",), 9), ((None,), 2)], "__rt_group struct<g: string>, __limit int")
    for at_most, want in ((5, lambda g: 5), (limits, lambda g: {"hot": 9, None: 2}.get(g, 0))):
        got = {r["i"]: r["rank"] for r in skew.group_rank(df, ["g"], ["h"], bucket, "rank", at_most, True).collect()}
        assert all(full[i] == rank for i, rank in got.items())
        assert {i for g, i, _ in hot_rows() if full[i] <= want(g)} <= set(got) and len(got) < len(full)
