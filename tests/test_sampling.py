import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roentgrid.operators import curriculum, sampling

SIZES = {"a": 2, "b": 5, "c": 9}


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(g, f"{g}{i}") for g, n in SIZES.items() for i in range(n)]
    return spark.createDataFrame(rows, "g string, k string").cache()


def counts(df):
    return {r["g"]: r["n"] for r in df.groupBy("g").agg(F.sum("copies").alias("n")).collect()}


def level_fill(sizes, n):
    """Row by row: one more for each group that has any left, smallest groups first."""
    got = Counter()
    order = sorted(sizes, key=lambda g: (sizes[g], g))
    while sum(got.values()) < n:
        for g in order:
            if got[g] < sizes[g] and sum(got.values()) < n:
                got[g] += 1
    return dict(got)


@pytest.mark.parametrize("n", [3, 4, 6, 7, 10, 13, 16])
def test_waterfill(pool, n):
    assert counts(sampling.waterfill(pool, n, ["g"], ["k"])) == level_fill(SIZES, n)


def test_waterfill_many_groups(spark):
    rng = random.Random(4)
    sizes = {f"g{i:02d}": rng.randint(1, 30) for i in range(25)}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, k int")
    for n in (25, 60, 137, 200):
        assert counts(sampling.waterfill(df, n, ["g"], ["g", "k"])) == level_fill(sizes, n)


def test_waterfill_rounding_and_excess(pool):
    assert sum(counts(sampling.waterfill(pool, 7, ["g"], ["k"], 4)).values()) == 8
    assert sum(counts(sampling.waterfill(pool, 1, ["g"], ["k"])).values()) == 3
    assert counts(sampling.waterfill(pool, 24, ["g"], ["k"])) == {"a": 5, "b": 8, "c": 11}


def test_uniform_quota(pool):
    assert counts(sampling.uniform_quota(pool, 20, ["g"], ["k"], 1)) == {"a": 7, "b": 7, "c": 6}
    short = sampling.uniform_quota(pool, 6, ["g"], ["k"], 1).collect()
    assert len(short) == 6 and all(r["copies"] == 1 for r in short)


def test_samples_do_not_depend_on_partitioning(pool):
    def keys(df):
        return sorted(r["k"] for r in sampling.random_subset(df, 7, ["k"], seed=3).collect())

    assert keys(pool) == keys(pool.repartition(5)) and len(keys(pool)) == 7
    assert len(sampling.random_subset(pool, 7, ["k"], 5).collect()) == 10
    assert sampling.random_subset(pool, 99, ["k"]).count() == 16
    assert sampling.epoch_sample(pool, 2, 4, ["k"]).count() == 8
    big = sampling.epoch_sample(pool, 10, 4, ["k"])
    assert sampling.expand_copies(big).count() == 40
    assert sorted(r["position"] for r in sampling.shuffle(pool, ["k"], 1).collect()) == list(range(16))


def slots_by_hand(weights):
    """Schedule built slot by slot with plain lists."""
    if all(w == weights[0] for w in weights):
        return list(range(len(weights)))
    used = [i for i, w in enumerate(weights) if w]
    total = sum(weights[i] for i in used)
    share = {i: weights[i] / total for i in used}
    need = {i: max(int(20 * share[i] / min(share.values())), 1) for i in used}
    where = {}
    for i in sorted(used, key=lambda i: -need[i]):
        open_slots = [s for s in range(sum(need.values())) if s not in where]
        gap = len(open_slots) / need[i]
        for j in range(need[i]):
            where[open_slots[int(j * gap)]] = i
    return [where[s] for s in sorted(where)]


def test_schedules(spark):
    rng = random.Random(8)
    groups = [[rng.choice([0, 0.1, 0.25, 0.5, 1, rng.random()]) for _ in range(rng.randint(1, 6))] for _ in range(60)]
    groups += [[1, 1, 1], [3.0], [0, 2], [1e-3, 1], [0.3, 0.3, 0.1], [1 / 3, 1 / 7, 1 / 49], [float(i + 1) for i in range(40)]]
    groups = [w for w in groups if any(w)]
    rows = [(g, f"c{i:02d}", float(x)) for g, w in enumerate(groups) for i, x in enumerate(w)]
    rng.shuffle(rows)
    weights = spark.createDataFrame(rows, "g int, class string, weight double").repartition(3)
    got = {}
    for r in sampling.schedule(weights, "class", ["g"]).orderBy("g", "slot").collect():
        got.setdefault(r["g"], []).append(r)
    for g, w in enumerate(groups):
        names = [f"c{i:02d}" for i in slots_by_hand([x for x in w if x])] if 0 not in w else None
        used = [f"c{i:02d}" for i, x in enumerate(w) if x]
        names = names or [used[i] for i in slots_by_hand([x for x in w if x])]
        assert [r["slot"] for r in got[g]] == list(range(len(names))) and [r["class"] for r in got[g]] == names
        seen = Counter()
        for r in got[g]:
            assert r["before"] == seen[r["class"]] and r["period"] == len(names) and r["per_period"] == names.count(r["class"])
            seen[r["class"]] += 1


def test_schedule_of_far_weights(spark):
    weights = spark.createDataFrame([("a", 1e-4), ("b", 1.0)], "class string, weight double")
    rows = sampling.schedule(weights, "class").orderBy("slot").collect()
    per = Counter(r["class"] for r in rows)
    assert [r["slot"] for r in rows] == list(range(len(rows))) and per["a"] == 20 and per["b"] in (199_999, 200_000)
    gaps = np.diff([r["slot"] for r in rows if r["class"] == "a"])
    assert gaps.min() > 9_000


def test_broken_weights(spark):
    for w, message in ((-1.0, "non-negative"), (None, "non-negative")):
        weights = spark.createDataFrame([("a", w), ("b", 1.0)], "class string, weight double")
        with pytest.raises(Exception, match=message):
            sampling.schedule(weights, "class").collect()
    with pytest.raises(Exception, match="no weight above 0"):
        sampling.schedule(spark.createDataFrame([("a", 0.0)], "class string, weight double"), "class").collect()
    rows = spark.createDataFrame([("a", 1)], "g string, k int")
    with pytest.raises(Exception, match="no rows of class"):
        sampling.weighted_sequence(rows, {"a": 1.0, "b": 1.0}, "g", ["k"]).collect()


def test_nested_sequence_with_a_null_class(spark):
    df = spark.createDataFrame([(None, "p", 1), (None, None, 2), ("y", None, 3)], "dataset string, category string, k int")
    out = curriculum.apply_weights(df, None, None, 40, ["k"]).collect()
    assert Counter(r["k"] for r in out) == {3: 20, 1: 10, 2: 10} and sorted(r["position"] for r in out) == list(range(40))


def test_weighted_sequence(pool):
    weights = {"a": 1.0, "b": 0.0, "c": 3.0}
    rows = sampling.weighted_sequence(pool, weights, "g", ["k"]).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    period = ["ac"[i] for i in slots_by_hand([1.0, 3.0])]
    assert Counter(period) == {"a": 20, "c": 60}
    assert [r["g"] for r in rows] == [period[i % 80] for i in range(len(rows))]
    for g in "ac":
        seen = [r["k"] for r in rows if r["g"] == g]
        assert len(set(seen[: SIZES[g]])) == SIZES[g]
        assert seen[SIZES[g] : 2 * SIZES[g]] == seen[: SIZES[g]]


def test_weighted_sequence_with_replicated_rows(pool, monkeypatch):
    weights = {"a": 1.0, "b": 2.0, "c": 3.0}
    plain = sampling.weighted_sequence(pool, weights, "g", ["k"], 500).orderBy("position").collect()
    monkeypatch.setattr(sampling, "MAX_FAN_OUT", 3)
    salted = sampling.weighted_sequence(pool, weights, "g", ["k"], 500).orderBy("position").collect()
    assert plain == salted and len(plain) == 500


def test_nested_sequence(spark):
    df = spark.createDataFrame([(d, c, i) for d in "xy" for c in "pq" for i in range(3)], "d string, c string, k int")
    out = sampling.nested_sequence(df, {"x": 1.0, "y": 3.0}, {"x": {"p": 1.0, "q": 1.0}, "y": {"p": 1.0, "q": 0.0}}, "d", "c", ["d", "c", "k"], 160)
    got = Counter((r["d"], r["c"]) for r in out.collect())
    assert got == {("x", "p"): 20, ("x", "q"): 20, ("y", "p"): 120}


def test_core_sample(spark):
    rows = [(i, i % 2 == 0, f"l{i % 3}", ["yes", "no", None][i % 5 % 3], "no") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, has_report boolean, location string, abnormality string, devices string")
    out = sampling.core_sample(df, 50, ["id"]).collect()
    assert len({r["id"] for r in out}) == 50
    assert sum(r["has_report"] for r in out) == 35
    strata = Counter((r["location"], r["abnormality"]) for r in out if r["has_report"])
    assert len(strata) == 9 and max(strata.values()) <= 4
    few = sampling.core_sample(df.where("id < 20"), 50, ["id"]).count()
    assert few == 20


def test_extend_and_resume(spark):
    every = spark.createDataFrame([(i,) for i in range(20)], "id int")
    core, done = every.where("id < 6"), every.where("id % 4 = 0")
    out = sampling.extend_sample(core, every, done, 8, ["id"]).collect()
    ids = [r["id"] for r in out]
    assert len(ids) == 8 and {1, 2, 3, 5} <= set(ids) and not any(i % 4 == 0 for i in ids)
    left = sampling.extend_sample(core, every, done, 8, ["id"], core_only=True)
    assert {r["id"] for r in left.collect()} == {1, 2, 3, 5}


def test_location_core_sample(spark):
    rows = [(i, f"img{i % 30}", "spine" if i < 12 else "neck", i % 2 == 0, True, ["yes", "no", None][i % 3], "no") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, image string, location string, has_report boolean, has_box boolean, abnormality string, devices string")
    out = sampling.location_core_sample(df, "spine", 15, ["id"], "image").collect()
    tiers = Counter(r["tier"] for r in out)
    assert tiers[0] == 6 and tiers[1] == 6 and tiers[2] == 3
    others = [r["image"] for r in out if r["tier"] == 2]
    assert len(set(others)) == 3 and not set(others) & {f"img{i}" for i in range(12)}


def test_top_k(spark):
    names = ["checkpoint-10-m-0.5", "checkpoint-20-m-0.7", "checkpoint-30-m-0.7", "other", "checkpoint-5-x-0.9"]
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", sampling.parse_run_name("name", "m").alias("p")).select("name", "p.*")
    assert [r["step"] for r in sampling.top_k_runs(df, 2, "value", "step").collect()] == [20, 30]
    assert [r["step"] for r in sampling.top_k_runs(df, 1, "value", "step", False).collect()] == [10]


def test_curriculum_weights(spark):
    m = spark.createDataFrame([("x", 1.0, 1.0), ("y", None, 0.5), ("z", 0.2, None)], "dataset string, bbox_iou double, text_score double")
    w = {r["dataset"]: (r["error"], r["weight"]) for r in curriculum.dataset_weights(m, {"bbox_iou": 0.8, "text_score": 0.2}).collect()}
    assert w["x"][0] == pytest.approx(0.01) and w["y"][0] == pytest.approx(0.5) and w["z"][0] == pytest.approx(0.8)
    assert sum(v for _, v in w.values()) == pytest.approx(1.0)
    empty = spark.createDataFrame([("x", None, None)], "dataset string, bbox_iou double, text_score double")
    with pytest.raises(Exception, match="no metrics for x"):
        curriculum.dataset_weights(empty, {"bbox_iou": 0.8, "text_score": 0.2}).collect()
    mixed = spark.createDataFrame([("x", "a", 0.1, 0.5), ("x", "b", None, 0.5)], "dataset string, category string, bbox_iou double, text_score double")
    with pytest.raises(Exception, match="bbox_iou is missing for some categories"):
        curriculum.category_weights(mixed, {"bbox_iou": 0.8, "text_score": 0.2}).collect()
    c = spark.createDataFrame([(-1.0,), (0.5,), (3.0,)], "weight double")
    assert [r["weight"] for r in curriculum.clamp_weights(c).collect()] == [0.01, 0.5, 1.0]


def test_apply_weights(spark):
    df = spark.createDataFrame([(d, c, i) for d in ("x", "y") for c in "pq" for i in range(4)], "dataset string, category string, k int")
    out = curriculum.apply_weights(df, {"x": 0.25, "y": 0.75}, {"y": {"p": 0.2, "q": 0.6}}, 320, ["dataset", "category", "k"])
    got = Counter((r["dataset"], r["category"]) for r in out.collect())
    assert got == {("x", "p"): 40, ("x", "q"): 40, ("y", "p"): 60, ("y", "q"): 180}
