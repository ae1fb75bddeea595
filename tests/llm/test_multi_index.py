import helpers  # noqa: F401
import numpy as np
import pytest

from roentgrid.llm import multi_index


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "q") for i, v in rows], "vec_id long, embedding array<float>, score int, query_id string")


def brute(rows, k=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 6 and None not in v]
    good = [(i, x) for i, x in good if np.isfinite(x).all() and x.any()]
    out = {}
    for i, x in good:
        if i % 20 == 0:
            out[i] = sorted((-float((x * y).sum()), j) for j, y in good if j != i)[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    base += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25]) for i in range(400, 520)]  # copies: ties
    base += [(600, None), (620, [0.0] * 6), (640, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (660, [float("nan")] * 6), (680, [float("inf")] + [0.0] * 5)]
    return base + [(700, [1.0, 2.0]), (None, [1.0] * 6), (720, [])]


def check(found, want):
    by = {}
    for r in found.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert set(by) <= set(want)
    hits = total = 0
    for q, best in want.items():
        got = sorted(by.get(q, []))
        assert [r for r, _, _ in got] == list(range(1, len(got) + 1))
        assert [(s, i) for _, s, i in got] == sorted((s, i) for _, s, i in got)
        hits += len({i for _, _, i in got} & {i for _, i in best})
        total += len(best)
    return hits / total


def test_exhaustive_search_is_exact(spark, rows):
    t, want = table(spark, rows), brute(rows)
    found = multi_index.search(t, t.where("vec_id % 20 = 0"), share=1.0)
    assert check(found, want) == 1.0
    exact = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    for q, best in want.items():
        for rank, (less, i) in enumerate(best, 1):
            assert exact[q, rank][0] == i and abs(exact[q, rank][1] + less) < 1e-12


def test_recall_and_blocks(spark, rows, monkeypatch):
    t = table(spark, rows)
    found = multi_index.search(t, t.where("vec_id % 20 = 0"))
    assert check(found, brute(rows)) >= 0.9
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    monkeypatch.setattr(multi_index, "QUERY_GROUP", 5)
    cut = multi_index.search(t, t.where("vec_id % 20 = 0"))
    assert sorted(cut.collect()) == sorted(found.collect())


def test_few_and_no_vectors(spark):
    t = table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])])
    assert [tuple(r) for r in multi_index.search(t, t.where("vec_id % 20 = 0")).collect()] == [(0, 1, 1, 0.5)]
    assert multi_index.search(t.where("vec_id < 0"), t.where("vec_id < 0")).count() == 0


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    pairs = list(multi_index.walk(a, b, np.ones((7, 9)), 63))
    assert len(set(pairs)) == 63
    sums = [a[i] + b[j] for i, j in pairs]
    assert sums == sorted(sums)
