import hashlib
import random
import zlib

import helpers
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roentgrid.llm import periods


def brute(w, least=24, times=3):
    """(start, period, length) of all runs, by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((start, q, length) for (start, length), q in found.items())


def found(words):
    return [[(s, q, n) for s, n, q in runs.tolist()] for runs in periods.chunk_runs(words)]


def encoded(w):
    return [str(x).encode() for x in w]


def with_runs(rng):
    size = rng.choice([1, 2, 3, 50])
    w = [rng.randrange(size) for _ in range(rng.randrange(200))]
    for _ in range(rng.randrange(4)):
        q = rng.randrange(1, 90)
        base, at = [rng.randrange(size) for _ in range(q)], rng.randrange(len(w) + 1)
        w[at:at] = [base[i % q] for i in range(rng.randrange(2 * q, 6 * q))]
    return w


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    texts = [with_runs(rng) for _ in range(4)] + [fibonacci(rng.randrange(500)), thue_morse(rng.randrange(300)) * rng.choice([1, 4]), []]
    rng.shuffle(texts)
    assert found([encoded(t) for t in texts]) == [brute(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=90))
def test_two_words(w):
    assert found([encoded(w)]) == [brute(w)]


@pytest.mark.parametrize("q", [1, 7, 8, 15, 16, 23, 24, 25, 35, 36, 100, 999])
def test_shortest_run_of_a_period(q):
    base = [f"a{i}" for i in range(q)]
    n = max(24, 3 * q)
    long, short = [base[i % q] for i in range(n)], [base[i % q] for i in range(n - 1)]
    for w, count in ((long, 1), (short, 0)):
        w = ["x", "y", *w, "z"]
        assert found([encoded(w)]) == [[(2, q, n)] if count else []]


def test_one_word_very_often():
    assert found([[b"a"] * 300_000 + [b"b"] * 30]) == [[(0, 1, 300_000), (300_000, 1, 30)]]


def plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    a, p = h // 10 % len(w), 0
    p = 1 + (len(w) - a) // (3 + h // 10 % 8)
    return w[:a] + [w[a + i % p] for i in range(len(w) - a)]


def expected(doc_id, text):
    w = plant(doc_id, (text or "").encode().split())
    runs = brute(w) if len(w) < 5000 else [(s, q, n) for s, n, q in periods.chunk_runs([w])[0].tolist()]
    drop = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = sorted(runs, key=lambda r: (-r[2] / r[1], r[0], r[1]))[:1]
    start, period, length = best[0] if best else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (
        doc_id, len(runs), start, length, period, 1000 * length // period if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_report(spark):
    rng = random.Random(5)
    texts = helpers.awkward([" ".join(map(str, with_runs(rng))) for _ in range(40)])
    texts += ["x " * 500, "a b \t" * 12 + "c", "\x1c \x85   " * 30]
    ids = [None, *range(1, len(texts) - 1), 4]
    docs = helpers.documents(spark, texts, ids)
    got = [tuple(r) for r in periods.report(periods.runs(periods.planted(docs), chunk_words=500)).collect()]
    assert sorted(got, key=str) == sorted((expected(i, t) for i, t in zip(ids, texts, strict=True)), key=str)
    planted = [i for i, t in zip(ids, texts, strict=True) if plant(i, (t or "").split()) != (t or "").split()]
    assert planted  # some of them are


def test_operator_output(spark):
    docs = helpers.documents(spark, ["q " + "a b c " * 10 + "z", None])
    rows = {r["doc_id"]: r for r in periods.runs(docs).collect()}
    assert rows[0]["n_words"] == 32 and [tuple(x) for x in rows[0]["runs"]] == [(1, 30, 3)] and rows[0]["collapsed"] == "q a b c z"
    assert rows[1]["n_words"] == 0 and rows[1]["runs"] == [] and rows[1]["collapsed"] == ""


def test_empty_table(spark):
    docs = helpers.documents(spark, ["a"]).where("doc_id < 0")
    assert periods.report(periods.runs(periods.planted(docs))).count() == 0


def test_minimizers_are_the_window_minima():
    rng = np.random.default_rng(3)
    for width in (1, 2, 5, 9):
        hashes = rng.integers(0, 12, 60).astype(np.uint64)
        wanted = {i + k for i in range(60 - width + 1) for k in range(width) if hashes[i + k] == hashes[i : i + width].min()}
        assert set(periods.minimizers(hashes, width).tolist()) == wanted
