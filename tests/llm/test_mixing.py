import collections
import math

import helpers
import numpy as np
import pytest

from roentgrid.llm import mixing


def corpus():
    return helpers.awkward([" ".join(helpers.words_of(i, 80, 40)) + (" Rare%d" % i) * 2 for i in range(60)] + ["Tab\tand\x0bfeed\x0cend\r\n", "É é"])


@pytest.fixture(scope="module")
def scored(spark):
    texts = corpus()
    return texts, {r["doc_id"]: r for r in mixing.score(helpers.documents(spark, texts), frequent=60).collect()}


def test_base_score_against_brute_force(scored):
    texts, got = scored
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    counts = collections.Counter(w for i, ws in tokens.items() if helpers.fold(i, 5) != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), total)
        assert r["held_out"] == (helpers.fold(i, 5) == 1) and abs(r["base_score"] - base) < 1e-6 * abs(base)
        assert -1e7 < r["score"] < 0


def test_held_out_texts_are_likelier_than_by_the_base(scored):
    texts, got = scored
    held = [r for i, r in got.items() if r["held_out"] and 10 <= i < 70]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_partitions(spark, scored):
    texts, got = scored
    docs = helpers.documents(spark, texts)
    train = docs.where("doc_id % 2 = 0")
    counts = mixing.token_counts(train).collect()
    vocabulary = mixing.Vocabulary(np.array([r["h"] for r in counts]).view(np.uint64), np.array([r["c"] for r in counts]), 5)
    odds = mixing._odds(mixing.predictor_counts(train.repartition(3), vocabulary))
    assert (odds == mixing._odds(mixing.predictor_counts(train.repartition(1), vocabulary))).all()
    data = [(t or "").encode() for t in texts]

    def run(own):
        offsets = np.r_[0, np.cumsum([len(x) for x in own])]
        d = mixing.Decisions(np.frombuffer(b"".join(own), np.uint8), offsets, vocabulary)
        turns = mixing.Turns(d, len(own))
        total, spelling = mixing.mixed(d, odds, len(own), mixing.State(), turns, d.slots(turns.index, turns.place))
        return total + np.bincount(d.doc, weights=spelling, minlength=len(own))

    assert np.allclose(run(data), np.concatenate([run([x]) for x in data]), rtol=1e-4)


def test_whole_scores_do_not_depend_on_splits(spark, scored):
    texts, got = scored
    for parts in (1, 7):
        rows = mixing.score(helpers.documents(spark, texts).repartition(parts), frequent=60).collect()
        assert all(abs(r["score"] - got[r["doc_id"]]["score"]) <= 1e-6 * abs(r["score"]) for r in rows)


def test_counts_beyond_32_bits(spark):
    blob = np.full(2 * mixing.SLOTS, 1_200_000_000, np.int64).tobytes()
    found = spark.createDataFrame([(0, bytearray(blob))] * 3, "block long, counts binary").repartition(3)
    tables = mixing._tables(mixing._merged(found))
    assert tables[0, 0] == 3_600_000_000 and np.isfinite(mixing._odds(tables)).all()


def test_first_weights_fit_the_counted_decisions():
    """One gate whose outcomes follow twice the first input's log odds; the others keep their weights."""
    cases = np.zeros((mixing.GATES, mixing.LEVELS, mixing.LEVELS, 3, 2), np.int64)
    middle = mixing.LIMIT * mixing.STEPS
    for level in range(-4, 5):
        p = 1 / (1 + math.exp(-2 * level / mixing.STEPS))
        cases[0, middle + level, middle, 1] = round(1e6 * (1 - p)), round(1e6 * p)
    state = mixing.State().fit(cases)
    assert abs(state.weights[0, 0] - 2) < 0.01
    assert np.allclose(state.weights[1:], mixing.State().weights[1:])
    assert state.seen[1].sum() == pytest.approx(mixing.State().seen[1].sum() + cases.sum())


def test_probabilities_add_up():
    """Over all tokens that may come next, the probabilities of the tree's leaves make one."""
    starts, nodes, bits = mixing.huffman([5, 1, 1, 3, 2])
    paths = [tuple(zip(nodes[a:b].tolist(), bits[a:b].tolist(), strict=True)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    p = {n: 0.3 + 0.1 * (n % 4) for n in nodes.tolist()}
    assert abs(sum(math.prod(p[n] if b else 1 - p[n] for n, b in path) for path in paths) - 1) < 1e-12
    assert len(paths[0]) <= min(len(x) for x in paths[1:]) + 1


def test_empty_tables(spark):
    docs = helpers.documents(spark, ["a b", None])
    assert mixing.score(docs.where("doc_id < 0")).count() == 0
    only = helpers.documents(spark, ["x y", ""], [i for i in range(100) if helpers.fold(i, 5) == 1][:2])
    rows = mixing.score(only).collect()
    assert [r["train_tokens"] for r in rows] == [0, 0] and all(r["n_known"] == 0 and r["score"] < 0 for r in rows)
