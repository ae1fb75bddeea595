import random

import helpers
import numpy as np
import pytest

from roentgrid.llm import simhash


def near_copies():
    rng, out = random.Random(4), []
    for k in range(6):
        base = helpers.words_of(50 + k, 200, 5000)
        for _ in range(7):
            copy = list(base)
            copy[rng.randrange(200)] = "changed"
            out.append(" ".join(copy))
    return helpers.awkward(out)


def test_against_brute_force(spark):
    texts = near_copies()
    got = {r["doc_id"]: r for r in simhash.components(simhash.fingerprints(helpers.documents(spark, texts))).collect()}
    codes = [helpers.simhash(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{c:016x}" for c in codes]
    assert [got[i]["component_id"] for i in range(len(texts))] == helpers.classes(codes)
    assert len(set(helpers.classes(codes))) < len(texts) - 10


@pytest.mark.parametrize("shard", [3, 1 << 13])
def test_links_of_crowded_codes(spark, shard):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(4)]
    codes = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for c in centres for _ in range(60)})
    table = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.connected(simhash.links(table, shard=shard)).collect()}
    want = helpers.classes(codes)
    label = [roots.get(c, c if c < 1 << 63 else c - (1 << 64)) for c in codes]
    assert len(set(zip(want, label, strict=True))) == len(set(want)) == len(set(label))


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 12, 500).astype(np.uint64))
    found = {(int(q), int(c)) for a, b in simhash.BKTree(codes).search(codes, 2) for q, c in zip(a, b, strict=True)}
    far = np.bitwise_count(codes[:, None] ^ codes)
    assert found == set(zip(*map(lambda x: x.tolist(), np.nonzero(far <= 2)), strict=True))


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.connected(edges).collect()}
    assert all(found[i] == 0 for i in range(301)) and found[1000] == found[1001] == 1000


def test_one_of_each(spark):
    texts = [None, "", "a b c", "a b c", "a b c", "other words here at all"]
    docs = helpers.documents(spark, texts, [4, 2, 9, 9, None, 1])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "other words here at all"), (2, ""), (9, "a b c")]
    alone = helpers.documents(spark, ["x y z", "x y z"], [None, None])
    assert simhash.one_of_each(alone).count() == 1
    assert simhash.one_of_each(docs.where("doc_id < 0")).count() == 0
