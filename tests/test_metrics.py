import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roentgrid.operators import plugins
from roentgrid.operators.metrics import bootstrap, labels, overlap, similarity

WORDS = ["the", "lung", "is", "clear", "no", "Effusion", "left"]


def texts(n=60, seed=1):
    rng = random.Random(seed)

    def one():
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ". ", "!"]) for _ in range(rng.randint(0, 25)))

    return [(i, one(), one()) for i in range(n)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(texts(), "pair_id int, hyp string, ref string").cache()


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def bleu(rows, n):
    hits, all_, hl, rl = [0] * n, [0] * n, 0, 0
    for hyp, ref in rows:
        h, r = hyp.split(), ref.split()
        hl, rl = hl + len(h), rl + len(r)
        for k in range(n):
            hits[k] += sum((grams(h, k + 1) & grams(r, k + 1)).values())
            all_[k] += max(len(h) - k, 0)
    if min(hits) == 0:
        return 0.0
    p = sum(math.log(a / b) for a, b in zip(hits, all_)) / n
    return (1.0 if hl > rl else math.exp(1 - rl / hl)) * math.exp(p)


def test_bleu(pairs):
    got = {r["pair_id"]: r for r in overlap.bleu(pairs).collect()}
    assert len(got) == 60
    for i, h, r in texts():
        for n in (1, 2, 3, 4):
            assert got[i][f"bleu_{n}"] == pytest.approx(bleu([(h, r)], n), abs=1e-9)
    corpus = overlap.corpus_bleu(pairs).first()
    for n in (1, 2, 3, 4):
        assert corpus[f"bleu_{n}"] == pytest.approx(bleu([(h, r) for _, h, r in texts()], n))


def tokens(t):
    return re.sub("[^a-z0-9]+", " ", t.lower()).split()


def f1(hits, a, b):
    return 2 * hits / (a + b) if hits else 0.0


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t


def union_hits(ref, hyp):
    left_h, left_r = Counter(w for s in hyp for w in s), Counter(w for s in ref for w in s)
    hits = 0
    for r in ref:
        found = set()
        for h in hyp:
            t, i, j = lcs_table(r, h), len(r), len(h)
            while i and j:
                if r[i - 1] == h[j - 1]:
                    found.add(i - 1)
                    i, j = i - 1, j - 1
                elif t[i][j - 1] > t[i - 1][j]:
                    j -= 1
                else:
                    i -= 1
        for i in sorted(found):
            if left_h[r[i]] and left_r[r[i]]:
                hits += 1
                left_h[r[i]] -= 1
                left_r[r[i]] -= 1
    return hits


def test_rouge(pairs):
    n = {r["pair_id"]: r for r in overlap.rouge_n(pairs).collect()}
    ell = {r["pair_id"]: r["rouge_l"] for r in overlap.rouge_l(pairs).collect()}
    lsum = {r["pair_id"]: r["rouge_lsum"] for r in overlap.rouge_lsum(pairs).collect()}
    for i, h, r in texts():
        a, b = tokens(h), tokens(r)
        for k in (1, 2):
            hits = sum((grams(a, k) & grams(b, k)).values())
            assert n[i][f"rouge_{k}"] == pytest.approx(f1(hits, max(len(a) - k + 1, 0), max(len(b) - k + 1, 0)))
        assert ell[i] == pytest.approx(f1(lcs_table(a, b)[-1][-1], len(a), len(b)))
        sents = [[tokens(s) for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s] for t in (h, r)]
        assert lsum[i] == pytest.approx(f1(union_hits(sents[1], sents[0]), len(a), len(b)))


def test_common_subsequences_of_long_texts():
    import tracemalloc

    rng = random.Random(3)
    a, b = ([f"w{rng.randrange(200)}" for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    places = overlap.lcs_places(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and len(places) == overlap.lcs_length(a, b)
    at = iter(a)
    assert all(any(w == x for x in at) for w in (b[i] for i in sorted(places)))
    assert overlap.union_hits([a], [b]) == len(places)


def test_merge_labels(spark):
    rows = [(1, 1, 0, 1), (1, 0, -1, 0), (2, 0, 0, 1), (3, None, None, None)]
    df = spark.createDataFrame(rows, "r int, A int, B int, NF int")
    got = {x["r"]: (x["A"], x["B"], x["NF"]) for x in labels.merge_labels(df, "r", ["A", "B", "NF"], "NF").collect()}
    assert got == {1: (1, 0, 0), 2: (0, 0, 1), 3: (0, 0, 1)}


def test_classification_report(spark):
    rng = random.Random(6)
    rows = [(i, c, rng.randint(0, 1) if c != "never" else 0, rng.randint(0, 1) if c != "never" else 0) for i in range(40) for c in ("a", "b", "never")]
    df = spark.createDataFrame(rows, "k int, class string, y_true int, y_pred int")
    got = {r["label"]: r for r in labels.classification_report(df, "k").collect()}

    def scores(sel):
        tp = sum(t and p for _, _, t, p in sel)
        fp, fn = sum(p for _, _, t, p in sel if not t), sum(t for _, _, t, p in sel if not p)
        div = lambda a, b: a / b if b else 0.0
        return div(tp, tp + fp), div(tp, tp + fn), div(2 * tp, 2 * tp + fp + fn), tp + fn

    per = {c: scores([r for r in rows if r[1] == c]) for c in ("a", "b", "never")}
    assert got["never"]["f1"] == 0.0 and got["never"]["support"] == 0
    assert got["micro avg"]["f1"] == pytest.approx(scores(rows)[2])
    assert got["macro avg"]["precision"] == pytest.approx(np.mean([v[0] for v in per.values()]))
    total = sum(v[3] for v in per.values())
    assert got["weighted avg"]["f1"] == pytest.approx(sum(v[2] * v[3] for v in per.values()) / total)
    each = [scores([r for r in rows if r[0] == i]) for i in range(40)]
    assert got["samples avg"]["recall"] == pytest.approx(np.mean([v[1] for v in each]))


def sets(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for pair in range(5):
        for side in ("hyp", "ref"):
            for k in range(rng.integers(0 if pair else 3, 9)):
                item = int(rng.integers(0, 6))
                v = np.random.default_rng(item).normal(size=4)
                rows.append((pair, side, f"i{item}", f"t{item % 2}", [float(x) for x in v], k))
    return [r for r in rows if not (r[0] == 4 and r[1] == "ref")]


@pytest.mark.parametrize("block", [2, 512])
def test_set_similarity(spark, block):
    rows = sets()
    items = spark.createDataFrame([r[:5] for r in rows], "pair_id int, side string, item_id string, item_type string, embedding array<double>")
    ids = spark.createDataFrame([(i,) for i in range(6)], "pair_id int")
    affinity = {("t0", "t1"): 0.5, ("t1", "t0"): 0.25}
    plain = {r["pair_id"]: r["similarity"] for r in similarity.max_mean_cosine(items, ids, block).collect()}
    typed = {r["pair_id"]: r for r in similarity.entity_affinity_f1(items, ids, affinity, block).collect()}
    for pair in range(6):
        h = [r for r in rows if r[0] == pair and r[1] == "hyp"]
        t = [r for r in rows if r[0] == pair and r[1] == "ref"]
        if not h or not t:
            assert plain[pair] == 0.0
            assert typed[pair]["f1"] == (0.5 if not h and not t else 0.0)
            continue
        a, b = np.array([r[4] for r in h]), np.array([r[4] for r in t])
        s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        assert plain[pair] == pytest.approx((s.max(1).mean() + s.max(0).mean()) / 2)
        w = s * np.array([[affinity.get((x[3], y[3]), 1.0) for y in t] for x in h])
        p, r = w.max(1).mean(), w.max(0).mean()
        assert typed[pair]["precision"] == pytest.approx(p) and typed[pair]["recall"] == pytest.approx(r)
        assert typed[pair]["f1"] == pytest.approx(2 * p * r / (p + r))


def test_entity_rewards(spark):
    rows = [
        (1, "hyp", 1, "effusion", "obs", "located_at", "lung"),
        (1, "hyp", 2, "left", "anat", None, None),
        (1, "ref", 1, "effusion", "obs", "located_at", "pleura"),
        (1, "ref", 2, "left", "anat", None, None),
        (1, "ref", 3, "clear", "obs", None, None),
        (2, "hyp", 1, "x", "obs", None, None),
    ]
    df = spark.createDataFrame(rows, "pair_id int, side string, entity_id int, tokens string, label string, relation string, target_tokens string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "pair_id int")
    got = {r["pair_id"]: (r["simple"], r["partial"], r["complete"]) for r in similarity.entity_rewards(df, ids).collect()}
    assert got[1] == pytest.approx((0.8, 0.8, 0.4)) and got[2] == (0, 0, 0) and got[3] == (0, 0, 0)


def test_report_facts(spark):
    s = spark.createDataFrame([(1, 0, "a b"), (1, 1, "12"), (1, 2, "c"), (1, 3, "a b")], "report_id int, sentence_no int, sentence string")
    f = spark.createDataFrame([("a b", ["x", "c"]), ("12", [])], "sentence string, facts array<string>")
    got = similarity.report_facts(s, f).orderBy("sentence_no", "fact_no").collect()
    assert [(r["sentence_no"], r["fact"]) for r in got] == [(0, "x"), (0, "c")]


def test_bootstraps(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(v), "rare" if i == 0 else "ab"[i % 2]) for i, v in enumerate(rng.normal(5, 1, 400))]
    df = spark.createDataFrame(rows, "k int, v double, c string").repartition(3)
    values = np.array([r[1] for r in rows])
    for fn in (bootstrap.bootstrap_mean, bootstrap.poisson_bootstrap_mean):
        b = fn(df, "v", ["k"], 200).first()
        assert b["mean"] == pytest.approx(values.mean(), abs=0.02)
        assert b["std"] == pytest.approx(values.std() / 20, rel=0.2)
    got = {(r["level"], r["category"]): r for r in bootstrap.bootstrap_by_category(df, "v", "c", ["k"], 50).collect()}
    assert got[("category", "rare")]["mean"] == pytest.approx(rows[0][1]) and got[("category", "rare")]["std"] == pytest.approx(0)
    assert ("micro", None) in got and ("macro", None) in got


def test_block_pairs_are_a_grid(spark):
    sizes = {("p", "hyp"): 23, ("p", "ref"): 11, ("q", "hyp"): 4, ("r", "hyp"): 1, ("r", "ref"): 1}
    rows = [(p, s, i, "t", [1.0, float(i)]) for (p, s), n in sizes.items() for i in range(n)]
    items = spark.createDataFrame(rows, "pair_id string, side string, item_id int, item_type string, embedding array<double>").repartition(3)
    got = similarity.block_pairs(items, 5).collect()
    cells = [(r["pair_id"], r["h_block"], r["r_block"]) for r in got]
    assert sorted(cells) == sorted([("p", h, r) for h in range(5) for r in range(3)] + [("r", 0, 0)])
    for pair, side, name in (("p", "hyp", "h"), ("p", "ref", "r")):
        blocks = {r[f"{name}_block"]: tuple(r[f"{name}_item_id"]) for r in got if r["pair_id"] == pair}
        assert sorted(i for b in blocks.values() for i in b) == list(range(sizes[(pair, side)])) and max(map(len, blocks.values())) <= 5


def test_split_draws_are_whole_and_binomial():
    b = np.arange(400)
    n, rows = np.full(400, 9_000), np.full(400, 1_000)
    got = {}
    for lines in bootstrap.split_draws(5, b, n, rows, block=64):
        for i, block, k in zip(*lines, strict=True):
            assert (i, block) not in got
            got[(i, block)] = k
    per_b, per_block = Counter(), {}
    for (i, block), k in got.items():
        per_b[i] += k
        per_block.setdefault(block, []).append(k)
    assert set(per_b.values()) == {9_000} and sorted(per_block) == list(range(16))
    for block, ks in per_block.items():
        p = min(64, 1_000 - 64 * block) / 1_000
        assert np.mean(ks) == pytest.approx(9_000 * p, rel=0.02)
        assert np.std(ks) == pytest.approx((9_000 * p * (1 - p)) ** 0.5, rel=0.2)
    # In small pieces it is the same tree.
    nodes, words = bootstrap.NODES, bootstrap.WORDS
    bootstrap.NODES, bootstrap.WORDS = 7, 50
    again = {(i, block): k for x in bootstrap.split_draws(5, b, n, rows, block=64) for i, block, k in zip(*x, strict=True)}
    bootstrap.NODES, bootstrap.WORDS = nodes, words
    assert again == got


def test_block_draws_are_even():
    b = np.arange(300)
    line, place = bootstrap.block_draws(1, b, np.full(300, 7), np.full(300, 100), 10)
    assert (np.bincount(line) == 100).all() and np.bincount(place) == pytest.approx(3_000, rel=0.06)
    # Iterations draw for themselves.
    assert len({tuple(place[line == i]) for i in range(300)}) == 300


def by_hand(entries, totals, sure, rows, block, seed):
    """Sums per (iteration, group) with one draw after the other."""
    out = Counter()
    b, n = np.array(list(totals)), np.array(list(totals.values()))
    drawn = list(sure)
    for i, number, k in (x for lines in bootstrap.split_draws(seed, b, n, np.full(len(b), rows), block) for x in zip(*lines, strict=True)):
        one = (np.array([i]), np.array([number]), np.array([k]))
        drawn += [(i, number * block + p) for p in bootstrap.block_draws(seed, *one, min(block, rows - number * block))[1]]
    for i, idx in drawn:
        for group, v in entries.get(idx, []):
            out[(i, group)] += v
    return out


def test_resampled_sums(spark):
    rng = random.Random(2)
    entries = {i: [(rng.choice(["p", "q", None]), rng.randint(1, 5)) for _ in range(rng.randrange(4))] for i in range(50)}
    totals, sure = {i: 40 + i for i in range(9)}, [(i, rng.randrange(50)) for i in range(9) for _ in range(3)]
    flat = spark.createDataFrame([(i, g, float(v)) for i, own in entries.items() for g, v in own], "idx long, group string, v double")
    got = {}
    for parts, cells in ((1, bootstrap.CELLS), (5, 60)):
        whole, bootstrap.CELLS = bootstrap.CELLS, cells
        df = bootstrap.resampled_sums(
            flat.repartition(parts), spark.createDataFrame([(b, n, 50) for b, n in totals.items()], "b long, n long, rows long").repartition(parts), ["v"], 3,
            spark.createDataFrame([(b, i, 50) for b, i in sure], "b long, idx long, rows long"), block=8,
        )
        got[parts] = {(r["b"], r["group"]): r["v"] for r in df.collect()}
        bootstrap.CELLS = whole
    assert got[1] == got[5] == by_hand(entries, totals, sure, 50, 8, 3)


def test_no_draw_leaves_its_task(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("v"))
    plan = bootstrap.bootstrap_mean(df, "v", ["id"], 1000)._jdf.queryExecution().toString()
    assert "ArrowCoGroup" in plan or "FlatMapCoGroupsInArrow" in plan
    sums = bootstrap.bootstrap_mean(df.where("id < 0"), "v", ["id"], 10).first()
    assert sums["mean"] is None


def test_label_metrics(spark):
    rows = [(i, c, int((i + j) % 9 == 0), int(i % 3 == j % 3)) for i in range(30) for j, c in enumerate("pq")] + [(0, "zero", 0, 1)]
    df = spark.createDataFrame(rows, "k int, class string, y_true int, y_pred int")
    kept = bootstrap.bootstrap_multilabel(df, "k", "macro", 5).first()["mean"]
    dropped = bootstrap.bootstrap_multilabel(df, "k", "macro", 5, drop_empty_classes=True).first()["mean"]
    assert dropped == pytest.approx(kept * 3 / 2)
    # Every class with positives has one in every resample.
    least = bootstrap.LabelMetric(lambda t, p: {"true": t}, lambda: F.min(F.when(F.col("group") != "zero", F.col("true"))))
    scores = [r["score"] for r in bootstrap.bootstrap_label_scores(df, "k", least, 40).collect()]
    assert len(scores) == 40 and min(scores) >= 1
    bootstrap.register_label_metric("rows", bootstrap.LabelMetric(lambda t, p: {"n": F.lit(True)}, lambda: F.max("n")))
    drawn = {r["score"] for r in bootstrap.bootstrap_label_scores(df.where("class = 'p'"), "k", "rows", 10).collect()}
    assert drawn == {30.0}
    with pytest.raises(ValueError, match="unknown metric"):
        bootstrap.bootstrap_multilabel(df, "k", "nope")
    with pytest.raises(Exception, match="no positive label"):
        bootstrap.bootstrap_multilabel(df.withColumn("y_true", F.lit(0)), "k", ensure_all_classes=False, n_boot=3).collect()


def test_registry(pairs):
    with pytest.raises(ValueError, match="unknown metrics"):
        plugins.compute_metrics(pairs, ["nope"])
    out = plugins.compute_metrics(pairs, ["BLEU-1", "BLEU-4", "ROUGE-1", "ROUGE-2", "ROUGE-L"])
    assert out.columns == ["pair_id", "bleu_1", "bleu_4", "rouge_1", "rouge_2", "rouge_l"] and out.count() == 60
    assert plugins.drop_empty_refs(pairs).count() == sum(bool(r.strip()) for _, _, r in texts())


def test_memoized_runs_misses_only(spark, tmp_path):
    log = str(tmp_path / "calls")

    def fn(batch):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in batch)
        return [(len(t),) for t in batch]

    model = plugins.text_model(fn, "n int", 2)
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([("a",), ("bb",), ("a",)], "t string")
    assert sorted(r["n"] for r in plugins.memoized(first, "t", model, cache).collect()) == [1, 1, 2]
    second = spark.createDataFrame([("bb",), ("ccc",)], "t string")
    assert sorted(r["n"] for r in plugins.memoized(second, "t", model, cache).collect()) == [2, 3]
    assert sorted(open(log).read().split()) == ["a", "bb", "ccc"]


def test_metrics_over_model_outputs_by_name(spark):
    from roentgrid.operators import plugins

    pairs = spark.createDataFrame([(1, "a b", "a c"), (2, "x", "x")], "pair_id int, hyp string, ref string")
    labels = spark.createDataFrame([(1, "p", 1, 1), (1, "q", 0, 1)], "pair_id int, class string, y_true int, y_pred int")
    entity = "pair_id int, side string, entity_id int, tokens string, label string, relation string, target_tokens string"
    entities = spark.createDataFrame([(1, s, 1, "x", "obs", None, None) for s in ("hyp", "ref")], entity)
    items = spark.createDataFrame([(2, s, "i", "t", [1.0, 0.0]) for s in ("hyp", "ref")], "pair_id int, side string, item_id string, item_type string, embedding array<double>")
    options = {"CheXbert": {"labels": labels}, "RadGraph": {"entities": entities}, "RaTEScore": {"items": items, "affinity": {}}}
    got = {r["pair_id"]: r for r in plugins.compute_metrics(pairs, options).collect()}
    assert got[1]["chexbert_accuracy"] == 0.5 and got[2]["chexbert_accuracy"] is None
    assert got[1]["radgraph_simple"] == 1.0 and got[2]["radgraph_simple"] == 0.0
    assert got[2]["ratescore_f1"] == pytest.approx(1.0) and got[1]["ratescore_f1"] == 0.5
    assert {"CheXbert", "CXRFEScore", "RadGraph", "RaTEScore"} <= set(plugins.METRICS) and len(plugins.METRICS) >= 12
