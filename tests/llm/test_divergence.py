import random
import re
from collections import Counter

import helpers
import numpy as np
import pyarrow as pa

from roentgrid.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, p long, c int"


def table(spark, rows):
    """Documents with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2, 3) for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, in_documents=10, top=10):
    groups, seen = {}, {}
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        words = ["".join(c.lower() if c < "\x7f" else c for c in w) for w in words]
        groups.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(words)
        seen.setdefault(lang or "", Counter()).update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= in_documents]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(sum(sources.values(), Counter()))
        p = {s: shares(c) for s, c in sources.items()}

        def apart(x, y):
            return (x - y) ** 2 // (x + y)

        for s in sources:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def corpus(seed, n=400, sources=9):
    rng = random.Random(seed)
    words = [f"w{''.join(rng.choice('abcdEFG') for _ in range(3))}" for _ in range(60)] + ["Äpfel", "äpfel", "漢字", "naïve"]
    rows = []
    for _ in range(n):
        source = f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        own = words[int(source[1:]) * 3 :]
        rows.append((rng.choice([" ", "-", "1", "\n"]).join(rng.choice(own) for _ in range(rng.randrange(40))), rng.choice(["en", "de"]), source))
    return rows


AWKWARD = [
    (None, None, None), ("", "", ""), ("Zz zz ZZ", "xx", "alone"), (" ".join(helpers.words_of(1, 20_000)), "en", "long"),
    ("one two", "yy", "a"), ("one three", "yy", "b"), (None, "en", "silent"), ("w\x00waaa\x7fwaaa", "en", None),
]


def result(df):
    return sorted(map(tuple, df.collect()))


def test_audit_against_brute_force(spark):
    rows = corpus(1) + AWKWARD + [corpus(1)[0]] * 3
    got = result(divergence.audit(table(spark, rows)))
    assert got == brute(rows)
    assert {r[:3] for r in got if r[0] == "yy"} == {("yy", "a", "pair"), ("yy", "b", "pair")}
    assert all(r[4] == 0 for r in got if r[0] == "yy")


def test_cells_add_up_to_the_same(spark):
    rows = corpus(2, 300) + AWKWARD
    groups, entries = divergence.tables(table(spark, rows))
    whole = result(divergence.pair_divergences(groups, entries))
    cut = result(divergence.pair_divergences(groups, entries, groups_a_block=2, terms_a_block=7))
    assert cut == whole == sorted((lang, s, item, value) for lang, s, part, item, value, _ in brute(rows) if part == "pair")


def test_counts_do_not_depend_on_flushes(spark):
    docs = table(spark, corpus(3, 100))
    sums = [
        sorted(map(str, divergence.count_terms(docs, held).groupBy("lang", "source", "term").agg({"n": "sum", "n_docs": "sum"}).collect()))
        for held in (10, 10**6)
    ]
    assert sums[0] == sums[1]


def test_shares_beyond_long_products(spark):
    from pyspark.sql import functions as F

    big = 9 * 10**17
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(big), F.lit(3)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 2) // (big + 6)


def test_a_cell_of_two_blocks():
    rows = pa.table({
        "second": [0, 1, 1, 0, 1], "gid": [5, 9, 2, 5, 9], "term": [None, None, None, "a", "b"], "p": np.array([10, 20, 30, 100, 7]),
    })

    def pairs(b, rows):
        key = tuple(pa.scalar(x) for x in ("en", 0, b, 0))
        return {(r["g"], r["h"]): r["value"] for r in divergence._partial_sums(key, rows).to_pylist()}

    def f(x, y):
        return (x - y) ** 2 // (x + y)

    # A block without groups has no pairs with another, nor with itself.
    assert pairs(1, rows.filter(pa.array([True, False, False, True, False]))) == {}
    assert pairs(1, rows) == {(5, 9): f(100, 20) + f(10, 7) - 2 * f(10, 20), (5, 2): f(100, 30) + f(10, 30) - 2 * f(10, 30)}


def test_empty_table(spark):
    assert divergence.audit(table(spark, AWKWARD).where("doc_id < 0")).count() == 0
