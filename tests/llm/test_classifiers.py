import random

import helpers
import numpy as np
import pytest

from roentgrid.llm import license_scan, pu_quality, toxicity

GOOD = "the quick brown fox and a lazy dog went over the hill in fine weather but came home late".split()


def prose(seed, n=60):
    rng = random.Random(seed)
    return ". ".join(" ".join(rng.choice(GOOD) for _ in range(8)).capitalize() for _ in range(n // 8)) + "."


def junk(seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(GOOD).upper() + rng.choice(["!!", "$$$", "%%%", " |"]) for _ in range(60))


def labelled(spark, rows):
    return spark.createDataFrame([(i, q, t, "x") for i, q, t in rows], "doc_id long, quality int, toxic int, text string")


def test_quality(spark):
    texts = [junk(i) if i % 5 == 0 else prose(i) for i in range(400)]
    docs = helpers.documents(spark, texts + [None, "", prose(1000, 4000)])
    labels = labelled(spark, [(i, int(i % 5 != 0), 0) for i in range(300)] + [(None, 1, 0), (3, 0, 0), (9999, 1, 0), (7, None, 0)])
    model = pu_quality.learn(docs, labels)
    got = {r["doc_id"]: r for r in pu_quality.score(docs, model).collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got.values())
    for i in range(400):
        assert got[i]["predicted"] == (i % 5 != 0)
        assert got[i]["held_out"] == (helpers.fold(i, 3) == 1)
    kept = pu_quality.accepted(docs, model)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_quality_ignores_held_out_labels(spark):
    texts = [junk(i) if i % 4 == 0 else prose(i) for i in range(120)]
    docs = helpers.documents(spark, texts)
    right = [(i, int(i % 4 != 0), 0) for i in range(120)]
    wrong = [(i, 1 - q if helpers.fold(i, 3) == 1 else q, t) for i, q, t in right]
    a, b = (sorted(pu_quality.score(docs, pu_quality.learn(docs, labelled(spark, x))).collect()) for x in (right, wrong))
    assert a == b


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = helpers.awkward([prose(1), junk(2), "\n", "a\na\na\nb"])
    together = pu_quality.batch_features(pa.array([t or "" for t in texts]))
    alone = np.concatenate([pu_quality.batch_features(pa.array([t or ""])) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_without_labels_or_rows(spark):
    docs = helpers.documents(spark, [prose(1), None, ""])
    none = labelled(spark, []) if False else labelled(spark, [(0, 0, 0)]).where("doc_id < 0")
    assert {r["score"] for r in pu_quality.score(docs, pu_quality.learn(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.0}
    empty = docs.where("doc_id < 0")
    one = labelled(spark, [(0, 1, 1), (3, 0, 0)])
    assert pu_quality.score(empty, pu_quality.learn(empty, one)).count() == 0
    assert toxicity.score(empty, toxicity.learn(empty, one)).count() == 0


INSULTS = ["blockhead", "nitwit", "numskull"]


@pytest.fixture(scope="module")
def toxic(spark):
    def text(i):
        rng = random.Random(i)
        words = [rng.choice(GOOD) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(INSULTS))
        return " ".join(words)

    texts = [text(i) for i in range(300)]
    extra = ["", None, "you are a blokhead and a nitwitt you numskul " + prose(5), 'he said "nitwit" in a quote ' + prose(6), text(4) + " " + prose(7, 8000)]
    docs = helpers.documents(spark, texts + extra)
    labels = labelled(spark, [(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (1, 1, 1), (2, None, None)])
    return docs, toxicity.learn(docs, labels)


def test_toxicity(spark, toxic):
    docs, model = toxic
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(300))
    assert all(got[i]["held_out"] == (helpers.fold(i, 4) == 2) for i in range(300))
    assert got[302]["predicted"] == 1  # misspelled
    assert got[303]["score"] < got[302]["score"]  # quoted
    assert got[300]["predicted"] == got[301]["predicted"] == 0 and got[304]["predicted"] == 1


def test_lexicon_against_edit_distance():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))): float(k + 1) for k in range(12)}
    lexicon = toxicity.Lexicon(words, {"cabb": 20.0})
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 9)))
        exact = max([words.get(w, 0.0), 20.0 if w.startswith("cabb") else 0.0])
        near = max((weight for e, weight in words.items() if edits(w, e) <= 1), default=0.0)
        assert lexicon.fuzzy(w) == near
        assert lexicon.weight(w) == (exact or toxicity.FUZZY_WEIGHT * near)


def test_licenses(spark):
    filler = [prose(i) for i in range(120)]
    texts = [
        "Released under the MIT License.", f"{prose(900)}\nLicensed under the Apache License, Version 2.0.\n{prose(901)}",
        f"This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "I am licensed to drive",
        None, "", "\n\n", "Licensed under CC BY-NC 4.0.\n" * 2, prose(902, 20_000) + "\nReleased under the MIT License.",
    ]
    docs = helpers.documents(spark, texts + filler)
    model = license_scan.learn(docs)
    got = {r["doc_id"]: r for r in license_scan.licenses(docs, model).collect()}
    assert len(got) == len(texts) + 120
    assert [got[i]["licenses"] for i in range(9)] == [["mit"], ["apache-2.0"], ["cc-by-nc", "gpl"], [], [], [], [], ["cc-by-nc"], ["mit"]]
    assert [got[i]["license"] for i in (0, 1, 3, 4)] == ["mit", "apache-2.0", "unknown", "unknown"]
    assert got[7]["n_notices"] == 2 and all(got[i]["license"] == "unknown" for i in range(9, len(got)))
    empty = docs.where("doc_id < 0")
    assert license_scan.licenses(empty, license_scan.learn(empty)).count() == 0


def test_shared_words_name_no_family(spark):
    """Identifiers of licences without templates are unknown, whatever words stand in front of them."""
    texts = [f"SPDX-License-Identifier: {x}" for x in ("AGPL-3.0-only", "ISC", "Zlib", "EPL-2.0", "MIT", "Apache-2.0", "MPL-2.0", "BSD-3-Clause")]
    texts += ["Released under the ISC License.", "Licensed under the EUPL."]
    docs = helpers.documents(spark, texts + texts[4:5] + [prose(i) for i in range(120)])
    got = {r["doc_id"]: r["license"] for r in license_scan.licenses(docs, license_scan.learn(docs)).collect()}
    assert [got[i] for i in range(11)] == ["unknown"] * 4 + ["mit", "apache-2.0", "mpl-2.0", "bsd"] + ["unknown"] * 2 + ["mit"]


def test_every_template_is_found(spark):
    texts = [t for family in license_scan.TEMPLATES.values() for t in family]
    families = [f for f, ts in license_scan.TEMPLATES.items() for _ in ts]
    docs = helpers.documents(spark, texts + [prose(i) for i in range(150)])
    got = {r["doc_id"]: r["license"] for r in license_scan.licenses(docs, license_scan.learn(docs)).collect()}
    assert sum(got[i] == f for i, f in enumerate(families)) >= len(families) - 2
