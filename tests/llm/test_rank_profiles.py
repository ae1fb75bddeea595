import random
import unicodedata
from collections import Counter

import helpers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roentgrid.llm import rank_profiles

WORDS = {
    "en": "the and of to in that was with his they from have this which words water people over would their there could".split(),
    "de": "der und die das nicht ist ein eine mit sich auf für auch werden über würde zwischen straße können müssen".split(),
    "fr": "le la les des est une dans pour que qui sur avec être cette même après très où était garçon".split(),
}


def spaced(text):
    keep = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    return keep.split(" ") if any(unicodedata.category(c)[0] == "L" for c in text or "") else []


def counts(text):
    out = Counter()
    for word in filter(None, spaced(text)):
        s = f" {word} "
        out.update(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if s[i : i + k] != " ")
    return out


def profile(count, places):
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:places]]


def brute(rows, places):
    """(doc_id, held_out, lang_pred, score) by comparing lists."""
    learned = {}
    for i, text, lang in rows:
        if lang is not None and (i is None or helpers.fold(i, 4) != 2) and counts(text):
            learned.setdefault(lang, Counter()).update(counts(text))
    learned = {lang: {g: k for k, g in enumerate(profile(c, places))} for lang, c in learned.items()}
    out = []
    for i, text, _ in rows:
        own = profile(counts(text), places)
        far = [(sum(abs(at[g] - k) if g in at else places for k, g in enumerate(own)), lang) for lang, at in sorted(learned.items())]
        held = i is not None and helpers.fold(i, 4) == 2
        out.append((i, held, min(far)[1], 1 - min(far)[0] / (places * len(own))) if own and far else (i, held, "und", 0.0))
    return sorted(out, key=str)


def corpus(n=120):
    rng = random.Random(4)
    langs = [rng.choice(list(WORDS)) for _ in range(n)]
    return [(" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(5, 60))), lang) for lang in langs]


def table(spark, rows):
    made = [(i, t, lang, "x", 1, 2, "y") for i, t, lang in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, letters string, n long, place long, gram string").repartition(3)


@pytest.mark.parametrize("places", [300, 20])
def test_against_brute_force(spark, places):
    texts = corpus()
    texts += [(t, "en") for t in helpers.awkward(["123 !! 456", "É", "éÉ éé", "\U0001f600 áb", "a", "THE THE the"])] + [("le la les", None), ("qq xx", "")]
    ids = [None, *range(1, len(texts) - 1), 5]
    rows = [(i, t, lang) for i, (t, lang) in zip(ids, texts, strict=True)]
    docs = table(spark, rows)
    got = [tuple(r) for r in rank_profiles.predict(docs, rank_profiles.learn(docs, places)).collect()]
    assert sorted(got, key=str) == brute(rows, places)
    right = [p == lang for (_, _, lang), p in zip(rows[1:120], [dict((g[0], g[2]) for g in got)[i] for i in ids[1:120]], strict=True)]
    assert sum(right) > 110 or places < 300


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aábc 漢\U0001f600"), max_size=30))
def test_grams(text):
    words = [w for w in text.replace("\U0001f600", "\U00010400").split(" ") if w]
    norm = f" {' '.join(words)} " if words else ""
    got = Counter()
    for v in rank_profiles.grams(norm).tolist():
        chars = [v >> 42, v >> 21 & (1 << 21) - 1, v & (1 << 21) - 1]
        got["".join(chr(c) for c in chars if c)] += 1
    wanted = Counter()
    for word in words:
        s = f" {word} "
        wanted.update(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if s[i : i + k] != " ")
    assert got == wanted


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(corpus())]
    wrong = [(i, t, "zz" if helpers.fold(i, 4) == 2 else lang) for i, t, lang in rows]
    a, b = (sorted(map(tuple, rank_profiles.predict(d, rank_profiles.learn(d)).collect())) for d in (table(spark, rows), table(spark, wrong)))
    assert a == b and "zz" not in {r[2] for r in a}


def test_counts_do_not_depend_on_flushes(spark):
    from pyspark.sql import functions as F

    docs = table(spark, [(i, t, lang) for i, (t, lang) in enumerate(corpus())]).select("lang", rank_profiles.letters().alias("letters"))
    sums = [
        sorted(map(tuple, rank_profiles.gram_counts(docs, held).groupBy("lang", "gram").agg(F.sum("n")).collect())) for held in (1, 10**6)
    ]
    assert sums[0] == sums[1]


def test_nothing_learned_and_empty_table(spark):
    docs = table(spark, [(1, "the and", None), (2, None, "en")])
    assert {(r["lang_pred"], r["score"]) for r in rank_profiles.predict(docs, rank_profiles.learn(docs)).collect()} == {("und", 0.0)}
    empty = docs.where("doc_id < 0")
    assert rank_profiles.predict(empty, rank_profiles.learn(empty)).count() == 0
