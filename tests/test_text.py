import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roentgrid.functions import text, vocab


def test_path_parts(one):
    v = one(text.path_parts("p"), p="x/p10/p10703179/s58829627.txt")
    assert tuple(v) == ("10", "10703179", "58829627")
    assert one(text.path_parts("p"), p="p10/s1.txt") is None
    with pytest.raises(PySparkException):
        one(text.path_parts("p", strict=True), p="nothing")


@pytest.mark.parametrize(
    "findings, impression, want",
    [
        (" a ", " b? ", "a. b?"),
        (None, "b;", "b;"),
        ("  ", None, ""),
        ("a.", "", "a."),
        ("a,", "b:", "a, b:"),
        ("a!", "\n", "a!"),
    ],
)
def test_full_report(one, findings, impression, want):
    assert one(text.full_report("f", "i"), "f string, i string", f=findings, i=impression) == want


def test_concat_sections(one):
    assert one(text.concat_sections("f", "i"), f="a", i=" b") == "a. b"
    assert one(text.concat_sections("f", "i"), f="a.", i="b") == "a. b"
    assert one(text.concat_sections("f", "i"), "f string, i string", f=None, i="b") == "b"


def test_unicode_space(one):
    s = "  a \tb\x1f\n"
    assert one(text.squeeze_ws("s"), s=s) == " ".join(s.split())
    assert one(text.strip("s"), s=s) == s.strip()


def test_class_tables(one):
    assert len(vocab.CLASS_PHRASES) == 28 and len(vocab.GLOBAL_CLASSES) == 6
    assert one(text.class_phrase("c"), c="ILD") == "Interstitial lung disease"
    assert one(text.class_phrase("c"), c="none") is None
    assert one(text.is_localizable("c"), c="COPD") is False
    assert one(text.is_localizable("c"), c="none") is None
    assert len(vocab.LOCATE_AND_DESCRIBE) == 29 and len(vocab.LOCATE_ONLY) == 7 and len(vocab.DESCRIBE_ONLY) == 9


def test_prompts(one):
    assert one(text.agrg_prompt("l", "Localize"), l="spine") == "Localize and describe the spine."
    assert one(text.agrg_prompt("l"), l="neck") == "Describe the neck."
    assert one(text.agrg_prompt("l"), l="moon") is None
    assert one(text.prompt_type("p"), p="LOCATE and describe x") == "locate_and_describe"
    assert one(text.prompt_type("p"), p="find x") is None
    with pytest.raises(ValueError):
        text.agrg_text("draw", "l")


def test_generation_cleaning(one):
    assert one(text.clean_generation("t"), t="user\nmodel\na\nmodel\n b ") == "b"
    assert one(text.clean_generation("t", "sep_blank"), t="[BOS]a[SEP]b[EOS]") == "a b"
    assert one(text.clean_generation("t", "sep_paragraph"), t="[BOS]a[SEP]b[EOS]") == "a\n\nb"


def test_description(one):
    assert one(text.extract_description("t"), t="Location: x. DESCRIPTION of it:  clear \n") == "clear"
    assert one(text.extract_description("t"), t="Description: one\ntwo") is None
    assert one(text.extract_description("t", "eval"), t="Description: one\ntwo") == "one"
    assert one(text.extract_description("t"), t="nothing") is None
    assert one(text.extract_description("t"), t="Description:") == ""


def test_eval_text(one):
    t = "Location of the spine: [0.1,0.2, 0.3 ,0.4] . Description of x:  a : .  b ."
    assert one(text.clean_eval_text("t"), t=t) == "a. b."
    assert one(text.clean_eval_text("t"), t="Location of it: [1,2,3,4]") == "Location of it."


def test_remove_grounding(one):
    t = "Thickening [(0.72,0.08,0.26,0.12),(0.41,0.19,0.17,0.10)]"
    assert one(text.remove_grounding("t", "legacy"), t=t) == "Thickening"
    assert one(text.remove_grounding("t"), t="a [0.1,0.2,0.3,0.4] b") == "a b"


def test_join_sentences(one):
    assert one(text.join_sentences("s"), s=[" a", "", "b.", " "]) == "a. b."
    assert one(text.join_sentences("s"), s=["  "]) == ""


def test_parse_facts(one):
    assert one(text.parse_facts("t"), t='x ["a", "b", "a"] y') == ["a", "b"]
    assert one(text.parse_facts("t"), t='x ["a", "b"') == ["a", "b"]
    assert one(text.parse_facts("t"), t="none") is None
    assert one(text.parse_facts("t"), t="[ ]") == []


def naive_drop(words, k):
    low = [w.lower() for w in words]
    gone = set()
    for end in range(2 * k, len(low) + 1):
        if low[end - k : end] == low[end - 2 * k : end - k]:
            gone.update(range(end - k, end))
    return [w for i, w in enumerate(words) if i not in gone]


def test_drop_repeats_brute_force(spark):
    rng = random.Random(5)
    rows = [" ".join(rng.choice(["a", "b", "B", "c"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows += ["x y x y x y", " one ", "", "no no No yes"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", text.drop_repeats("t").alias("v")).collect()
    for r in got:
        words = rows[r["i"]].split()
        for k in range(1, 9):
            words = naive_drop(words, k)
        assert r["v"] == " ".join(words)


def test_sentences_and_chunks(one):
    assert one(text.sentences("t"), t=" A b.  C d! e? ") == ["A b.", "C d!", "e?"]
    assert one(text.sentences("t"), t="  ") == []
    assert one(text.chunk_text("t", 8), t="Ab c. De f! Long sentence here. x") == ["Ab c.", "De f!", "Long sentence here.", "x"]
    assert one(text.chunk_text("t", 10), t="Ab c. De f! x") == ["Ab c. De f!", "x"]
    assert one(text.chunk_text("t", 10), t="") == []


def test_locations(one):
    got = one(text.with_default_locations("l"), l=["neck", "unknown", "spine"])
    assert "unknown" not in got and set(got) == {"neck", *vocab.DEFAULT_LOCATIONS}
    assert "unknown" in one(text.with_default_locations("l", drop_unknown=False), l=["unknown"])


def test_grounded_list(one):
    v = one(text.grounded_list_text("t"), t='[["a", null], [3, []], "s", ["b.", [[1,2,3,4]]]]')
    assert (v["text"], v["skipped"]) == ("a. b.", 2)
    assert one(text.grounded_list_text("t"), t="no")["text"] is None


def test_names_and_refusals(one):
    assert one(text.safe_name("t"), t="org/mödel v1.0_x-y") == "org_mödel_v1.0_x-y"
    assert one(text.is_refusal("t"), t="Sorry, no") is True
    assert one(text.is_refusal("t"), t="sorry, no") is False
    assert one(text.extract_json("t"), t="a {x} \n {y} b") == "{x} \n {y}"
    assert one(text.extract_json("t"), t="} {") is None


def test_text_key(one):
    import hashlib

    t = "é" * 3
    assert one(text.text_key("t"), t=t) == f"3_{hashlib.sha256(t.encode()).hexdigest()}"


def test_clean_findings(spark):
    schema = "f array<struct<sentence_en: string, sentence_es: string>>"
    df = spark.createDataFrame([([(" a  b. ", "c")],)], schema)
    assert df.select(F.transform(text.clean_findings("f"), lambda x: x["sentence_en"]).alias("v")).first()["v"] == ["a b"]
