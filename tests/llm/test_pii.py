import helpers

from roentgrid.llm import pii

SPANS = [
    "mail a.b+c@d-e.co.uk, x@y z@w.com; a@b.c.+x@d.e q@@r.st @m.no u@v..w k@l.mn.",
    "ip 1.2.3.4 256.1.1.1 01.002.3.255 1.2.3.4.5 999.1.2.3 0.0.0.0, 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 79927398713 " + "0" * 19 + " " + "0" * 20,
    "phone +1 (286) 555-5136, +12 3, +1234567890+1234567890 ++49.30.123456-7890. +1(2)3 +999999999999999 +9999999999999999",
    "é€😀 +1 499 555 6503😀 a@b.cd 6992706490339255",
    "9" * 3000 + " " + "a" * 5000 + "@" + "b" * 5000 + ".c" * 3000 + " 1." * 4000,
]


def test_fixed_forms_against_brute_force(spark):
    texts = helpers.awkward([*SPANS, *SPANS[:2], " ".join(SPANS[:5] * 40)])
    ids = [None, *range(1, len(texts) - 1), 1]
    got = pii.report(pii.detect(helpers.documents(spark, texts, ids))).collect()
    want = []
    for i, t in zip(ids, texts, strict=True):
        spans = helpers.fixed_spans(t)
        want.append((i or -1, *[sum(s.startswith(k + ":") for s in spans) for k in pii.KINDS], helpers.sha(spans), ",".join(spans)))
    assert sorted((r[0] or -1, *r[1:]) for r in got) == sorted(want)


def test_contexts_discover_identifiers(spark):
    words = [" ".join(helpers.words_of(100 + i, 30)) for i in range(20)]
    texts = [f"{w} please call me at +1 (286) 555-51{i:02d} any day {w}" for i, w in enumerate(words[:8])]
    texts += [f"{words[8]} please call me at 286 555 7777 any day", f"{words[9]} in the year 2021 or 1234567 again"]
    texts += [f"{words[10]} invoice 99887766 and 286 555 7777"]  # a discovered value in another context
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.detect(helpers.documents(spark, texts))).collect()}
    for i in range(8):
        assert got[i] == ",".join(helpers.fixed_spans(texts[i]))
    for i in (8, 10):
        at = texts[i].index("286 555 7777")
        assert got[i] == f"phone:{at}:{at + 12}"
    assert got[9] == ""


def spans_of(texts, spark):
    return {r["doc_id"]: r["spans"] for r in pii.report(pii.detect(helpers.documents(spark, texts))).collect()}


def test_unseen_values_do_not_speak_against_their_pattern(spark):
    words = [" ".join(helpers.words_of(200 + i, 12)) for i in range(50)]
    texts = [f"{words[i]} call me at +1 (286) 555-51{i:02d}, {words[i]}" for i in range(10)]
    texts += [f"{words[i]} call me at 286 555 72{i:02d}, {words[i]}" for i in range(10, 40)]
    texts += [f"{words[40]} invoice 99887766, {words[40]}"]
    got = spans_of(texts, spark)
    for i in range(10, 40):
        at = texts[i].index("286 555")
        assert got[i] == f"phone:{at}:{at + 12}"
    assert got[40] == ""


def test_discovery_goes_on_until_nothing_is_new(spark):
    # Each group of numbers stands behind its own words and behind those of the group before.
    texts = [f"step za is +1 (286) 555-51{i:02d}" for i in range(10)]
    names = ["za", "zb", "zc", "zd", "ze", "zf", "zg"]
    for k, (old, new) in enumerate(zip(names, names[1:])):
        for i in range(12):
            texts += [f"step {old} is 286 555 {k}0{i:02d}", f"step {new} is 286 555 {k}0{i:02d}"]
    texts += ["step zg is 287 111 2222", "step zh is 287 111 3333"]
    got = spans_of(texts, spark)
    assert [i for i in range(len(texts)) if not got[i]] == [len(texts) - 1]


def test_mixed_contexts_prove_nothing(spark):
    kinds = ["+1 (286) 555-51{:02d}", "a{}@b.com", "10.0.0.{}", "token{}99999"]
    texts = [f"one of the {kinds[i % 4].format(i)} was here" for i in range(40)] + ["one of the 1234567 was here"]
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.detect(helpers.documents(spark, texts))).collect()}
    assert got[40] == ""


def test_redaction(spark):
    texts = ["to a@b.cd or +1 (286) 555-5136!", None, "", "clean  text", "é +1 (286) 555-5136"]
    docs = helpers.documents(spark, texts)
    out = pii.redacted(docs)
    assert out.schema == docs.schema
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["to [EMAIL] or [PHONE]!", None, "", "clean  text", "é [PHONE]"]
    assert pii.redacted(docs.where("doc_id < 0")).count() == 0


def test_overlapping_spans_become_one(spark):
    out = pii.redacted(helpers.documents(spark, ["+1 234 567 890 123 4 and +411111111111111 z"])).first()["text"]
    assert "1" not in out and out.endswith(" z")
