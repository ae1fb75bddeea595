import corpus_pipeline
import helpers

from roentgrid.llm import common, phrases, queries

ITEM = " ".join(helpers.words_of(11, 25))


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def cases():
    w = ITEM.split()
    mixed = " ".join(helpers.words_of(3, 40))
    return helpers.awkward([
        f"{mixed} {ITEM} {mixed}", f"{mixed} {' '.join(w[3:14])}, and {ITEM.upper()}!", " ".join(w[:9]), "-".join(w[5:15]),
        "x short item here y short ITEM here", f"{' '.join(w[:5])} extra {' '.join(w[5:12])}", ITEM, ITEM,
    ])


ITEMS = [(1, ITEM), (12, "Short item, here"), (2, None), (3, ""), (None, " ".join(helpers.words_of(2, 20))), (2, ITEM + " more"), (10, "漢字")]


def test_against_brute_force(spark):
    texts = cases()
    docs = helpers.documents(spark, texts)
    got = phrases.report(phrases.contamination(docs, table(spark, ITEMS))).collect()
    want = helpers.leaks(texts, ITEMS)
    assert len(got) == len(texts)
    for r in got:
        n, hit, items = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(items), helpers.sha(items), hit > 0)
    assert sum(r["contaminated"] for r in got) >= 6


def test_blocks_and_shards_do_not_matter(spark, monkeypatch):
    texts = cases()
    whole = sorted(phrases.report(phrases.contamination(helpers.documents(spark, texts), table(spark, ITEMS))).collect())
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 5)
    monkeypatch.setattr(phrases.blocks_of, "__defaults__", (phrases.WORDS, 5))
    monkeypatch.setattr(phrases.build_index, "__defaults__", (64,))
    assert sorted(phrases.report(phrases.contamination(helpers.documents(spark, texts), table(spark, ITEMS))).collect()) == whole


def test_proximity(spark):
    w = ITEM.split()
    near = " ".join([*w[:4], "new", *w[4:10]])
    far = " ".join([*w[:4], *helpers.words_of(9, 30), *w[4:10]])
    docs = helpers.documents(spark, [near, far, ITEM])
    found = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in phrases.contamination(docs, table(spark, [(1, ITEM)]), slop=2).collect()}
    assert found == {0: (0, 1), 1: (0, 0), 2: (25, 1)}


def near_items(text, items, width=10, slop=4):
    w, found = helpers.bench_words(text), set()
    for item, passage in items:
        v = helpers.bench_words(passage)
        for i in range(max(1, len(v) - width + 1) if v else 0):
            window = v[i : i + width]
            if any(all(x in w[max(0, p + k - slop) : max(0, p + k + slop + 1)] for k, x in enumerate(window)) for p in range(-slop, len(w) + slop)):
                found.add(item)
    return found


def test_registered_query_and_stage_find_near_passages(spark, tmp_path, monkeypatch):
    w = ITEM.split()
    filler = helpers.words_of(41, 30, 5000)
    inserted = [x for k, x in enumerate(w) for x in ([x, "new"] if k % 5 == 4 else [x])]
    dropped = [x for k, x in enumerate(w) if k != 2][:14]
    moved = [x for k in range(0, 24, 2) for x in (w[k + 1], w[k])]
    apart = [x for x in w for x in [x, "a", "b", "c", "d"]]
    texts = [" ".join(x) for x in ([*filler, *inserted, *filler], [*filler, *dropped], [*moved, *filler], [*filler, *apart], w, w[:9])] + ["Short and another item here", None, ""]
    helpers.documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, ITEM), (12, "Short item, here"), (None, " ".join(moved[:12])), (3, "")]
    table(spark, items).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in queries.op5(spark, str(tmp_path)).collect()}
    want = [near_items(t, items) for t in texts]
    assert [got[i]["n_near"] for i in range(len(texts))] == [len(x) for x in want]
    assert all(1 in want[i] for i in (0, 1, 2, 4)) and not want[3] and not want[5] and 12 in want[6]
    assert not got[0]["contaminated"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in enumerate(want) if not x}
    # Shards of other sizes have other rarest terms.
    monkeypatch.setattr(phrases.build_index, "__defaults__", (64,))
    assert {r["doc_id"]: r for r in queries.op5(spark, str(tmp_path)).collect()} == got


def test_repeated_ids_and_empty_tables(spark):
    docs = helpers.documents(spark, [ITEM, "clean", None, ITEM], [5, 5, None, None])
    found = phrases.contamination(docs, table(spark, ITEMS))
    kept = common.keep(docs, found.where("n_hit > 0"), "left_anti")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (5, "clean")]
    assert kept.columns == docs.columns
    none = phrases.report(phrases.contamination(docs, table(spark, ITEMS).where("item_id < 0"))).collect()
    assert len(none) == 4 and not any(r["contaminated"] for r in none)
    assert phrases.contamination(docs.where("doc_id < 0"), table(spark, ITEMS)).count() == 0
