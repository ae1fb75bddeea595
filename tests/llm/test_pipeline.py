import os

import helpers
import corpus_pipeline
from test_classifiers import junk, prose

from roentgrid.llm import pu_quality


def test_stages(spark, tmp_path):
    item = " ".join(helpers.words_of(77, 20, 4000))
    good = [prose(i) + " " + " ".join(helpers.words_of(i, 60, 5000)) for i in range(150)]
    texts = good + [junk(i) for i in range(40)] + [good[0], good[0], good[1] + " " + item + " " + good[2], good[3] + " a@b.cd", None, ""]
    docs = helpers.documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    folder = str(tmp_path)
    docs.write.parquet(os.path.join(folder, "documents.parquet"))
    labels = [(i, 1, 0) for i in range(100)] + [(i, 0, 0) for i in range(150, 190)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    docs, kept = spark.read.parquet(os.path.join(folder, "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, docs, folder), name)
        if name != "packed":
            assert out.schema == docs.schema
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        docs = out
    assert set(range(100)) <= kept["quality"] and not kept["quality"] & set(range(150, 190))
    assert {190, 191} & kept["near_duplicates"] == set() and 0 in kept["near_duplicates"]
    assert kept["near_duplicates"] - kept["decontaminated"] == {192}
    assert kept["without_personal_data"] == kept["packed"] == kept["decontaminated"]
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(whole.collect()) == sorted(docs.collect())


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    docs = helpers.documents(spark, ["x"]).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 0")
    docs.write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert pu_quality.learn(docs, spark.read.parquet(os.path.join(folder, "labels.parquet"))) is None
