import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from roentgrid.operators import stats
from roentgrid.sources import readers, schemas, sinks
from roentgrid.streaming import streams


def png(w, h):
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    chunk = struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))
    return b"\x89PNG\r\n\x1a\n" + chunk


def jpeg(w, h):
    extra = b"\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xdb" + struct.pack(">H", 6) + b"\xff\xc0ab"
    return b"\xff\xd8" + extra + b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00"


def test_csv_keeps_ids_as_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text('dicom_id,study_id,subject_id,split\na,007,1,train\n"b, c",8,,test\n')
    rows = readers.read_csv_table(spark, str(tmp_path / "t.csv"), schemas.IMAGE_SPLIT).orderBy("dicom_id").collect()
    assert rows[0]["study_id"] == "007" and rows[1]["dicom_id"] == "b, c" and rows[1]["subject_id"] is None


def test_json_array(spark, tmp_path):
    docs = [{"StudyID": "s", "ImageID": "i", "findings": [{"sentence_en": "a", "boxes": [[0.1, 0.2, 0.3, 0.4]], "labels": ["L"]}]}, {"StudyID": "t"}]
    (tmp_path / "d.json").write_text(json.dumps(docs, indent=1))
    rows = readers.read_json_docs(spark, str(tmp_path), schemas.GROUNDED_REPORTS).orderBy("StudyID").collect()
    assert rows[0]["findings"][0]["boxes"] == [[0.1, 0.2, 0.3, 0.4]] and rows[1]["findings"] is None


def test_jsonl(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n  \n{"a": \n{"a": 2}\n')
    with pytest.raises(Exception, match="FAILFAST"):
        readers.read_jsonl(spark, str(tmp_path), "a int").collect()
    kept = readers.read_jsonl(spark, str(tmp_path), "a int", "PERMISSIVE")
    assert sorted(r["a"] for r in kept.where("_corrupt_record is null").collect()) == [1, 2]
    bad = readers.bad_lines(spark, str(tmp_path), "a int").collect()
    assert [(r["line"], r["offset"]) for r in bad] == [('{"a": ', 3)]


def test_bad_lines_of_split_files(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.jsonl").write_text("".join("{bad\n" if i % 50 == f else '{"a": 1}\n' for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    try:
        found = readers.bad_lines(spark, str(tmp_path), "a int").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["file"][-7], r["offset"]) for r in found) == sorted((str(f), i) for f in range(3) for i in range(400) if i % 50 == f)


def test_image_sizes(spark, tmp_path):
    folder, saved = tmp_path / "img", str(tmp_path / "sizes")
    folder.mkdir()
    (folder / "a.png").write_bytes(png(640, 480))
    (folder / "b.jpg").write_bytes(jpeg(31, 17))
    (folder / "c.jpg").write_bytes(b"nothing")
    got = readers.image_size_table(spark, str(folder), "png", saved).collect()
    assert [(r["width"], r["height"]) for r in got] == [(640, 480)] and got[0]["image_path"].endswith("a.png")
    (folder / "d.png").write_bytes(png(1, 1))
    assert readers.image_size_table(spark, str(folder), "png", saved).count() == 1
    jpgs = {r["image_path"][-5:]: (r["width"], r["height"]) for r in readers.image_size_table(spark, str(folder), "jpg").collect()}
    assert jpgs == {"b.jpg": (31, 17), "c.jpg": (None, None)}


def test_location_docs(spark, tmp_path):
    df = spark.createDataFrame([("i", "r", {"spine": [0.0, 0.0, 1.0, 1.0]}, {"neck": "x"})], schemas.LOCATION_DOCS)
    df.write.json(str(tmp_path / "j"))
    back = readers.read_location_docs(spark, str(tmp_path / "j"), "json")
    assert readers.explode_locations(back, "location2report_snippet", "snippet").collect()[0].asDict() == {
        "dicom_id": "i", "original_report": "r", "location": "neck", "snippet": "x",
    }


def test_generations_round_trip(spark, tmp_path):
    rows = [("a\n \"b\", c ", "", ["x y", 'q"']), (None, " r", [])]
    df = spark.createDataFrame(rows, "predictions string, references string, image_paths array<string>")
    sinks.write_generations(df, str(tmp_path / "g"))
    got = sorted(tuple(r) for r in readers.read_generations(spark, str(tmp_path / "g")).collect())
    assert got == sorted([("a\n \"b\", c ", "", ["x y", 'q"']), ("", " r", [])])


def test_errors_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, None, "boom")], "i int, t string, error string")
    sinks.write_with_quarantine(df, str(tmp_path / "ok"), str(tmp_path / "bad"))
    sinks.write_with_quarantine(df, str(tmp_path / "ok"), str(tmp_path / "bad"))
    lines = spark.read.text(str(tmp_path / "ok")).collect()
    assert [json.loads(r["value"]) for r in lines] == [{"i": 1, "t": "é"}] * 2 and "é" in lines[0]["value"]
    bad = readers.read_jsonl(spark, str(tmp_path / "bad"), "entry string, error string").collect()
    assert json.loads(bad[0]["entry"]) == {"i": 2} and len(bad) == 2


def test_run_names(one):
    f = F.lit
    none = F.lit(None).cast("string")
    assert one(sinks.run_name(f("a/b"), none, none, f("ds"), f("test"))) == "a_b-base-on-ds-test"
    assert one(sinks.run_name(f("x/maira-2"), f("r1"), none, f("ds"), f("test"), f("t"))) == "x_maira-2-r1-on-ds-test-t"
    assert one(sinks.run_name(f("a"), none, f("e/checkpoint-5"), f("ds"), f("val"))) == "checkpoint-5-on-ds-val"


LOG = [("1", "see [0.5,0.5,0.2,0.2]", "a [0.5,0.5,0.2,0.2]"), ("2", "none", "b"), ("1", "see [0.5,0.5,0.2,0.2]", "late copy")]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    schema = "id string, gt_text string, pred_text string"
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    sinks.write_jsonl(spark.createDataFrame(LOG[:2], schema), log)
    stream = streams.stream_log(spark, log, schema)
    streams.append_to(streams.stream_scores(stream, ["id"]), out).awaitTermination()
    sinks.write_jsonl(spark.createDataFrame(LOG[2:] + [("3", "x [0.1,0.1,0.1,0.1]", "y")], schema), log)
    streams.append_to(streams.stream_scores(stream, ["id"]), out).awaitTermination()
    got = {r["id"]: (r["bbox_iou"], r["clean_pred"]) for r in spark.read.parquet(out + "/data").collect()}
    batch = streams.grounding_scores(spark.createDataFrame([*LOG[:2], ("3", "x [0.1,0.1,0.1,0.1]", "y")], schema))
    assert got == {r["id"]: (r["bbox_iou"], r["clean_pred"]) for r in batch.collect()}
    assert got["1"][0] == pytest.approx(1.0) and got["2"][0] is None and got["3"][0] == 0.0


def test_model_scores_over_restarts(spark, tmp_path):
    from roentgrid.operators import plugins

    calls, log, out = str(tmp_path / "calls"), str(tmp_path / "log"), str(tmp_path / "out")

    def fn(batch):
        with open(calls, "a") as f:
            f.writelines(t + "\n" for t in batch)
        return [(len(t),) for t in batch]

    model = plugins.text_model(fn, "n int", 2)
    for rows in ([(1, "aa"), (2, "b"), (3, "aa")], [(1, "aa"), (4, "b"), (5, "ccc")], []):
        if rows:
            sinks.write_jsonl(spark.createDataFrame(rows, "id int, t string").repartition(2), log)
        stream = streams.stream_log(spark, log, "id int, t string", files_per_batch=1)
        streams.model_scores_to(stream, ["id"], "t", model, out).awaitTermination()
    got = sorted((r["id"], r["n"]) for r in streams.read_batches(spark, out).collect())
    assert got == [(1, 2), (2, 1), (3, 2), (4, 1), (5, 3)]
    assert sorted(open(calls).read().split()) == ["aa", "b", "ccc"]


def test_remembered_keys_have_a_time_limit(spark, tmp_path):
    log = str(tmp_path / "log")
    sinks.write_jsonl(spark.createDataFrame([(1,), (1,), (2,)], "id int"), log)
    stream = streams.first_seen(streams.stream_log(spark, log, "id int"), ["id"])
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert stream.columns == ["id"] and "DeduplicateWithinWatermark" in plan
    streams.append_to(stream, str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "data")).count() == 2


def test_stream_aggregates(spark, tmp_path):
    rows = [(i, 0, i, i, f"ds{i % 2}", "c") for i in range(40)]
    df = spark.createDataFrame(rows, schemas.SAMPLING_LOG).repartition(4)
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    sinks.write_jsonl(df, log)
    stream = streams.stream_log(spark, log, schemas.SAMPLING_LOG, files_per_batch=1)
    streams.update_to(streams.stream_audit(stream, 10), out).awaitTermination()
    keys = ["window_start", "dataset_name", "category"]
    got = sorted(tuple(r) for r in streams.read_updates(spark, out, keys).collect())
    assert got == sorted(tuple(r) for r in stats.sampling_audit(df, 10).collect()) and len(got) == 8


def test_watermarked_scores(spark, tmp_path):
    schema = "id string, gt_text string, pred_text string, ts timestamp"
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    sinks.write_jsonl(spark.createDataFrame(LOG, "id string, gt_text string, pred_text string").withColumn("ts", F.current_timestamp()), log)
    stream = streams.stream_scores(streams.stream_log(spark, log, schema), ["id"], "ts", "1 hour")
    streams.append_to(stream, out).awaitTermination()
    assert spark.read.parquet(out + "/data").count() == 2


def test_scores_of_a_log_in_batches_leave_little_behind(spark, tmp_path, monkeypatch):
    from roentgrid.plans import catalog, io_queries
    from roentgrid.plans.views import Data

    rows = [(k, k % 50, k % 30, k % 7 + 1, k % 40 + 1.0, 0.05, "ANR"[k % 3], "OF"[k % 2]) for k in range(4000)]
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(sinks, "work_folder", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(io_queries, "BATCH", 40_000, raising=False)
    got = catalog.QUERIES["k1_stream_scores"](spark, str(tmp_path))
    scored = streams.grounding_scores(Data(spark, str(tmp_path)).view("v_grounded_text")).groupBy("category")
    once = scored.agg(F.count("*").alias("n"), F.round(F.avg("bbox_iou"), 6), F.sum(F.length("clean_pred")).alias("n_chars"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, once.collect()))
    left = [str(f.relative_to(tmp_path / "scores")) for f in (tmp_path / "scores").rglob("*") if f.is_file()]
    assert not [f for f in left if f.startswith("log") and f.endswith((".json", ".json.gz"))]
    # Two versions of the state and their offsets, in place of all; keys in files, not in a map.
    assert not [f for f in left if f.endswith(".delta")] and [f for f in left if f.endswith(".sst")]
    commits = sorted(int(f.split("/")[-1]) for f in left if "/commits/" in f and f.split("/")[-1].isdigit())
    assert commits[-1] >= 2 and len(commits) <= 3


def test_stream_goes_on_with_the_state_store_it_began_with(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    hdfs = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    spark.conf.set(provider, hdfs)
    try:
        for ids in ([(1,), (2,)], [(2,), (3,)]):
            sinks.write_jsonl(spark.createDataFrame(ids, "id int"), log)
            streams.append_to(streams.first_seen(streams.stream_log(spark, log, "id int"), ["id"]), out).awaitTermination()
            assert spark.conf.get(provider, None) == (hdfs if ids[0] == (1,) else None)
            spark.conf.unset(provider)
    finally:
        spark.conf.unset(provider)
    assert sorted(r["id"] for r in spark.read.parquet(out + "/data").collect()) == [1, 2, 3]
    assert list((tmp_path / "out").rglob("*.delta"))


def test_work_folder_needs_a_shared_folder():
    import pytest

    from roentgrid.sources.sinks import work_folder

    class Conf(dict):
        def contains(self, key):
            return key in self

    class Session:
        def __init__(self, master, **conf):
            self.conf = {"spark.sql.warehouse.dir": "file:/here/spark-warehouse"}
            self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: Conf(conf)})()

    with pytest.raises(ValueError):
        work_folder(Session("spark://host:7077"), "x")
    assert work_folder(Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://a/b"}), "x").startswith("hdfs://a/b/x-")
    assert work_folder(Session("local[2]"), "x").startswith("file:/here/spark-warehouse/x-")
