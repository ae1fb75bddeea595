"""Queries that write tables or logs and read them back, in batch and as streams."""

import os

from pyspark.sql import functions as F

from ..functions import text, vocab
from ..functions.hashing import hash_int
from ..operators import curriculum, joins, plugins
from ..sources import readers, schemas, sinks
from ..streaming import streams
from .box_queries import IOU
from .registry import query, r6
from .sampling_queries import _ERR, MW, rounded
from .text_queries import d_eval_text
from .views import Data


@query(
    "a1_csv_tables",
    "select split, view_position, count(*) as n, count(distinct study_id) as studies, sum(length(dicom_id))::bigint as id_chars from v_images group by 1, 2",
)
def a1(d: Data):
    folder = sinks.work_folder(d.spark, "csv")
    images = d.view("v_images")
    images.select("dicom_id", "study_id", "subject_id", "split").write.csv(os.path.join(folder, "split"), header=True)
    meta = images.select("dicom_id", F.col("view_position").alias("ViewPosition"), F.col("procedure_text").alias("ProcedureCodeSequence_CodeMeaning"))
    meta.write.csv(os.path.join(folder, "metadata"), header=True)
    split = readers.read_csv_table(d.spark, os.path.join(folder, "split"), schemas.IMAGE_SPLIT)
    meta = readers.read_csv_table(d.spark, os.path.join(folder, "metadata"), schemas.IMAGE_METADATA)
    meta = meta.withColumnsRenamed({"ViewPosition": "view_position", "ProcedureCodeSequence_CodeMeaning": "procedure_text"})
    return joins.with_views(split, meta).groupBy("split", "view_position").agg(
        F.count("*").alias("n"), F.countDistinct("study_id").alias("studies"), F.sum(F.length("dicom_id")).cast("bigint").alias("id_chars")
    )


@query("a2_json_docs", "select path, findings, impression from v_study_reports")
def a2(d: Data):
    folder = sinks.work_folder(d.spark, "docs")
    rows = d.view("v_study_reports").withColumn("part", F.floor(F.col("ordinal") / 1000))
    # Files of at most 1000 documents each, one JSON array per file.
    listed = rows.groupBy("part").agg(F.collect_list(F.struct("path", "findings", "impression")).alias("l"))
    arrays = listed.select("part", F.to_json("l", {"ignoreNullFields": "false"}).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(folder)
    return readers.read_json_docs(d.spark, folder, schemas.REPORTS).select("path", "findings", "impression")


@query(
    "a3_jsonl",
    """select 'bad' as kind, null as reason, count(*) as n from v_replies where request_id % 10 in (0, 4, 5, 6, 7, 8, 9)
       union all select 'good', json_extract_string(reply, '$.reason'), count(*) from v_replies where request_id % 10 in (1, 2, 3) group by 2""",
)
def a3(d: Data):
    folder = sinks.work_folder(d.spark, "lines")
    lines = d.view("v_replies").select(F.explode(F.array("reply", F.lit(""))).alias("value"))
    lines.write.text(folder)
    schema = "reason string, mentions_abnormalities string, mentions_devices string"
    rows = readers.read_jsonl(d.spark, folder, schema, "PERMISSIVE").select("reason", "_corrupt_record")
    good = rows.where("_corrupt_record is null").groupBy(F.lit("good").alias("kind"), "reason").agg(F.count("*").alias("n"))
    bad = readers.bad_lines(d.spark, folder, schema).agg(F.count("*").alias("n"))
    return good.unionByName(bad.select(F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("reason"), "n"))


@query("a4_location_docs", "select location, count(*) as n, round(sum(x1 + y1 + x2 + y2), 4) as total from v_loc_boxes group by 1")
def a4(d: Data):
    folder = sinks.work_folder(d.spark, "locations")
    d.location_docs().drop("split").write.parquet(folder)
    rows = readers.explode_locations(readers.read_location_docs(d.spark, folder), "location2bbox", "box")
    total = F.aggregate("box", F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("location").agg(F.count("*").alias("n"), F.round(F.sum(total), 4).alias("total"))


@query("a5_image_sizes", "select dicom_id as image_path, width, height from v_images union all select dicom_id || '.jpg', width, height from v_images")
def a5(d: Data):
    rows = d.view("v_images")

    def word(c, digits):
        return F.lpad(F.hex(c), digits, "0")

    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word("width", 8), word("height", 8)))
    jpg = F.unhex(F.concat(F.lit("FFD8FFE000044A46FFC0001108"), word("height", 4), word("width", 4), F.lit("03012200021101")))
    a = readers.image_sizes(rows.select(F.col("dicom_id").alias("path"), png.alias("content")), "png")
    b = readers.image_sizes(rows.select(F.concat("dicom_id", F.lit(".jpg")).alias("path"), jpg.alias("content")), "jpg")
    return a.unionByName(b)


@query("a6_write_jsonl", "select lang, 2 * count(*) as n, 2 * sum(length(text))::bigint as n_chars, 2 * count(case when n_chars % 2 = 0 then 1 end) as even from documents group by 1")
def a6(d: Data):
    folder = sinks.work_folder(d.spark, "jsonl")
    docs = d.table("documents").select("lang", "text", F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")).alias("even"))
    sinks.write_jsonl(docs, folder, "overwrite")
    sinks.write_jsonl(docs, folder, "append")
    rows = readers.read_jsonl(d.spark, folder, "lang string, text string, even bigint")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.count("even").alias("even"))


@query(
    "a7_quarantine",
    "select 'good' as kind, null as error, count(*) as n, sum(length(reply))::bigint as n_chars from v_replies where error is null union all select 'bad', error, count(*), sum(length(reply))::bigint from v_replies where error is not null group by 2",
)
def a7(d: Data):
    folder = sinks.work_folder(d.spark, "quarantine")
    rows = d.view("v_replies").select("request_id", "reply", "error")
    good_path, bad_path = os.path.join(folder, "good"), os.path.join(folder, "bad")
    sinks.write_with_quarantine(rows, good_path, bad_path)
    good = readers.read_jsonl(d.spark, good_path, "request_id bigint, reply string")
    bad = readers.read_jsonl(d.spark, bad_path, "entry string, error string")
    n_chars = F.sum(F.length("reply")).cast("bigint").alias("n_chars")
    a = good.agg(F.count("*").alias("n"), n_chars).select(F.lit("good").alias("kind"), F.lit(None).cast("string").alias("error"), "n", "n_chars")
    b = bad.withColumn("reply", F.get_json_object("entry", "$.reply")).groupBy(F.lit("bad").alias("kind"), "error").agg(F.count("*").alias("n"), n_chars)
    return a.unionByName(b)


@query(
    "a8_generations",
    "select md5(case when length(hyp) % 5 = 0 then '' else hyp end) as prediction, md5(ref) as reference, 'img' || pair_id::varchar || '.jpg' as first_path, 2 as n_paths from v_pairs",
)
def a8(d: Data):
    folder = sinks.work_folder(d.spark, "generations")
    name = F.concat(F.lit("img"), F.col("pair_id").cast("string"), F.lit(".jpg"))
    rows = d.view("v_pairs").select(
        F.when(F.length("hyp") % 5 != 0, F.col("hyp")).alias("predictions"), F.col("ref").alias("references"), F.array(name, F.lit('a "b", c.jpg')).alias("image_paths")
    )
    sinks.write_generations(rows, folder)
    back = readers.read_generations(d.spark, folder)
    return back.select(
        F.md5("predictions").alias("prediction"), F.md5("references").alias("reference"), F.col("image_paths")[0].alias("first_path"), F.size("image_paths").alias("n_paths")
    )


@query(
    "a9_run_names",
    r"""select p_partkey, case when p_size % 4 = 0 then 'checkpoint-' || p_size::varchar else regexp_replace(case when p_size % 4 = 1 then 'org/maira-2' else p_name || '/' || p_brand end, '[^\p{L}\p{N}\-_.]', '_', 'g') ||
       '-' || case when p_size % 4 = 1 then 'rev' || p_size::varchar else 'base' end end || '-on-' || p_type || '-test' || case when p_size % 3 = 0 then '-reportgen' else '' end as run_name from part""",
)
def a9(d: Data):
    size = F.col("p_size")
    model = F.when(size % 4 == 1, "org/maira-2").otherwise(F.concat("p_name", F.lit("/"), "p_brand"))
    adapter = F.when(size % 4 == 0, F.concat(F.lit("runs/x/checkpoint-"), size.cast("string")))
    task = F.when(size % 3 == 0, "reportgen")
    name = sinks.run_name(model, F.concat(F.lit("rev"), size.cast("string")), adapter, F.col("p_type"), F.lit("test"), task)
    return d.table("part").select("p_partkey", name.alias("run_name"))


@query(
    "a9_run_partitions",
    "select regexp_replace(p_brand, '[^A-Za-z0-9._-]', '_', 'g') as model, 'base' as run_tag, p_type as dataset, count(*) as n from part group by 1, 3",
)
def a9_partitions(d: Data):
    folder = sinks.work_folder(d.spark, "runs")
    rows = d.table("part").select(
        "p_partkey", F.col("p_brand").alias("model"), F.lit("").alias("revision"), F.col("p_type").alias("dataset"),
        F.lit("test").alias("split"), F.lit("reportgen").alias("task"),
    )
    # One task per run folder writes it; a huge run is cut into more files by salt.
    salted = rows.repartition("model", "dataset", (hash_int(F.md5(F.col("p_partkey").cast("string"))) % 4))
    sinks.write_runs(salted, folder)
    return d.spark.read.parquet(folder).groupBy("model", "run_tag", "dataset").agg(F.count("*").alias("n"))


@query(
    "a10_metrics_log",
    "select 'train/global_step' as step_metric, (floor(global_step / 20) * 20)::bigint as step, count(*)::double as samples, count(distinct category)::double as categories from v_log group by 2",
)
def a10(d: Data):
    folder = sinks.work_folder(d.spark, "metrics")
    step = (F.floor(F.col("global_step") / 20) * 20).alias("step")
    rows = d.view("v_log").groupBy(step).agg(F.count("*").cast("double").alias("samples"), F.countDistinct("category").cast("double").alias("categories"))
    sinks.append_metrics_log(rows, folder, "step", ["samples", "categories"])
    back = readers.read_jsonl(d.spark, folder, schemas.METRICS_LOG)
    return back.select("step_metric", "step", F.col("metrics")["samples"].alias("samples"), F.col("metrics")["categories"].alias("categories"))


_WEIGHTS = f"""m as (select dataset, null::varchar as category, avg(bbox_iou) as bbox_iou, avg(text_score) as text_score from v_eval group by 1
    union all select dataset, category, avg(bbox_iou), avg(text_score) from v_eval where category is not null group by 1, 2),
  e as (select dataset, category, {_ERR} as e from m),
  w as (select dataset, category, e / sum(e) over (partition by category is null, case when category is not null then dataset end) as w from e),
  weights as (select dataset, category, round(case when w <= 0 then 0.01 when w > 1 then 1 else w end, 6) as weight from w)"""


@query(
    "a11_eval_snapshots",
    f"""with s as (select unnest([500, 1000])::bigint as global_step), {_WEIGHTS}
        select global_step, 'results' as kind, dataset, category, count(*) as n, round(avg(text_score), 6) as value from s, v_eval group by 1, 3, 4
        union all select global_step, 'weights', dataset, category, 1, weight from s, weights""",
)
def a11(d: Data):
    folder = sinks.work_folder(d.spark, "snapshots")
    rows = d.view("v_eval")
    for step in (500, 1000):
        weights = curriculum.curriculum_weights(rows, MW, step).drop("global_step")
        sinks.append_eval_snapshot(rows, weights, step, folder)
    step, by = F.col("global_step").cast("bigint").alias("global_step"), ["dataset", "category"]
    results = d.spark.read.parquet(os.path.join(folder, "results")).groupBy(step, F.lit("results").alias("kind"), *by)
    results = results.agg(F.count("*").alias("n"), r6(F.avg("text_score")).alias("value"))
    weights = d.spark.read.parquet(os.path.join(folder, "weights"))
    return results.unionByName(weights.select(step, F.lit("weights").alias("kind"), *by, F.lit(1).cast("bigint").alias("n"), r6("weight").alias("value")))


@query("h5_weights_history", f"with {_WEIGHTS} select 3000::bigint as global_step, dataset, category, weight from weights")
def h5_history(d: Data):
    folder = sinks.work_folder(d.spark, "history")
    used = None
    for step in (2500, 3000, 3500):
        due = curriculum.curriculum_step(d.view("v_eval"), MW, step, 3000, folder)
        used = due if due is not None else used
    return used.select(F.col("global_step").cast("bigint").alias("global_step"), "dataset", "category", r6("weight").alias("weight"))


# -- streams -----------------------------------------------------------------------------------

#: Bytes of packed log that k1_stream_scores takes at a time: some 9 million rows.
BATCH = 256 << 20


def log_files(d: Data, df, name: str, **options) -> str:
    folder = sinks.work_folder(d.spark, name)
    sinks.write_jsonl(df, os.path.join(folder, "log"), **options)
    return folder


@query(
    "k1_stream_scores",
    f"""with {IOU} select category, count(*) as n, round(avg(case when regexp_matches(gt_text, '{vocab.BOX}') then iou end), 6) as bbox_iou, sum(length({d_eval_text('pred_text')}))::bigint as n_chars
        from v_grounded_text t join iou on t.example_id = iou.example_id group by 1""",
)
def k1(d: Data):
    rows = d.view("v_grounded_text")
    # The log is an eighth as large when packed. Packed files can't be split, so that none is large; what is scored of them goes.
    folder = log_files(d, rows.unionByName(rows.where("dataset = 'ds1'")), "scores", compression="gzip", maxRecordsPerFile=250_000)
    schema = "example_id string, category string, dataset string, gt_text string, pred_text string"
    log = streams.stream_log(d.spark, os.path.join(folder, "log"), schema, bytes_per_batch=BATCH, delete=True)
    streams.append_to(streams.stream_scores(log, ["example_id"]), folder).awaitTermination()
    done = d.spark.read.parquet(os.path.join(folder, "data"))
    return done.groupBy("category").agg(F.count("*").alias("n"), r6(F.avg("bbox_iou")).alias("bbox_iou"), F.sum(F.length("clean_pred")).cast("bigint").alias("n_chars"))


@query("k1_model_scores", "select event_type, count(*) as n, sum(length(props))::bigint as n_chars, count(distinct props) as scored from events where props is not null group by 1")
def k1_models(d: Data):
    # The log comes in two halves, with every fourth row again in the second; the query is started for each.
    rows = d.table("events").where("props is not null").select("event_id", "event_type", "props")
    folder = sinks.work_folder(d.spark, "models")
    model = plugins.text_model(lambda texts: [(len(t),) for t in texts], "n_chars bigint")
    for half in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1 or event_id % 4 = 0")):
        sinks.write_jsonl(half, os.path.join(folder, "log"))
        log = streams.stream_log(d.spark, os.path.join(folder, "log"), "event_id bigint, event_type string, props string", files_per_batch=4)
        streams.model_scores_to(log, ["event_id"], "props", model, folder).awaitTermination()
    done = streams.read_batches(d.spark, folder)
    # Stored outputs, not distinct ones: a text that was scored twice would count twice.
    scored = d.spark.read.parquet(os.path.join(folder, "models")).select("key")
    texts = done.select("event_type", text.text_key("props").alias("key")).distinct().join(scored, "key").groupBy("event_type").agg(F.count("*").alias("scored"))
    return done.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")).join(texts, "event_type")


@query("k2_stream_audit", "select (floor(global_step / 50) * 50)::bigint as window_start, dataset_name, category, count(*) as n from v_log group by 1, 2, 3")
def k2(d: Data):
    rows = d.view("v_log").select("global_step", "process_id", "orig_index", "dataset_name", "category").repartition(4)
    folder = log_files(d, rows, "audit")
    log = streams.stream_log(d.spark, os.path.join(folder, "log"), schemas.SAMPLING_LOG, files_per_batch=2)
    streams.update_to(streams.stream_audit(log, 50), folder).awaitTermination()
    return streams.read_updates(d.spark, folder, ["window_start", "dataset_name", "category"])


@query(
    "k3_stream_weights",
    """with w as (select global_step, dataset_name as dataset, category, count(*) / cast(100 as double) as weight from v_log group by 1, 2, 3)
       select dataset, category, max(global_step) as global_step, round(arg_max(weight, global_step), 6) as weight from w group by 1, 2""",
)
def k3(d: Data):
    log = d.view("v_log").groupBy("global_step", F.col("dataset_name").alias("dataset"), "category")
    folder = log_files(d, log.agg((F.count("*") / F.lit(100.0)).alias("weight")).repartition(4), "weights")
    stream = streams.stream_log(d.spark, os.path.join(folder, "log"), "global_step bigint, dataset string, category string, weight double", files_per_batch=2)
    streams.update_to(streams.stream_weights(stream), folder).awaitTermination()
    return rounded(streams.read_updates(d.spark, folder, ["dataset", "category"]), "weight")
