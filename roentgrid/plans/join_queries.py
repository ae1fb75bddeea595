"""Queries of the lookups."""

from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import instances, joins
from .registry import d_list, d_squeeze, query, r6
from .text_queries import _sec
from .views import Data

REPORTS = rf"""(select regexp_extract(path, 'p(\d+)/p(\d+)/s(\d+)\.txt', 3) as study_id, regexp_extract(path, 'p(\d+)/p(\d+)/s(\d+)\.txt', 1) as part_id,
  regexp_extract(path, 'p(\d+)/p(\d+)/s(\d+)\.txt', 2) as report_subject, concat_ws(' ', {_sec('findings')}, {_sec('impression')}) as full_report, ordinal from v_study_reports)"""
PATH = "'/img/p' || part_id || '/p' || subject_id || '/s' || study_id || '/' || dicom_id || '.jpg'"


def reports(d: Data):
    return d.view("v_study_reports")


@query("d1_image_paths", f"select i.dicom_id, {PATH.replace('study_id', 'i.study_id')} as image_path from v_images i left join {REPORTS} r on i.study_id = r.study_id")
def d1(d: Data):
    return joins.image_paths(d.view("v_images"), reports(d), "/img", "ordinal").select("dicom_id", "image_path")


@query("d2_image_reports", f"select dicom_id, i.study_id, full_report as report from v_images i join {REPORTS} r on i.study_id = r.study_id")
def d2(d: Data):
    return joins.image_reports(reports(d), d.view("v_images"), "ordinal")


@query("d3_study_reports", f"select study_id, part_id, report_subject as subject_id, full_report from {REPORTS} r")
def d3(d: Data):
    return joins.study_reports(reports(d), "ordinal")


@query(
    "d4_in_split",
    """select split, count(*) as n, sum(length(text))::bigint as n_chars from (select doc_id, text, split from documents join (select ordinal, split from v_reports) r on doc_id = ordinal
       where cast(doc_id as varchar) in (select study_id from v_images where split <> 'train')) a group by 1""",
)
def d4(d: Data):
    docs = d.location_docs()
    held_out = d.view("v_images").where("split <> 'train'").select(F.col("study_id").alias("dicom_id"))
    kept = joins.in_split(docs, held_out)
    return kept.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("original_report")).cast("bigint").alias("n_chars"))


@query(
    "d5_with_views",
    "select split, view_position, procedure_text, count(*) as n from v_images group by 1, 2, 3",
)
def d5(d: Data):
    images = d.view("v_images")
    joined = joins.with_views(images.select("dicom_id", "split"), images.select("dicom_id", "view_position", "procedure_text"))
    return joined.groupBy("split", "view_position", "procedure_text").agg(F.count("*").alias("n"))


_GROUPS = "(select label, arg_max(label_group, ordinal) as label_group from v_master group by 1)"


@query(
    "d6_label_group",
    f"select m.label, g.label_group, count(*) as n from v_master m join {_GROUPS} g on m.label = g.label group by 1, 2",
)
def d6(d: Data):
    m = d.view("v_master")
    rows = joins.with_label_group(m.select("label", "StudyID"), m, "ordinal")
    return rows.groupBy("label", "label_group").agg(F.count("*").alias("n"))


@query(
    "d7_boxed_and_described",
    """with b as (select dicom_id, location, greatest(0, x1) as x1, greatest(0, y1) as y1, least(1, x2) as x2, least(1, y2) as y2 from v_loc_boxes)
       select b.dicom_id, b.location, trim(regexp_replace(snippet, '\\s+', ' ', 'g')) as snippet, round(x1, 6) as x1 from b join v_loc_snippets s on b.dicom_id = s.dicom_id and b.location = s.location
       where b.location <> 'unknown' and x1 < x2 and y1 < y2 and trim(regexp_replace(snippet, '\\s+', ' ', 'g')) <> ''""",
)
def d7(d: Data):
    docs = d.location_docs()
    both = joins.boxed_and_described(instances.location_boxes(docs), instances.location_snippets(docs), ("dicom_id", "split", "location"))
    return both.select("dicom_id", "location", "snippet", r6(F.col("box")[0]).alias("x1"))


# Answers exist for the reports in two languages of the source and for every location
# but one; every third answer is not available.
_QUERY = "'Report: \"' || " + d_squeeze("text") + " || '\" | Location: \"' || location || '\"'"
_ANSWER = "case when length({0}) % 3 = 0 then 'N/A' else 'mini ' || (length({0}) % 40)::varchar end"


@query(
    "d8_eval_set",
    f"""with loc as (select dicom_id, location from v_loc_boxes union select dicom_id, location from v_loc_snippets
          union select doc_id::varchar, unnest({d_list(vocab.DEFAULT_LOCATIONS)}) from documents),
        q as (select l.dicom_id, l.location, {_QUERY} as query, lang from loc l join documents d on l.dicom_id = d.doc_id::varchar),
        a as (select q.dicom_id, q.location, x1, case when lang in ('en', 'fr') and q.location <> 'spine' then {_ANSWER.replace('{0}', 'query')} end as mini
              from q left join v_loc_boxes b on q.dicom_id = b.dicom_id and q.location = b.location),
        k as (select dicom_id, location, x1, case when mini <> 'N/A' then mini end as mini from a)
        select dicom_id, location, round(x1, 6) as x1, mini as mini_report, case when mini is not null and substr(mini, 6)::int < 30 then case when substr(mini, 6)::int % 2 = 0 then 'yes' else 'no' end end as abnormal,
        mini is not null or x1 is not null as keep from k""",
)
def d8(d: Data):
    docs = d.location_docs()
    locations = instances.merged_location_docs(docs)
    langs = d.table("documents").select(F.col("doc_id").cast("string").alias("dicom_id"), "lang")
    texts = docs.select("dicom_id", text.squeeze_ws("original_report").alias("report")).join(langs, "dicom_id")
    asked = locations.where("location <> 'spine'").join(texts.where(F.col("lang").isin("en", "fr")), "dicom_id")
    asked = asked.select(joins.mini_report_query("report", "location", clean=False).alias("query")).distinct()
    n = F.length("query")
    answers = asked.select(
        "query", F.lit("why").alias("reasoning"),
        F.when(n % 3 == 0, "N/A").otherwise(F.concat(F.lit("mini "), (n % 40).cast("string"))).alias("mini_report"),
    )
    reports_ = answers.select(F.col("mini_report").alias("query")).distinct()
    number = F.try_to_number(F.substring("query", 6, 9), F.lit("99")).cast("int")
    flags = reports_.where(number < 30).select(
        "query", F.when(number % 2 == 0, "yes").otherwise("no").alias("mentions_abnormalities"), F.lit("no").alias("mentions_devices")
    )
    out = joins.build_eval_set(docs.select("dicom_id", "original_report"), locations, answers, flags)
    return out.select(
        "dicom_id", "location", r6(F.col("bbox")[0]).alias("x1"), "mini_report", F.col("mentions_abnormalities").alias("abnormal"), "keep"
    )


@query(
    "d9_unprocessed",
    """select study_id, location, count(*) as n from v_predictions p where location is not null and not exists
       (select 1 from v_predictions q where q.study_id = p.study_id and q.location = p.location and q.prediction like '%A clear%') group by 1, 2""",
)
def d9(d: Data):
    rows = d.view("v_predictions").where("location is not null")
    done = rows.where("prediction like '%A clear%'")
    left = joins.unprocessed(rows, done, ["study_id", "location"])
    return left.groupBy("study_id", "location").agg(F.count("*").alias("n"))


@query(
    "d10_image_size",
    "select class_name, count(*) as n, sum(width)::bigint as w, sum(height)::bigint as h from v_annotations join v_sizes using (image_id) group by 1",
)
def d10(d: Data):
    rows = joins.with_image_size(d.view("v_annotations"), d.view("v_sizes"))
    return rows.groupBy("class_name").agg(
        F.count("*").alias("n"), F.sum("width").cast("bigint").alias("w"), F.sum("height").cast("bigint").alias("h")
    )


# One weight per (step, dataset, category), the step being a multiple of 25.
_HISTORY = """(select global_step * 25 as global_step, dataset_name as dataset, category, count(*) / cast(100 as double) as weight from v_log group by 1, 2, 3)"""


@query(
    "d11_weights_as_of",
    f"""with h as {_HISTORY} select global_step, dataset, category, round(weight, 6) as weight from h
        where global_step = (select max(global_step) from h where global_step <= 5310 and global_step % 500 = 0)""",
)
def d11(d: Data):
    log = d.view("v_log").groupBy((F.col("global_step") * 25).alias("global_step"), F.col("dataset_name").alias("dataset"), "category")
    history = log.agg((F.count("*") / F.lit(100.0)).alias("weight"))
    out = joins.weights_as_of(history, 5310, 500, ("dataset", "category"))
    return out.withColumn("weight", r6("weight"))


@query(
    "d12_sampling_pool",
    """select location, category, count(*) as n from v_pool where not (has_report and abnormality = 'yes') and not coalesce(devices = 'no', false) or (has_report and abnormality is null) group by 1, 2""",
)
def d12(d: Data):
    pool = d.view("v_pool")
    core = pool.where("has_report and abnormality = 'yes'")
    done = pool.where("devices = 'no'")
    rows = joins.sampling_pool(pool, core, done, ["id"])
    return rows.groupBy("location", "category").agg(F.count("*").alias("n"))


@query("j10_refusals", "select flagged, count(*) as n from (select regexp_matches(reply, '" + vocab.REFUSAL.replace("'", "''") + "') as flagged from v_replies) a group by 1")
def j10(d: Data):
    return d.view("v_replies").groupBy(text.is_refusal("reply").alias("flagged")).agg(F.count("*").alias("n"))
