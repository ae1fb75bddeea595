"""Queries of statistics, sampling and the curriculum."""

from pyspark.sql import functions as F

from ..operators import curriculum, instances, labelling, sampling, stats
from ..operators.metrics import labels as lab
from ..operators.metrics import overlap
from ..operators.skips import Skips
from ..sources.sinks import stored
from ..streaming.streams import grounding_scores
from .box_queries import IOU
from .instance_queries import CLASSES, hash_bucket60
from .join_queries import REPORTS
from .registry import query, r6
from .text_queries import d_eval_text
from .views import Data, hash60

MW = {"bbox_iou": 0.8, "text_score": 0.2}


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


# -- statistics ------------------------------------------------------------------------

@query(
    "f1_phrase_stats",
    """select split, null as category, count(distinct dicom_id) as num_images, count(distinct label_text) as num_phrases, count(distinct category_name) as num_categories,
       count(distinct (dicom_id, label_text)) as num_instances from v_phrases group by 1
       union all select split, category_name, null, null, null, count(distinct (dicom_id, label_text)) from v_phrases group by 1, 2""",
)
def f1(d: Data):
    overall, per_category = stats.phrase_stats(d.view("v_phrases"))
    none = F.lit(None).cast("string").alias("category")
    overall = overall.select("split", none, "num_images", "num_phrases", "num_categories", "num_instances")
    return overall.unionByName(per_category.withColumnRenamed("category_name", "category"), allowMissingColumns=True)


@query(
    "f2_instance_stats",
    """select split, null as category, count(distinct dicom_id) as num_images, count(distinct location) as num_phrases, count(distinct location) as num_label_groups, count(*) as num_instances from
       (select * from v_loc_boxes where location <> 'unknown' and greatest(0, x1) < least(1, x2) and greatest(0, y1) < least(1, y2)) b group by 1
       union all select split, location, null, null, null, count(*) from (select * from v_loc_boxes where location <> 'unknown' and greatest(0, x1) < least(1, x2) and greatest(0, y1) < least(1, y2)) b group by 1, 2""",
)
def f2(d: Data):
    rows = instances.locate_instances(d.location_docs()).withColumn("phrase", F.col("category"))
    overall, per_group = stats.instance_stats(rows)
    overall = overall.withColumn("category", F.lit(None).cast("string"))
    return overall.unionByName(per_group, allowMissingColumns=True)


_F3 = {
    "with_box": "has_box", "without_box": "not has_box", "with_report": "has_report", "without_report": "not has_report", "abnormal": "abnormality = 'yes'",
    "not_abnormal": "abnormality = 'no'", "with_devices": "devices = 'yes'", "without_devices": "devices = 'no'", "missing_both": "not has_box and not has_report",
}


@query(
    "f3_location_stats",
    "select location, count(*) as total, " + ", ".join(f"count(case when {c} then 1 end) as {n}, round(count(case when {c} then 1 end) / count(*) * 100, 6) as {n}_pct" for n, c in _F3.items()) + " from v_pool group by 1",
)
def f3(d: Data):
    return rounded(stats.location_stats(d.view("v_pool")), *[f"{n}_pct" for n in _F3])


_DS = "(select dataset, avg(bbox_iou) as bbox_iou, avg(text_score) as text_score, count(*) as size, 0.8 * avg(bbox_iou) + 0.2 * avg(text_score) as combined from v_eval group by 1)"


@query("f5_dataset_metrics", f"select dataset, round(bbox_iou, 6) as bbox_iou, round(text_score, 6) as text_score, size, round(combined, 6) as combined from {_DS} m")
def f5(d: Data):
    return rounded(stats.dataset_metrics(d.view("v_eval"), MW), "bbox_iou", "text_score", "combined")


@query("f6_category_metrics", "select dataset, category, round(avg(bbox_iou), 6) as bbox_iou, round(avg(text_score), 6) as text_score from v_eval group by 1, 2")
def f6(d: Data):
    return rounded(stats.category_metrics(d.view("v_eval"), list(MW)), "bbox_iou", "text_score")


_TYPE = "case when lower(prompt) like 'locate and%' then 'locate_and_describe' when lower(prompt) like 'describe%' then 'describe' else 'locate' end"
_F7 = f"""(select t.dataset, t.subtask, t.category, case when subtask <> 'describe' then i end as bbox_iou, case when subtask <> 'locate' then s end as text_score
  from (select distinct dataset, category, {_TYPE} as subtask from v_eval) t join (select dataset, category, avg(bbox_iou) as i, avg(text_score) as s from v_eval group by 1, 2) m using (dataset, category))"""


@query("f7_prompt_type_metrics", f"select dataset, subtask, category, round(bbox_iou, 6) as bbox_iou, round(text_score, 6) as text_score from {_F7} f")
def f7(d: Data):
    return rounded(stats.prompt_type_metrics(d.view("v_eval")), "bbox_iou", "text_score")


@query(
    "f8_overall_metrics",
    f"""select round(i, 6) as bbox_iou, round(t, 6) as text_score, round(0.8 * i + 0.2 * t, 6) as combined from
        (select sum(bbox_iou * size) / sum(case when bbox_iou is not null then size end) as i, sum(text_score * size) / sum(size) as t from {_DS} m) a""",
)
def f8(d: Data):
    return rounded(stats.overall_metrics(stats.dataset_metrics(d.view("v_eval"), MW), MW), "bbox_iou", "text_score", "combined")


@query("f9_weighted_score", f"select dataset, round((3 * bbox_iou + text_score) / 4, 6) as weighted_score from {_DS} m")
def f9(d: Data):
    rows = stats.weighted_score(stats.dataset_metrics(d.view("v_eval"), MW), {"bbox_iou": 3, "text_score": 1})
    return rounded(rows.select("dataset", "weighted_score"), "weighted_score")


@query(
    "f10_flatten_metrics",
    f"select dataset, round(bbox_iou, 6) as scores_bbox_iou, round(text_score, 6) as scores_text_score, round(combined, 6) as macro_f1, round(combined / 2, 6) as micro_f1, size from {_DS} m",
)
def f10(d: Data):
    m = stats.dataset_metrics(d.view("v_eval"), MW)
    nested = m.select(
        "dataset", F.struct("bbox_iou", "text_score").alias("scores"), "size",
        F.struct(F.struct(F.col("combined").alias("f1")).alias("macro_avg"), F.struct((F.col("combined") / 2).alias("f1")).alias("micro_avg")).alias("report"),
    )
    return rounded(stats.flatten_metrics(nested, "report"), "scores_bbox_iou", "scores_text_score", "macro_f1", "micro_f1")


@query("f11_sampling_audit", "select (floor(global_step / 50) * 50)::bigint as window_start, dataset_name, category, count(*) as n from v_log group by 1, 2, 3")
def f11(d: Data):
    return stats.sampling_audit(d.view("v_log"), 50)


@query(
    "f12_skip_counts",
    """select case when coalesce(gt_text, '') = '' then 'no report' when lower(pred_text) not like '%description%' then 'no description' end as reason, count(*) as n
       from (select case when category = 'spine' and dataset = 'ds1' then '' else gt_text end as gt_text, case when dataset = 'ds2' then replace(pred_text, 'Description', 'text') else pred_text end as pred_text from v_grounded_text) a group by 1""",
)
def f12(d: Data):
    rows = d.view("v_grounded_text").select(
        F.when((F.col("category") == "spine") & (F.col("dataset") == "ds1"), "").otherwise(F.col("gt_text")).alias("gt_report"),
        F.when(F.col("dataset") == "ds2", F.replace("pred_text", F.lit("Description"), F.lit("text"))).otherwise(F.col("pred_text")).alias("prediction"),
    )
    return stats.skip_counts(labelling.build_queries(rows, "description"))


def d_skips(builder, rows, **reasons):
    cases = " ".join(f"when {condition} then '{reason.replace('_', ' ')}'" for reason, condition in reasons.items())
    return f"select '{builder}' as builder, case {cases} end as reason, count(*) as n from {rows} group by 2"


_OK = "greatest(0, x1) < least(1, x2) and greatest(0, y1) < least(1, y2)"
_SIZED = """(select a.*, width, height, greatest(0, least(1, x_min / nullif(width, 0))) < greatest(0, least(1, x_max / nullif(width, 0))) and greatest(0, least(1, y_min / nullif(height, 0))) < greatest(0, least(1, y_max / nullif(height, 0))) as good
  from v_annotations a left join (select * from v_sizes where width < 1000) z using (image_id))"""


@query(
    "f12_builder_skips",
    " union all ".join([
        d_skips("reports", REPORTS + " r", no_study_in_the_path="study_id = ''", empty_report="full_report = ''"),
        d_skips("location boxes", "v_loc_boxes", unknown_location="location = 'unknown'", invalid_box=f"not ({_OK})"),
        d_skips("phrase boxes", "(select w - 40 as w from v_phrases) p", empty_box="w <= 0"),
        d_skips("annotations", _SIZED + " a", no_box="x_min is null", no_image_size="width is null", empty_box="not good"),
    ]),
)
def f12_builders(d: Data):
    skips = Skips()
    stored(instances.studies(d.view("v_images"), d.view("v_study_reports"), "/img", "ordinal", bucket=hash_bucket60(), skips=skips), "studies")
    stored(instances.locate_instances(d.location_docs(), skips), "locate")
    stored(instances.phrase_instances_ms(d.view("v_phrases").withColumn("w", F.col("w") - 40), bucket=hash_bucket60(), skips=skips), "phrases")
    boxes, _ = instances.normalised_boxes(d.view("v_annotations"), d.view("v_sizes").where("width < 1000"), skips)
    wide = instances.rater_union(d.view("v_raters"), CLASSES)
    stored(instances.pseudo_reports(instances.label_long(wide, CLASSES, ["image_id"]), wide, boxes), "reports")
    return skips.table(d.spark)


_RATES = """(select run, location, count(*) as n, avg((gen_has_hallucinated_abnormalities = 'yes')::int) as hallucinated_abnormalities,
  avg((gen_has_hallucinated_devices = 'yes')::int) as hallucinated_devices, avg((nli_status = 'contradiction')::int) as contradictions from v_comparisons group by 1, 2)"""


@query("f13_hallucination_rates", f"select run, location, n, round(hallucinated_abnormalities, 6) as hallucinated_abnormalities, round(hallucinated_devices, 6) as hallucinated_devices, round(contradictions, 6) as contradictions from {_RATES} r")
def f13(d: Data):
    rates = stats.hallucination_rates(d.view("v_comparisons"), ["run", "location"])
    return rounded(rates, "hallucinated_abnormalities", "hallucinated_devices", "contradictions")


@query(
    "f13_relative_reduction",
    f"""select location, round(max(case when run = 'run0' then hallucinated_abnormalities end), 6) as baseline, round(max(case when run = 'run1' then hallucinated_abnormalities end), 6) as candidate,
        round(1 - max(case when run = 'run1' then hallucinated_abnormalities end) / max(case when run = 'run0' then hallucinated_abnormalities end), 6) as reduction from {_RATES} r group by 1""",
)
def f13_reduction(d: Data):
    rates = stats.hallucination_rates(d.view("v_comparisons"), ["run", "location"])
    return rounded(stats.relative_reduction(rates, ["location"], "run", "run0", "run1", "hallucinated_abnormalities"), "baseline", "candidate", "reduction")


@query(
    "f14_metric_tables",
    f"""select dataset as key, metric, round(value, 6) as value from (unpivot (select dataset, bbox_iou, text_score, combined from {_DS} m) on bbox_iou, text_score, combined into name metric value value) u
        union all select class, 'support', sum(y_true)::double from v_labels group by 1""",
)
def f14(d: Data):
    means = stats.dataset_metrics(d.view("v_eval"), MW)
    a = stats.metric_report_tables(means, [*MW, "combined"], "dataset").withColumnRenamed("dataset", "key").where("value is not null")
    per_class = lab.class_scores(d.view("v_labels"), ["class"]).withColumn("support", F.col("support").cast("double"))
    b = stats.metric_report_tables(per_class, ["support"], "class").withColumnRenamed("class", "key")
    return rounded(a.unionByName(b), "value")


# -- sampling -----------------------------------------------------------------------------

def d_rank(seed, table="v_pool", by="category", key="id"):
    part = f"partition by {by} " if by else ""
    return f"(select *, row_number() over ({part}order by md5('{seed}|' || {key}::varchar), {key}) as rk from {table})"


def d_take(seed, quotas, by="category", table="v_pool", key="id"):
    """Rows and copies for a table of quotas (by, size, quota)."""
    pick = hash60(f"concat_ws('|', '{seed}', 'draw', {by}::varchar, draw::varchar)", "duckdb")
    return f"""with q as ({quotas}), r as {d_rank(seed, table, by, key)},
    dr as (select {by}, size, unnest(range(quota)) as draw from q where quota > size),
    pk as (select {by}, {pick} % size + 1 as rk, count(*) as copies from dr group by 1, 2)
    select r.{key}, 1::bigint as copies from r join q using ({by}) where quota <= size and rk <= quota
    union all select r.{key}, pk.copies from r join pk on r.{by} is not distinct from pk.{by} and r.rk = pk.rk"""


def d_uniform(n, by="category"):
    return f"select {by}, count(*) as size, {n} // (count(*) over ()) + case when row_number() over (order by {by}) <= {n} % (count(*) over ()) then 1 else 0 end as quota from v_pool group by {by}"


@query("g1_uniform_quota", d_take(1, d_uniform(130)))
def g1(d: Data):
    return sampling.uniform_quota(d.view("v_pool"), 130, ["category"], ["id"], 1).select("id", "copies")


@query("g1_uniform_quota_replacement", d_take(1, d_uniform(30000)))
def g1_replacement(d: Data):
    return sampling.uniform_quota(d.view("v_pool"), 30000, ["category"], ["id"], 1).select("id", "copies")


def d_waterfill(n, by):
    return f"""with s as (select {by}, count(*) as size from v_pool group by 1), p as (select {by}, row_number() over (partition by {by}) as rn from v_pool),
    l as (select {by}, row_number() over (order by rn, size, {by}) as place from p join s using ({by}))
    select s.{by}, size, case when {n} > (select sum(size) from s) then size + ({n} - (select sum(size) from s)) // (select count(*) from s)
        + case when row_number() over (order by s.{by}) <= ({n} - (select sum(size) from s)) % (select count(*) from s) then 1 else 0 end
      else (select count(*) from l where l.{by} = s.{by} and place <= {n}) end::bigint as quota from s"""


@query("g2_waterfill", d_take(2, d_waterfill(336, "location"), "location"))
def g2(d: Data):
    return sampling.waterfill(d.view("v_pool"), 333, ["location"], ["id"], 8, 2).select("id", "copies")


@query("g2_waterfill_over_ask", d_take(2, d_waterfill(30001, "location"), "location"))
def g2_over(d: Data):
    return sampling.waterfill(d.view("v_pool"), 30001, ["location"], ["id"], 1, 2).select("id", "copies")


@query("g3_random_subset", f"select id, location from {d_rank(3, by='')} r where rk <= 100")
def g3(d: Data):
    return sampling.random_subset(d.view("v_pool"), 97, ["id"], 10, 3).select("id", "location")


@query("g4_epoch_sample", f"select id, 1::bigint as copies from {d_rank(4, by='')} r where rk <= 160")
def g4(d: Data):
    return sampling.epoch_sample(d.view("v_pool"), 10, 16, ["id"], 4).select("id", "copies")


@query(
    "g4_epoch_sample_replacement",
    f"""with r as {d_rank(4, by='')}, n as (select count(*) as n from v_pool), dr as (select {hash60("concat_ws('|', '4', 'draw', '0', draw::varchar)", 'duckdb')} % n + 1 as rk from n, (select unnest(range(40000)) as draw) d)
        select id, count(*) as copies from r join dr using (rk) group by 1""",
)
def g4_replacement(d: Data):
    return sampling.expand_copies(sampling.epoch_sample(d.view("v_pool"), 2500, 16, ["id"], 4).select("id", "copies")).groupBy("id").agg(F.max("copy").alias("c")).select(
        "id", (F.col("c") + 1).alias("copies")
    )


@query("g5_shuffle", f"select id, rk - 1 as position from {d_rank('base7', by='')} r")
def g5(d: Data):
    out = sampling.shuffle(d.view("v_pool"), ["id"], "base7")
    return out.select("id", "position")


def d_schedule(weights: str, name: str) -> str:
    """CTEs that end in <name>(grp, class, slot, before, per, period) for a table <weights>(grp, class, weight).

    Slots are dealt out class by class from a list of the free ones.
    """
    n = name
    # Sums with the rounding errors added at the end.
    add = "lambda a, b: {s: a.s + b.s, c: a.c + case when a.s >= b.s then (a.s - (a.s + b.s)) + b.s else (b.s - (a.s + b.s)) + a.s end}"
    total = f"list_reduce(list({{s: weight, c: 0.0::double}} order by class), {add})"
    return f"""{n}_pos as (select * from {weights} where weight > 0),
      {n}_tot as (select grp, {total}.s + {total}.c as total, min(weight) as low, max(weight) as high from {n}_pos group by 1),
      {n}_freq as (select grp, class, case when low = high then 1 else greatest(floor(20 * (weight / total) / (low / total))::bigint, 1) end as per from {n}_pos join {n}_tot using (grp)),
      {n}_order as (select *, row_number() over (partition by grp order by per desc, class) as k, (sum(per) over (partition by grp))::bigint as period from {n}_freq),
      {n}_steps as (
        select grp, 0::bigint as k, range(period) as free, []::bigint[] as taken from (select distinct grp, period from {n}_order) z
        union all
        select grp, k, list_filter(free, lambda x: not list_contains(dealt, x)), dealt from (
          select s.grp, o.k, s.free, list_transform(range(o.per), lambda j: s.free[floor(j * (len(s.free) / o.per))::bigint + 1]) as dealt from {n}_steps s join {n}_order o on s.grp = o.grp and o.k = s.k + 1) z),
      {n}_slots as (select o.grp, o.class, o.per, o.period, unnest(s.taken) as slot from {n}_steps s join {n}_order o on s.grp = o.grp and s.k = o.k),
      {n} as (select *, row_number() over (partition by grp, class order by slot) - 1 as before from {n}_slots)"""


def d_read(seed, table, inner, outer, key, by):
    """The end of a nested sequence: rows of ``table`` at <t>(position, grp, class, turn)."""
    return f"""r as (select *, row_number() over (partition by {outer}, {inner} order by md5('{seed}|' || {by}), {key}) as rk, count(*) over (partition by {outer}, {inner}) as size from {table})
      select t.position, t.grp as {outer}, t.class as {inner}, r.{key} from t join r on r.{outer} is not distinct from t.grp and r.{inner} is not distinct from t.class and r.rk = t.turn % r.size + 1"""


def d_nested(weights: str, inner_weights: str, table: str, outer: str, inner: str, key: str, seed) -> str:
    """A whole nested sequence over all rows of ``table``, from weights (grp, class, weight) at both levels."""
    return f"""with recursive w as ({weights}), {d_schedule("w", "o")}, v as ({inner_weights}), {d_schedule("v", "i")},
      sz as (select {outer} as grp, {inner} as class, count(*) as size from {table} group by 1, 2),
      len as (select grp, max(period) as period, max(ceil(size / per)::bigint) * max(period) as length from (select distinct grp, class, per, period from i) z join sz using (grp, class) group by 1),
      pos as (select unnest(range((select count(*) from {table}))) as position),
      a as (select position, o.class as grp, (position // o.period * o.per + o.before) as turn from pos join o on position % o.period = o.slot),
      b as (select position, grp, turn % length as at, len.period from a join len using (grp)),
      t as (select position, i.grp, i.class, (b.at // i.period * i.per + i.before) as turn from b join i on b.grp = i.grp and b.at % b.period = i.slot),
      {d_read(seed, table, inner, outer, key, f"{key}::varchar")}"""


@query("g6_schedule", f"""with recursive w as (select 0 as grp, lang as class, sum(n_chars)::double as weight from documents group by 2), {d_schedule("w", "s")}
    select slot, class, before, per as per_period, period from s""")
def g6(d: Data):
    # Sampling weights per language: its share of the characters.
    sums = d.table("documents").groupBy(F.col("lang").alias("class")).agg(F.sum("n_chars").alias("weight"))
    return sampling.schedule(sums, "class")


@query(
    "g6_schedules",
    f"""with recursive w as (select source as grp, lang as class, count(*)::double as weight from documents where lang is not null and source is not null group by 1, 2), {d_schedule("w", "s")}
        select grp as source, slot, class, before, per as per_period, period from s""",
)
def g6_many(d: Data):
    docs = d.table("documents").where("lang is not null and source is not null")
    sums = docs.groupBy("source", F.col("lang").alias("class")).agg(F.count("*").alias("weight"))
    return sampling.schedule(sums, "class", ["source"])


WEIGHTS = {"de": 0.2, "en": 0.5, "es": 0.0, "fr": 0.35}
_WEIGHTS = "select 0 as grp, * from (values " + ", ".join(f"('{c}', {w}::double)" for c, w in WEIGHTS.items()) + ") z(class, weight)"


@query(
    "g7_weighted_sequence",
    f"""with recursive w as ({_WEIGHTS}), {d_schedule("w", "sch")}, sz as (select location, count(*) as size from v_pool group by 1),
        n as (select max(ceil(size / per)::bigint) * max(period) as n from sch join sz on sch.class = sz.location),
        pos as (select unnest(range((select n from n))) as position), t as (select position, class as location, (position // period) * per + before as turn from pos join sch on position % period = slot),
        r as {d_rank(5, by='location')} select position, t.location, r.id from t join sz on t.location = sz.location join r on r.location = t.location and r.rk = turn % size + 1""",
)
def g7(d: Data):
    out = sampling.weighted_sequence(d.view("v_pool"), WEIGHTS, "location", ["id"], None, 5)
    return out.select("position", "location", "id")


@query(
    "g7_nested_sequence",
    d_nested("select distinct 0 as grp, location as class, 1.0::double as weight from v_pool",
             "select distinct location as grp, category as class, 1.0::double + category[4:]::int % 3 as weight from v_pool", "v_pool", "location", "category", "id", 5),
)
def g7_nested(d: Data):
    rows = d.view("v_pool")
    inner = rows.select("location", "category").distinct().withColumn("weight", F.lit(1.0) + F.substring("category", 4, 9).cast("int") % 3)
    outer = inner.select("location").distinct().withColumn("weight", F.lit(1.0))
    out = sampling.nested_sequence(rows, outer, inner, "location", "category", ["id"], rows.count(), 5)
    return out.select("position", "location", "category", "id")


@query("g8_concat_shuffle", """select name, id, row_number() over (order by md5('8|' || name || '|' || id::varchar), name, id) - 1 as position from
       (select 'documents' as name, doc_id as id from documents union all select 'pages', page_id from pages) a""")
def g8(d: Data):
    a = d.table("documents").select(F.lit("documents").alias("name"), F.col("doc_id").alias("id"))
    b = d.table("pages").select(F.lit("pages").alias("name"), F.col("page_id").alias("id"))
    return sampling.concat_shuffle([a, b], ["name", "id"], 8)


@query(
    "g9_uniform_subset_tasks",
    f"""with e as (select example_id, {_TYPE} as subtask, category from v_eval), s as (select subtask, category, count(*) as size from e group by 1, 2),
        t as (select *, greatest(ceil(100 / (select count(distinct subtask) from s)), count(*) over (partition by subtask)) as n from s),
        q as (select subtask, category, size, (ceil(n / 4) * 4)::bigint // count(*) over (partition by subtask) + case when row_number() over (partition by subtask order by category) <= (ceil(n / 4) * 4)::bigint % count(*) over (partition by subtask) then 1 else 0 end as quota from t),
        r as (select *, row_number() over (partition by subtask, category order by md5('9|' || example_id::varchar), example_id) as rk from e)
        select example_id, subtask, 1::bigint as copies from r join q using (subtask, category) where rk <= quota""",
)
def g9(d: Data):
    from ..functions.text import prompt_type

    rows = d.view("v_eval").withColumn("subtask", prompt_type("prompt"))
    out = sampling.uniform_subset_tasks(rows, 100, "subtask", "category", ["example_id"], 4, 9)
    return out.select("example_id", "subtask", "copies")


_CORE = """with p as (select id, has_report, location, case when has_report then abnormality end as abnormality, case when has_report then devices end as devices from v_pool),
  k as (select p.*, row_number() over (partition by has_report, location, abnormality, devices order by md5('42-stratum|' || id::varchar), id) as rn from p),
  g as (select has_report, count(*) as rows, count(distinct (location, coalesce(abnormality, '-'), coalesce(devices, '-'))) as groups from p group by 1),
  w as (select least({with_n}, coalesce(max(case when has_report then rows end), 0)) as w from g),
  t as (select has_report, groups, case when has_report then w else least({n} - w, rows) end as take from g, w),
  o as (select k.id, k.has_report, take, row_number() over (partition by k.has_report order by case when rn <= ceil(take / groups) then 0 else 1 end, md5('42|' || id::varchar), id) as place from k join t on k.has_report = t.has_report)
  select id from o where place <= take"""


@query("g10_core_sample", _CORE.format(n=150, with_n=105))
def g10(d: Data):
    return sampling.core_sample(d.view("v_pool"), 150, ["id"]).select("id")


_LOC = """with here as (select * from v_pool where location = 'fr' and (has_report or has_box)),
  c as (select id, case when row_number() over (partition by abnormality, devices order by md5('42-cell|' || id::varchar), id) <= {q} then 0 else 1 end as tier from here where abnormality in ('yes', 'no') and devices in ('yes', 'no')),
  rest as (select id, 1 as tier from here where not coalesce(abnormality in ('yes', 'no') and devices in ('yes', 'no'), false)),
  other as (select id, 2 as tier from v_pool where has_report and has_box and id not in (select id from here)),
  a as (select *, row_number() over (order by tier, md5('42|' || id::varchar), id) as place from (select * from c union all select * from rest union all select * from other) u)
  select id, tier from a where place <= {n}"""


@query("g11_location_core_sample", _LOC.format(n=300, q=75))
def g11(d: Data):
    return sampling.location_core_sample(d.view("v_pool"), "fr", 300, ["id"], "id").select("id", "tier")


@query(
    "g12_extend_sample",
    """with core as (select id from v_pool where abnormality = 'yes'), done as (select id from v_pool where devices = 'no'),
       a as (select id, 0 as tier from core where id not in (select id from done) union all select id, 1 from v_pool where id not in (select id from core) and id not in (select id from done)),
       r as (select *, row_number() over (order by tier, md5('42|' || id::varchar), id) as place from a) select id, tier from r where place <= 250""",
)
def g12(d: Data):
    pool = d.view("v_pool")
    out = sampling.extend_sample(pool.where("abnormality = 'yes'"), pool, pool.where("devices = 'no'"), 250, ["id"])
    return out.select("id", "tier")


_RUNS = """select 'checkpoint-' || window_start::varchar || '-score-' || printf('%.3f', n / 1000.0) as name, window_start as step, round(n / 1000.0, 3) as value
  from (select (floor(global_step / 20) * 20)::bigint as window_start, count(*) filter (category = 'error') as n from v_log group by 1) a"""


@query("g13_top_k_runs", f"select name, step, value from ({_RUNS}) r order by value desc, step limit 7")
def g13(d: Data):
    start = (F.floor(F.col("global_step") / 20) * 20).cast("bigint")
    n = d.view("v_log").groupBy(start.alias("s")).agg(F.count_if(F.col("category") == "error").alias("n"))
    value = F.call_function("format_number", F.col("n") / F.lit(1000.0), F.lit("0.000"))
    names = n.select(F.concat(F.lit("checkpoint-"), F.col("s").cast("string"), F.lit("-score-"), value).alias("name"))
    parsed = names.select("name", sampling.parse_run_name("name", "score").alias("p")).select("name", "p.step", "p.value")
    return sampling.top_k_runs(parsed, 7, "value", "step")


# -- curriculum ------------------------------------------------------------------------------

_ERR = "case when 1 - coalesce(0.8 * bbox_iou + 0.2 * text_score, bbox_iou, text_score) <= 0 then 0.01 else 1 - coalesce(0.8 * bbox_iou + 0.2 * text_score, bbox_iou, text_score) end"


@query("h1_dataset_weights", f"select dataset, round(e, 6) as error, round(e / sum(e) over (), 6) as weight from (select dataset, {_ERR} as e from {_DS} m) a")
def h1(d: Data):
    return rounded(curriculum.dataset_weights(stats.dataset_metrics(d.view("v_eval"), MW), MW), "error", "weight")


@query(
    "h2_category_weights",
    f"""with c as (select dataset, null::varchar as subtask, category, avg(bbox_iou) as bbox_iou, avg(text_score) as text_score from v_eval group by 1, 3
          union all select 'anatomy', subtask, category, bbox_iou, text_score from {_F7.replace('from v_eval', "from (select example_id, 'anatomy' as dataset, category, prompt, bbox_iou, text_score from v_eval) z")} f)
        select dataset, subtask, category, round(e, 6) as error, round(e / sum(e) over (partition by dataset, subtask), 6) as weight from (select dataset, subtask, category, {_ERR} as e from c) a""",
)
def h2(d: Data):
    rows = d.view("v_eval")
    plain = curriculum.category_weights(stats.category_metrics(rows, list(MW)), MW)
    anatomy = stats.prompt_type_metrics(rows.withColumn("dataset", F.lit("anatomy")))
    return rounded(plain.unionByName(curriculum.category_weights(anatomy, MW)), "error", "weight")


@query("h3_clamp_weights", "select event_id, case when w <= 0 then 0.01::double when w > 1 then 1.0::double else w end as weight from (select event_id, (event_id % 300 - 50) / cast(100 as double) as w from events) a")
def h3(d: Data):
    rows = d.table("events").select("event_id", ((F.col("event_id") % 300 - 50) / F.lit(100.0)).alias("weight"))
    return curriculum.clamp_weights(rows)


@query(
    "h4_apply_weights",
    d_nested(f"select 0 as grp, dataset as class, round(e / sum(e) over (), 4) as weight from (select dataset, {_ERR} as e from {_DS} m) a",
             "select distinct dataset as grp, category as class, 1.0::double as weight from v_eval", "v_eval", "dataset", "category", "example_id", 0),
)
def h4(d: Data):
    rows = d.view("v_eval")
    per_dataset = curriculum.dataset_weights(stats.dataset_metrics(rows, MW), MW).withColumn("weight", F.round("weight", 4))
    out = curriculum.apply_weights(rows, per_dataset, None, rows.count(), ["example_id"])
    return out.select("position", "dataset", "category", "example_id")


def scored(d: Data):
    """Generated texts with their box and word scores."""
    rows = grounding_scores(d.view("v_grounded_text"))
    # The box score travels inside the pair key, which saves scoring the rows a second
    # time for a join.
    pair = F.struct("example_id", "dataset", "category", "bbox_iou").alias("pair_id")
    texts = rows.select(pair, F.col("clean_pred").alias("hyp"), F.col("clean_gt").alias("ref"))
    return overlap.rouge_n(texts, (1,)).select("pair_id.*", F.col("rouge_1").alias("text_score"))


_TOK = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
_CYCLE = f"""with {IOU},
  tx as (select example_id, dataset, category, gt_text, {_TOK.replace('{0}', d_eval_text('pred_text'))} as h, {_TOK.replace('{0}', d_eval_text('gt_text'))} as r from v_grounded_text),
  hits as (select example_id, sum(least(hn, rn)) as hits from (select example_id, w, sum(a) as hn, sum(b) as rn from (select example_id, unnest(h) as w, 1 as a, 0 as b from tx union all select example_id, unnest(r), 0, 1 from tx) u group by 1, 2) v group by 1),
  sc as (select dataset, category, case when regexp_matches(gt_text, '\\[') then iou end as bbox_iou, coalesce(2 * hits / (len(h) + len(r)), 0) as text_score from tx join iou using (example_id) left join hits using (example_id)),
  m as (select dataset, null::varchar as category, avg(bbox_iou) as bbox_iou, avg(text_score) as text_score from sc group by 1 union all select dataset, category, avg(bbox_iou), avg(text_score) from sc group by 1, 2),
  e as (select dataset, category, {_ERR} as e from m),
  w as (select dataset, category, e / sum(e) over (partition by case when category is null then 0 else 1 end, case when category is not null then dataset end) as weight from e)
  select dataset, category, round(weight, 6) as weight from w"""


@query("h5_curriculum_cycle", _CYCLE)
def h5(d: Data):
    out = curriculum.curriculum_weights(scored(d), MW, 3000)
    return rounded(out.select("dataset", "category", "weight"), "weight")
