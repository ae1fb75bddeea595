"""Queries of the instance builders."""

from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import instances
from ..operators.skew import PART_ROWS
from .box_queries import d_finding
from .join_queries import PATH, REPORTS, _GROUPS, reports
from .registry import ORACLES, d_list, query, r6
from .text_queries import _D_BOX, d_description
from .views import Data

IMAGES = f"""(select i.*, part_id, {PATH.replace('study_id', 'i.study_id')} as image_path, full_report,
  case when view_position in ('PA', 'AP') then 'frontal' when view_position in ('LATERAL', 'LL') then 'lateral' when procedure_text like '%AP%' then 'frontal' end as kind,
  case when view_position = 'PA' then 0 when view_position = 'AP' or procedure_text like '%AP%' then 1 end as priority
  from v_images i join {REPORTS} r on i.study_id = r.study_id where full_report <> '')"""


def hash_bucket60(c="ordinal"):
    """Even buckets of the 60-bit hash ordinals."""
    return F.shiftright(F.col(c), 44)


def n_boxes():
    return F.size("boxes").cast("bigint").alias("n_boxes")


def d_parts(by, rows):
    """Rows with the ``part`` of their group's list that they fall into and the number of its parts."""
    return f"""(select *, (row_number() over (partition by {by} order by ordinal) - 1) // {PART_ROWS} as part,
      ceil(count(*) over (partition by {by}) / {PART_ROWS})::bigint as n_parts from {rows} x)"""


@query(
    "e1_studies",
    f"""select study_id, part, n_parts, any_value(full_report) as full_report, count(*) as n_images, string_agg(image_path, ' ' order by ordinal) as images
        from {d_parts("study_id", IMAGES)} a group by 1, 2, 3""",
)
def e1(d: Data):
    out = instances.studies(d.view("v_images"), reports(d), "/img", "ordinal", bucket=hash_bucket60())
    return out.select("study_id", "part", "n_parts", "full_report", F.size("image_paths").cast("bigint").alias("n_images"), F.array_join("image_paths", " ").alias("images"))


@query(
    "e2_frontal_studies",
    f"select study_id, any_value(full_report) as full_report, arg_min(image_path, (priority, ordinal)) as image_path from {IMAGES} a where priority is not null group by 1",
)
def e2(d: Data):
    out = instances.studies(d.view("v_images"), reports(d), "/img", "ordinal", "frontal_only")
    return out.select("study_id", "full_report", "image_path")


@query(
    "e3_frontal_lateral",
    f"""select a.*, part, n_parts, frontal_paths from (select study_id, count(case when kind = 'frontal' then 1 end) as n_frontal, count(case when kind = 'lateral' then 1 end) as n_lateral,
        arg_min(case when kind = 'frontal' then image_path end, case when kind = 'frontal' then md5('7|' || dicom_id) end) as frontal_path,
        arg_min(case when kind = 'lateral' then image_path end, case when kind = 'lateral' then md5('7|' || dicom_id) end) as lateral_path
        from {IMAGES} a where kind is not null group by 1) a left join (select study_id, part, n_parts, string_agg(image_path, ' ' order by ordinal) as frontal_paths
        from {d_parts("study_id", f"(select * from {IMAGES} y where kind = 'frontal')")} z group by 1, 2, 3) b using (study_id)""",
)
def e3(d: Data):
    out = instances.studies(d.view("v_images"), reports(d), "/img", "ordinal", "frontal_lateral", seed=7)
    lists = instances.study_image_lists(d.view("v_images"), reports(d), "/img", "ordinal", hash_bucket60())
    lists = lists.where("kind = 'frontal'").select("study_id", "part", "n_parts", F.array_join("image_paths", " ").alias("frontal_paths"))
    return out.join(lists, "study_id", "left").select("study_id", "n_frontal", "n_lateral", "frontal_path", "lateral_path", "part", "n_parts", "frontal_paths")


LOCB = "(select dicom_id, split, location, greatest(0, x1) as x1, greatest(0, y1) as y1, least(1, x2) as x2, least(1, y2) as y2 from v_loc_boxes where location <> 'unknown')"
LOCS = r"(select dicom_id, split, location, trim(regexp_replace(snippet, '\s+', ' ', 'g')) as snippet from v_loc_snippets where location <> 'unknown')"


def shown(df):
    return df.select("example_id", "subtask", "split", "image_key", "category", "prompt", "target")


def _eid(subtask, *keys):
    return "md5(" + " || '|' || ".join([f"'{subtask}'", *keys]) + ")"


@query(
    "e4_locate_instances",
    f"""select {_eid('anatomy|locate', 'dicom_id', 'location')} as example_id, 'locate' as subtask, split, dicom_id as image_key, location as category, 'Locate the ' || location || '.' as prompt,
        'Location of the ' || location || ': ' || {_D_BOX} as target from {LOCB} b where x1 < x2 and y1 < y2""",
)
def e4(d: Data):
    return shown(instances.locate_instances(d.location_docs()))


@query(
    "e5_describe_instances",
    f"""select {_eid('anatomy|describe', 'dicom_id', 'location')} as example_id, 'describe' as subtask, split, dicom_id as image_key, location as category, 'Describe the ' || location || '.' as prompt,
        'Description of the ' || location || ': ' || snippet as target from {LOCS} s where snippet <> ''""",
)
def e5(d: Data):
    return shown(instances.describe_instances(d.location_docs()))


@query(
    "e6_locate_describe_instances",
    f"""select {_eid('anatomy|locate_and_describe', 'dicom_id', 'location')} as example_id, 'locate_and_describe' as subtask, b.split, dicom_id as image_key, location as category,
        'Locate and describe the ' || location || '.' as prompt, 'Location of the ' || location || ': ' || {_D_BOX} || '. Description: ' || snippet as target
        from {LOCB} b join {LOCS} s using (dicom_id, location) where snippet <> '' and x1 < x2 and y1 < y2""",
)
def e6(d: Data):
    return shown(instances.locate_describe_instances(d.location_docs()))


_NB = "'[' || printf('%.2f', x / iw) || ',' || printf('%.2f', y / ih) || ',' || printf('%.2f', (x + w) / iw) || ',' || printf('%.2f', (y + h) / ih) || ']'"


@query(
    "e7_phrase_instances",
    f"""with f as (select p.*, first_value(image_width) over w as iw, first_value(image_height) over w as ih, first_value(category_name) over w as cat
          from v_phrases p window w as (partition by split, dicom_id, label_text order by ordinal))
        select split, dicom_id as image_key, cat as category, label_text as phrase, 'Ground the phrase: ' || label_text as prompt, part, n_parts,
        label_text || ': ' || string_agg({_NB}, ' ' order by ordinal) as target, count(*) as n_boxes from {d_parts("split, dicom_id, label_text", "f")} f group by 1, 2, 3, 4, 5, 6, 7""",
)
def e7(d: Data):
    out = instances.phrase_instances_ms(d.view("v_phrases"), bucket=hash_bucket60())
    return out.select("split", "image_key", "category", "phrase", "prompt", "part", "n_parts", "target", n_boxes())


_REPORT = "select study, string_agg({0}, '. ' order by finding_no) as target, sum(n_boxes)::bigint as n_boxes from v_findings group by 1"
_SPLITS = "(select distinct StudyID::bigint as study, split from v_master)"


@query(
    "e8_grounded_reports",
    f"""select 'en' as subtask, split, 'img' || study::varchar as image_key, 'Generate a grounded report.' as prompt, target, n_boxes from ({_REPORT.replace('{0}', d_finding('sentence_en'))}) r join {_SPLITS} s using (study)
        union all select 'es', split, 'img' || study::varchar, 'Generate a report.', target, null from
        (select study, string_agg(regexp_replace(trim(regexp_replace(sentence_es, '\\s+', ' ', 'g')), '\\.$', ''), '. ' order by finding_no) as target from v_findings group by 1) r join {_SPLITS} s using (study)""",
)
def e8(d: Data):
    docs, master = d.grounded_docs(), d.view("v_master")
    en = instances.grounded_report_instances(docs, master, "ordinal")
    es = instances.grounded_report_instances(docs, master, "ordinal", "es", grounded=False)
    return en.unionByName(es).select("subtask", "split", "image_key", "prompt", "target", F.size("boxes").cast("bigint").alias("n_boxes"))


@query(
    "e9_finding_phrases",
    f"""with f as (select study, finding_no, label, regexp_replace(regexp_replace(sentence_en, '^\\s+|\\s+$', '', 'g'), '\\.$', '') as sentence, n_boxes from v_findings where n_boxes > 0),
        p as (select study, label, sentence as phrase, n_boxes from f union all select study, label, label, n_boxes from f)
        select split, 'img' || study::varchar as image_key, phrase, label_group as category, n_boxes::bigint as n_boxes from p join {_SPLITS} s using (study) left join {_GROUPS} g using (label) where phrase <> ''""",
)
def e9(d: Data):
    out = instances.phrase_instances_pc(d.grounded_docs(), d.view("v_master"), "ordinal", labels_as_phrases=True)
    return out.select("split", "image_key", "phrase", "category", F.size("boxes").cast("bigint").alias("n_boxes"))


CLASSES = ["Cardiomegaly", "Nodule/Mass", "COPD", "Other disease", "No finding"]
RATED = """(select image_id, 'Cardiomegaly' as class_name from v_raters group by 1 having sum("Cardiomegaly") > 0 union all select image_id, 'Nodule/Mass' from v_raters group by 1 having sum("Nodule/Mass") > 0
  union all select image_id, 'COPD' from v_raters group by 1 having sum("COPD") > 0 union all select image_id, 'Other diseases' from v_raters group by 1 having sum("Other disease") > 0
  union all select image_id, 'No finding' from v_raters group by 1 having sum("No finding") > 0)"""
ANN = """(select * from (select a.ordinal, a.image_id, a.split, a.class_name, greatest(0, least(1, x_min / width)) as x1, greatest(0, least(1, y_min / height)) as y1,
  greatest(0, least(1, x_max / width)) as x2, greatest(0, least(1, y_max / height)) as y2 from v_annotations a join v_sizes using (image_id) where x_min is not null) t where x1 < x2 and y1 < y2)"""


_LOCAL = "class_name in ('Cardiomegaly', 'Nodule/Mass')"


@query(
    "e10_pseudo_reports",
    f"""with bx as (select image_id, class_name, part, string_agg({_D_BOX}, ' ' order by ordinal) as found from {d_parts("image_id, class_name", ANN)} b group by 1, 2, 3),
        c as (select r.image_id, r.class_name, case when r.class_name = 'No finding' then 2 when r.{_LOCAL} then 0 else 1 end as tier, list_position({d_list(vocab.CLASS_PHRASES)}, r.class_name) as place,
              case when r.{_LOCAL} then coalesce(k, 1) else 1 end as k from {RATED} r left join (select image_id, class_name, count(*) as k from bx group by 1, 2) n on r.image_id = n.image_id and r.class_name = n.class_name),
        o as (select *, (sum(k) over w - k)::bigint as start, (sum(k) over (partition by image_id))::bigint as pieces, count(*) over (partition by image_id) as classes from c window w as (partition by image_id order by tier, place)),
        p as (select o.*, part, start + part as no from o, unnest(range(k)) as x(part)),
        t as (select p.image_id, no, pieces, classes, case when p.part > 0 then '' else case when no > 0 then '. ' else '' end || case when tier < 2 then map({d_list(vocab.CLASS_PHRASES)}, {d_list(vocab.CLASS_PHRASES.values())})[p.class_name]
              when classes > 1 then 'No other relevant findings are noted.' else 'No finding' end end || case when tier = 0 and found is not null then ' ' || found else '' end || case when no = pieces - 1 then '.' else '' end as piece
              from p left join bx on p.image_id = bx.image_id and p.class_name = bx.class_name and p.part = bx.part),
        s as (select image_id, case when pieces > classes then no else 0 end as part, case when pieces > classes then pieces else 1 end as n_parts, string_agg(piece, '' order by no) as report from t group by 1, 2, 3)
        select image_id, coalesce(part, 0)::bigint as part, coalesce(n_parts, 1)::bigint as n_parts, coalesce(report, '.') as report from (select distinct image_id from v_raters) i left join s using (image_id)""",
)
def e10(d: Data):
    wide = instances.rater_union(d.view("v_raters"), CLASSES)
    labels = instances.label_long(wide, CLASSES, ["image_id"])
    boxes, _ = instances.normalised_boxes(d.view("v_annotations"), d.view("v_sizes"))
    return instances.pseudo_reports(labels, wide, boxes)


@query(
    "e11_class_phrases",
    f"""select split, image_id as image_key, map({d_list(vocab.CLASS_PHRASES)}, {d_list(vocab.CLASS_PHRASES.values())})[class_name] as phrase, part, n_parts, count(*) as n_boxes,
        phrase || ': ' || string_agg({_D_BOX}, ' ' order by ordinal) as target from {d_parts("split, image_id, class_name", ANN)} b group by 1, 2, 3, 4, 5""",
)
def e11(d: Data):
    boxes, _ = instances.normalised_boxes(d.view("v_annotations"), d.view("v_sizes"))
    out = instances.phrase_instances_vd(boxes)
    return out.select("split", "image_key", "phrase", "part", "n_parts", n_boxes(), "target")


_ROWS = "split, image_key, category, prompt, target"


@query(
    "e12_multitask",
    " union all ".join([
        *[f"select 'cig_location' as dataset, subtask, {_ROWS} from ({ORACLES[name]}) {name[:2]}" for name in ("e4_locate_instances", "e5_describe_instances", "e6_locate_describe_instances")],
        f"select 'ms_phrase_grounding', 'phrase', {_ROWS} from ({ORACLES['e7_phrase_instances']}) e7",
        f"select 'pc_grounded_report', 'en', split, image_key, 'unknown', prompt, target from ({ORACLES['e8_grounded_reports']}) e8 where subtask = 'en'",
    ]),
)
def e12(d: Data):
    docs = d.location_docs()
    anatomy = instances.locate_instances(docs).unionByName(instances.describe_instances(docs)).unionByName(instances.locate_describe_instances(docs))
    ms = instances.phrase_instances_ms(d.view("v_phrases"), bucket=hash_bucket60())
    pc = instances.grounded_report_instances(d.grounded_docs(), d.view("v_master"), "ordinal")
    return instances.multitask({"cig": anatomy, "ms": ms, "pc": pc}).select("dataset", "subtask", "split", "image_key", "category", "prompt", "target")


@query(
    "e13_label_long",
    """select rad_id, class_name, count(*) as n from (select rad_id, 'Cardiomegaly' as class_name from v_raters where "Cardiomegaly" > 0 union all select rad_id, 'Nodule/Mass' from v_raters where "Nodule/Mass" > 0
       union all select rad_id, 'COPD' from v_raters where "COPD" > 0 union all select rad_id, 'Other diseases' from v_raters where "Other disease" > 0
       union all select rad_id, 'No finding' from v_raters where "No finding" > 0) a group by 1, 2""",
)
def e13(d: Data):
    return instances.label_long(d.view("v_raters"), CLASSES, ["rad_id", "image_id"]).groupBy("rad_id", "class_name").agg(F.count("*").alias("n"))


PLACES = ["right lung", "left lung", "spine", "abdomen"]
_SAID = f"coalesce({d_description('prediction', 'label')}, regexp_replace(prediction, '^\\s+|\\s+$', '', 'g'))"


@query(
    "e14_assemble_reports",
    f"""with l as (select study_id, location, arg_max(prediction, ordinal) as prediction from v_predictions group by 1, 2),
        s as (select study_id, case when location is null then -1 else list_position({d_list(PLACES)}, location) end as place,
              case when location is null then regexp_replace(prediction, '^\\s+|\\s+$', '', 'g') else {_SAID} end as said from l)
        select study_id, string_agg(case when right(said, 1) = '.' then said else said || '.' end, ' ' order by place) as hybrid,
        string_agg(case when place > 0 then case when right(said, 1) = '.' then said else said || '.' end end, ' ' order by place) as agrg from s group by 1""",
)
def e14(d: Data):
    preds = d.view("v_predictions")
    hybrid = instances.assemble_reports(preds, "hybrid", PLACES).withColumnRenamed("report", "hybrid")
    agrg = instances.assemble_reports(preds, "agrg", PLACES).withColumnRenamed("report", "agrg")
    return hybrid.join(agrg, "study_id", "left")


@query(
    "e15_fan_out",
    f"""select study_id, location, case when location = 'neck' then 'Describe the neck.' else 'Locate and describe the ' || location || '.' end as prompt
        from (select study_id, unnest(['spine', 'neck', 'trachea']) as location from v_reports) a""",
)
def e15(d: Data):
    return instances.fan_out_locations(d.view("v_reports").select("study_id"), ["spine", "neck", "trachea"])


@query(
    "f4_rater_union",
    """select image_id, (sum("Cardiomegaly") > 0)::int as cardiomegaly, (sum("Nodule/Mass") > 0)::int as nodule, (sum("COPD") > 0)::int as copd,
       (sum("Other disease") > 0)::int as other, (sum("No finding") > 0)::int as none from v_raters group by 1""",
)
def f4(d: Data):
    wide = instances.rater_union(d.view("v_raters"), CLASSES)
    return wide.toDF("image_id", "cardiomegaly", "nodule", "copd", "other", "none")


@query(
    "e7_cxcywh_boxes",
    """with f as (select p.*, first_value(image_width) over w as iw, first_value(image_height) over w as ih from v_phrases p window w as (partition by split, dicom_id, label_text order by ordinal))
       select label_text as phrase, count(*) as n, round(sum((x + w / 2) / iw), 4) as cx, round(sum(h / ih), 4) as h from f group by 1""",
)
def e7_cxcywh(d: Data):
    out = instances.phrase_instances_ms(d.view("v_phrases"), "cxcywh", bucket=hash_bucket60())
    rows = out.select("phrase", F.explode("boxes").alias("b"))
    return rows.groupBy("phrase").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("b")[0]), 4).alias("cx"), F.round(F.sum(F.col("b")[3]), 4).alias("h")
    )
