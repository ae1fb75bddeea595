"""Queries of the box expressions."""

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import vocab
from ..operators import instances
from ..streaming.streams import grounding_scores
from .registry import query, r6
from .text_queries import _D_BOX, d_eval_text
from .views import Data

BOX = vocab.BOX


def boxes(d: Data):
    return d.view("v_boxes").withColumn("b", F.array("x1", "y1", "x2", "y2"))


def _sides(b, names):
    return [r6(b[i]).alias(n) for i, n in enumerate(names)]


@query(
    "c1_xyxy_to_cxcywh",
    "select box_id, round((x1 + x2) / 2, 6) as cx, round((y1 + y2) / 2, 6) as cy, round(x2 - x1, 6) as w, round(y2 - y1, 6) as h from v_boxes",
)
def c1(d: Data):
    return boxes(d).select("box_id", *_sides(bx.xyxy_to_cxcywh("b"), ["cx", "cy", "w", "h"]))


@query(
    "c2_cxcywh_to_xyxy",
    "select box_id, round(x1 - x2 / 2, 6) as x1, round(y1 - y2 / 2, 6) as y1, round(x1 + x2 / 2, 6) as x2, round(y1 + y2 / 2, 6) as y2 from v_boxes",
)
def c2(d: Data):
    return boxes(d).select("box_id", *_sides(bx.cxcywh_to_xyxy("b"), ["x1", "y1", "x2", "y2"]))


@query(
    "c3_norm_xywh",
    """select ordinal, round(x / image_width, 6) as x1, round(y / image_height, 6) as y1, round((x + w) / image_width, 6) as x2, round((y + h) / image_height, 6) as y2 from v_phrases""",
)
def c3(d: Data):
    b = bx.norm_xywh("x", "y", "w", "h", "image_width", "image_height", strict=True)
    return d.view("v_phrases").select("ordinal", *_sides(b, ["x1", "y1", "x2", "y2"]))


@query(
    "c4_norm_xyxy",
    """with b as (select class_name, greatest(0, least(1, x_min / width)) as x1, greatest(0, least(1, y_min / height)) as y1,
           greatest(0, least(1, x_max / width)) as x2, greatest(0, least(1, y_max / height)) as y2
           from v_annotations join v_sizes using (image_id) where x_min is not null)
       select class_name, x1 < x2 and y1 < y2 as kept, count(*) as n, round(sum(case when x1 < x2 and y1 < y2 then x1 + y1 + x2 + y2 end), 6) as total from b group by 1, 2""",
)
def c4(d: Data):
    good, bad = instances.normalised_boxes(d.view("v_annotations"), d.view("v_sizes"))
    total = F.aggregate("box", F.lit(0.0), lambda a, x: a + x)
    kept = good.groupBy("class_name").agg(F.lit(True).alias("kept"), F.count("*").alias("n"), r6(F.sum(total)).alias("total"))
    return kept.unionByName(
        bad.groupBy("class_name").agg(F.lit(False).alias("kept"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    )


@query(
    "c5_clamp_box",
    """with c as (select box_id, greatest(0, x1) as x1, greatest(0, y1) as y1, least(1, x2) as x2, least(1, y2) as y2 from v_boxes)
       select box_id, x1 < x2 and y1 < y2 as valid, round(case when x1 < x2 and y1 < y2 then x1 end, 6) as x1, round(case when x1 < x2 and y1 < y2 then y1 end, 6) as y1,
       round(case when x1 < x2 and y1 < y2 then x2 end, 6) as x2, round(case when x1 < x2 and y1 < y2 then y2 end, 6) as y2 from c""",
)
def c5(d: Data):
    rows = boxes(d).select("box_id", bx.clamp_box("b").alias("c"))
    return rows.select("box_id", F.col("c").isNotNull().alias("valid"), *_sides(F.col("c"), ["x1", "y1", "x2", "y2"]))


@query("c6_format_box", f"select box_id, {_D_BOX} as formatted, {_D_BOX} || ' ' || {_D_BOX} as twice from v_boxes")
def c6(d: Data):
    return boxes(d).select("box_id", bx.format_box("b").alias("formatted"), bx.format_boxes(F.array("b", "b")).alias("twice"))


def _parsed(side, column):
    return f"""select example_id, '{side}' as side, generate_subscripts(m, 1)::int - 1 as pos, list_transform(string_split(regexp_replace(unnest(m), '[\\[\\]\\s]', '', 'g'), ','), lambda x: x::double) as v
    from (select example_id, regexp_extract_all({column}, '{BOX}', 0) as m from v_grounded_text) t where len(m) > 0"""


PARSED = f"({_parsed('gt', 'gt_text')} union all {_parsed('pred', 'pred_text')})"


@query("c7_parse_boxes", f"select example_id, side, pos, v[1] as a, v[2] as b, v[3] as c, v[4] as d from {PARSED} p")
def c7(d: Data):
    rows = d.view("v_grounded_text")
    out = None
    for side in ("gt", "pred"):
        part = rows.select("example_id", F.lit(side).alias("side"), F.posexplode(bx.parse_boxes(f"{side}_text")).alias("pos", "v"))
        out = part if out is None else out.unionByName(part)
    return out.select("example_id", "side", "pos", *[F.col("v")[i].alias(n) for i, n in enumerate("abcd")])


# Area by cells between all distinct edges of an example.
IOU = f"""p as {PARSED},
r as (select example_id, side, v[1] - v[3] / 2 as x1, v[2] - v[4] / 2 as y1, v[1] + v[3] / 2 as x2, v[2] + v[4] / 2 as y2 from p where v[3] > 0 and v[4] > 0),
xs as (select example_id, x as a, lead(x) over (partition by example_id order by x) as b from (select example_id, x1 as x from r union select example_id, x2 from r) e),
ys as (select example_id, y as a, lead(y) over (partition by example_id order by y) as b from (select example_id, y1 as y from r union select example_id, y2 from r) e),
cells as (select xs.example_id, xs.a as xa, xs.b as xb, ys.a as ya, ys.b as yb from xs join ys on xs.example_id = ys.example_id where xs.b is not null and ys.b is not null),
cov as (select c.example_id, xa, xb, ya, yb, bool_or(side = 'gt') as g, bool_or(side = 'pred') as q from cells c join r on r.example_id = c.example_id
  and r.x1 <= xa and r.x2 >= xb and r.y1 <= ya and r.y2 >= yb group by all),
areas as (select example_id, sum(case when g and q then (xb - xa) * (yb - ya) else 0 end) / sum((xb - xa) * (yb - ya)) as iou from cov group by 1),
iou as (select t.example_id, coalesce(a.iou, 1) as iou from (select example_id from v_grounded_text) t left join areas a on a.example_id = t.example_id)"""


@query("c8_union_iou", f"with {IOU} select example_id, round(iou + 1e-9, 6) as iou from iou")
def c8(d: Data):
    score = bx.union_iou(bx.parse_boxes("gt_text"), bx.parse_boxes("pred_text"), "cxcywh")
    return d.view("v_grounded_text").select("example_id", r6(score + 1e-9).alias("iou"))


@query(
    "c9_box_formats",
    """select location, round(sum(x1 + y1 + x2 + y2), 4) as xyxy, round(sum(2 * x1 + 2 * y1), 4) as cxcywh, round(sum((x1 + x1 + x2) / width + (y1 + y1 + y2) / height), 4) as xywh,
       round(sum((x1 + x2) / width + (y1 + y2) / height), 4) as pixel from v_boxes group by 1""",
)
def c9(d: Data):
    def total(fmt, *size):
        b = bx.to_xyxy("b", fmt, *size)
        return b[0] + b[1] + b[2] + b[3]

    rows = boxes(d).select(
        "location", total("albumentations").alias("xyxy"), total("yolo").alias("cxcywh"),
        total("coco", "width", "height").alias("xywh"), total("pascal_voc", "width", "height").alias("pixel"),
    )
    return rows.groupBy("location").agg(*[F.round(F.sum(c), 4).alias(c) for c in ("xyxy", "cxcywh", "xywh", "pixel")])


D_BOX1 = "'[' || printf('%.2f', x1) || ',0.25,' || printf('%.2f', x1 + 0.2) || ',0.50]'"
D_BOX2 = "'[' || '0.12,' || printf('%.2f', x1) || ',0.50,' || printf('%.2f', x1 + 0.25) || ']'"


def d_finding(column):
    clean = rf"regexp_replace(trim(regexp_replace({column}, '\s+', ' ', 'g')), '\.$', '')"
    return f"{clean} || case when n_boxes = 0 then '' when n_boxes = 1 then ' ' || {D_BOX1} else ' ' || {D_BOX1} || ' ' || {D_BOX2} end"


@query(
    "c10_grounded_report",
    f"""select study::varchar as study_id, string_agg({d_finding('sentence_en')}, '. ' order by finding_no) as en, string_agg({d_finding('sentence_es')}, '. ' order by finding_no) as es
        from v_findings group by 1""",
)
def c10(d: Data):
    from ..functions.text import clean_findings

    rows = d.grounded_docs().withColumn("f", clean_findings("findings"))
    boxes_ = F.transform("f", lambda f: f["boxes"])

    def report(lang):
        return bx.grounded_report(F.transform("f", lambda f: f[f"sentence_{lang}"]), boxes_).alias(lang)

    return rows.select(F.col("StudyID").alias("study_id"), report("en"), report("es"))


@query(
    "c11_denorm_box",
    "select box_id, round(x1 * width, 6) as x, round(y1 * height, 6) as y, round((x2 - x1) * width, 6) as w, round((y2 - y1) * height, 6) as h from v_boxes",
)
def c11(d: Data):
    rows = boxes(d).select("box_id", bx.denorm_box("b", "width", "height").alias("p"))
    return rows.select("box_id", *[r6(F.col(f"p.{c}")).alias(c) for c in "xywh"])


@query(
    "c12_box_bins",
    f"""select case when n = 0 then '0 boxes' when n = 1 then '1 box' when n = 2 then '2 boxes' when n <= 4 then '3-4 boxes' else '5+ boxes' end as bin, count(*) as n
        from (select len(regexp_extract_all(gt_text || ' ' || pred_text, '{BOX}', 0)) as n from v_grounded_text) a group by 1""",
)
def c12(d: Data):
    found = bx.parse_boxes(F.concat("gt_text", F.lit(" "), "pred_text"))
    return d.view("v_grounded_text").groupBy(bx.num_boxes_bin(found).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "c13_grounding_scores",
    f"""with {IOU} select t.example_id, round(case when regexp_matches(gt_text, '{BOX}') then iou end + 1e-9, 6) as bbox_iou, {d_eval_text('gt_text')} as clean_gt, {d_eval_text('pred_text')} as clean_pred
        from v_grounded_text t join iou on t.example_id = iou.example_id""",
)
def c13(d: Data):
    rows = grounding_scores(d.view("v_grounded_text"))
    return rows.select("example_id", r6(F.col("bbox_iou") + 1e-9).alias("bbox_iou"), "clean_gt", "clean_pred")
