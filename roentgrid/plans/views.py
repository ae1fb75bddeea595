"""Reference-shaped views over the given tables.

One SQL text per view, read by both engines; only the hash and the number format
differ by dialect. Every view covers all rows and all of a text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def hash60(x: str, dialect: str) -> str:
    if dialect == "spark":
        return f"cast(conv(substr(md5({x}), 1, 15), 16, 10) as bigint)"
    return f"('0x' || substr(md5({x}), 1, 15))::bigint"


def two_decimals(x: str, dialect: str) -> str:
    return f"format_number({x}, '0.00')" if dialect == "spark" else f"printf('%.2f', {x})"


def _box(dialect: str, *sides: str) -> str:
    return "concat('[', " + ", ',', ".join(two_decimals(s, dialect) for s in sides) + ", ']')"


SPLIT = "case when {0} % 10 < 7 then 'train' when {0} % 10 = 7 then 'validate' else 'test' end"
IMAGE_ID = (
    "concat(cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', "
    "cast(l_linenumber as string))"
)


def view_sql(dialect: str) -> dict[str, str]:
    d = dialect
    cx, cy = "(20 + l_partkey % 60) / cast(100 as double)", "(20 + l_suppkey % 60) / cast(100 as double)"
    bw, bh = "l_quantity / cast(100 as double)", "(5 + l_linenumber * 4) / cast(100 as double)"
    first = _box(d, cx, cy, bw, bh)
    second = _box(d, f"{cy}", f"{cx}", "cast(0.11 as double)", f"{bw}")
    shifted = _box(d, f"{cx} + l_linenumber / cast(100 as double)", cy, bw, f"{bh} + l_discount")
    return {
        # Reports, whole texts cut in two sections.
        "v_reports": f"""
select doc_id as ordinal,
       concat('files/p1', cast(doc_id % 10 as string), '/p', cast(1000 + doc_id % 997 as string), '/s', cast(doc_id as string), '.txt') as path,
       cast(doc_id as string) as study_id, source as category, lang,
       substr(text, 1, cast(floor(length(text) / 2) as int)) as findings,
       substr(text, cast(floor(length(text) / 2) as int) + 1) as impression,
       {SPLIT.format("doc_id")} as split
from documents""",
        # Short reports of the studies that the images belong to.
        "v_study_reports": """
select o_orderkey as ordinal,
       concat('files/p1', cast(o_custkey % 10 as string), '/p', cast(o_custkey as string), '/s', cast(o_orderkey as string), '.txt') as path,
       case when o_orderkey % 11 = 0 then '  ' when o_orderkey % 7 = 0 then null else concat(' Priority ', o_orderpriority, ' ') end as findings,
       case when o_orderkey % 11 = 0 then null when o_orderstatus = 'F' then 'Status: final.' when o_orderstatus = 'O' then '' else 'Pending?' end as impression
from orders""",
        "v_images": f"""
select {IMAGE_ID} as dicom_id, {hash60(IMAGE_ID, d)} as ordinal,
       cast(l_orderkey as string) as study_id, cast(l_suppkey as string) as subject_id,
       {SPLIT.format("l_orderkey")} as split,
       case when l_linenumber % 4 = 0 then 'PA' when l_linenumber % 4 = 1 then 'AP' when l_linenumber % 4 = 2 then 'LATERAL' end as view_position,
       case when l_returnflag = 'R' then 'CHEST (PORTABLE AP)' else 'CHEST' end as procedure_text,
       cast(1000 + l_partkey % 500 as int) as width, cast(1200 + l_suppkey % 300 as int) as height
from lineitem""",
        "v_boxes": f"""
select {IMAGE_ID} as box_id, cast(l_orderkey as string) as example_id,
       case when l_linenumber % 2 = 0 then 'pred' else 'gt' end as side,
       case when l_returnflag = 'A' then 'right lung' when l_returnflag = 'N' then 'left lung' else 'spine' end as location,
       (l_partkey % 80) / cast(100 as double) - cast(0.1 as double) as x1,
       (l_suppkey % 80) / cast(100 as double) as y1,
       (l_partkey % 80) / cast(100 as double) + (l_quantity - 5) / cast(100 as double) as x2,
       (l_suppkey % 80) / cast(100 as double) + (5 + l_linenumber * 4) / cast(100 as double) as y2,
       cast(1000 + l_partkey % 500 as int) as width, cast(1200 + l_suppkey % 300 as int) as height
from lineitem""",
        # Phrase annotations in pixels, several boxes per image and phrase.
        "v_phrases": f"""
select {hash60(IMAGE_ID, d)} as ordinal, cast(l_orderkey as string) as dicom_id,
       case when l_returnflag = 'A' then 'small nodule' when l_returnflag = 'N' then 'pleural effusion' else 'rib fracture' end as label_text,
       case when l_returnflag = 'A' then 'Lesion' when l_returnflag = 'N' then 'Effusion' else 'Bone' end as category_name,
       cast(l_partkey % 500 as double) as x, cast(l_suppkey % 400 as double) as y,
       l_quantity as w, cast(5 + l_linenumber * 4 as double) as h,
       cast(1000 + l_partkey % 500 as int) as image_width, cast(1200 + l_suppkey % 300 as int) as image_height,
       {SPLIT.format("l_orderkey")} as split
from lineitem""",
        # Generated and true texts with boxes (cxcywh) and a description.
        "v_grounded_text": f"""
select {IMAGE_ID} as example_id,
       case when l_returnflag = 'A' then 'right lung' when l_returnflag = 'N' then 'left lung' else 'spine' end as category,
       concat('ds', cast(l_suppkey % 4 as string)) as dataset,
       case when l_linenumber = 7 then concat('Description of the spine: clear  ', l_returnflag, ' .')
            when l_linenumber % 3 = 0 then concat('Location of the spine: ', {first}, ' ', {second}, '. Description: clear ', l_returnflag, '.')
            else concat('Location of the spine: ', {first}, '. Description: clear ', l_returnflag, '.') end as gt_text,
       case when l_linenumber = 5 then concat('Description:  ', l_linestatus, ' is clear.')
            when l_linenumber % 2 = 0 then concat('Location of the spine: ', {shifted}, ' ', {second}, '. Description: ', l_linestatus, ' is clear.')
            else concat('Location of the spine: ', {shifted}, '. Description: ', l_linestatus, ' is clear.') end as pred_text
from lineitem""",
        # Image labels by raters, one 0/1 column per class, and box annotations.
        "v_raters": """
select cast(user_id as string) as image_id, concat('R', cast(event_id % 3 as string)) as rad_id,
       case when event_type = 'error' then 1 else 0 end as `Cardiomegaly`,
       case when event_type = 'purchase' then 1 else 0 end as `Nodule/Mass`,
       case when event_type = 'view' and user_id % 2 = 0 then 1 else 0 end as `COPD`,
       case when event_type = 'click' and user_id % 5 = 0 then 1 else 0 end as `Other disease`,
       case when event_type = 'signup' or user_id % 7 = 0 then 1 else 0 end as `No finding`
from events""",
        "v_annotations": f"""
select event_id as ordinal, cast(user_id as string) as image_id, {SPLIT.format("user_id")} as split,
       case when event_type = 'error' then 'Cardiomegaly' when event_type = 'purchase' then 'Nodule/Mass'
            when event_type = 'view' then 'Consolidation' else 'No finding' end as class_name,
       case when event_type in ('error', 'purchase', 'view') then cast(event_id % 900 as double) end as x_min,
       cast(event_id % 700 as double) as y_min,
       cast(event_id % 900 as double) + value as x_max,
       cast(event_id % 700 as double) + cast(event_id % 50 as double) * 3 as y_max
from events""",
        "v_sizes": """
select cast(user_id as string) as image_id, cast(600 + max(user_id) % 500 as int) as width, cast(500 + max(user_id) % 400 as int) as height
from events group by user_id""",
        # Consecutive turns as hypothesis and reference, whole texts.
        "v_pairs": """
select a.conv_id * 1000 + a.turn as pair_id, a.conv_id, b.text as hyp, a.text as ref
from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1""",
        "v_labels": """
select l.doc_id, 'quality' as class, l.quality as y_true, case when d.n_chars > 500 then 1 else 0 end as y_pred
from labels l join documents d on l.doc_id = d.doc_id
union all
select l.doc_id, 'toxic' as class, l.toxic as y_true, case when d.doc_id % 5 = 0 then 1 else 0 end as y_pred
from labels l join documents d on l.doc_id = d.doc_id""",
        "v_sets": """
select vec_id % 50 as pair_id, case when vec_id % 100 < 50 then 'hyp' else 'ref' end as side,
       vec_id as item_id, concat('T', cast(label as string)) as item_type, embedding
from embeddings""",
        "v_eval": """
select event_id as example_id, concat('ds', cast(user_id % 4 as string)) as dataset, event_type as category,
       case when event_id % 3 = 0 then 'Locate the spine.' when event_id % 3 = 1 then 'describe the spine.' else 'Locate and describe the spine.' end as prompt,
       case when user_id % 4 = 3 then null else (event_id % 101) / cast(100 as double) end as bbox_iou,
       (event_id % 89) / cast(88 as double) as text_score
from events""",
        "v_replies": """
select event_id as request_id,
       concat('Report: "', event_type, '" | Location: "', cast(user_id % 29 as string), '"') as query,
       case when event_id % 10 = 0 then 'no json here'
            when event_id % 10 = 1 then '{"reason": "  ", "mentions_abnormalities": "yes", "mentions_devices": "no"}'
            when event_id % 10 = 2 then concat('{"reason": "', event_type, '", "mentions_abnormalities": "maybe", "mentions_devices": "no"}')
            when event_id % 10 = 3 then concat('{"reason": "', event_type, '", "mentions_abnormalities": "no"}')
            when event_id % 10 = 4 then 'Sorry {"reason": "x", '
            else concat('Sure: {"reason": " ', event_type, '", "mentions_abnormalities": "', case when user_id % 2 = 0 then 'yes' else 'no' end, '", "mentions_devices": "', case when user_id % 3 = 0 then 'yes' else 'no' end, '"} done') end as reply,
       case when event_id % 17 = 0 then 'rate limit' end as error, event_type, user_id, props
from events""",
        "v_pool": """
select d.doc_id as id, d.source as category, d.lang as location, d.n_chars % 3 <> 0 as has_box,
       l.quality is not null as has_report,
       case when l.toxic = 1 then 'yes' when l.toxic = 0 then 'no' end as abnormality,
       case when l.doc_id is null then null when d.n_chars > 500 then 'yes' else 'no' end as devices
from documents d left join labels l on d.doc_id = l.doc_id""",
        "v_log": """
select cast(floor(event_id / cast(25 as double)) as bigint) as global_step, cast(event_id % 2 as int) as process_id,
       event_id as orig_index, concat('ds', cast(user_id % 4 as string)) as dataset_name, event_type as category, ts as ingest_ts
from events""",
        # Predictions per study and location; a null location is the whole report.
        "v_predictions": f"""
select {hash60(IMAGE_ID, d)} as ordinal, cast(l_orderkey as string) as study_id,
       case when l_linenumber % 4 = 0 then 'right lung' when l_linenumber % 4 = 1 then 'spine' when l_linenumber % 4 = 2 then 'abdomen' end as location,
       case when l_linenumber % 4 = 1 then concat('Location of the spine: [0.1,0.2,0.3,0.4]. Description:  ', l_returnflag, ' clear ')
            else concat(' Part ', cast(l_partkey as string), '. ') end as prediction
from lineitem""",
        # Label comparisons of two runs.
        "v_comparisons": """
select concat('run', cast(event_id % 2 as string)) as run, concat('loc', cast(user_id % 6 as string)) as location,
       case when event_type in ('error', 'view') and event_id % 2 = 0 then 'yes' when event_type = 'error' then 'yes' else 'no' end as gen_has_hallucinated_abnormalities,
       case when event_type = 'click' then 'yes' else 'no' end as gen_has_hallucinated_devices,
       case when event_type = 'error' then 'contradiction' when event_type = 'view' then 'neutral' else 'entailment' end as nli_status
from events""",
        # Location documents in long form; location_docs() holds them as maps.
        "v_loc_boxes": f"""
select cast(doc_id as string) as dicom_id, {SPLIT.format("doc_id")} as split, 'right lung' as location,
       (doc_id % 50) / cast(40 as double) - cast(0.2 as double) as x1, (n_chars % 60) / cast(50 as double) as y1,
       (doc_id % 50) / cast(40 as double) + cast(0.3 as double) as x2, (n_chars % 60) / cast(50 as double) + cast(0.125 as double) as y2
from documents
union all
select cast(doc_id as string), {SPLIT.format("doc_id")}, case when doc_id % 3 = 0 then 'aortic arch' when doc_id % 3 = 1 then 'svc' else 'unknown' end,
       cast(0.25 as double), cast(0.5 as double), (n_chars % 100) / cast(100 as double), cast(0.75 as double)
from documents""",
        "v_loc_snippets": f"""
select cast(doc_id as string) as dicom_id, {SPLIT.format("doc_id")} as split, 'right lung' as location,
       case when doc_id % 4 = 0 then '  ' else concat('  ', source, '   is ', lang, ' ') end as snippet
from documents
union all
select cast(doc_id as string), {SPLIT.format("doc_id")}, case when doc_id % 3 = 0 then 'aortic arch' when doc_id % 3 = 1 then 'neck' else 'unknown' end,
       concat('seen in ', source)
from documents""",
        # Two findings per study in long form; grounded_docs() holds them as arrays.
        "v_findings": """
select o_orderkey as study, 0 as finding_no, concat('  Priority   ', o_orderpriority, '.') as sentence_en, concat(' Prioridad ', o_orderpriority) as sentence_es,
       case when o_orderkey % 3 = 0 then 0 when o_orderkey % 3 = 1 then 1 else 2 end as n_boxes, (o_custkey % 70) / cast(100 as double) as x1, concat('label ', o_orderstatus) as label
from orders
union all
select o_orderkey, 1, concat('Status ', o_orderstatus), concat('Estado  ', o_orderstatus, '. '), case when o_orderkey % 5 = 0 then 1 else 0 end,
       (o_custkey % 40) / cast(100 as double), concat('label ', o_orderpriority)
from orders""",
        "v_master": f"""
select o_orderkey as ordinal, cast(o_orderkey as string) as StudyID, {SPLIT.format("o_orderkey")} as split,
       concat('label ', o_orderstatus) as label, concat('group ', cast(o_custkey % 5 as string)) as label_group
from orders
union all
select o_orderkey, cast(o_orderkey as string), {SPLIT.format("o_orderkey")}, concat('label ', o_orderpriority), concat('kind ', o_orderpriority)
from orders""",
        # Entities with relations per pair and side.
        "v_entities": """
select l_orderkey as pair_id, case when l_linenumber % 2 = 0 then 'hyp' else 'ref' end as side,
       concat('part', cast(l_partkey % 4 as string)) as tokens, l_returnflag as label,
       case when l_suppkey % 3 = 0 then 'located_at' when l_suppkey % 3 = 1 then 'modify' end as relation,
       case when l_suppkey % 3 < 2 then concat('part', cast(l_suppkey % 2 as string)) end as target_tokens
from lineitem""",
    }


def _render(sql: str, dialect: str) -> str:
    return sql if dialect == "spark" else sql.replace("`", '"')


def duck(sql: str) -> str:
    """A DuckDB query with the views it uses as common table expressions."""
    views = view_sql("duckdb")
    used: list[str] = []

    def add(text: str) -> None:
        for name in views:
            if re.search(rf"\b{name}\b", text) and name not in used:
                add(views[name])
                used.append(name)

    add(sql)
    ctes = [f"{name} as ({_render(views[name], 'duckdb')})" for name in views if name in used]
    body = sql.strip()
    if not ctes:
        return body
    for head in ("with recursive ", "with "):
        if body.lower().startswith(head):
            return head + ",\n".join(ctes) + ",\n" + body[len(head) :]
    return "with " + ",\n".join(ctes) + "\n" + body


class Data:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = view_sql("spark")[name].strip()
        used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", sql)]
        # Table names become placeholders; other braces are data and are doubled.
        sql = sql.replace("{", "{{").replace("}", "}}")
        sql = re.sub(rf"\b(from|join) ({'|'.join(used)})\b", r"\1 {\2}", sql)
        return self.spark.sql(sql, **{t: self.table(t) for t in used})

    def location_docs(self) -> DataFrame:
        """v_loc_boxes and v_loc_snippets as one map document per image."""
        d = self.table("documents")
        third = F.when(F.col("doc_id") % 3 == 0, "aortic arch")
        n, c = F.col("doc_id"), F.col("n_chars")
        x, y = (n % 50) / F.lit(40.0), (c % 60) / F.lit(50.0)
        boxes = F.create_map(
            F.lit("right lung"), F.array(x - 0.2, y, x + 0.3, y + 0.125),
            third.when(n % 3 == 1, "svc").otherwise("unknown"),
            F.array(F.lit(0.25), F.lit(0.5), (c % 100) / F.lit(100.0), F.lit(0.75)),
        )
        snippet = F.when(n % 4 == 0, "  ").otherwise(F.concat(F.lit("  "), "source", F.lit("   is "), "lang", F.lit(" ")))
        snippets = F.create_map(
            F.lit("right lung"), snippet,
            third.when(n % 3 == 1, "neck").otherwise("unknown"), F.concat(F.lit("seen in "), "source"),
        )
        split = F.when(n % 10 < 7, "train").when(n % 10 == 7, "validate").otherwise("test")
        return d.select(
            n.cast("string").alias("dicom_id"), split.alias("split"), F.col("text").alias("original_report"),
            boxes.alias("location2bbox"), snippets.alias("location2report_snippet"),
        )

    def grounded_docs(self) -> DataFrame:
        """v_findings as one document per study."""
        o = self.table("orders")
        k, cu = F.col("o_orderkey"), F.col("o_custkey")

        def boxes(n, x):
            one = F.array(x, F.lit(0.25), x + F.lit(0.2), F.lit(0.5))
            two = F.array(F.lit(0.125), x, F.lit(0.5), x + F.lit(0.25))
            none = F.array().cast("array<array<double>>")
            return F.when(n == 0, none).when(n == 1, F.array(one)).otherwise(F.array(one, two))

        def finding(en, es, n, x, label):
            return F.struct(
                en.alias("sentence_en"), es.alias("sentence_es"), boxes(n, x).alias("boxes"), F.array(label).alias("labels")
            )

        findings = F.array(
            finding(
                F.concat(F.lit("  Priority   "), "o_orderpriority", F.lit(".")),
                F.concat(F.lit(" Prioridad "), "o_orderpriority"),
                k % 3, (cu % 70) / F.lit(100.0), F.concat(F.lit("label "), "o_orderstatus"),
            ),
            finding(
                F.concat(F.lit("Status "), "o_orderstatus"), F.concat(F.lit("Estado  "), "o_orderstatus", F.lit(". ")),
                F.when(k % 5 == 0, 1).otherwise(0), (cu % 40) / F.lit(100.0), F.concat(F.lit("label "), "o_orderpriority"),
            ),
        )
        return o.select(
            k.alias("ordinal"), k.cast("string").alias("StudyID"), F.concat(F.lit("img"), k.cast("string")).alias("ImageID"),
            findings.alias("findings"),
        )

