"""Queries of the text expressions and the SQL functions."""

from pyspark.sql import functions as F

from ..functions import sql as sqlfn
from ..functions import text, vocab
from ..operators import instances, joins
from .registry import d_list, d_squeeze, d_strip, query
from .views import Data

LOCATIONS = vocab.LOCATE_AND_DESCRIBE + vocab.LOCATE_ONLY + vocab.DESCRIBE_ONLY + ["nowhere"]
CLASSES = [*vocab.CLASS_PHRASES, "Not a class"]
BOX = vocab.BOX


@query(
    "b1_path_parts",
    r"""select study_id, regexp_extract(path, 'p(\d+)/p(\d+)/s(\d+)\.txt', 1) as part, regexp_extract(path, 'p(\d+)/p(\d+)/s(\d+)\.txt', 2) as subject,
       regexp_extract(path, 'p(\d+)/p(\d+)/s(\d+)\.txt', 3) as study, regexp_extract(path, '/s(\d+)', 1) as study_only from v_reports""",
)
def b1(d: Data):
    p = text.path_parts("path", strict=True)
    return d.view("v_reports").select(
        "study_id", p["part_id"].alias("part"), p["subject_id"].alias("subject"), p["study_id"].alias("study"),
        text.study_of_path("path").alias("study_only"),
    )


ALL_REPORTS = """select 'd' || study_id as id, findings, impression from v_reports
union all select 's' || ordinal::varchar, findings, impression from v_study_reports"""


def all_reports(d: Data):
    docs = d.view("v_reports").select(F.concat(F.lit("d"), "study_id").alias("id"), "findings", "impression")
    short = d.view("v_study_reports").select(F.concat(F.lit("s"), F.col("ordinal").cast("string")).alias("id"), "findings", "impression")
    return docs.unionByName(short)


def _sec(x):
    s = d_strip(x)
    return f"case when {s} = '' then null when regexp_matches({s}, '[.!?,;:]$') then {s} else {s} || '.' end"


@query(
    "b2_full_report",
    f"select id, md5(r) as digest, length(r) as n_chars from (select id, concat_ws(' ', {_sec('findings')}, {_sec('impression')}) as r from ({ALL_REPORTS}) a) b",
)
def b2(d: Data):
    r = text.full_report("findings", "impression")
    return all_reports(d).select("id", r.alias("r")).select("id", F.md5("r").alias("digest"), F.length("r").cast("bigint").alias("n_chars"))


@query(
    "b3_concat_sections",
    f"""select id, md5(r) as digest from (select id, case when f <> '' and i <> '' then case when right(f, 1) = '.' then f || ' ' || i else f || '. ' || i end
        when f <> '' then f else i end as r from (select id, coalesce({d_strip('findings')}, '') as f, coalesce({d_strip('impression')}, '') as i from ({ALL_REPORTS}) a) b) c""",
)
def b3(d: Data):
    return all_reports(d).select("id", F.md5(text.concat_sections("findings", "impression")).alias("digest"))


@query(
    "b4_image_path",
    """select dicom_id, '/img/p1' || right(subject_id, 1) || '/p' || subject_id || '/s' || study_id || '/' || dicom_id || '.jpg' as image_path,
       '/img/p1' || right(subject_id, 1) || '/p' || subject_id || '/s' || study_id || '/' || dicom_id || '.png' as swapped from v_images""",
)
def b4(d: Data):
    part = F.concat(F.lit("1"), F.right("subject_id", F.lit(1)))
    path = text.image_path(F.lit("/img"), part, "subject_id", "study_id", "dicom_id")
    return d.view("v_images").select("dicom_id", path.alias("image_path"), text.swap_ext(path, "png").alias("swapped"))


@query(
    "b5_split_filter",
    """select asked, case when split = 'validate' then 'val' else split end as split, count(*) as n, count(distinct study_id) as studies
       from v_images join (values ('train', 'train'), ('val', 'validate'), ('test', 'test'), ('all', 'train'), ('all', 'validate'), ('all', 'test')) a(asked, name) on split = name group by 1, 2""",
)
def b5(d: Data):
    images = d.view("v_images")
    out = None
    for asked in ("train", "val", "test", "all"):
        rows = joins.filter_split(images, asked).groupBy(joins.output_split().alias("split")).agg(
            F.count("*").alias("n"), F.countDistinct("study_id").alias("studies")
        ).select(F.lit(asked).alias("asked"), "split", "n", "studies")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("b6_squeeze_ws", f"select doc_id, md5(t) as digest, length(t) as n_chars from (select doc_id, {d_squeeze('text')} as t from documents) a")
def b6(d: Data):
    rows = d.table("documents").select("doc_id", text.squeeze_ws("text").alias("t"))
    return rows.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


_CLEAN = "regexp_replace(" + d_squeeze("{0}") + r", '\.$', '')"


@query(
    "b7_clean_sentence",
    f"""select 'd' || doc_id::varchar as id, md5({_CLEAN.replace('{0}', 'text')}) as en, null::varchar as es from documents
        union all select study::varchar || '/' || finding_no::varchar, {_CLEAN.replace('{0}', 'sentence_en')}, {_CLEAN.replace('{0}', 'sentence_es')} from v_findings""",
)
def b7(d: Data):
    docs = d.table("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.md5(text.clean_sentence("text")).alias("en"), F.lit(None).cast("string").alias("es")
    )
    rows = d.grounded_docs().select("StudyID", F.posexplode(text.clean_findings("findings")).alias("no", "f"))
    return docs.unionByName(rows.select(F.concat("StudyID", F.lit("/"), F.col("no").cast("string")).alias("id"), F.col("f.sentence_en").alias("en"), F.col("f.sentence_es").alias("es")))


def class_rows(d: Data):
    names = F.array(*[F.lit(c) for c in CLASSES])
    return d.table("events").select(F.element_at(names, (F.col("event_id") % len(CLASSES) + 1).cast("int")).alias("class_name"))


_CLASS_ROWS = f"(select {d_list(CLASSES)}[event_id % {len(CLASSES)} + 1] as class_name from events)"


@query(
    "b8_class_phrase",
    f"select class_name, map({d_list(vocab.CLASS_PHRASES)}, {d_list(vocab.CLASS_PHRASES.values())})[class_name] as phrase, count(*) as n from {_CLASS_ROWS} group by 1, 2",
)
def b8(d: Data):
    return class_rows(d).groupBy("class_name", text.class_phrase("class_name").alias("phrase")).agg(F.count("*").alias("n"))


@query(
    "b9_localizable",
    f"""select class_name, case when class_name in (select unnest({d_list(vocab.GLOBAL_CLASSES)})) then false
        when class_name in (select unnest({d_list(vocab.CLASS_PHRASES)})) then true end as localizable, count(*) as n from {_CLASS_ROWS} group by 1, 2""",
)
def b9(d: Data):
    return class_rows(d).groupBy("class_name", text.is_localizable("class_name").alias("localizable")).agg(F.count("*").alias("n"))


def _d_prompt(word):
    return f"""case when list_contains({d_list(vocab.LOCATE_AND_DESCRIBE)}, location) then '{word} and describe the ' || location || '.'
    when list_contains({d_list(vocab.DESCRIBE_ONLY)}, location) then 'Describe the ' || location || '.'
    when list_contains({d_list(vocab.LOCATE_ONLY)}, location) then '{word} the ' || location || '.' end"""


@query(
    "b10_location_prompts",
    f"""select location, {_d_prompt('Locate')} as prompt, {_d_prompt('Localize')} as localize_prompt, count(*) as n
        from (select {d_list(LOCATIONS)}[event_id % {len(LOCATIONS)} + 1] as location from events) a group by 1, 2, 3""",
)
def b10(d: Data):
    names = F.array(*[F.lit(c) for c in LOCATIONS])
    rows = d.table("events").select(F.element_at(names, (F.col("event_id") % len(LOCATIONS) + 1).cast("int")).alias("location"))
    return rows.groupBy(
        "location", text.agrg_prompt("location").alias("prompt"), text.agrg_prompt("location", "Localize").alias("localize_prompt")
    ).agg(F.count("*").alias("n"))


_D_BOX = "'[' || printf('%.2f', x1) || ',' || printf('%.2f', y1) || ',' || printf('%.2f', x2) || ',' || printf('%.2f', y2) || ']'"


@query(
    "b11_location_texts",
    f"""select box_id, 'Locate the ' || location || '.' as locate_prompt, 'Location of the ' || location || ': ' || {_D_BOX} as locate_target,
        'Description of the ' || location || ': seen ' || side as describe_target,
        'Location of the ' || location || ': ' || {_D_BOX} || '. Description: seen ' || side as both_target from v_boxes""",
)
def b11(d: Data):
    rows = d.view("v_boxes").withColumns({"box": F.array("x1", "y1", "x2", "y2"), "snippet": F.concat(F.lit("seen "), "side")})
    locate = text.agrg_text("locate", "location", "box")
    describe = text.agrg_text("describe", "location", None, "snippet")
    both = text.agrg_text("locate_and_describe", "location", "box", "snippet")
    return rows.select(
        "box_id", locate["prompt"].alias("locate_prompt"), locate["target"].alias("locate_target"),
        describe["target"].alias("describe_target"), both["target"].alias("both_target"),
    )


@query(
    "b12_messages",
    """select include_target, role, content_digits, count(*) as n, sum(length(content))::bigint as n_chars from (
         select true as include_target, 'user' as role, 'Locate and describe the ' || category || '.' as content, 0 as content_digits from v_grounded_text
         union all select true, 'assistant', gt_text, 1 from v_grounded_text
         union all select false, 'user', 'Locate and describe the ' || category || '.', 0 from v_grounded_text) a group by 1, 2, 3""",
)
def b12(d: Data):
    rows = d.view("v_grounded_text").select(text.agrg_prompt("category").alias("prompt"), F.col("gt_text").alias("target"))
    out = None
    for flag in (True, False):
        m = instances.to_messages(rows, flag).select(F.posexplode("messages").alias("turn", "m"))
        part = m.groupBy(F.lit(flag).alias("include_target"), F.col("m.role").alias("role"), F.col("turn").alias("content_digits")).agg(
            F.count("*").alias("n"), F.sum(F.length("m.content")).cast("bigint").alias("n_chars")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "b13_prompt_type",
    """select case when lower(prompt) like 'locate and describe%' then 'locate_and_describe' when lower(prompt) like 'describe%' then 'describe'
       when lower(prompt) like 'locate%' then 'locate' end as prompt_type, dataset, count(*) as n from v_eval group by 1, 2""",
)
def b13(d: Data):
    return d.view("v_eval").groupBy(text.prompt_type("prompt").alias("prompt_type"), "dataset").agg(F.count("*").alias("n"))


@query(
    "b14_clean_generation",
    f"""select pair_id, md5({d_strip("string_split(chat, 'model' || chr(10))[-1]")}) as chat,
        md5({d_strip("replace(replace(replace(tok, '[BOS]', ''), '[EOS]', ''), '[SEP]', ' ')")}) as blank,
        md5({d_strip("replace(replace(replace(tok, '[BOS]', ''), '[EOS]', ''), '[SEP]', chr(10) || chr(10))")}) as paragraph
        from (select pair_id, 'user' || chr(10) || ref || chr(10) || 'model' || chr(10) || ref || chr(10) || 'model' || chr(10) || ' ' || hyp || ' ' as chat,
              '[BOS] ' || ref || '[SEP]' || hyp || ' [EOS]' as tok from v_pairs) a""",
)
def b14(d: Data):
    ref, hyp, nl = F.col("ref"), F.col("hyp"), F.lit("\nmodel\n")
    chat = F.concat(F.lit("user\n"), ref, nl, ref, nl, F.lit(" "), hyp, F.lit(" "))
    tok = F.concat(F.lit("[BOS] "), ref, F.lit("[SEP]"), hyp, F.lit(" [EOS]"))
    return d.view("v_pairs").select(
        "pair_id", F.md5(text.clean_generation(chat)).alias("chat"),
        F.md5(text.clean_generation(tok, "sep_blank")).alias("blank"),
        F.md5(text.clean_generation(tok, "sep_paragraph")).alias("paragraph"),
    )


@query("b15_strip_tags", f"select page_id, md5(t) as digest, length(t) as n_chars from (select page_id, {d_strip('regexp_replace(html, ' + chr(39) + '<[^<>]+>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} as t from pages) a")
def b15(d: Data):
    rows = d.table("pages").select("page_id", text.strip_tags("html").alias("t"))
    return rows.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


def d_description(x, dialect):
    pattern = {"label": r"(?i)descri.*?:\s*(.*?)\s*$", "eval": r"Description.*?:(.*)"}[dialect]
    return f"case when regexp_matches({x}, '{pattern}') then {d_strip(f'regexp_extract({x}, {chr(39)}{pattern}{chr(39)}, 1)')} end"


@query(
    "b16_description",
    f"""select example_id, {d_description('gt_text', 'label')} as gt_label, {d_description('pred_text', 'label')} as pred_label,
        {d_description('gt_text', 'eval')} as gt_eval from v_grounded_text""",
)
def b16(d: Data):
    return d.view("v_grounded_text").select(
        "example_id", text.extract_description("gt_text").alias("gt_label"),
        text.extract_description("pred_text").alias("pred_label"), text.extract_description("gt_text", "eval").alias("gt_eval"),
    )


def d_eval_text(x):
    bare = d_squeeze(f"regexp_replace({x}, '{BOX}', '', 'g')")
    return f"replace(replace(replace(coalesce({d_description(bare, 'eval')}, {bare}), ': .', '.'), ' .', '.'), ':', '.')"


@query("b17_eval_text", f"select example_id, {d_eval_text('gt_text')} as clean_gt, {d_eval_text('pred_text')} as clean_pred from v_grounded_text")
def b17(d: Data):
    return d.view("v_grounded_text").select("example_id", text.clean_eval_text("gt_text").alias("clean_gt"), text.clean_eval_text("pred_text").alias("clean_pred"))


@query(
    "b18_remove_grounding",
    f"""select example_id, {d_squeeze(f"regexp_replace(gt_text, '{BOX}', '', 'g')")} as plain,
        {d_strip(f"regexp_replace('Nodule of ' || category || ' [(0.12,0.5),(1.0, 2.25 )] and ' || example_id, '{vocab.LEGACY_BOXES}', '', 'g')")} as legacy from v_grounded_text""",
)
def b18(d: Data):
    old = F.concat(F.lit("Nodule of "), "category", F.lit(" [(0.12,0.5),(1.0, 2.25 )] and "), "example_id")
    return d.view("v_grounded_text").select(
        "example_id", text.remove_grounding("gt_text").alias("plain"), text.remove_grounding(old, "legacy").alias("legacy")
    )


D_SENTENCES = "list_filter(string_split(regexp_replace(" + d_strip("{0}") + f", '([.!?]){vocab.WHITESPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def d_sentences(x):
    return D_SENTENCES.replace("{0}", x)


@query(
    "b19_join_sentences",
    f"""select doc_id, md5(array_to_string(list_transform(s, lambda x: case when right(x, 1) = '.' then x else x || '.' end), ' ')) as digest
        from (select doc_id, {d_sentences('text')} as s from documents) a""",
)
def b19(d: Data):
    return d.table("documents").select("doc_id", F.md5(text.join_sentences(text.sentences("text"))).alias("digest"))


@query(
    "b20_parse_facts",
    r"""select event_id, array_to_string(list_filter([event_type, case when user_id % 2 = 0 then 'k ' || props else event_type end], lambda x: true), '|') as facts_raw,
        case when user_id % 2 = 0 then event_type || '|user ' || user_id::varchar else event_type end as facts, case when user_id % 2 = 0 then 2 else 1 end as n from events""",
)
def b20(d: Data):
    other = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("user "), F.col("user_id").cast("string"))).otherwise(F.col("event_type"))
    closing = F.when(F.col("event_id") % 3 == 0, "").otherwise("] and so on")
    said = F.concat(F.lit('The facts: [ "'), "event_type", F.lit('" ,"'), other, F.lit('", "'), "event_type", F.lit('"'), closing)
    facts = text.parse_facts(said)
    second = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("k "), "props")).otherwise(F.col("event_type"))
    return d.table("events").select(
        "event_id", F.concat_ws("|", "event_type", second).alias("facts_raw"), F.array_join(facts, "|").alias("facts"), F.size(facts).alias("n")
    )


# One pass for each k: words equal to the one k places before, in islands of at least k, go.
_REPEATS = f"""with recursive w as (select doc_id, unnest(s) as w, unnest(range(len(s))) as i from (select doc_id, list_filter(string_split({d_squeeze('text')}, ' '), lambda x: x <> '') as s from documents) a),
  st as (
    select doc_id, i, w, lower(w) as l, 0 as k from w
    union all
    select doc_id, i, w, l, k + 1 from (select *, count(case when same then 1 end) over (partition by doc_id, island) as run from (
      select *, sum(case when same then 0 else 1 end) over (partition by doc_id order by i) as island from (
        select doc_id, i, w, l, k, coalesce(l = lag(l, k + 1) over (partition by doc_id order by i), false) as same from st where k < 8) a) b) c
    where not same or run <= k),
  t as (select doc_id, string_agg(w, ' ' order by i) as t from st where k = 8 group by 1)
  select doc_id, length(text) as before, length(coalesce(t, '')) as after, md5(coalesce(t, '')) as digest from documents left join t using (doc_id)"""


@query("b21_drop_repeats", _REPEATS)
def b21(d: Data):
    rows = d.table("documents").select("doc_id", F.length("text").alias("before"), text.drop_repeats("text").alias("t"))
    return rows.select("doc_id", F.col("before").cast("bigint").alias("before"), F.length("t").cast("bigint").alias("after"), F.md5("t").alias("digest"))


@query(
    "b22_sentences",
    f"select doc_id, len(s) as n, md5(array_to_string(s, '|')) as digest from (select doc_id, {d_sentences('text')} as s from documents) a",
)
def b22(d: Data):
    rows = d.table("documents").select("doc_id", text.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


_CUR = "string_split(a, chr(2))[-1]"


@query(
    "b23_chunk_text",
    f"""select doc_id, len(string_split(c, chr(2))) as n, md5(replace(c, chr(2), '|')) as digest from (select doc_id, list_reduce({d_sentences('text')},
        lambda a, s: case when length({_CUR}) + length(s) > 200 then a || chr(2) || s
                          when right(a, 1) = '.' then a || ' ' || s else a || '. ' || s end) as c from documents) x""",
)
def b23(d: Data):
    rows = d.table("documents").select("doc_id", text.chunk_text("text", 200).alias("c"))
    return rows.select("doc_id", F.size("c").cast("bigint").alias("n"), F.md5(F.array_join("c", "|")).alias("digest"))


@query("b24_text_key", "select doc_id, length(text)::varchar || '_' || sha256(text) as key from documents")
def b24(d: Data):
    return d.table("documents").select("doc_id", text.text_key("text").alias("key"))


@query(
    "b25_default_locations",
    f"""with named as (select distinct dicom_id, location from (select dicom_id, location from v_loc_boxes union all select dicom_id, location from v_loc_snippets
          union all select doc_id::varchar, unnest({d_list(vocab.DEFAULT_LOCATIONS)}) from documents) a)
        select location, count(*) as n_with_unknown, sum(case when location <> 'unknown' then 1 else 0 end)::bigint as n_without from named group by 1""",
)
def b25(d: Data):
    names = F.array_union(F.map_keys("location2bbox"), F.map_keys("location2report_snippet"))
    docs = d.location_docs()
    kept = docs.select("dicom_id", F.explode(text.with_default_locations(names, drop_unknown=False)).alias("location"))
    dropped = docs.select("dicom_id", F.explode(text.with_default_locations(names)).alias("location"))
    a = kept.groupBy("location").agg(F.count("*").alias("n_with_unknown"))
    b = dropped.groupBy("location").agg(F.count("*").alias("n_without"))
    return a.join(b, "location", "left").na.fill(0, ["n_without"])


@query(
    "b26_grounded_list_text",
    """select event_id, case when event_id % 5 = 0 then null when event_id % 5 = 1 then 'see ' || event_type || '.' else event_type || '. more.' end as report,
       case when event_id % 5 = 0 then 0 when event_id % 5 = 1 then 1 else 0 end as skipped from events""",
)
def b26(d: Data):
    said = (
        F.when(F.col("event_id") % 5 == 0, "not a list")
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('[[ "see '), "event_type", F.lit('", [[0.1,0.2,0.3,0.4]]], [7, null]]')))
        .otherwise(F.concat(F.lit('[["'), "event_type", F.lit(' ", null], ["more.", [[0,0,1,1]]], ["  ", null]]')))
    )
    t = text.grounded_list_text(said)
    return d.table("events").select("event_id", t["text"].alias("report"), t["skipped"].alias("skipped"))


@query(
    "l4_sql_functions",
    f"""select box_id, {_D_BOX} as formatted, round(x1 + x2 + 1e-9, 6) as side_sum from v_boxes""",
)
def l4(d: Data):
    sqlfn.register_sql(d.spark)
    rows = d.view("v_boxes").withColumn("b", F.array("x1", "y1", "x2", "y2"))
    rows = rows.selectExpr("box_id", "rg_format_box(b) as formatted", "rg_cxcywh_to_xyxy(rg_xyxy_to_cxcywh(b)) as back")
    return rows.select("box_id", "formatted", F.round(F.col("back")[0] + F.col("back")[2] + 1e-9, 6).alias("side_sum"))
