"""Queries of the labelling jobs."""

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import labelling
from .registry import d_list, d_squeeze, d_strip, query
from .text_queries import d_description
from .views import Data

_LOCQ = "'Report: \"' || " + d_squeeze("text") + " || '\" | Location: \"' || location || '\"'"


@query(
    "j1_location_queries",
    f"""select dicom_id, md5({_LOCQ}) as digest from documents join (select dicom_id, location from v_loc_snippets union select doc_id::varchar, unnest({d_list(vocab.DEFAULT_LOCATIONS)}) from documents) l
        on doc_id::varchar = dicom_id where location <> 'unknown' and {d_squeeze('text')} <> ''""",
)
def j1(d: Data):
    return labelling.location_queries(d.location_docs()).select("dicom_id", F.md5("query").alias("digest"))


_GT = "case when category = 'spine' and dataset = 'ds1' then null else gt_text end"
_PRED = "case when dataset = 'ds2' then replace(pred_text, 'Description', 'Text') when dataset = 'ds3' then 'description' else pred_text end"
_TAG = "'<b>' || pred_text || '</b> '"


@query(
    "j1_comparison_queries",
    f"""with a as (select example_id, {_GT} as gt, {_PRED} as p, {_TAG} as t from v_grounded_text),
        b as (select *, case when coalesce(gt, '') = '' then 'no report' when lower(p) not like '%description%' then 'no description' when {d_description('p', 'label')} is null then 'malformed description' end as reason from a)
        select example_id, reason, case when reason is null then '[GT]: ' || gt || chr(10) || chr(10) || '[GEN]: ' || {d_description('p', 'label')} end as described,
        case when coalesce(gt, '') <> '' then '[GT]: ' || gt || chr(10) || chr(10) || '[GEN]: ' || {d_strip("regexp_replace(t, '<[^<>]+>', '', 'g')")} end as tagged from b""",
)
def j1_comparisons(d: Data):
    rows = d.view("v_grounded_text").selectExpr(
        "example_id", f"{_GT} as gt_report", f"{_PRED} as prediction", f"{_TAG} as raw_prediction"
    )
    one = labelling.build_queries(rows, "description").select("example_id", "raw_prediction", "gt_report", "reason", F.col("query").alias("described"))
    two = labelling.build_queries(one.withColumnRenamed("reason", "why"), "tagged")
    return two.select("example_id", F.col("why").alias("reason"), "described", F.col("query").alias("tagged"))


@query(
    "j1_sentence_queries",
    """select event_id, case when event_id % 4 = 0 then 'malformed list' when event_id % 4 = 1 then 'no sentences' end as reason, case when event_id % 4 > 1 then event_type || '. ok.' end as query,
       case when user_id % 3 = 0 then 'not available' when user_id % 3 = 1 then 'missing' end as mini_reason from events""",
)
def j1_sentences(d: Data):
    said = (
        F.when(F.col("event_id") % 4 == 0, '{"a": 1}')
        .when(F.col("event_id") % 4 == 1, "[[3, []]]")
        .otherwise(F.concat(F.lit('[["'), "event_type", F.lit('", null], ["ok.", [[0,0,1,1]]]]')))
    )
    mini = F.when(F.col("user_id") % 3 == 0, "N/A").when(F.col("user_id") % 3 == 2, "clear")
    rows = d.table("events").select("event_id", said.alias("grounded_report"), mini.alias("mini_report"))
    one = labelling.build_queries(rows, "sentence_list").select("event_id", "mini_report", F.col("reason").alias("r"), F.col("query").alias("q"))
    two = labelling.build_queries(one, "mini_report")
    return two.select("event_id", F.col("r").alias("reason"), F.col("q").alias("query"), F.col("reason").alias("mini_reason"))


@query(
    "j2_pending_queries",
    """with p as (select distinct length(query)::varchar || '_' || sha256(query) as key, query from v_replies where query not in (select query from v_replies where event_type = 'signup' and error is not null))
       select 'all' as kind, key, query from p union all (select 'capped', key, query from p order by key limit 20)""",
)
def j2(d: Data):
    r = d.view("v_replies")
    done = r.where("event_type = 'signup' and error is not null")
    every = labelling.pending_queries(r, done).select(F.lit("all").alias("kind"), "key", "query")
    return every.unionByName(labelling.pending_queries(r, done, 20).select(F.lit("capped").alias("kind"), "key", "query"))


SYSTEM = 'Answer with "yes" or "no".'
_KEY = "length(query)::varchar || '_' || sha256(query)"
_MSG = "[{'role': 'system', 'content': 'Answer with \"yes\" or \"no\".'}, {'role': 'user', 'content': query}]"


@query(
    "j3_requests",
    f"""with q as (select distinct query from v_replies)
        select 'openai' as provider, {_KEY} as key, to_json({{'model': 'gpt-4o-mini', 'messages': {_MSG}, 'metadata': {{'query': query}}, 'temperature': 0.5::double, 'frequency_penalty': 0::double, 'presence_penalty': 0::double, 'max_tokens': 100}})::varchar as request from q
        union all select 'gemini', {_KEY}, to_json({{'model': 'gemini-2.0-flash', 'messages': {_MSG}, 'metadata': {{'query': query}}, 'temperature': 0::double, 'max_tokens': 100}})::varchar from q
        union all select 'batch', {_KEY}, to_json({{'custom_id': {_KEY}, 'method': 'POST', 'url': '/v1/chat/completions', 'body': {{'model': 'gpt-4o', 'messages': {_MSG}, 'temperature': 0::double, 'frequency_penalty': 0::double, 'presence_penalty': 0::double, 'max_tokens': 100}}}})::varchar from q""",
)
def j3(d: Data):
    q = d.view("v_replies").select("query").distinct()
    a = labelling.to_requests(q, "openai", "gpt-4o-mini", SYSTEM, 100, 0.5)
    b = labelling.to_requests(q, "gemini", "gemini-2.0-flash", SYSTEM, 100)
    c = labelling.to_requests(q, "openai", "gpt-4o", SYSTEM, 100, batch=True)
    out = None
    for name, rows in (("openai", a), ("gemini", b), ("batch", c)):
        rows = rows.select(F.lit(name).alias("provider"), "key", "request")
        out = rows if out is None else out.unionByName(rows)
    return out


def requests(d: Data):
    """Chat, completion and embedding requests over the documents' whole texts."""
    docs = d.table("documents")
    chat = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"), F.lit(7).alias("max_tokens"), F.lit(2).alias("n")))
    plain = F.to_json(F.struct(F.array("text", F.lit("ab")).alias("prompt")))
    one = F.to_json(F.struct(F.col("text").alias("input")))
    kind = F.col("doc_id") % 3
    return docs.select("doc_id", F.when(kind == 0, chat).when(kind == 1, plain).otherwise(one).alias("request"))


_EST = "(case when length(text) = 0 then 0 else ceil(length(text) / 4) end)::bigint"
_TOKENS = f"(select doc_id, case doc_id % 3 when 0 then 'chat/completions' when 1 then 'completions' else 'embeddings' end as endpoint, case doc_id % 3 when 0 then 1 + {_EST} + 14 when 1 then {_EST} + 1 + 30 else {_EST} end as tokens from documents)"


@query("j4_estimate_tokens", f"select doc_id, endpoint, tokens::bigint as tokens from {_TOKENS} t")
def j4(d: Data):
    return labelling.estimate_tokens(requests(d)).select("doc_id", "endpoint", "tokens")


@query(
    "j5_rate_plan",
    f"""with c as (select doc_id, tokens, case when m > 0 then length(bin(m)) - 1 end as k from (select doc_id, tokens::bigint as tokens, least(50, 20000 // greatest(tokens::bigint, 1))::bigint as m from {_TOKENS} t) t),
        r as (select doc_id, tokens, k, row_number() over (partition by k order by md5('plan|' || doc_id::varchar), doc_id) as rn from c),
        s as (select k, sum(minutes) over (order by k) - minutes as start from (select k, ceil(count(*) / (2 ** k))::bigint as minutes from c where k is not null group by k) q)
        select doc_id, tokens, (start + floor((rn - 1) / (2 ** r.k)))::bigint as minute, case when r.k is null then 'more tokens than a minute allows' end as reason from r left join s on r.k = s.k""",
)
def j5(d: Data):
    rows = labelling.estimate_tokens(requests(d)).select("doc_id", "tokens")
    return labelling.rate_plan(rows, "doc_id", "tokens", 50, 20000)


_PARSED = r"""(select *, regexp_extract(reply, '(?s)\{.*\}', 0) as js from v_replies)"""
_REASON = """case when js = '' or request_id % 10 = 4 then 'no JSON object' when request_id % 10 = 3 then 'missing mentions_devices' when request_id % 10 = 2 then 'invalid mentions_abnormalities'
  when request_id % 10 = 1 then 'blank reason' end"""


@query("j6_extract_json", "select request_id, nullif(js, '') as json from " + _PARSED + " p")
def j6(d: Data):
    from ..functions.text import extract_json

    return d.view("v_replies").select("request_id", extract_json("reply").alias("json"))


_OK = "json_extract_string(js, '$.{0}')"


@query(
    "j7_validate_reply",
    f"""select request_id, {_REASON} as reason, case when {_REASON} is null then trim({_OK.replace('{0}', 'reason')}) end as why,
        case when {_REASON} is null then {_OK.replace('{0}', 'mentions_abnormalities')} end as abnormalities, case when {_REASON} is null then {_OK.replace('{0}', 'mentions_devices')} end as devices
        from (select request_id, case when json_valid(js) then js else '' end as js from {_PARSED} p) a""",
)
def j7(d: Data):
    out = labelling.validate_reply(d.view("v_replies"), "abnormality_device_flags")
    return out.select(
        "request_id", "reason", F.col("parsed.reason").alias("why"), F.col("parsed.mentions_abnormalities").alias("abnormalities"),
        F.col("parsed.mentions_devices").alias("devices"),
    )


def responses(d: Data):
    r = d.view("v_replies")
    message = F.struct(F.struct(F.col("reply").alias("content")).alias("message"))
    choices = F.struct(F.array(message).alias("choices"))
    errors = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>"))
    return r.select(
        "request_id", F.lit("{}").alias("request"), F.when(F.col("user_id") % 11 != 0, choices).alias("response"),
        F.struct("query").alias("metadata"), errors.alias("errors"),
    )


@query(
    "j8_ingest_responses",
    f"""select query, case when user_id % 11 = 0 or error is not null then 'request failed' else {_REASON} end as reason, count(*) as n from (select *, case when json_valid(j) then j else '' end as js from
        (select *, js as j from {_PARSED} p) b) a group by 1, 2""".replace("select *, case when json_valid(j)", "select request_id, query, user_id, error, case when json_valid(j)"),
)
def j8(d: Data):
    out = labelling.ingest_responses(responses(d), "abnormality_device_flags")
    return out.groupBy("query", "reason").agg(F.count("*").alias("n"))


@query(
    "j9_ingest_batch",
    f"select request_id::varchar as custom_id, query, {_REASON} as reason, case when {_REASON} is null then {_OK.replace('{0}', 'mentions_devices')} end as devices from (select request_id, query, case when json_valid(js) then js else '' end as js from {_PARSED} p) a",
)
def j9(d: Data):
    r = d.view("v_replies").withColumn("custom_id", F.col("request_id").cast("string"))
    message = F.struct(F.struct(F.col("reply").alias("content")).alias("message"))
    outputs = r.select("custom_id", F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response"))

    def turn(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    inputs = r.select("custom_id", F.struct(F.array(turn("system", F.lit(SYSTEM)), turn("user", F.col("query"))).alias("messages")).alias("body"))
    out = labelling.ingest_batch(outputs, inputs, "abnormality_device_flags")
    return out.select("custom_id", "query", "reason", F.col("parsed_response.mentions_devices").alias("devices"))


_ATT = "(select event_id // 3 as key, event_id % 3 + 1 as attempt, case when event_id % 5 < 3 or user_id % 2 = 0 then 'err ' || event_type end as error from events)"


@query(
    "j11_retry_set",
    f"""select key, count(*) as attempts, case when count(*) filter (error is null) > 0 then 'done' when count(*) < 3 then 'retry' else 'exhausted' end as status,
        case when count(*) filter (error is null) = 0 and count(*) >= 3 then string_agg(error, '|' order by attempt) end as errors from {_ATT} a group by 1""",
)
def j11(d: Data):
    e = d.table("events")
    rows = e.select(
        F.floor(F.col("event_id") / 3).alias("key"), (F.col("event_id") % 3 + 1).alias("attempt"),
        F.when((F.col("event_id") % 5 < 3) | (F.col("user_id") % 2 == 0), F.concat(F.lit("err "), "event_type")).alias("error"),
    )
    errors = labelling.exhausted_errors(rows, 3).select("key", F.array_join("errors", "|").alias("errors"))
    return labelling.retry_set(rows, 3).join(errors, "key", "left")


@query(
    "l2_reply_schema",
    """select case when event_type in ('view', 'click') then null else 'invalid kind' end as reason, event_type as kind, count(*) as n from events group by 1, 2""",
)
def l2(d: Data):
    labelling.register_reply_schema("event_kind", {"kind": ["view", "click"], "note": "text"})
    reply = F.concat(F.lit('Here: {"kind": "'), "event_type", F.lit('", "note": ""}'))
    out = labelling.validate_reply(d.table("events").select("event_type", reply.alias("reply")), "event_kind")
    return out.groupBy("reason", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
