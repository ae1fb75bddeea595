"""Labelling jobs as tables: queries, requests, rate plan, reply parsing and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..functions.hashing import hash_bucket, hash_order
from . import joins
from .skew import group_rank

# Reply schemas by name: field -> allowed values (None: non-blank text, "text": any text).
REPLY_SCHEMAS: dict[str, dict] = dict(vocab.REPLY_SCHEMAS)


def register_reply_schema(name: str, fields: dict) -> None:
    REPLY_SCHEMAS[name] = fields


# -- queries -------------------------------------------------------------------------------

def location_queries(docs: DataFrame) -> DataFrame:
    """One query per report and location: snippet and default locations, not 'unknown'."""
    # Reports are squeezed once, before they are repeated for their locations.
    names = text.with_default_locations(F.map_keys("location2report_snippet"))
    rows = docs.where(F.col("original_report").rlike("[^" + vocab.WHITESPACE[1:]))
    rows = rows.select("dicom_id", text.squeeze_ws("original_report").alias("report"), names.alias("names"))
    rows = rows.select("dicom_id", "report", F.explode("names").alias("location"))
    return rows.select("dicom_id", joins.mini_report_query("report", "location", clean=False).alias("query"))


def build_queries(df: DataFrame, mode: str) -> DataFrame:
    """Add ``query`` and, where there is none, the ``reason``.

    sentence_list: grounded_report (JSON list). mini_report: mini_report.
    description: gt_report and prediction. tagged: gt_report and raw_prediction.
    """
    if mode == "sentence_list":
        df = df.withColumn("__said", text.grounded_list_text("grounded_report")["text"])
        query = F.col("__said")
        reason = F.when(F.from_json("grounded_report", "array<string>").isNull(), "malformed list").when(
            query.isNull(), "no sentences"
        )
    elif mode == "mini_report":
        query = F.col("mini_report")
        reason = F.when(query.isNull(), "missing").when(query == "N/A", "not available")
    elif mode in ("description", "tagged"):
        said = F.col("__said")
        if mode == "description":
            df = df.withColumn("__said", text.extract_description("prediction"))
            named = F.coalesce(F.lower("prediction").contains("description"), F.lit(False))
            absent = F.when(~named, "no description").when(said.isNull(), "malformed description")
        else:
            df = df.withColumn("__said", text.strip_tags("raw_prediction"))
            absent = F.when(said.isNull(), "no prediction")
        query = F.concat(F.lit("[GT]: "), "gt_report", F.lit("\n\n[GEN]: "), said)
        reason = F.when(F.coalesce(F.col("gt_report"), F.lit("")) == "", "no report").otherwise(absent)
    else:
        raise ValueError(f"unknown mode: {mode}")
    df = df.withColumn("reason", reason)
    return df.withColumn("query", F.when(F.col("reason").isNull(), query)).drop("__said")


def pending_queries(queries: DataFrame, done: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct queries that have no answer yet; the first ``cap`` by key if given.

    Texts are matched by digest, so that long texts are neither sort nor join keys.
    """
    keyed = queries.where(F.col("query").isNotNull()).select(text.text_key("query").alias("key"), "query")
    distinct = keyed.groupBy("key").agg(F.first("query").alias("query"))
    left = distinct.join(done.select(text.text_key("query").alias("key")).distinct(), "key", "left_anti")
    return left.orderBy("key").limit(cap) if cap else left


# -- requests --------------------------------------------------------------------------------

def check_model(provider: str, model: str) -> None:
    if provider not in vocab.PROVIDER_MODELS:
        raise ValueError(f"unknown provider: {provider}")
    if model not in vocab.PROVIDER_MODELS[provider]:
        raise ValueError(f"model {model} is not available from {provider}")


def to_requests(df: DataFrame, provider: str, model: str, system: str, max_tokens: int, temperature: float = 0.0, frequency_penalty: float = 0.0, presence_penalty: float = 0.0, batch: bool = False) -> DataFrame:
    """One JSON request per query; penalties only where the provider knows them.

    The batch form wraps the request with ``custom_id`` (the query's key).
    """
    check_model(provider, model)
    if not system:
        raise ValueError("system instructions are empty")

    def turn(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    fields = [
        F.lit(model).alias("model"),
        F.array(turn("system", F.lit(system)), turn("user", F.col("query"))).alias("messages"),
    ]
    if not batch:
        fields.append(F.struct("query").alias("metadata"))
    fields.append(F.lit(float(temperature)).alias("temperature"))
    if provider == "openai":
        fields.append(F.lit(float(frequency_penalty)).alias("frequency_penalty"))
        fields.append(F.lit(float(presence_penalty)).alias("presence_penalty"))
    if max_tokens is not None:
        fields.append(F.lit(max_tokens).alias("max_tokens"))
    body = F.struct(*fields)
    key = text.text_key("query")
    if batch:
        if provider != "openai":
            raise ValueError("the batch form belongs to one provider only")
        body = F.struct(
            key.alias("custom_id"), F.lit("POST").alias("method"),
            F.lit("/v1/chat/completions").alias("url"), body.alias("body"),
        )
    rows = df.where(F.col("query") != "")
    return rows.select(key.alias("key"), F.to_json(body).alias("request"))


MESSAGE = "struct<role: string, content: string, name: string>"


def _estimate(c: Column) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0)).otherwise(F.ceil(F.length(c) / 4)).cast("bigint")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def estimate_tokens(df: DataFrame, request: str = "request", count: Column | None = None) -> DataFrame:
    """Add ``endpoint`` and ``tokens`` of JSON requests.

    A text costs ceil(characters / 4); every role, name and content counts. Completions
    add n * max_tokens per prompt (defaults 1 and 15). ``prompt`` and ``input`` may be
    a text or a list of texts.
    """
    c = F.col(request)
    messages = F.from_json(F.get_json_object(c, "$.messages"), f"array<{MESSAGE}>")

    def texts(path):
        raw = F.get_json_object(c, path)
        return F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))

    def number(path, default):
        return F.coalesce(F.get_json_object(c, path).try_cast("bigint"), F.lit(default).cast("bigint"))

    prompt, given = texts("$.prompt"), texts("$.input")
    completion = number("$.n", 1) * number("$.max_tokens", 15)
    chat = _sum(F.transform(messages, lambda m: _estimate(m["role"]) + _estimate(m["content"]) + _estimate(m["name"])))
    endpoint = F.when(messages.isNotNull(), "chat/completions").when(prompt.isNotNull(), "completions").when(
        given.isNotNull(), "embeddings"
    )
    tokens = (
        F.when(messages.isNotNull(), chat + completion)
        .when(prompt.isNotNull(), _sum(F.transform(prompt, _estimate)) + completion * F.size(prompt))
        .otherwise(_sum(F.transform(given, _estimate)))
    )
    return df.withColumns({"endpoint": endpoint, "tokens": tokens})


def rate_plan(requests: DataFrame, key: str, tokens: str, per_minute: int, tokens_per_minute: int, seed="plan") -> DataFrame:
    """Add ``minute``, so that no minute exceeds either cap, and a ``reason`` where there is none.

    A request of which m fit into a minute under both caps belongs to the class of the
    largest power of two up to m, and that many of its class share a minute. Classes follow
    each other from the largest requests on, each in hash order of the keys; at most twice
    the minutes needed are used. A request above the token cap gets no minute.
    """
    cost = F.greatest(F.coalesce(F.col(tokens), F.lit(0)).cast("bigint"), F.lit(1))
    fits = F.least(F.lit(per_minute).cast("bigint"), F.floor(F.lit(tokens_per_minute) / cost).cast("bigint"))
    rows = requests.withColumns({"__class": F.when(fits > 0, F.length(F.bin(fits)) - 1), "__h": hash_order(seed, key)})
    # At most 63 classes.
    sizes = rows.where(F.col("__class").isNotNull()).groupBy("__class").agg(F.count("*").alias("__n"))
    minutes = F.ceil(F.col("__n") / F.pow(F.lit(2), F.col("__class"))).cast("bigint")
    before = Window.orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("__class", F.coalesce(F.sum(minutes).over(before), F.lit(0)).alias("__first"))
    rows = group_rank(rows, ["__class"], ["__h", key], hash_bucket(F.col("__h")), "__rank")
    rows = rows.join(F.broadcast(first), "__class", "left")
    minute = F.col("__first") + F.floor((F.col("__rank") - 1) / F.pow(F.lit(2), F.col("__class"))).cast("bigint")
    reason = F.when(F.col("__class").isNull(), "more tokens than a minute allows")
    return rows.withColumns({"minute": minute.cast("bigint"), "reason": reason}).drop("__class", "__h", "__rank", "__first")


# -- replies ---------------------------------------------------------------------------------

def validate_reply(df: DataFrame, schema: str, reply: str = "reply") -> DataFrame:
    """Add ``parsed`` (struct of trimmed fields) or the first ``reason`` why there is none."""
    fields = REPLY_SCHEMAS[schema]
    names = list(fields)
    raw = text.extract_json(reply)
    row = F.from_json(raw, ", ".join(f"`{n}` string" for n in names))
    keys = F.json_object_keys(raw)
    reason = F.when(raw.isNull(), "no JSON object").when(keys.isNull() | row.isNull(), "malformed JSON")
    for n in names:
        reason = reason.when(~F.array_contains(keys, n), f"missing {n}")
    for n, allowed in fields.items():
        if isinstance(allowed, list):
            reason = reason.when(~F.coalesce(row[n].isin(allowed), F.lit(False)), f"invalid {n}")
    for n, allowed in fields.items():
        if allowed is None or allowed == "text":
            quoted = F.coalesce(F.get_json_object(raw, f"$['{n}']"), F.lit("")) == F.coalesce(row[n], F.lit(""))
            reason = reason.when(row[n].isNull() | ~quoted, f"invalid {n}")
        if allowed is None:
            reason = reason.when(text.strip(row[n]) == "", f"blank {n}")
    parsed = F.struct(*[(row[n] if isinstance(a, list) else text.strip(row[n])).alias(n) for n, a in fields.items()])
    df = df.withColumn("reason", reason)
    return df.withColumn("parsed", F.when(F.col("reason").isNull(), parsed))


def ingest_responses(responses: DataFrame, schema: str) -> DataFrame:
    """Parsed replies of (request, response, metadata, errors) rows, with reasons for the rest."""
    content = F.try_element_at("response.choices", F.lit(1))["message"]["content"]
    failed = F.col("response").isNull() | (F.coalesce(F.size("errors"), F.lit(0)) > 0)
    rows = responses.withColumns({"reply": content, "failed": failed})
    rows = validate_reply(rows, schema)
    reason = F.when(F.col("failed"), "request failed").when(F.col("reply").isNull(), "no content").otherwise(F.col("reason"))
    return rows.select(
        "metadata.query", F.when(reason.isNull(), F.col("parsed")).alias("parsed_response"), reason.alias("reason")
    )


def ingest_batch(outputs: DataFrame, inputs: DataFrame, schema: str) -> DataFrame:
    """Parsed replies of batch outputs, their query recovered from the batch input."""
    queries = inputs.select("custom_id", F.try_element_at("body.messages", F.lit(2))["content"].alias("query"))
    rows = outputs.join(queries, "custom_id").select(
        "custom_id", "query", F.try_element_at("response.body.choices", F.lit(1))["message"]["content"].alias("reply")
    )
    rows = validate_reply(rows, schema)
    reason = F.when(F.col("reply").isNull(), "no content").otherwise(F.col("reason"))
    return rows.select("custom_id", "query", F.col("parsed").alias("parsed_response"), reason.alias("reason"))


def retry_set(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """State per request from its attempts (key, attempt, error or null).

    Gives (key, attempts, status): done, retry or exhausted; errors stay in the
    attempts table and are listed by ``exhausted_errors``.
    """
    state = attempts.groupBy("key").agg(
        F.count("*").alias("attempts"), F.max(F.col("error").isNull()).alias("ok")
    )
    status = F.when(F.col("ok"), "done").when(F.col("attempts") < max_attempts, "retry").otherwise("exhausted")
    return state.select("key", "attempts", status.alias("status"))


def exhausted_errors(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """(key, errors in order of the attempts) of requests that used all attempts without success."""
    failed = retry_set(attempts, max_attempts).where(F.col("status") == "exhausted").select("key")
    rows = attempts.join(failed, "key", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("attempt", "error")))
    return rows.groupBy("key").agg(F.transform(listed, lambda x: x["error"]).alias("errors"))


def errors_of_replies(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and failed rows of an ingest."""
    return df.where(F.col("reason").isNull()).drop("reason"), df.where(F.col("reason").isNotNull())
