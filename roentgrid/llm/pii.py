"""Personal data: fixed forms, and further identifiers found by bootstrapped contexts.

Emails, IP addresses, card and phone numbers of fixed form are the seeds. Every chunk of
text that looks like an identifier, seed or not, links its value with the lexical patterns
around it (the words to its left and right). Over this graph of patterns and instances,
rounds of scoring alternate: a pattern is as sure of a kind as the share of its distinct
instances of known kind that are of that kind, and an instance is as sure as the patterns
that hold it. Only sure patterns promote instances, promoted instances count in the next
round, and rounds go on until one promotes nothing new.

DataFrame functions only. A pattern is judged by all identifiers of known kind around which
it stands, so words that stand before identifiers of all kinds stay unsure; values of no
known kind speak neither for nor against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .common import keyed, row_key, whole_text

KINDS = ["email", "ip", "card", "phone"]
# The forms of the four kinds. A run of characters is tried from its start only, or from the
# end of the last match, and never given back: other starts in it fail alike.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheaper tests that hold wherever a form can match.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Chunks that may be identifiers: with an @, of digit groups, or words with digits.
CHUNK = (
    r"(?<![^\s@])[^\s@]++@[^\s@]++|(?<![A-Za-z0-9_+(])\+?\(?[0-9](?:[\x20./()-]{0,2}[0-9])++(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]++"
)
CONTEXT = 48
# A sure pattern holds this weight of distinct instances of its kind, and this share of all its known instances.
SUPPORT, SURE = 4, 0.8
# Instances of other kinds that every pattern is taken to hold besides: few instances give little confidence.
DOUBT = 2
# Digits that a promoted number has at least.
DIGITS = 6
BLOCK = 64


def located(text: Column, form: str) -> Column:
    """Matches of a form in order: array of (start, end, value, before, after) in code points, end exclusive.

    ``before`` and ``after`` are the ends of the texts between matches next to it. Offsets
    are running sums of lengths, taken in blocks so that the work stays near linear.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("values"), F.split(text, form, -1).alias("gaps"))

    def parts(m):
        return F.transform(
            m["values"],
            lambda v, i: F.struct(
                F.length(m["gaps"][i]).alias("gap"), F.length(v).alias("size"), v.alias("value"),
                F.right(m["gaps"][i], F.lit(CONTEXT)).alias("before"), F.left(m["gaps"][i + 1], F.lit(CONTEXT)).alias("after"),
            ),
        )

    none = F.array().cast(SPANS)
    return once(found, lambda m: F.when(F.size(m["values"]) > 0, once(parts(m), _running)).otherwise(none))


SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often a lambda inside refers to it."""
    return F.transform(F.array(value), use)[0]


def _running(parts: Column) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(BLOCK)), lambda at: F.slice(parts, at + 1, F.lit(BLOCK)))

    def place(state, x):
        start = state["at"] + x["gap"]
        end = start + x["size"]
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def block(state, xs):
        inner = F.aggregate(xs, F.struct(state["at"].alias("at"), F.array().cast(SPANS).alias("out")), place)
        return once(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.flatten(F.aggregate(blocks, start, block, lambda s: s["out"]))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def part(d, i):
        n = d.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), part)
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check beyond its form that a value of a kind has to pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def seed_kind(value: Column) -> Column:
    """Kind of a chunk that is, as a whole, of a fixed form; null if it is none."""
    whole = {"email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++[.,;:!?)]?$", "ip": r"^[0-9]++(?:\.[0-9]++){3}$",
             "card": r"^[0-9](?:[\x20-]?[0-9])++$", "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$"}
    tests = [F.when(value.rlike(whole[k]) & passes(k, value), k) for k in KINDS]
    return F.coalesce(*tests)


NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _of_kind(kind: str, found: Column) -> Column:
    """Those of the located matches that pass the kind's check, as spans."""
    held = F.filter(found, lambda s: passes(kind, s["value"]))
    return F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def fixed_spans(text: Column) -> Column:
    """Spans of the four forms, sorted by start and kind: array of (start, rank, end, kind)."""
    none = F.array().cast(NO_SPANS)
    return F.array_sort(F.concat(*[F.when(HINTS[k](text), _of_kind(k, located(text, FORMS[k]))).otherwise(none) for k in KINDS]))


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns around a chunk; those with a missing word are left out."""
    left = F.regexp_extract_all(F.lower(before), F.lit(r"[\p{L}:=#]+"), F.lit(0))
    right = F.regexp_extract_all(F.lower(after), F.lit(r"[\p{L}]+"), F.lit(0))
    l1, l2 = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
    r1, r2 = F.try_element_at(right, F.lit(1)), F.try_element_at(right, F.lit(2))
    slot = F.lit(" _ ")
    return F.array_compact(F.array(F.concat(l2, F.lit(" "), l1, slot), F.concat(l1, slot, r1), F.concat(slot, r1, F.lit(" "), r2)))


def candidates(docs: DataFrame) -> DataFrame:
    """Stored, one row per document: (doc_id, h, spans of fixed form, chunks with value, kind of seed and patterns)."""
    text = F.col("__text")
    rows = docs.select("doc_id", row_key()["h"].alias("h"), whole_text().alias("__text"))
    spans = F.when(text.rlike("[@0-9]"), fixed_spans(text)).otherwise(F.array().cast(NO_SPANS))
    chunks = F.when(text.rlike("[@0-9]"), located(text, CHUNK)).otherwise(F.array().cast(SPANS))
    # Only what may be a seed or be promoted.
    kept = F.filter("__chunks", lambda c: c["value"].contains("@") | (F.length(F.regexp_replace(c["value"], "[^0-9]", "")) >= DIGITS))
    shown = F.transform(
        kept,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), F.lower(c["value"]).alias("value"),
            seed_kind(c["value"]).alias("kind"), _patterns(c["before"], c["after"]).alias("patterns"),
        ),
    )
    rows = rows.withColumns({"spans": spans, "__chunks": chunks})
    return stored(rows.select("doc_id", "h", "spans", shown.alias("chunks")), "candidates")


def _sums(weight: Column) -> list[Column]:
    return [F.sum(F.when(F.col("kind") == k, weight).otherwise(0.0)).alias(k) for k in KINDS]


def _best() -> Column:
    """Struct (w, kind) of the kind with the largest sum; ties go to the kind listed first."""
    return F.greatest(*[F.struct(F.col(k).alias("w"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])


def bootstrap(found: DataFrame, support: float = SUPPORT, sure: float = SURE) -> DataFrame:
    """(value, kind, score): instances that sure patterns promote. Stored after every round.

    What is promoted stays so, with the kind and score of its round; the last round finds nothing new.
    """
    chunks = found.select(F.explode("chunks").alias("c")).select("c.*")
    edges = chunks.select(F.explode("patterns").alias("pattern"), "value", F.col("kind").alias("seed")).distinct()
    edges = stored(edges, "edges")
    unseen = edges.where(F.col("seed").isNull()).select("pattern", "value")
    seeds = edges.where(F.col("seed").isNotNull()).select("pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("w"))
    promoted = None
    while True:
        # Links are distinct, so a copied text counts once.
        known, fresh = seeds, unseen
        if promoted is not None:
            known = known.unionByName(unseen.join(promoted, "value").select("pattern", "kind", F.col("score").alias("w")))
            fresh = fresh.join(promoted, "value", "left_anti")
        rated = known.groupBy("pattern").agg(F.sum("w").alias("all"), *_sums(F.col("w"))).withColumn("best", _best())
        patterns = rated.where((F.col("best.w") >= support) & (F.col("best.w") / F.col("all") >= sure))
        patterns = patterns.select("pattern", F.col("best.kind").alias("kind"), (F.col("best.w") / (F.col("all") + DOUBT)).alias("conf"))
        scored = fresh.join(patterns, "pattern").groupBy("value").agg(*_sums(-F.log(1 - F.col("conf")))).withColumn("best", _best())
        scored = scored.select("value", F.col("best.kind").alias("kind"), F.round(1 - F.exp(-F.col("best.w")), 9).alias("score"))
        fits = F.col("value").contains("@") == (F.col("kind") == "email")
        new = stored(scored.where(fits & (F.col("score") >= sure)), "promoted")
        if new.isEmpty():
            return new if promoted is None else promoted
        promoted = new if promoted is None else stored(promoted.unionByName(new), "promoted")


def detect(docs: DataFrame) -> DataFrame:
    """Per document row: (doc_id, __key, base, spans), both arrays of (start, rank, end, kind) in order.

    ``base`` holds the fixed forms, ``spans`` these and the promoted instances that overlap
    none of them. Null texts are empty and have none; repeated rows are judged alike; an
    empty table gives no rows.
    """
    found = candidates(docs)
    promoted = bootstrap(found)
    chunks = found.select("doc_id", "h", F.explode("chunks").alias("c")).where(F.col("c.kind").isNull())
    chunks = chunks.select("doc_id", "h", "c.start", "c.end", "c.value").distinct()
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = chunks.join(promoted, "value").groupBy(F.struct(F.col("doc_id").alias("id"), "h").alias("__key"))
    added = added.agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")).alias("__more"))
    rows = found.select("doc_id", F.struct(F.col("doc_id").alias("id"), "h").alias("__key"), F.col("spans").alias("base"))
    rows = rows.join(added, "__key", "left")
    free = F.filter("__more", lambda m: ~F.exists("base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    spans = F.when(F.col("__more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", free)))
    return rows.select("doc_id", "__key", "base", spans.alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """The digest of ``detect``: doc_id, counts of the fixed forms by kind, base_sha256, spans."""

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS)
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""

    def step(state, s):
        apart = s["start"] >= state["at"]
        more = F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, F.concat(state["out"], more)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans masked in their texts; other columns and texts without spans are kept as they are."""
    hits = detect(docs).where(F.size("spans") > 0).select("__key", "spans").dropDuplicates(["__key"])
    joined = keyed(docs).join(hits, "__key", "left")
    text = F.when(F.col("spans").isNull(), F.col("__row.text")).otherwise(masked(F.col("__row.text"), F.col("spans")))
    return joined.select(*[text.alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
