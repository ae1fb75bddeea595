"""Text expressions: report assembly, prompts, cleaning, parsing.

Everything here takes and returns Columns of built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .boxes import format_box, let

WS = vocab.WHITESPACE


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Remove white space at both ends; a text without any there is left as it is."""
    def stripped(c: Column) -> Column:
        ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
        return F.when(ends.rlike(WS), F.regexp_replace(c, f"^{WS}+|{WS}+$", "")).otherwise(c)

    # An expression, such as a match of a pattern, is worked out once.
    return stripped(F.col(col)) if isinstance(col, str) else let(col, stripped)


# Any character but the blank, printable ASCII and what follows it up to the first other white space.
NOT_PLAIN = r"[^ -~\u00a1-\u167f]"


def squeeze_ws(col) -> Column:
    """Collapse runs of white space to one blank and strip.

    A text of plain characters and single blanks only has nothing to collapse.
    """

    def squeezed(c: Column) -> Column:
        single = ~c.rlike(NOT_PLAIN) & ~c.contains("  ")
        return F.trim(F.when(single, c).otherwise(F.regexp_replace(c, f"{WS}+", " ")))

    # The text may be an expression, such as one without its boxes: it is worked out once.
    return squeezed(F.col(col)) if isinstance(col, str) else let(col, squeezed)


def path_parts(col, strict: bool = False) -> Column:
    """(part, subject, study) of a report path; null, or an error, if it does not match."""
    col = _c(col)
    parts = F.struct(
        *[
            F.regexp_extract(col, vocab.REPORT_PATH, i + 1).alias(name)
            for i, name in enumerate(["part_id", "subject_id", "study_id"])
        ]
    )
    other = (
        F.raise_error(F.concat(F.lit("not a report path: "), F.coalesce(col, F.lit("null"))))
        if strict
        else F.lit(None)
    )
    return F.when(col.rlike(vocab.REPORT_PATH), parts).otherwise(other)


def study_of_path(col) -> Column:
    """Study id of a report path, or null."""
    return F.nullif(F.regexp_extract(_c(col), r"/s(\d+)", 1), F.lit(""))


def _section(col) -> Column:
    text = strip(col)
    return F.when(text == "", None).when(text.rlike("[.!?,;:]$"), text).otherwise(F.concat(text, F.lit(".")))


def full_report(findings, impression) -> Column:
    """Both sections, each closed by punctuation, joined by a blank; '' if both are empty."""
    return F.concat_ws(" ", _section(findings), _section(impression))


def concat_sections(findings, impression) -> Column:
    """'findings. impression' without closing the last section."""
    f = F.coalesce(strip(findings), F.lit(""))
    i = F.coalesce(strip(impression), F.lit(""))
    glue = F.when(f.endswith("."), " ").otherwise(". ")
    return F.when((f != "") & (i != ""), F.concat(f, glue, i)).when(f != "", f).otherwise(i)


def image_path(root, part, subject, study, image, ext: str = "jpg") -> Column:
    """root/p<part>/p<subject>/s<study>/<image>.<ext>"""
    return F.concat_ws(
        "/",
        _c(root),
        F.concat(F.lit("p"), _c(part)),
        F.concat(F.lit("p"), _c(subject)),
        F.concat(F.lit("s"), _c(study)),
        F.concat(_c(image), F.lit("." + ext)),
    )


def swap_ext(col, ext: str) -> Column:
    return F.regexp_replace(_c(col), r"\.[^./]+$", "." + ext)


def clean_sentence(col) -> Column:
    """Squeeze white space, then drop one trailing period."""
    return F.regexp_replace(squeeze_ws(col), r"\.$", "")


def clean_findings(findings, fields=("sentence_en", "sentence_es")) -> Column:
    """Apply ``clean_sentence`` to the sentence fields of an array of finding structs."""

    def clean(item):
        for name in fields:
            item = item.withField(name, clean_sentence(item[name]))
        return item

    return F.transform(_c(findings), clean)


def _lookup(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def class_phrase(col) -> Column:
    """Phrase of an image-level finding class; null for an unknown class."""
    return F.try_element_at(_lookup(vocab.CLASS_PHRASES), _c(col))


def is_localizable(col) -> Column:
    """Whether a known class can carry boxes; null for an unknown class."""
    return F.when(_c(col).isin(list(vocab.CLASS_PHRASES)), ~_c(col).isin(vocab.GLOBAL_CLASSES))


def agrg_prompt(location, wording: str = "Locate") -> Column:
    """Prompt for a location by what it supports; null for an unknown location."""
    loc = _c(location)
    the = F.concat(F.lit(" the "), loc, F.lit("."))
    return (
        F.when(loc.isin(vocab.LOCATE_AND_DESCRIBE), F.concat(F.lit(f"{wording} and describe"), the))
        .when(loc.isin(vocab.DESCRIBE_ONLY), F.concat(F.lit("Describe"), the))
        .when(loc.isin(vocab.LOCATE_ONLY), F.concat(F.lit(wording), the))
    )


def agrg_text(mode: str, location, box=None, snippet=None) -> Column:
    """struct(prompt, target) for one of locate, describe, locate_and_describe."""
    loc = _c(location)
    the = F.concat(F.lit(" the "), loc, F.lit("."))
    where = None if box is None else F.concat(F.lit("Location of the "), loc, F.lit(": "), format_box(box))
    if mode == "locate":
        prompt, target = F.concat(F.lit("Locate"), the), where
    elif mode == "describe":
        prompt = F.concat(F.lit("Describe"), the)
        target = F.concat(F.lit("Description of the "), loc, F.lit(": "), _c(snippet))
    elif mode == "locate_and_describe":
        prompt = F.concat(F.lit("Locate and describe"), the)
        target = F.concat(where, F.lit(". Description: "), _c(snippet))
    else:
        raise ValueError(f"unknown prompt mode: {mode}")
    return F.struct(prompt.alias("prompt"), target.alias("target"))


TASK_PROMPTS = {
    "grounded_report": "Generate a grounded report.",
    "report": "Generate a report.",
}



def prompt_type(col, strict: bool = False) -> Column:
    """locate_and_describe, describe or locate by prefix, whatever the case; else null, or an error if ``strict``."""
    p = F.lower(_c(col))
    kind = (
        F.when(p.startswith("locate and describe"), "locate_and_describe")
        .when(p.startswith("describe"), "describe")
        .when(p.startswith("locate"), "locate")
    )
    if not strict:
        return kind
    return F.coalesce(kind, F.raise_error(F.concat(F.lit("prompt of no type: "), F.coalesce(_c(col), F.lit("null")))).cast("string"))


def clean_generation(col, family: str = "chat") -> Column:
    """Model output without its wrapping.

    chat: text after the last ``model`` line; sep_blank and sep_paragraph: marker
    tokens dropped, the separator becoming a blank or an empty line.
    """
    col = _c(col)
    if family == "chat":
        return strip(F.element_at(F.split(col, "model\n"), -1))
    sep = {"sep_blank": " ", "sep_paragraph": "\n\n"}[family]
    for token, to in (("[BOS]", ""), ("[EOS]", ""), ("[SEP]", sep)):
        col = F.replace(col, F.lit(token), F.lit(to))
    return strip(col)


def strip_tags(col) -> Column:
    """Drop <...> tags."""
    return strip(F.regexp_replace(_c(col), "<[^<>]+>", ""))


LABEL_DESCRIPTION = r"(?id)descri.*?:\s*(.*?)\s*$"
EVAL_DESCRIPTION = r"(?d)Description.*?:(.*)"


def extract_description(col, dialect: str = "label") -> Column:
    """Description part of a generation, null if there is none (dialects label, eval)."""
    pattern = {"label": LABEL_DESCRIPTION, "eval": EVAL_DESCRIPTION}[dialect]
    return strip(F.try_element_at(F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(1)), F.lit(1)))


def remove_boxes(col) -> Column:
    return F.regexp_replace(_c(col), vocab.BOX, "")


def remove_grounding(col, dialect: str = "boxes") -> Column:
    """Text without its boxes; dialect legacy matches [(a,b,c,d),...]."""
    if dialect == "legacy":
        return strip(F.regexp_replace(_c(col), vocab.LEGACY_BOXES, ""))
    return squeeze_ws(remove_boxes(col))


def clean_eval_text(col) -> Column:
    """Text as compared in evaluation: no boxes, description only, tidy periods."""
    text = squeeze_ws(remove_boxes(col))
    # A squeezed text is one line, so dropping all up to the description leaves it.
    text = F.trim(F.regexp_replace(text, "^.*?Description.*?:", ""))
    for old, new in ((": .", "."), (" .", "."), (":", ".")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def join_sentences(sentences) -> Column:
    """Join an array of sentences by blanks, each closed by a period; blank ones skipped."""
    kept = F.filter(F.transform(_c(sentences), strip), lambda s: s != "")
    return F.array_join(F.transform(kept, lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))), " ")


def parse_facts(col) -> Column:
    """First quoted list in a text, distinct in order; null if absent or malformed."""
    found = F.regexp_extract(_c(col), vocab.FACT_LIST, 0)
    closed = F.when(found.endswith("]"), found).otherwise(F.concat(found, F.lit("]")))
    return F.when(found != "", F.array_distinct(F.from_json(closed, "array<string>")))


def drop_repeats(col, ks=tuple(range(1, 9))) -> Column:
    """Drop consecutive repeats of phrases of k words, for each k in turn, ignoring case.

    Every word is marked by whether it equals the word k places before it; a stretch of at
    least k marks is a repeated phrase. Null stays null.
    """
    # Marks in a stretch of at least k: one in front of k marks, or one right after another such.
    def stretch(k: Column) -> Column:
        return F.concat(F.lit("(?:(?=1{"), k.cast("string"), F.lit(r"})|\G(?!^))1"))

    def once(value: Column, use) -> Column:
        """``use`` of a value that is worked out once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def step(acc: Column, k: Column) -> Column:
        same = F.transform(acc["low"], lambda x, i: F.when((i >= k) & (x == F.get(acc["low"], i - k)), "1").otherwise("0"))
        marks = F.regexp_replace(F.array_join(same, ""), stretch(k), F.lit("x"))

        def kept(mark: Column) -> Column:
            return F.struct(*[F.filter(acc[c], lambda _, i: F.get(mark, i) != "x").alias(c) for c in ("words", "low")])

        return once(marks, lambda m: F.when(m.contains("x"), once(F.split(m, ""), kept)).otherwise(acc))

    words = F.array_remove(F.split(squeeze_ws(col), " "), "")
    start = F.struct(words.alias("words"), F.transform(words, F.lower).alias("low"))
    return F.when(_c(col).isNotNull(), F.aggregate(F.array(*map(F.lit, ks)), start, step, lambda acc: F.array_join(acc["words"], " ")))


def sentences(col) -> Column:
    """Sentences of a text: cut after . ! ? followed by white space; blank text has none."""
    marked = F.regexp_replace(strip(col), rf"([.!?]){WS}+", "$1\u0001")
    return F.array_remove(F.split(marked, "\u0001"), "")


def chunk_text(col, max_length: int) -> Column:
    """Pack sentences into chunks of about max_length characters.

    The length check ignores the joiner, and a single long sentence stays whole.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, s):
        cur = acc["cur"]
        full = (F.length(cur) + F.length(s) > max_length) & (cur != "")
        done = F.when(full, F.array_append(acc["done"], cur)).otherwise(acc["done"])
        cur = (
            F.when(full | (cur == ""), s)
            .when(cur.endswith("."), F.concat(cur, F.lit(" "), s))
            .otherwise(F.concat(cur, F.lit(". "), s))
        )
        return F.struct(done.alias("done"), cur.alias("cur"))

    def finish(acc):
        return F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])

    return F.aggregate(sentences(col), start, step, finish)


def text_key(col) -> Column:
    """length_sha256, a stable key of a text."""
    return F.concat_ws("_", F.length(_c(col)).cast("string"), F.sha2(_c(col), 256))


def with_default_locations(locations, drop_unknown: bool = True) -> Column:
    """Array of locations with the default ones added."""
    merged = F.array_union(_c(locations), F.array(*[F.lit(x) for x in vocab.DEFAULT_LOCATIONS]))
    return F.array_except(merged, F.array(F.lit("unknown"))) if drop_unknown else merged


def grounded_list_items(col) -> Column:
    """Items of a JSON list [[text, boxes], ...] as array of struct(text, ok)."""

    def item(raw):
        ok = F.coalesce(raw.rlike(r'^\s*\[\s*"'), F.lit(False))
        return F.struct(F.when(ok, F.get_json_object(raw, "$[0]")).alias("text"), ok.alias("ok"))

    return F.transform(F.from_json(_c(col), "array<string>"), item)


def grounded_list_text(col) -> Column:
    """struct(text, skipped) of a grounded list; text is null when nothing usable is there."""
    items = grounded_list_items(col)
    good = F.filter(items, lambda x: x["ok"])
    return F.struct(
        F.when(F.size(good) > 0, join_sentences(F.transform(good, lambda x: x["text"]))).alias("text"),
        F.coalesce(F.size(items) - F.size(good), F.lit(0)).alias("skipped"),
    )


def safe_name(col) -> Column:
    """Replace everything but letters, digits, '-', '_' and '.' by '_'."""
    return F.regexp_replace(_c(col), r"[^\p{L}\p{N}\-_.]", "_")


def is_refusal(col) -> Column:
    return _c(col).rlike(vocab.REFUSAL)


def extract_json(col) -> Column:
    """Text from the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(_c(col), r"(?s)\{.*\}", 0), F.lit(""))
