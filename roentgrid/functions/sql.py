"""Box and text expressions as functions of a SQL session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import vocab

WS = vocab.WHITESPACE


def _text(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else 'r"' + s + '"'


# name -> (parameters, result type, body)
FUNCTIONS = {
    "rg_strip": ("t STRING", "STRING", f"regexp_replace(t, {_text(f'^{WS}+|{WS}+$')}, '')"),
    "rg_squeeze_ws": ("t STRING", "STRING", f"regexp_replace(regexp_replace(t, {_text(WS + '+')}, ' '), '^ | $', '')"),
    "rg_study_of_path": ("t STRING", "STRING", "nullif(regexp_extract(t, r'/s(\\d+)', 1), '')"),
    "rg_clean_sentence": ("t STRING", "STRING", "regexp_replace(rg_squeeze_ws(t), r'\\.$', '')"),
    "rg_strip_tags": ("t STRING", "STRING", "rg_strip(regexp_replace(t, '<[^<>]+>', ''))"),
    "rg_text_key": ("t STRING", "STRING", "concat_ws('_', cast(length(t) as string), sha2(t, 256))"),
    "rg_prompt_type": (
        "t STRING", "STRING",
        "CASE WHEN lower(t) LIKE 'locate and describe%' THEN 'locate_and_describe' "
        "WHEN lower(t) LIKE 'describe%' THEN 'describe' WHEN lower(t) LIKE 'locate%' THEN 'locate' END",
    ),
    "rg_safe_name": ("t STRING", "STRING", r"regexp_replace(t, r'[^\p{L}\p{N}\-_.]', '_')"),
    "rg_remove_boxes": ("t STRING", "STRING", f"rg_squeeze_ws(regexp_replace(t, {_text(vocab.BOX)}, ''))"),
    "rg_xyxy_to_cxcywh": (
        "b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "array((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1])",
    ),
    "rg_cxcywh_to_xyxy": (
        "b ARRAY<DOUBLE>", "ARRAY<DOUBLE>",
        "array(b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2)",
    ),
    "rg_clamp_box": (
        "b ARRAY<DOUBLE>", "ARRAY<DOUBLE>",
        "CASE WHEN greatest(0D, b[0]) < least(1D, b[2]) AND greatest(0D, b[1]) < least(1D, b[3]) "
        "THEN array(greatest(0D, b[0]), greatest(0D, b[1]), least(1D, b[2]), least(1D, b[3])) END",
    ),
    "rg_format_box": (
        "b ARRAY<DOUBLE>", "STRING",
        "concat('[', concat_ws(',', transform(b, x -> format_number(x, '0.00'))), ']')",
    ),
    "rg_parse_boxes": (
        "t STRING", "ARRAY<ARRAY<DOUBLE>>",
        f"transform(regexp_extract_all(t, {_text(vocab.BOX)}, 0), "
        "s -> transform(split(regexp_replace(s, r'[\\[\\]\\s]', ''), ','), x -> cast(x as double)))",
    ),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Create the temporary functions; later ones may call earlier ones."""
    for name, (params, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
