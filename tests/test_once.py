"""Patterns are matched once, however often their matches are used."""

import pytest

from roentgrid.functions import text


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("clean", [text.clean_eval_text, text.remove_grounding, text.extract_description, text.strip_tags])
def test_patterns_are_matched_once(spark, clean):
    rows = spark.createDataFrame([(" Description:  a <b>[0.1,0.2,0.3,0.4] b . ",), ("",), (None,)], "t string")
    out = rows.select(clean("t").alias("c"))
    match = {"clean_eval_text": "-?", "remove_grounding": "-?", "extract_description": "descri", "strip_tags": "<[^<>]+>"}[clean.__name__]
    times = 4 if match == "-?" else 1  # the pattern of a box holds four numbers
    assert _plan(out).count(match) == times
    assert [r["c"] for r in out.collect()][2] is None
