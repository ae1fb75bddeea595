"""Lookups as joins. No broadcast is forced: adaptive execution broadcasts a side
once its measured size is small enough and splits skewed partitions otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .skips import Skips, kept


def last_per_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Keep, per key, the row with the highest ordinal (a dictionary's last entry wins)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    return df.groupBy(*keys).agg(F.max_by(row, ordinal).alias("__row")).select(*keys, "__row.*")


SPLIT_NAMES = {"val": "validate", "valid": "validate"}


def filter_split(df: DataFrame, split: str, column: str = "split", names: dict | None = None) -> DataFrame:
    """Rows of a split; 'all' keeps every row and aliases are resolved first."""
    if split == "all":
        return df
    return df.where(F.col(column) == (SPLIT_NAMES if names is None else names).get(split, split))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail if a table is empty (used after a split filter)."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def output_split(col="split") -> Column:
    """'validation' and 'validate' read 'val' in results."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin("validation", "validate"), "val").otherwise(c)


def study_reports(reports: DataFrame, ordinal: str, told: bool = False, skips: Skips | None = None) -> DataFrame:
    """(study_id, part_id, subject_id, full_report), the last report of a study winning.

    ``told`` leaves empty reports out first, so that they do not hide an earlier one.
    """
    parts = text.path_parts("path")
    rows = reports.select(
        parts["study_id"].alias("study_id"),
        parts["part_id"].alias("part_id"),
        parts["subject_id"].alias("subject_id"),
        text.full_report("findings", "impression").alias("full_report"),
        ordinal,
    )
    reasons = {"no study in the path": F.col("study_id").isNull()}
    if told:
        reasons["empty report"] = F.col("full_report") == ""
    return last_per_key(kept(rows, skips, "reports", reasons), ["study_id"], ordinal).drop(ordinal)


def image_paths(split: DataFrame, reports: DataFrame, root: str, ordinal: str, strict: bool = False) -> DataFrame:
    """Image path per image; when the study has no report path, ``image_path`` is null, or it is an error if ``strict``."""
    parts = study_reports(reports, ordinal).select("study_id", "part_id")
    path = text.image_path(F.lit(root), "part_id", "subject_id", "study_id", "dicom_id")
    path = F.when(F.col("part_id").isNotNull(), path)
    if strict:
        path = F.coalesce(path, F.raise_error(F.concat(F.lit("no report path of study "), F.col("study_id").cast("string"))).cast("string"))
    return split.join(parts, "study_id", "left").withColumn("image_path", path)


def image_reports(reports: DataFrame, split: DataFrame, ordinal: str) -> DataFrame:
    """Every image of a study with the study's last report."""
    found = study_reports(reports, ordinal).select("study_id", F.col("full_report").alias("report"))
    return split.select("dicom_id", "study_id").join(found, "study_id").select("dicom_id", "study_id", "report")


def in_split(docs: DataFrame, split: DataFrame, key: str = "dicom_id") -> DataFrame:
    """Documents whose image is in the split."""
    return docs.join(split.select(key), key, "left_semi")


def with_views(split: DataFrame, metadata: DataFrame, key: str = "dicom_id") -> DataFrame:
    """Add view position and procedure text."""
    return split.join(metadata.select(key, "view_position", "procedure_text"), key, "left")


def with_label_group(df: DataFrame, master: DataFrame, ordinal: str, label: str = "label") -> DataFrame:
    """Add the label's group, the last entry of a label winning."""
    groups = last_per_key(master.select("label", "label_group", ordinal), ["label"], ordinal).drop(ordinal)
    return df.join(groups.withColumnRenamed("label", label), label, "left")


def boxed_and_described(boxes: DataFrame, snippets: DataFrame, keys=("dicom_id", "location")) -> DataFrame:
    """Locations that have both a box and a snippet."""
    return boxes.join(snippets, list(keys))


def with_image_size(boxes: DataFrame, sizes: DataFrame, key: str = "image_id") -> DataFrame:
    return boxes.join(sizes.select(key, "width", "height"), key)


def mini_report_query(report, location, clean: bool = True) -> Column:
    """Query text of a report and location; ``clean=False`` if the report is squeezed already."""
    report = F.col(report) if isinstance(report, str) else report
    location = F.col(location) if isinstance(location, str) else location
    body = text.squeeze_ws(report) if clean else report
    return F.concat(F.lit('Report: "'), body, F.lit('" | Location: "'), location, F.lit('"'))


def build_eval_set(docs: DataFrame, locations: DataFrame, responses: DataFrame, flags: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row per image and location with its box, mini-report and flags.

    docs(dicom_id, original_report), locations(dicom_id, location, bbox) holding
    the box, snippet and default locations; responses(query, reasoning, mini_report);
    flags(query, mentions_abnormalities, mentions_devices) keyed by mini-report text. Of
    several entries for a query the last by ``ordinal`` counts, or without one the greatest.
    ``keep`` tells whether there is a mini-report or a box.
    """
    # Texts meet by their SHA-256 digest: whole reports are squeezed once per image and
    # never travel further than the join that brings them to their locations.
    squeezed = docs.select("dicom_id", text.squeeze_ws("original_report").alias("report"))
    rows = locations.join(squeezed, "dicom_id")
    rows = rows.withColumn("query_key", F.sha2(mini_report_query("report", "location", clean=False), 256)).drop("report")

    def last(log, key, *columns):
        kept = F.max_by(F.struct(*columns), ordinal) if ordinal else F.max(F.struct(*columns))
        return log.groupBy(F.sha2("query", 256).alias(key)).agg(kept.alias("__e")).select(key, "__e.*")

    rows = rows.join(last(responses, "query_key", "reasoning", "mini_report"), "query_key", "left").drop("query_key")
    known = F.col("mini_report") != "N/A"
    rows = rows.withColumns(
        {"reasoning": F.when(known, F.col("reasoning")), "mini_report": F.when(known, F.col("mini_report"))}
    )
    # Rows without a mini-report would all share the null key; theirs match nothing and are spread.
    nothing = F.concat(F.lit("-"), F.pmod(F.xxhash64("dicom_id", "location"), F.lit(4096)).cast("string"))
    rows = rows.withColumn("report_key", F.coalesce(F.sha2("mini_report", 256), nothing))
    notes = last(flags, "report_key", "mentions_abnormalities", "mentions_devices")
    rows = rows.join(notes, "report_key", "left").drop("report_key")
    return rows.withColumn("keep", F.col("mini_report").isNotNull() | F.col("bbox").isNotNull())


def unprocessed(df: DataFrame, done: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Entries whose key is not in the results yet; the first ``limit`` by key if given."""
    left = df.join(done.select(*keys).distinct(), keys, "left_anti")
    return left.orderBy(*keys).limit(limit) if limit else left


def weights_as_of(history: DataFrame, step: int, every: int, keys=("dataset", "subtask", "category")) -> DataFrame:
    """Weights of the latest entry at or before a step whose step is a multiple of ``every``."""
    usable = history.where((F.col("global_step") <= step) & (F.col("global_step") % every == 0))
    latest = usable.agg(F.max("global_step")).scalar()
    return usable.where(F.col("global_step") == latest).select("global_step", *keys, "weight")


def sampling_pool(entries: DataFrame, core: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that are neither in the core sample nor processed."""
    used = core.select(*keys).unionByName(done.select(*keys)).distinct()
    return entries.join(used, keys, "left_anti")
