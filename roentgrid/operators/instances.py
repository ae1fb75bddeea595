"""Builders of studies and of training/evaluation instances.

Lists whose length is set by the data (images of a study, boxes of a phrase) come
in parts through ``collect_parts``: almost always one, more for a huge group. Their
``ordinal`` is a source position; if it is not a dense integer, give the ``bucket``
that cuts it into even ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import text, vocab
from ..functions.hashing import example_id, hash_order
from . import joins
from .skew import PART_ROWS, collect_parts
from .skips import Skips, kept

INSTANCE_COLUMNS = {
    "dataset": "string", "task": "string", "subtask": "string", "split": "string", "example_id": "string",
    "image_key": "string", "image_path": "string", "category": "string", "phrase": "string", "prompt": "string",
    "target": "string", "boxes": "array<array<double>>", "part": "bigint", "n_parts": "bigint",
}


def instances(df: DataFrame, dataset: str, task: str, subtask: str, key: list[str], **columns) -> DataFrame:
    """Project to the canonical instance table; columns left out are null."""
    given = {
        "dataset": F.lit(dataset), "task": F.lit(task), "subtask": F.lit(subtask),
        "example_id": example_id(F.lit(dataset), F.lit(subtask), *key), "part": F.lit(0), "n_parts": F.lit(1),
        "category": F.lit("unknown"), **columns,
    }
    return df.select(
        *[
            (F.col(c) if isinstance(c, str) else c).cast(t).alias(n)
            for n, t in INSTANCE_COLUMNS.items()
            for c in [given.get(n, F.lit(None))]
        ]
    )


# -- studies ---------------------------------------------------------------------

def image_views(split: DataFrame) -> DataFrame:
    """Images with their view ``kind`` (frontal, lateral or null) and frontal ``priority``
    (0 for PA, 1 for AP)."""
    named_ap = F.col("procedure_text").contains("AP")
    view = F.col("view_position")
    return split.withColumns(
        {
            "kind": F.when(view.isin("PA", "AP"), "frontal")
            .when(view.isin("LATERAL", "LL"), "lateral")
            .when(named_ap, "frontal"),
            "priority": F.when(view == "PA", 0).when((view == "AP") | named_ap, 1),
        }
    )


IMAGE = ("subject_id", "dicom_id")


def _told(found: DataFrame, reports: DataFrame, ordinal: str, skips: Skips | None = None) -> DataFrame:
    """Add the study's non-empty report; studies without one are left out."""
    info = joins.study_reports(reports, ordinal, told=True, skips=skips)
    return found.join(info.withColumnRenamed("subject_id", "report_subject_id"), "study_id")


def _path(root: str, image):
    path = text.image_path(F.lit(root), "part_id", image["subject_id"], "study_id", image["dicom_id"])
    return F.when(image.isNotNull(), path)


def studies(split: DataFrame, reports: DataFrame, root: str, ordinal: str, mode: str = "standard", seed: int = 0, bucket: Column | None = None, skips: Skips | None = None) -> DataFrame:
    """One row per study with a non-empty report.

    standard: ``image_paths`` of all images, in parts. frontal_only: one
    ``image_path``, PA before AP, then source order. frontal_lateral: one of each
    kind drawn by hash, with the number of images of the kind. Images are reduced to
    their study before they meet the reports. Reports are skipped for an unknown path or
    an empty text.
    """
    views = image_views(split)
    image = F.struct(*IMAGE)
    if mode == "standard":
        found = _told(collect_parts(views, ["study_id"], ordinal, image, name="images", bucket=bucket), reports, ordinal, skips)
        return found.withColumn("image_paths", F.transform("images", lambda x: _path(root, x))).drop("images")
    if mode == "frontal_only":
        best = F.min(F.struct("priority", ordinal, *IMAGE)).alias("image")
        found = _told(views.where(F.col("priority").isNotNull()).groupBy("study_id").agg(best), reports, ordinal, skips)
        return found.withColumn("image_path", _path(root, F.col("image"))).drop("image")
    if mode == "frontal_lateral":
        order = hash_order(seed, "dicom_id")

        def one(kind):
            return F.min(F.when(F.col("kind") == kind, F.struct(order.alias("h"), *IMAGE))).alias(kind)

        known = views.where(F.col("kind").isNotNull())
        found = known.groupBy("study_id").agg(
            F.count_if(F.col("kind") == "frontal").alias("n_frontal"),
            F.count_if(F.col("kind") == "lateral").alias("n_lateral"),
            one("frontal"),
            one("lateral"),
        )
        paths = {f"{k}_path": _path(root, F.col(k)) for k in ("frontal", "lateral")}
        return _told(found, reports, ordinal, skips).withColumns(paths).drop("frontal", "lateral")
    raise ValueError(f"unknown mode: {mode}")


def study_image_lists(split: DataFrame, reports: DataFrame, root: str, ordinal: str, bucket: Column | None = None) -> DataFrame:
    """Frontal and lateral image lists per study, in parts."""
    views = image_views(split).where(F.col("kind").isNotNull())
    lists = collect_parts(views, ["study_id", "kind"], ordinal, F.struct(*IMAGE), name="images", bucket=bucket)
    paths = F.transform("images", lambda x: _path(root, x))
    return _told(lists, reports, ordinal).withColumn("image_paths", paths).drop("images")


# -- location instances ------------------------------------------------------------

def location_boxes(docs: DataFrame, skips: Skips | None = None) -> DataFrame:
    """(dicom_id, split, location, box) with clamped, valid boxes of known locations."""
    rows = docs.select("dicom_id", "split", F.explode("location2bbox").alias("location", "raw"))
    reasons = {"unknown location": F.col("location") == "unknown", "invalid box": F.col("box").isNull()}
    return kept(rows.withColumn("box", bx.clamp_box("raw")), skips, "location boxes", reasons).drop("raw")


def location_snippets(docs: DataFrame, squeeze: bool = True, skips: Skips | None = None) -> DataFrame:
    """(dicom_id, split, location, snippet) of known locations with a non-empty snippet."""
    rows = docs.select("dicom_id", "split", F.explode("location2report_snippet").alias("location", "raw"))
    rows = rows.withColumn("snippet", text.squeeze_ws("raw") if squeeze else F.col("raw"))
    reasons = {"unknown location": F.col("location") == "unknown", "empty snippet": F.coalesce(F.col("snippet") == "", F.lit(True))}
    return kept(rows, skips, "location snippets", reasons).drop("raw")


def _location_instances(df: DataFrame, subtask: str) -> DataFrame:
    has_box = "box" in df.columns
    told = text.agrg_text(subtask, "location", F.col("box") if has_box else None, "snippet")
    return instances(
        df, "anatomy", "location", subtask, ["dicom_id", "location"],
        split="split", image_key="dicom_id", category="location",
        prompt=told["prompt"], target=told["target"],
        **({"boxes": F.array("box")} if has_box else {}),
    )


def locate_instances(docs: DataFrame, skips: Skips | None = None) -> DataFrame:
    return _location_instances(location_boxes(docs, skips), "locate")


def describe_instances(docs: DataFrame, skips: Skips | None = None) -> DataFrame:
    return _location_instances(location_snippets(docs, skips=skips), "describe")


def locate_describe_instances(docs: DataFrame, skips: Skips | None = None) -> DataFrame:
    keys = ["dicom_id", "split", "location"]
    both = joins.boxed_and_described(location_boxes(docs, skips), location_snippets(docs, skips=skips), keys)
    return _location_instances(both, "locate_and_describe")


# -- phrase instances ----------------------------------------------------------------

def _positive(*columns: str) -> Column:
    return reduce(Column.__and__, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in columns])


def _phrase_columns(boxes: str) -> dict:
    return {
        "phrase": "phrase",
        "prompt": F.concat(F.lit("Ground the phrase: "), "phrase"),
        "target": F.concat("phrase", F.lit(": "), bx.format_boxes(boxes)),
        "boxes": boxes,
    }


def phrase_instances_ms(
    df: DataFrame, fmt: str = "xyxy", ordinal: str = "ordinal", part_size: int = PART_ROWS, bucket: Column | None = None, skips: Skips | None = None
) -> DataFrame:
    """Per image and phrase all boxes, normalised by the first row's image size.

    A box or image without extent is an error; with ``skips`` it is left out and counted.
    """
    if skips is not None:
        reasons = {"no image size": ~_positive("image_width", "image_height"), "empty box": ~_positive("w", "h")}
        df = skips.keep(df, "phrase boxes", reasons)
    raw = F.array("x", "y", "w", "h")
    grouped = collect_parts(
        df, ["split", "dicom_id", "label_text"], ordinal, raw, part_size, "raw",
        first={"iw": "image_width", "ih": "image_height", "category": "category_name"}, bucket=bucket,
    )

    def convert(b):
        box = bx.norm_xywh(b[0], b[1], b[2], b[3], F.col("iw"), F.col("ih"), strict=True)
        return bx.xyxy_to_cxcywh(box) if fmt == "cxcywh" else box

    rows = grouped.withColumns({"boxes": F.transform("raw", convert), "phrase": F.col("label_text")})
    return instances(
        rows, "phrase_ms", "phrase_grounding", "phrase", ["split", "dicom_id", "phrase", "part"],
        split="split", image_key="dicom_id", category="category", part="part", n_parts="n_parts",
        **_phrase_columns("boxes"),
    )


def grounded_docs(docs: DataFrame, master: DataFrame, ordinal: str) -> DataFrame:
    """Reports (last per study) with cleaned sentences, once per split of the study."""
    last = joins.last_per_key(docs, ["StudyID"], ordinal).drop(ordinal)
    cleaned = last.withColumn("findings", text.clean_findings("findings"))
    return cleaned.join(master.select("StudyID", "split").distinct(), "StudyID")


def grounded_report_instances(docs: DataFrame, master: DataFrame, ordinal: str, lang: str = "en", grounded: bool = True, fmt: str = "xyxy") -> DataFrame:
    """One report per study: its sentences, each followed by its boxes if grounded."""
    rows = grounded_docs(docs, master, ordinal)
    sentences = F.transform("findings", lambda f: f[f"sentence_{lang}"])

    def convert(b):
        return bx.xyxy_to_cxcywh(b) if fmt == "cxcywh" else b

    boxes = F.transform("findings", lambda f: F.transform(f["boxes"], convert))
    target = bx.grounded_report(sentences, boxes) if grounded else text.strip(F.array_join(sentences, ". "))
    flat = F.flatten(F.filter(boxes, lambda b: b.isNotNull()))
    task = "grounded_report" if grounded else "report"
    return instances(
        rows, "report_pc", task, lang, ["StudyID", "split"], split="split", image_key="ImageID",
        prompt=F.lit(text.TASK_PROMPTS[task]), target=target, **({"boxes": flat} if grounded else {}),
    )


def phrase_instances_pc(docs: DataFrame, master: DataFrame, ordinal: str, lang: str = "en", fmt: str = "xyxy", labels_as_phrases: bool = False) -> DataFrame:
    """One instance per boxed finding sentence and, if asked, per label of the finding.

    The sentence's group is that of the finding's first label.
    """
    last = joins.last_per_key(docs, ["StudyID"], ordinal).drop(ordinal)
    rows = last.join(master.select("StudyID", "split").distinct(), "StudyID")
    rows = rows.select("StudyID", "ImageID", "split", F.posexplode("findings").alias("finding_no", "f"))
    rows = rows.where(F.size("f.boxes") > 0)
    sentence = F.regexp_replace(text.strip(F.coalesce(F.col(f"f.sentence_{lang}"), F.lit(""))), r"\.$", "")
    label = F.try_element_at("f.labels", F.lit(1))
    phrases = F.array(F.struct(F.lit("sentence").alias("kind"), sentence.alias("phrase"), label.alias("label")))
    if labels_as_phrases:
        extra = F.transform(
            "f.labels", lambda x: F.struct(F.lit("label").alias("kind"), x.alias("phrase"), x.alias("label"))
        )
        phrases = F.concat(phrases, F.coalesce(extra, F.slice(phrases, 1, 0)))

    def convert(b):
        return bx.xyxy_to_cxcywh(b) if fmt == "cxcywh" else b

    rows = rows.select(
        "StudyID", "ImageID", "split", "finding_no",
        F.transform("f.boxes", convert).alias("boxes"), F.posexplode(phrases).alias("phrase_no", "p"),
    ).select("*", "p.*").where(F.col("phrase") != "")
    rows = joins.with_label_group(rows, master, "ordinal")
    return instances(
        rows, "phrase_pc", "phrase_grounding", "phrase", ["StudyID", "split", "finding_no", "phrase_no"],
        split="split", image_key="ImageID", category="label_group", **_phrase_columns("boxes"),
    )


def normalised_boxes(annotations: DataFrame, sizes: DataFrame, skips: Skips | None = None) -> tuple[DataFrame, DataFrame]:
    """Boxes divided by the image size and clamped; and the anomalous rows.

    Rows without a box are neither.
    """
    box = bx.norm_xyxy(F.array("x_min", "y_min", "x_max", "y_max"), "width", "height")
    rows = joins.with_image_size(annotations.where(F.col("x_min").isNotNull()), sizes).withColumn("box", box)
    bad = rows.where(F.col("box").isNull())
    if skips is None:
        return rows.where(F.col("box").isNotNull()), bad
    judged = annotations.join(sizes.select("image_id", "width", "height"), "image_id", "left").withColumn("box", box)
    reasons = {"no box": F.col("x_min").isNull(), "no image size": ~_positive("width", "height"), "empty box": F.col("box").isNull()}
    return skips.keep(judged, "annotations", reasons), bad


def phrase_instances_vd(boxes: DataFrame, ordinal: str = "ordinal", fmt: str = "xyxy", part_size: int = PART_ROWS) -> DataFrame:
    """Per image and class all boxes; boxes(split, image_id, class_name, box, ordinal)."""
    box = bx.xyxy_to_cxcywh("box") if fmt == "cxcywh" else F.col("box")
    rows = collect_parts(
        boxes.where(F.col("class_name") != "No finding"),
        ["split", "image_id", "class_name"], ordinal, box, part_size, "boxes",
    ).withColumn("phrase", text.class_phrase("class_name"))
    return instances(
        rows, "phrase_vd", "phrase_grounding", "phrase", ["split", "image_id", "class_name", "part"],
        split="split", image_key="image_id", part="part", n_parts="n_parts", **_phrase_columns("boxes"),
    )


# -- label tables ---------------------------------------------------------------------

def label_long(wide: DataFrame, classes: list[str], keep: list[str], renames: dict | None = None) -> DataFrame:
    """(keep..., class_name) of the positive cells of a wide 0/1 label table."""
    renames = {"Other disease": "Other diseases"} if renames is None else renames
    long = wide.unpivot(keep, [F.col(f"`{c}`") for c in classes], "class_name", "value")
    return long.where(F.col("value") > 0).select(*keep, F.col("class_name")).replace(renames, subset=["class_name"])


def rater_union(wide: DataFrame, classes: list[str], image: str = "image_id") -> DataFrame:
    """One row per image; a class is 1 if any rater set it."""
    return wide.groupBy(image).agg(*[(F.sum(F.col(f"`{c}`")) > 0).cast("int").alias(c) for c in classes])


CLASS_ORDER = {c: i for i, c in enumerate(vocab.CLASS_PHRASES)}


def pseudo_reports(labels: DataFrame, images: DataFrame, boxes: DataFrame, ordinal: str = "ordinal", part_size: int = PART_ROWS) -> DataFrame:
    """Report text per image made of its positive classes.

    labels(image_id, class_name), images(image_id), boxes(image_id, class_name, box,
    ordinal). Localizable phrases come first, each with its boxes, then global ones,
    then the no-finding phrase. A text with very many boxes continues in parts.
    """
    order = F.try_element_at(F.create_map(*[F.lit(x) for kv in CLASS_ORDER.items() for x in kv]), "class_name")
    local = text.is_localizable("class_name")
    none = F.col("class_name") == "No finding"
    keys = ["image_id", "class_name"]
    # One row per image and class, at most as many per image as there are classes: how
    # many parts its boxes come in, and where they start in the report.
    sizes = boxes.groupBy(*keys).agg(F.count("*").alias("n"))
    known = labels.select(*keys).distinct().where(text.class_phrase("class_name").isNotNull()).join(sizes, keys, "left")
    tier = F.when(none, 2).when(local, 0).otherwise(1)
    box_parts = F.when(local & F.col("n").isNotNull(), F.ceil(F.col("n") / part_size)).otherwise(1)
    known = known.select(*keys, tier.alias("tier"), order.alias("class_no"), box_parts.alias("box_parts"))
    w = Window.partitionBy("image_id")
    before = w.orderBy("tier", "class_no").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumns(
        {
            "start": F.coalesce(F.sum("box_parts").over(before), F.lit(0)),
            "pieces": F.sum("box_parts").over(w),
            "classes": F.count("*").over(w),
        }
    )
    phrase = F.when(
        none, F.when(F.col("classes") > 1, "No other relevant findings are noted.").otherwise("No finding")
    ).otherwise(text.class_phrase("class_name"))
    known = known.select("*", phrase.alias("phrase"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("box_parts") - 1)).alias("part"))
    lists = collect_parts(boxes, keys, ordinal, bx.format_box("box"), part_size, "found")
    lists = lists.select(*keys, "part", F.array_join("found", " ").alias("found"))
    pieces = known.join(lists, [*keys, "part"], "left").withColumn("place", F.col("start") + F.col("part"))
    lead = F.when(F.col("part") > 0, "").when(F.col("place") > 0, F.concat(F.lit(". "), "phrase")).otherwise(F.col("phrase"))
    tail = F.when((F.col("tier") == 0) & F.col("found").isNotNull(), F.concat(F.lit(" "), "found")).otherwise("")
    # A report is one text unless some class has several parts of boxes; then every
    # piece is a part. Either way a group below holds one piece per class at most.
    split = F.col("pieces") > F.col("classes")
    pieces = pieces.select(
        "image_id",
        F.when(split, F.col("place")).otherwise(0).cast("bigint").alias("part"),
        F.when(split, F.col("pieces")).otherwise(1).cast("bigint").alias("n_parts"),
        "place",
        F.concat(lead, tail, F.when(F.col("place") == F.col("pieces") - 1, ".").otherwise("")).alias("piece"),
    )
    listed = F.array_sort(F.collect_list(F.struct("place", "piece")))
    texts = pieces.groupBy("image_id", "part", "n_parts").agg(
        F.array_join(F.transform(listed, lambda x: x["piece"]), "").alias("report")
    )
    return images.select("image_id").distinct().join(texts, "image_id", "left").select(
        "image_id", F.coalesce("part", F.lit(0)).cast("bigint").alias("part"),
        F.coalesce("n_parts", F.lit(1)).cast("bigint").alias("n_parts"), F.coalesce("report", F.lit(".")).alias("report"),
    )


# -- composition ------------------------------------------------------------------------

def multitask(tables: dict[str, DataFrame]) -> DataFrame:
    """Union of instance tables, each renamed ``<name>_<task>``."""
    named = [df.withColumn("dataset", F.concat(F.lit(f"{name}_"), F.col("task"))) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def to_messages(df: DataFrame, include_target: bool = True) -> DataFrame:
    """Chat rows: user prompt and assistant target, or the prompt alone with ``gt_text``."""

    def turn(role, content):
        return F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))

    if include_target:
        return df.withColumn("messages", F.array(turn("user", "prompt"), turn("assistant", "target")))
    return df.withColumns({"messages": F.array(turn("user", "prompt")), "gt_text": F.col("target")})


def fan_out_locations(rows: DataFrame, locations: list[str]) -> DataFrame:
    """Every row once per requested location with its prompt."""
    allowed = vocab.LOCATE_AND_DESCRIBE + vocab.DESCRIBE_ONLY
    bad = [x for x in locations if x not in allowed]
    if bad:
        raise ValueError(f"unsupported locations: {bad}")
    out = rows.withColumn("location", F.explode(F.array(*[F.lit(x) for x in locations])))
    return out.withColumn("prompt", text.agrg_prompt("location"))


def assemble_reports(preds: DataFrame, mode: str, location_order: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Report per study from per-location predictions and/or a whole-report prediction.

    preds(study_id, location, prediction, ordinal); the whole report has a null
    location. agrg: descriptions in location order; grg: the whole report; hybrid:
    the whole report, then the descriptions. The last prediction per location counts,
    so a study has at most one sentence per listed location.
    """
    places = {x: i for i, x in enumerate(location_order)}
    place = F.try_element_at(F.create_map(*[F.lit(x) for kv in places.items() for x in kv]), "location")
    whole = F.col("location").isNull()
    said = F.coalesce(text.extract_description("prediction"), text.strip("prediction"))
    rows = preds.select(
        "study_id",
        F.when(whole, F.lit(-1)).otherwise(place).alias("place"),
        F.when(whole, text.strip("prediction")).otherwise(said).alias("said"),
        ordinal,
    ).where(F.col("place").isNotNull())
    if mode == "agrg":
        rows = rows.where(F.col("place") >= 0)
    elif mode == "grg":
        rows = rows.where(F.col("place") < 0)
    elif mode != "hybrid":
        raise ValueError(f"unknown mode: {mode}")
    last = joins.last_per_key(rows, ["study_id", "place"], ordinal)
    listed = F.array_sort(F.collect_list(F.struct("place", "said")))
    return last.groupBy("study_id").agg(listed.alias("l")).select(
        "study_id", text.join_sentences(F.transform("l", lambda x: x["said"])).alias("report")
    )


def merged_location_docs(docs: DataFrame) -> DataFrame:
    """(dicom_id, location, bbox) over box, snippet and default locations."""
    names = F.array_union(F.map_keys("location2bbox"), F.map_keys("location2report_snippet"))
    rows = docs.withColumn("location", F.explode(text.with_default_locations(names, drop_unknown=False)))
    return rows.select("dicom_id", "location", F.try_element_at("location2bbox", F.col("location")).alias("bbox"))


