import pytest
from pyspark.sql import functions as F

from roentgrid.functions.hashing import example_id
from roentgrid.operators import instances, joins, stats

IMAGES = "dicom_id string, study_id string, subject_id string, split string, view_position string, procedure_text string, ordinal bigint"


@pytest.fixture(scope="module")
def cxr(spark):
    reports = spark.createDataFrame(
        [
            (0, "f/p10/p1/s1.txt", "old", None),
            (1, "f/p10/p1/s1.txt", "new", "ok."),
            (2, "f/p11/p2/s2.txt", " ", None),
            (3, "f/p12/p3/s3.txt", None, "seen"),
            (4, "bad path", "x", "y"),
            (5, "f/p12/p4/s4.txt", "a", None),
        ],
        "ordinal bigint, path string, findings string, impression string",
    )
    images = spark.createDataFrame(
        [
            ("a", "1", "1", "train", "AP", "CHEST", 0),
            ("b", "1", "1", "train", "PA", "CHEST", 1),
            ("c", "1", "1", "train", "PA", "CHEST", 2),
            ("d", "1", "1", "train", "LL", "CHEST", 3),
            ("e", "2", "2", "train", "PA", "CHEST", 4),
            ("f", "3", "3", "test", None, "PORTABLE AP", 5),
            ("g", "4", "4", "test", "LATERAL", None, 6),
            ("h", "9", "9", "test", "PA", None, 7),
        ],
        IMAGES,
    )
    return images, reports


def test_lookups(cxr):
    images, reports = cxr
    paths = {r["dicom_id"]: r["image_path"] for r in joins.image_paths(images, reports, "/r", "ordinal").collect()}
    assert paths["a"] == "/r/p10/p1/s1/a.jpg" and paths["h"] is None
    told = {r["dicom_id"]: r["report"] for r in joins.image_reports(reports, images, "ordinal").collect()}
    assert told["a"] == "new. ok." and told["e"] == "" and "h" not in told


def test_studies(cxr):
    images, reports = cxr
    std = {r["study_id"]: [p[-5] for p in r["image_paths"]] for r in instances.studies(images, reports, "/r", "ordinal").collect()}
    assert std == {"1": ["a", "b", "c", "d"], "3": ["f"], "4": ["g"]}
    front = {r["study_id"]: r["image_path"][-5] for r in instances.studies(images, reports, "/r", "ordinal", "frontal_only").collect()}
    assert front == {"1": "b", "3": "f"}
    both = {r["study_id"]: r for r in instances.studies(images, reports, "/r", "ordinal", "frontal_lateral").collect()}
    assert (both["1"]["n_frontal"], both["1"]["n_lateral"]) == (3, 1)
    assert both["4"]["frontal_path"] is None and both["4"]["lateral_path"].endswith("g.jpg")
    with pytest.raises(ValueError):
        instances.studies(images, reports, "/r", "ordinal", "sideways")


def test_splits(cxr):
    images, _ = cxr
    assert joins.filter_split(images, "all").count() == 8
    assert joins.filter_split(images, "test").count() == 3
    with pytest.raises(ValueError):
        joins.require_rows(joins.filter_split(images, "val"), "val")


def test_location_instances(spark):
    docs = spark.createDataFrame(
        [("i", "train", "r", {"spine": [-0.1, 0.2, 0.5, 1.4], "unknown": [0.0, 0.0, 1.0, 1.0], "svc": [0.6, 0.1, 0.5, 0.2]}, {"spine": "  a   b ", "neck": " ", "unknown": "x"})],
        "dicom_id string, split string, original_report string, location2bbox map<string,array<double>>, location2report_snippet map<string,string>",
    )
    locate = instances.locate_instances(docs).collect()
    assert [(r["category"], r["target"]) for r in locate] == [("spine", "Location of the spine: [0.00,0.20,0.50,1.00]")]
    assert [r["target"] for r in instances.describe_instances(docs).collect()] == ["Description of the spine: a b"]
    both = instances.locate_describe_instances(docs).collect()
    assert both[0]["target"] == "Location of the spine: [0.00,0.20,0.50,1.00]. Description: a b"
    assert both[0]["boxes"] == [[0.0, 0.2, 0.5, 1.0]]
    merged = {r["location"]: r["bbox"] for r in instances.merged_location_docs(docs).collect()}
    assert "unknown" in merged and merged["neck"] is None and merged["spine"] == [-0.1, 0.2, 0.5, 1.4] and len(merged) == 12


def test_phrase_instances_in_parts(spark):
    rows = [("train", "i", "p", "c" if k else "first", float(k), 0.0, 1.0, 1.0, 10 if k else 20, 10, k) for k in range(10)]
    df = spark.createDataFrame(rows, "split string, dicom_id string, label_text string, category_name string, x double, y double, w double, h double, image_width int, image_height int, ordinal bigint")
    out = instances.phrase_instances_ms(df, part_size=4, bucket=F.floor(F.col("ordinal") / 3)).orderBy("part").collect()
    assert [len(r["boxes"]) for r in out] == [4, 4, 2] and {r["n_parts"] for r in out} == {3}
    assert {r["category"] for r in out} == {"first"}
    assert [b[0] for r in out for b in r["boxes"]] == [k / 20 for k in range(10)]
    whole = instances.phrase_instances_ms(df, "cxcywh").first()
    assert whole["boxes"][0] == pytest.approx([0.025, 0.05, 0.05, 0.1]) and whole["target"].startswith("p: [0.03,0.05,0.05,0.10] ")
    bad = df.withColumn("w", F.lit(0.0))
    with pytest.raises(Exception, match="must be positive"):
        instances.phrase_instances_ms(bad).collect()


FINDINGS = "StudyID string, ImageID string, ordinal bigint, findings array<struct<sentence_en: string, sentence_es: string, boxes: array<array<double>>, labels: array<string>>>"


def test_grounded_reports_and_phrases(spark):
    b = [0.1, 0.2, 0.3, 0.4]
    docs = spark.createDataFrame(
        [
            ("s", "old", 0, [("x", "x", None, [])]),
            ("s", "img", 1, [(" a  b. ", "es.", [b], ["L1", "L2"]), ("c", "d", None, ["L3"]), (" ", "f", [b, b], ["L2"])]),
        ],
        FINDINGS,
    )
    master = spark.createDataFrame([("s", "train", "L1", "old", 0), ("s", "train", "L1", "G1", 1), ("s", "train", "L2", "G2", 2)], "StudyID string, split string, label string, label_group string, ordinal bigint")
    r = instances.grounded_report_instances(docs, master, "ordinal").first()
    assert r["image_key"] == "img" and r["target"] == "a b [0.10,0.20,0.30,0.40]. c.  [0.10,0.20,0.30,0.40] [0.10,0.20,0.30,0.40]"
    assert len(r["boxes"]) == 3
    plain = instances.grounded_report_instances(docs, master, "ordinal", "es", grounded=False).first()
    assert plain["target"] == "es. d. f" and plain["boxes"] is None
    got = instances.phrase_instances_pc(docs, master, "ordinal", labels_as_phrases=True).collect()
    assert sorted((x["phrase"], x["category"], len(x["boxes"])) for x in got) == [("L1", "G1", 1), ("L2", "G2", 1), ("L2", "G2", 2), ("a  b", "G1", 1)]
    assert instances.phrase_instances_pc(docs, master, "ordinal").count() == 1


def test_pseudo_reports(spark):
    wide = spark.createDataFrame(
        [("a", "R1", 1, 0, 0, 1), ("a", "R2", 0, 1, 0, 0), ("b", "R1", 0, 0, 0, 1), ("c", "R1", 0, 0, 0, 0), ("d", "R1", 1, 0, 1, 0)],
        "image_id string, rad_id string, `Cardiomegaly` int, `COPD` int, `Other disease` int, `No finding` int",
    )
    classes = ["Cardiomegaly", "COPD", "Other disease", "No finding"]
    union = instances.rater_union(wide, classes)
    labels = instances.label_long(union, classes, ["image_id"])
    boxes = spark.createDataFrame(
        [("a", "Cardiomegaly", [0.1 * k, 0.0, 1.0, 1.0], k) for k in range(3)] + [("d", "ILD", [0.0, 0.0, 1.0, 1.0], 9)],
        "image_id string, class_name string, box array<double>, ordinal bigint",
    )
    want = {
        "a": "Cardiomegaly [0.00,0.00,1.00,1.00] [0.10,0.00,1.00,1.00] [0.20,0.00,1.00,1.00]. Chronic Obstructive Pulmonary Disease.. No other relevant findings are noted..",
        "b": "No finding.",
        "c": ".",
        "d": "Cardiomegaly. Other diseases.",
    }
    got = instances.pseudo_reports(labels, union, boxes).collect()
    assert {r["image_id"]: r["report"] for r in got} == want
    # Tiny parts: the pieces of a text, put together in order, are the same text.
    parts = instances.pseudo_reports(labels, union, boxes, part_size=2).collect()
    glued = {}
    for r in sorted(parts, key=lambda r: r["part"]):
        glued[r["image_id"]] = glued.get(r["image_id"], "") + r["report"]
    assert glued == want and max(r["n_parts"] for r in parts) > 1


def test_normalised_boxes(spark):
    ann = spark.createDataFrame(
        [("i", "A", -5.0, 0.0, 5.0, 5.0), ("i", "A", 3.0, 0.0, 3.0, 5.0), ("i", "No finding", None, None, None, None), ("z", "A", 0.0, 0.0, 1.0, 1.0)],
        "image_id string, class_name string, x_min double, y_min double, x_max double, y_max double",
    )
    sizes = spark.createDataFrame([("i", 10, 10), ("z", 0, 10)], "image_id string, width int, height int")
    good, bad = instances.normalised_boxes(ann, sizes)
    assert [r["box"] for r in good.collect()] == [[0.0, 0.0, 0.5, 0.5]] and bad.count() == 2


def test_assemble_and_fan_out(spark):
    p = spark.createDataFrame(
        [("s", "spine", "Description: old", 0), ("s", "spine", "Locate. Description: clear", 1), ("s", "abdomen", " soft. ", 2), ("s", None, "Whole", 3), ("s", "moon", "x", 4)],
        "study_id string, location string, prediction string, ordinal bigint",
    )
    order = ["abdomen", "spine"]
    assert instances.assemble_reports(p, "agrg", order).first()["report"] == "soft. clear."
    assert instances.assemble_reports(p, "grg", order).first()["report"] == "Whole."
    assert instances.assemble_reports(p, "hybrid", order).first()["report"] == "Whole. soft. clear."
    with pytest.raises(ValueError):
        instances.fan_out_locations(p, ["right upper abdomen"])
    assert instances.fan_out_locations(p.select("study_id").distinct(), ["neck", "spine"]).count() == 2


def test_messages_and_multitask(spark):
    df = spark.createDataFrame([("p", "t", "a"), ("q", "u", "b")], "prompt string, target string, image string")
    one = instances.instances(df, "x", "location", "locate", ["image"], prompt="prompt", target="target")
    both = instances.multitask({"n": one, "m": one.drop("boxes")})
    assert {r["dataset"] for r in both.collect()} == {"n_location", "m_location"} and both.count() == 4
    assert df.select(example_id("image").alias("e")).distinct().count() == 2
    m = instances.to_messages(one, False).first()
    assert [x["role"] for x in m["messages"]] == ["user"] and m["gt_text"] == m["target"]
    assert [x["role"] for x in instances.to_messages(one).first()["messages"]] == ["user", "assistant"]


def test_eval_set(spark):
    docs = spark.createDataFrame([("i", " a   report ")], "dicom_id string, original_report string")
    loc = spark.createDataFrame([("i", "spine", [0.1, 0.1, 0.2, 0.2]), ("i", "neck", None), ("i", "svc", None)], "dicom_id string, location string, bbox array<double>")
    ans = spark.createDataFrame(
        [('Report: "a report" | Location: "spine"', "w", "N/A"), ('Report: "a report" | Location: "neck"', "w", "mini")], "query string, reasoning string, mini_report string"
    )
    flags = spark.createDataFrame([("mini", "yes", "no")], "query string, mentions_abnormalities string, mentions_devices string")
    got = {r["location"]: r for r in joins.build_eval_set(docs, loc, ans, flags).collect()}
    assert got["spine"]["mini_report"] is None and got["spine"]["reasoning"] is None and got["spine"]["keep"]
    assert got["neck"]["mentions_abnormalities"] == "yes" and got["neck"]["keep"]
    assert not got["svc"]["keep"]


def test_stats(spark):
    df = spark.createDataFrame([("x", "a", 0.5, None), ("x", "b", None, 1.0), ("y", "a", None, 0.5)], "dataset string, category string, bbox_iou double, text_score double")
    w = {"bbox_iou": 0.8, "text_score": 0.2}
    m = {r["dataset"]: r for r in stats.dataset_metrics(df, w).collect()}
    assert m["x"]["combined"] == pytest.approx(0.6) and m["y"]["combined"] is None and m["x"]["size"] == 2
    o = stats.overall_metrics(stats.dataset_metrics(df, w), w).first()
    assert o["bbox_iou"] == pytest.approx(0.5) and o["text_score"] == pytest.approx((2 * 1.0 + 0.5) / 3)
    sums = stats.metric_sums(df, list(w))
    assert {r["dataset"]: r["text_score"] for r in stats.means_of(sums, ["dataset"], list(w)).collect()} == {"x": 1.0, "y": 0.5}
    with pytest.raises(ValueError):
        stats.weighted_score(df, {"bbox_iou": 0})


def test_skips_are_counted_on_the_way(spark):
    from roentgrid.operators.skips import Skips, kept

    df = spark.createDataFrame([(i, i % 3 or None) for i in range(30)], "i int, v int").repartition(3)
    reasons = {"null": F.col("v").isNull(), "even": F.col("i") % 2 == 0, "never": F.col("i") < 0}
    skips = Skips()
    rows = sorted(r["i"] for r in kept(df, skips, "x", reasons).groupBy("i", "v").count().collect())
    want = [i for i in range(30) if i % 3 and i % 2]
    assert rows == want == sorted(r["i"] for r in kept(df, None, "x", reasons).collect())
    counts = [("x", None, len(want)), ("x", "null", 10), ("x", "even", 20 - len(want))]
    assert skips.counts() == counts and sorted(map(tuple, skips.table(spark).collect()), key=str) == sorted(counts, key=str)
    with pytest.raises(ValueError, match="counted already"):
        skips.keep(df, "x", reasons)


def test_boxes_without_extent(spark):
    from roentgrid.operators.skips import Skips

    rows = [("train", "a", "p", "c", 0.0, 0.0, w, 5.0, size, 100, i) for i, (w, size) in enumerate([(5.0, 100), (0.0, 100), (5.0, 0), (None, 100), (7.0, 100)])]
    df = spark.createDataFrame(rows, "split string, dicom_id string, label_text string, category_name string, x double, y double, w double, h double, image_width int, image_height int, ordinal bigint")
    skips = Skips()
    got = instances.phrase_instances_ms(df, skips=skips).collect()
    assert len(got) == 1 and len(got[0]["boxes"]) == 2
    assert dict((r, n) for _, r, n in skips.counts()) == {None: 2, "no image size": 1, "empty box": 2}
    with pytest.raises(Exception):
        instances.phrase_instances_ms(df).collect()


def test_broken_prompts_and_paths(spark):
    from roentgrid.operators import joins, stats

    rows = [("d", "c", p, 0.5, 0.5) for p in ("Locate the x.", "find it")]
    df = spark.createDataFrame(rows, "dataset string, category string, prompt string, bbox_iou double, text_score double")
    with pytest.raises(Exception, match="prompt of no type: find it"):
        stats.prompt_type_metrics(df).collect()
    assert stats.prompt_type_metrics(df.limit(1)).count() == 1
    split = spark.createDataFrame([("1", "2", "3"), ("1", "9", "4")], "subject_id string, study_id string, dicom_id string")
    reports = spark.createDataFrame([("files/p10/p1/s2.txt", "a", "b", 1)], "path string, findings string, impression string, ordinal int")
    paths = {r["study_id"]: r["image_path"] for r in joins.image_paths(split, reports, "/r", "ordinal").collect()}
    assert paths["2"].endswith("p10/p1/s2/3.jpg") and paths["9"] is None
    with pytest.raises(Exception, match="no report path of study 9"):
        joins.image_paths(split, reports, "/r", "ordinal", strict=True).collect()
