"""Schemas of the input tables (DDL) and of the instance table."""

FINDING = "struct<sentence_en: string, sentence_es: string, boxes: array<array<double>>, labels: array<string>>"

IMAGE_SPLIT = "dicom_id string, study_id string, subject_id string, split string"
IMAGE_METADATA = "dicom_id string, ViewPosition string, ProcedureCodeSequence_CodeMeaning string"
REPORTS = "path string, findings string, impression string"
LOCATION_DOCS = (
    "dicom_id string, original_report string, location2bbox map<string, array<double>>, "
    "location2report_snippet map<string, string>"
)
PHRASE_BOXES = (
    "dicom_id string, label_text string, category_name string, x double, y double, w double, h double, "
    "image_width int, image_height int, split string"
)
GROUNDED_MASTER = "StudyID string, split string, label string, label_group string"
GROUNDED_REPORTS = f"StudyID string, ImageID string, findings array<{FINDING}>"
BOX_ANNOTATIONS = "image_id string, class_name string, x_min double, y_min double, x_max double, y_max double"
IMAGE_SIZES = "image_path string, width int, height int"
MINI_REPORTS = "metadata struct<query: string>, parsed_response struct<reasoning: string, `mini-report`: string>"
MINI_REPORT_FLAGS = (
    "metadata struct<query: string>, "
    "parsed_response struct<reason: string, mentions_abnormalities: string, mentions_devices: string>"
)
COMPARISON_LABELS = (
    "metadata struct<query: string>, parsed_response struct<reason: string, gt_has_abnormalities: string, "
    "gt_has_devices: string, gen_has_abnormalities: string, gen_has_devices: string, "
    "gen_has_correct_abnormalities: string, gen_has_hallucinated_abnormalities: string, "
    "gen_has_correct_devices: string, gen_has_hallucinated_devices: string, nli_status: string>"
)
PREDICTIONS = (
    "dicom_id string, phrase string, gt_bboxes array<array<double>>, image_path string, prompt string, "
    "grounding_prediction string"
)
API_RESPONSES = (
    "request string, response struct<choices: array<struct<message: struct<content: string>>>>, "
    "metadata struct<query: string>, errors array<string>"
)
BATCH_OUTPUT = "custom_id string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>"
BATCH_INPUT = "custom_id string, body struct<messages: array<struct<role: string, content: string>>>"
METRICS_LOG = "step_metric string, step bigint, metrics map<string, double>"
SAMPLING_LOG = (
    "global_step bigint, process_id int, orig_index bigint, actual_index bigint, dataset_name string, category string"
)

# The canonical training/evaluation example.
INSTANCE = (
    "dataset string, task string, subtask string, split string, example_id string, image_key string, "
    "image_path string, category string, phrase string, prompt string, target string, "
    "boxes array<array<double>>, part bigint, n_parts bigint"
)


def image_labels(classes: list[str], raters: bool) -> str:
    """Schema of the wide image-label table: one 0/1 column per class."""
    head = "image_id string, rad_id string" if raters else "image_id string"
    return ", ".join([head, *[f"`{c}` int" for c in classes]])
