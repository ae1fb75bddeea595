"""Fixed word lists, labels and patterns.

Fixed values: results only match when these are spelled exactly like this.
"""

# Characters treated as white space when text is stripped or squeezed.
WHITESPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Report file paths: part, subject and study.
REPORT_PATH = r"p(\d+)/p(\d+)/s(\d+)\.txt"

# A box written as four numbers between square brackets.
BOX = r"\[\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*\]"

# The older box syntax, [(a,b,c,d),(e,f,g,h)].
LEGACY_BOXES = (
    r"\s*\[\(\d+\.\d+\s*(,\s*\d+\.\d+\s*)*\)\s*"
    r"(,\s*\(\d+\.\d+\s*(,\s*\d+\.\d+\s*)*\)\s*)*\]"
)

# First JSON-like list of quoted strings; the closing bracket may be missing.
FACT_LIST = r'\[\s*(".+?"(\s*,\s*".+?")*)?\s*\]?'

# Chatter or refusal in a model reply (case-sensitive).
REFUSAL = r"\b(I'm sorry|Sorry|Could you|Can you|I apologize|Sure|I'd be happy|do you need)\b"

# Locations that can be both located and described.
LOCATE_AND_DESCRIBE = [
    "left lung", "right lung", "cardiac silhouette", "left costophrenic angle",
    "mediastinum", "right costophrenic angle", "right hilar structures",
    "left hilar structures", "upper mediastinum", "left lower lung zone",
    "right lower lung zone", "abdomen", "spine", "right clavicle", "left clavicle",
    "trachea", "left mid lung zone", "right mid lung zone", "right apical zone",
    "right hemidiaphragm", "left apical zone", "aortic arch", "svc",
    "left hemidiaphragm", "right upper lung zone", "carina", "left upper lung zone",
    "right atrium", "cavoatrial junction",
]

# Locations that can only be located.
LOCATE_ONLY = [
    "right upper abdomen", "left cardiac silhouette", "left upper abdomen",
    "right cardiac silhouette", "right cardiophrenic angle",
    "left cardiophrenic angle", "descending aorta",
]

# Locations that can only be described.
DESCRIBE_ONLY = [
    "neck", "right chest wall", "left chest wall", "right shoulder",
    "left shoulder", "right arm", "right breast", "left arm", "left breast",
]

# Locations every report is asked about.
DEFAULT_LOCATIONS = [
    "right lung", "left lung", "left costophrenic angle", "right costophrenic angle",
    "spine", "right clavicle", "left clavicle", "mediastinum", "cardiac silhouette",
]

# Image-level finding classes and the phrase used for each.
CLASS_PHRASES = {
    "Aortic enlargement": "Aortic enlargement",
    "Atelectasis": "Atelectasis",
    "Calcification": "Calcification",
    "Cardiomegaly": "Cardiomegaly",
    "Clavicle fracture": "Clavicle fracture",
    "Consolidation": "Consolidation",
    "Edema": "Edema",
    "Emphysema": "Emphysema",
    "Enlarged PA": "Enlarged pulmonary artery",
    "ILD": "Interstitial lung disease",
    "Infiltration": "Infiltration",
    "Lung Opacity": "Lung Opacity",
    "Lung cavity": "Lung cavity",
    "Lung cyst": "Lung cyst",
    "Mediastinal shift": "Mediastinal shift",
    "Nodule/Mass": "Nodule or mass",
    "Other lesion": "Other lesion",
    "COPD": "Chronic Obstructive Pulmonary Disease.",
    "Lung tumor": "Lung tumor",
    "Pneumonia": "Pneumonia",
    "Pleural effusion": "Pleural effusion",
    "Pleural thickening": "Pleural thickening",
    "Pneumothorax": "Pneumothorax",
    "Pulmonary fibrosis": "Pulmonary fibrosis",
    "Rib fracture": "Rib fracture",
    "Tuberculosis": "Tuberculosis",
    "Other diseases": "Other diseases",
    "No finding": "No finding",
}

# Classes without boxes; all others can be localized.
GLOBAL_CLASSES = [
    "COPD", "Lung tumor", "Pneumonia", "Tuberculosis", "Other diseases", "No finding",
]

# The fourteen report labels and their short names, in label order.
REPORT_LABELS = {
    "Enlarged Cardiomediastinum": "EC",
    "Cardiomegaly": "CM",
    "Lung Opacity": "LO",
    "Lung Lesion": "LL",
    "Edema": "E",
    "Consolidation": "C",
    "Pneumonia": "P",
    "Atelectasis": "A",
    "Pneumothorax": "PT",
    "Pleural Effusion": "PE",
    "Pleural Other": "PO",
    "Fracture": "F",
    "Support Devices": "SD",
    "No Finding": "NF",
}

# Reply schemas: required field -> allowed values (None: any non-blank text,
# "text": any text).
REPLY_SCHEMAS = {
    "pneumonia_triage": {
        "reason": None,
        "has_abnormalities": ["yes", "no", "unknown"],
        "supports_pneumonia": [
            "definitely no", "probably no", "unknown", "probably yes", "definitely yes",
        ],
    },
    "abnormality_device_flags": {
        "reason": None,
        "mentions_abnormalities": ["yes", "no"],
        "mentions_devices": ["yes", "no"],
    },
    "truth_vs_generated": {
        "reason": None,
        "gt_has_abnormalities": ["yes", "no"],
        "gt_has_devices": ["yes", "no"],
        "gen_has_abnormalities": ["yes", "no"],
        "gen_has_devices": ["yes", "no"],
        "gen_has_correct_abnormalities": ["yes", "no"],
        "gen_has_hallucinated_abnormalities": ["yes", "no"],
        "gen_has_correct_devices": ["yes", "no"],
        "gen_has_hallucinated_devices": ["yes", "no"],
        "nli_status": ["contradiction", "entailment", "neutral"],
    },
    "anatomy_mini_report": {"reasoning": "text", "mini-report": "text"},
}

# Hosted model names accepted per provider.
PROVIDER_MODELS = {
    "openai": [
        "gpt-3.5-turbo", "gpt-3.5-turbo-0301", "gpt-3.5-turbo-0613",
        "gpt-3.5-turbo-16k-0613", "gpt-4", "gpt-4-0613", "gpt-4-1106-preview",
        "gpt-4o", "gpt-4o-mini",
    ],
    "gemini": [
        "gemini-2.0-pro", "gemini-2.0-flash", "gemini-2.5-pro-exp-03-25",
        "gemini-2.5-pro-preview-03-25", "gemini-2.5-flash-preview-04-17",
        "gemini-2.5-flash-preview-04-17-thinking", "gemini-2.5-pro-preview-05-06",
        "gemini-2.5-flash-lite-preview-06-17", "gemini-2.5-flash-lite-preview-09-2025",
    ],
}
