"""Fields and word lists of the annotated training texts."""

# Header fields of an annotation, in text order.
ANNOTATION_FIELDS = [
    "doctor_name", "clinic_name", "clinic_address", "patient_name", "patient_age",
    "patient_gender", "date", "diagnosis", "medications", "signature",
]

# Frequency phrases, first one contained in the text wins.
FREQUENCY_PER_DAY = [
    ("once daily", 1), ("od", 1), ("every 24 hours", 1), ("every 12 hours", 2),
    ("twice daily", 2), ("bd", 2), ("bid", 2), ("three times daily", 3), ("tds", 3),
    ("tid", 3), ("four times daily", 4), ("qds", 4), ("qid", 4), ("as needed", 0),
    ("sos", 0), ("prn", 0),
]

# First words of an instruction item (not a drug).
INSTRUCTION_STARTS = [
    "after", "as", "at", "before", "every", "for", "if", "in", "on", "once",
    "take", "three", "twice", "with",
]
ANNOTATION_DOSAGE_PATTERN = (
    r"(?i)([A-Za-z][A-Za-z0-9 ./'-]*?)\s+(\d+(?:\.\d+)?)\s*"
    r"(mg|mcg|ml|g|iu|units?|puffs?|drops?)\b"
)
ANNOTATION_REG_PATTERN = r"(?i)\b(?:mci|reg|nmc)[\s.:-]*([A-Z0-9/-]+)"
TASK_TOKEN_PATTERN = r"</?s(?:_ocr)?>"

# Clinical fields of a training record.
CLINICAL_FIELDS = [
    "doctor_name", "doctor_reg", "clinic_name", "patient_name", "patient_age",
    "patient_gender", "prescription_date", "diagnosis",
]
TARGET_START = "<s_rx>"
TARGET_END = "</s>"
IMAGE_SUFFIXES = ["png", "jpg", "jpeg"]

# Defaults of model and service payloads.
MODEL_CONFIDENCE = 0.75
SERVICE_CONFIDENCE = 0.8
MODEL_MODE = "local_donut_ml"
SERVICE_MODE = "gemini_hybrid_image_and_text"
RULES_MODE = "tesseract_ner_fallback"
ANALYTE_DEFAULT = "OTHER"

# Thresholds of the evaluation.
STRICT_FREQUENCY_RATIO = 0.7
RELAXED_RATIO = 0.5
RELAXED_DOSE_GAP = 0.1
SET_RATIO = 0.8
BEST_RATIO = 0.5
PREFER_MARGIN = 0.20
