"""Word lists and patterns for reading prescription text (Java regex syntax)."""

import re
from collections.abc import Iterable

# First entry found, in this order, gives the frequency. Columns:
# whole words, shapes that need only a word end, text, times per day.
FREQUENCY_WORDS = [
    (r"qds|qid|four\s+times\s+(?:daily|a\s+day)", r"1[-–]1[-–]1[-–]1", "four times daily", 4),
    (r"tds|tid|three\s+times\s+(?:daily|a\s+day)", r"1[-–]1[-–]1|morning\s+afternoon\s+night", "three times daily", 3),
    (r"ac|before\s+meals?", None, "before meals", 3),
    (r"pc|after\s+meals?", None, "after meals", 3),
    (r"bd|bid|twice\s+(?:daily|a\s+day)", r"1[-–]0[-–]1|morning\s+and\s+night", "twice daily", 2),
    (r"hs|at\s+bedtime|night\s+only", r"0[-–]0[-–]1", "at bedtime", 1),
    (r"om|every\s+morning|morning\s+only", r"(?<!\d)1[-–]0[-–]0", "every morning", 1),
    (r"on|every\s+night", None, "every night", 1),
    (r"od|qd|once\s+(?:daily|a\s+day)", None, "once daily", 1),
    (r"sos|prn|as\s+needed|if\s+required", None, "as needed", 0),
    (r"stat|immediately|at\s+once", None, "immediately", 0),
]


def _frequency_pattern(words: list[str], shapes: list[str]) -> str:
    """One word-start test for all words keeps the patterns cheap."""
    tail = "|(?:" + "|".join(shapes) + r")\b" if shapes else ""
    return r"(?i)\b(?:" + "|".join(words) + r")\b" + tail


FREQUENCIES = [(_frequency_pattern([w], [s] if s else []), text, rate) for w, s, text, rate in FREQUENCY_WORDS]
ANY_FREQUENCY = _frequency_pattern([w for w, _, _, _ in FREQUENCY_WORDS], [s for _, s, _, _ in FREQUENCY_WORDS if s])


def _first_letters(words: Iterable[str]) -> str:
    """A test that only looks at the next letter, before all words are tried."""
    return "(?=[" + "".join(dict.fromkeys(w[0] for w in words)) + "])"


def _word_lists(pattern: str) -> list[list[str]]:
    """The alternatives of a pattern as lists of words, without optional letters and inner groups."""
    return [a.split(r"\s+") for a in re.sub(r"\(\?[^)]*\)|\w\?", "", pattern).split("|")]


_WRITTEN = [a for w, s, _, _ in FREQUENCY_WORDS for x in (w, s) if x for a in _word_lists(x)]
_ONE_WORD = [a[0] for a in _WRITTEN if len(a) == 1 and a[0].isalpha()]
#: Frequencies of one whole word: taking one out neither makes nor breaks another.
ONE_WORD_FREQUENCY = r"(?i)\b" + _first_letters(_ONE_WORD) + "(?:" + "|".join(_ONE_WORD) + r")\b"
_PHRASE_ENDS = list(dict.fromkeys([w for w in a if w][-1] for a in _WRITTEN if len(a) > 1))
#: The last word of each longer frequency.
PHRASE_PATTERN = r"(?i)\b" + _first_letters(_PHRASE_ENDS) + "(?:" + "|".join(_PHRASE_ENDS) + ")"
#: ASCII without control characters and without the one unit that a letter may follow.
PLAIN_PATTERN = r"^[ -$&-~]*\z"

# Written unit (with common misreadings) to unit.
UNITS = {
    "mg": "mg", "milligrams": "mg", "milligram": "mg",
    "my": "mg", "mq": "mg", "m9": "mg", "mo": "mg", "rng": "mg",
    "mcg": "mcg", "micrograms": "mcg", "microgram": "mcg", "ug": "mcg",
    "ml": "ml", "millilitres": "ml", "milliliters": "ml", "cc": "ml",
    "mi": "ml", "rnl": "ml",
    "g": "g", "gm": "g", "gram": "g", "grams": "g",
    "iu": "iu", "units": "units", "unit": "units",
    "meq": "meq",
    "drops": "drops", "drop": "drops",
    "puffs": "puffs", "puff": "puffs",
    "%": "%",
}
IMPLIED_UNIT = "mg"

# Longer spellings go first so that "mcg" is not read as "m" + "cg".
DOSAGE_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*" + _first_letters(UNITS) + "(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b"

# Letters misread for digits (pattern, replacement).
DIGIT_FIXES = [
    (r"(?<![A-Za-z])[Zz](\d)", "2$1"),
    (r"(?<![A-Za-z])[lI](\d)", "1$1"),
    (r"(\d)[O](\d)", "$10$2"),
]
#: Found wherever one of them applies.
MISREAD_DIGIT = r"[ZzlIO]\d"

# Duration unit to days, first hit in this order.
DURATIONS = [
    (r"(?i)(\d+)\s*days?\b", 1),
    (r"(?i)(\d+)\s*weeks?\b", 7),
    (r"(?i)(\d+)\s*months?\b", 30),
]

ANY_DURATION = r"(?i)\d+\s*(?:days?|weeks?|months?)\b"
DURATION_WORDS = ["day", "week", "month"]

#: A longer duration, a century, is a misread number and counts as none.
LONGEST_DURATION = 36_500

# Line prefixes that name a drug form (with cut-off variants).
FORM_PATTERN = (
    r"(?i)^\s*(?:tab\.?|cap\.?|syp\.?|syr\.?|inj\.?|susp\.?|oint\.?|drops?|cream|gel|patch|liq\.?|sol\.?|pwd\.?"
    r"|ab\.?|ap\.?|nj\.?|yp\.?|yr\.?)\s+"
)
NUMBERED_PATTERN = r"^\s*\d+[.)]\s+(?=\w)"
BARE_LABEL_PATTERN = r"^\s*\d+\s+[A-Za-z]"

# Words that mark a line as something other than a medication.
NON_MEDICATION_PATTERN = (
    r"(?i)\b(patient|doctor|hospital|clinic|date|age|sex|address|name|reg|"
    r"diagnosis|dx|rx|signature|stamp|phone|tel|mob|email|fax|"
    r"dept|department|ref|referred|refill|conducted|test|tast|disp|dispensed|"
    r"sig|directions|instructions|note|advised|collected|reported)\b"
)

# Drug names recognised without dose, form or frequency.
KNOWN_DRUGS = [
    "acetaminophen", "paracetamol", "ibuprofen", "aspirin", "naproxen",
    "diclofenac", "nimesulide", "mefenamic", "indomethacin", "celecoxib",
    "etoricoxib", "tramadol", "codeine", "morphine", "pentazocine",
    "amoxicillin", "amoxyclav", "augmentin", "ciprofloxacin", "levofloxacin",
    "ofloxacin", "azithromycin", "clarithromycin", "erythromycin", "doxycycline",
    "metronidazole", "tinidazole", "cefalexin", "cefixime", "ceftriaxone",
    "cefpodoxime", "norfloxacin", "moxifloxacin", "fluconazole", "itraconazole",
    "amlodipine", "nifedipine", "lisinopril", "ramipril", "enalapril",
    "captopril", "losartan", "telmisartan", "olmesartan", "valsartan",
    "atenolol", "metoprolol", "propranolol", "bisoprolol", "nebivolol",
    "carvedilol", "furosemide", "hydrochlorothiazide", "spironolactone",
    "torsemide", "indapamide",
    "metformin", "glibenclamide", "glimepiride", "gliclazide", "glipizide",
    "sitagliptin", "vildagliptin", "saxagliptin", "linagliptin", "alogliptin",
    "empagliflozin", "dapagliflozin", "canagliflozin",
    "atorvastatin", "rosuvastatin", "simvastatin", "pravastatin",
    "levothyroxine", "liothyronine",
    "pantoprazole", "omeprazole", "esomeprazole", "rabeprazole", "lansoprazole",
    "domperidone", "ondansetron", "metoclopramide", "ranitidine",
    "prednisolone", "prednisone", "dexamethasone", "methylprednisolone",
    "betamethasone", "hydrocortisone",
    "sertraline", "fluoxetine", "escitalopram", "paroxetine",
    "clonazepam", "alprazolam", "diazepam", "lorazepam",
    "olanzapine", "risperidone", "quetiapine", "haloperidol", "clozapine",
    "venlafaxine", "duloxetine", "mirtazapine", "amitriptyline",
    "gabapentin", "pregabalin", "phenytoin", "carbamazepine",
    "levetiracetam", "valproate", "lithium",
    "warfarin", "heparin", "enoxaparin", "rivaroxaban", "apixaban", "dabigatran",
    "clopidogrel",
    "cholecalciferol", "calcitriol", "mecobalamin", "folic",
    "salbutamol", "ipratropium", "theophylline", "montelukast",
    "tamsulosin", "finasteride", "dutasteride",
    "isoniazid", "rifampicin", "pyrazinamide", "ethambutol",
    "tenofovir", "lamivudine", "efavirenz", "nevirapine", "dolutegravir",
]
KNOWN_DRUGS_PATTERN = r"(?i)\b(" + "|".join(sorted(KNOWN_DRUGS, key=len, reverse=True)) + r")\b"

# Header fields of a prescription.
REGISTRATION_PATTERN = r"(?i)(?:mci|nmc|reg(?:istration)?|regd?)[\s.:/#]*([A-Z0-9/-]{4,20})"
AGE_PATTERN = r"(?i)(?:age|aged?)[:\s]*(\d{1,3})\s*(?:yrs?|years?|y\.?)?|(\d{1,3})\s*(?:yrs?|years?)"
_MONTHS = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?"
    r"|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
DATE_PATTERN = (
    r"(?i)\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"
    r"|\b(\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"
    r"|\b(" + _MONTHS + r"[\s.]+\d{1,2}[,\s]+\d{4})\b"
    r"|\b(\d{1,2}[\s.]+" + _MONTHS + r"[\s.,]+\d{4})\b"
)
DIAGNOSIS_PATTERN = r"(?i)(?:diagnosis|dx|d/x)[:\s]+([A-Za-z0-9 ,/()-]{3,60})"

# Routes of administration.
_ROUTE_WORDS = (
    r"oral|po|iv|im|sc|topical|sublingual|sl|rectal|inhaled?|transdermal|nasal"
    r"|ophthalmic|ophth|eye\s+drops?|ear\s+drops?|otic|intraocular"
    r"|intramuscular|intravenous|subcutaneous"
)
ROUTE_PATTERN = r"(?i)\b" + _first_letters(_ROUTE_WORDS.split("|")) + "(" + _ROUTE_WORDS + r")\b"
ROUTES = {
    "oral": "oral", "po": "oral",
    "iv": "iv", "intravenous": "iv",
    "im": "im", "intramuscular": "im",
    "sc": "sc", "subcutaneous": "sc",
    "topical": "topical",
    "sublingual": "sublingual", "sl": "sublingual",
    "rectal": "rectal",
    "inhaled": "inhaled", "inhale": "inhaled",
    "transdermal": "transdermal",
    "nasal": "nasal",
    "ophthalmic": "ophthalmic", "ophth": "ophthalmic",
    "intraocular": "ophthalmic", "eye drops": "ophthalmic", "eye drop": "ophthalmic",
    "ear drops": "otic", "ear drop": "otic", "otic": "otic",
}
DEFAULT_ROUTE = "oral"

# Confidence formula and routing of a prescription.
CONFIDENCE_WITH_MEDS = 0.40
CONFIDENCE_WITHOUT_MEDS = -0.30
CONFIDENCE_REGISTRATION = 0.20
CONFIDENCE_DIAGNOSIS = 0.20
CONFIDENCE_DATE = 0.10
CONFIDENCE_AGE = 0.10
CONFIDENCE_SHORT_NAMES = -0.10
SHORT_NAME_LENGTH = 4
REVIEW_THRESHOLD = 0.5
AUDIT_CONFIDENCE_CAP = 0.45
ACTIVE_WINDOW_DAYS = 90
HISTORY_LIMIT = 50

# Name cleaning and fuzzy brand lookup.
CLEAN_FORM_PATTERN = r"^(tab\.?|cap\.?|syp\.?|inj\.?|susp\.?)\s*"
CLEAN_DOSAGE_PATTERN = r"\s*\d+(\.\d+)?\s*(mg|mcg|ml|g|iu|units?)\b.*$"
FUZZY_RATIO = 0.82
FUZZY_CANDIDATES = 3
FUZZY_EDITS = 2
FUZZY_MIN_LENGTH = 3

# Date formats accepted when a document is stored. Two-digit
# years and month names are included so that no accepted text turns NULL.
DATE_FORMATS = ["d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "yyyy/M/d", "d/M/yy", "d-M-yy", "d-MMM-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
