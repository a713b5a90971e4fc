"""Lab analytes: line patterns, units, ranges and flag limits."""

ANALYTE_COLUMNS = ["rule_order", "analyte_name", "pattern", "unit", "ref_range", "low_below", "high_above", "high_from"]

# Fixed values. A value is low when < low_below, high when > high_above or
# >= high_from, else normal.
ANALYTES = [
    (1, "HBA1C", r"\bhba1c\b|\bglycated\s+hemoglobin\b|\bglyco\s+hemoglobin\b", "%", "< 5.7 %", None, None, 5.7),
    (2, "FASTING_BLOOD_SUGAR", r"\bfasting\s+blood\s+sugar\b|\bfasting\s+glucose\b|\bfbs\b", "mg/dL", "70 - 100 mg/dL", 70.0, 100.0, None),
    (3, "CREATININE", r"\bserum\s+creatinine\b|\bs\.?\s*creatinine\b|\bcreatinine\b", "mg/dL", "0.6 - 1.2 mg/dL", 0.5, 1.3, None),
    (4, "HEMOGLOBIN", r"\bhemoglobin\b|\bhaemoglobin\b", "g/dL", "M: 13-17 / F: 12-16 g/dL", 12.0, 17.0, None),
    (5, "TSH", r"\btsh\b|\bthyroid\s+stimulating\s+hormone\b", "uIU/mL", "0.4 - 4.5 uIU/mL", 0.4, 4.5, None),
    (6, "LDL", r"\bldl\b|\bldl\s+cholesterol\b|\blow\s+density\s+lipoprotein\b", "mg/dL", "< 100 mg/dL", None, 100.0, None),
    (7, "HDL", r"\bhdl\b|\bhdl\s+cholesterol\b|\bhigh\s+density\s+lipoprotein\b", "mg/dL", "40 - 60 mg/dL", 40.0, None, None),
    (8, "TRIGLYCERIDES", r"\btriglycerides\b|\btriglyceride\b", "mg/dL", "< 150 mg/dL", None, 150.0, None),
    (9, "PCV", r"\bpcv\b|\bpacked\s+cell\s+volume\b|\bhaematocrit\b|\bhematocrit\b", "%", "M: 40-50 / F: 36-46 %", 36.0, 50.0, None),
    (10, "RBC_COUNT", r"\brbc\s+count\b|\bred\s+blood\s+cell\s+count\b|\berythrocyte\s+count\b", "mill/mm3", "M: 4.5-5.5 / F: 4.0-5.0 mill/mm3", 4.0, 5.5, None),
    (11, "MCV", r"\bmcv\b|\bmean\s+corpuscular\s+volume\b", "fL", "80 - 100 fL", 80.0, 100.0, None),
    (12, "MCH", r"\bmch\b(?!c)|\bmean\s+corpuscular\s+hemoglobin\b(?!\s+conc)", "pg", "27 - 32 pg", 27.0, 32.0, None),
    (13, "MCHC", r"\bmchc\b|\bmean\s+corpuscular\s+hemoglobin\s+conc", "g/dL", "32 - 36 g/dL", 32.0, 36.0, None),
    (14, "RDW", r"\brdw\b|\bred\s+cell\s+distribution\s+width\b", "%", "11.5 - 14.5 %", 11.5, 14.5, None),
    (15, "TLC", r"\btlc\b|\btotal\s+leukocyte\s+count\b|\bwbc\s+count\b|\bwhite\s+blood\s+cell\s+count\b", "thou/mm3", "4.0 - 10.0 thou/mm3", 4.0, 10.0, None),
    (16, "PLATELET_COUNT", r"\bplatelet\s+count\b|\bplatelets\b|\bthrombocyte\s+count\b", "thou/mm3", "150 - 450 thou/mm3", 150.0, 450.0, None),
    (17, "NEUTROPHILS", r"\bneutrophils?\b|\bsegmented\s+neutrophils?\b", "%", "40 - 80 %", 40.0, 80.0, None),
    (18, "LYMPHOCYTES", r"\blymphocytes?\b", "%", "20 - 40 %", 20.0, 40.0, None),
]

# Lab names, date, range and threshold patterns of a report.
LAB_NAME_PATTERN = r"(?i)(apollo\s+diagnostics|srl\s+diagnostics|lal\s+pathlabs|thyrocare|metropolis|care\s+clinic|lorem\s+ipsum\s+lab)"
LAB_NAME_DEFAULT = "Unknown Diagnostics"
LAB_DATE_PATTERN = r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b|\b(\d{1,2}[/-][A-Za-z]{3}[/-]\d{2,4})\b"
LAB_DATE_WORDS = ["date", "report"]
RANGE_PATTERN = r"[\(\[\s]*\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?[\)\]\s]*"
THRESHOLD_PATTERN = r"[<>]\s*\d+(?:\.\d+)?"
VALUE_PATTERN = r"\b(\d+(?:\.\d+)?)\b"

# Confidence penalties and routing texts of a lab report.
NO_DATE_PENALTY = 0.15
NO_RESULT_PENALTY = 0.50
REASON_NO_DATE = "Missing report date."
REASON_NO_RESULTS = "No analytes detected."
REASON_LOW_CONFIDENCE = "Lab report confidence below threshold."
