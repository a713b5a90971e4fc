"""Drug and lab safety rules, kept as data."""

RULE_COLUMNS = [
    "rule_name", "drug_inn", "analyte_name", "operator", "threshold_value",
    "threshold_value_max", "flag_match", "gender_specific", "severity",
    "description_template", "management_plan", "is_enabled", "is_deleted", "version",
]

_METFORMIN_TEXT = "Metformin is contraindicated due to elevated Serum Creatinine ({value} {unit} > {threshold} {unit} limit). Significantly elevated risk of Metformin-induced Lactic Acidosis."
_METFORMIN_PLAN = "Discontinue Metformin. Calculate eGFR and consider alternative glycemic agents."
_HYPO_PLAN = "Hold/reduce hypoglycemic drug dosage. Administer fast-acting glucose immediately and counsel patient on hypoglycemia protocols."
_STATIN_PLAN = "Continue lipid-lowering statin therapy. Recheck lipid profile in 6-8 weeks."

# The rules a new installation starts with, columns as above.
BASELINE_RULES = [
    ("Metformin Female Creatinine Contraindication", "metformin", "CREATININE", ">", 1.4, None, None, "female", "critical", _METFORMIN_TEXT, _METFORMIN_PLAN, True, False, 1),
    ("Metformin Male Creatinine Contraindication", "metformin", "CREATININE", ">", 1.5, None, None, "male", "critical", _METFORMIN_TEXT, _METFORMIN_PLAN, True, False, 1),
    ("Levothyroxine Under-dosing Warning", "levothyroxine", "TSH", ">", 4.5, None, None, "both", "warning", "TSH level is elevated ({value} {unit} > {threshold} {unit} range), indicating potential under-dosing. Levothyroxine dose adjustment may be required.", "Re-evaluate thyroid status and consider increasing Levothyroxine dose.", True, False, 1),
    ("Levothyroxine Over-dosing Warning", "levothyroxine", "TSH", "<", 0.4, None, None, "both", "warning", "TSH level is suppressed ({value} {unit} < {threshold} {unit} range), indicating potential over-dosing. Risk of iatrogenic hyperthyroidism.", "Re-evaluate thyroid status and consider reducing Levothyroxine dose.", True, False, 1),
    ("Aspirin Suppressed Hemoglobin Risk", "aspirin", "HEMOGLOBIN", "<", 10.0, None, None, "both", "warning", "Severe anemia detected (Hemoglobin {value} {unit} < {threshold} {unit} normal). Concomitant antiplatelet therapy (Aspirin) significantly elevates gastrointestinal bleeding risks.", "Evaluate anemia source. Consider adding PPIs (e.g. Pantoprazole) for gastroprotection if Aspirin is mandatory.", True, False, 1),
    ("Atorvastatin LDL Efficacy Target", "atorvastatin", "LDL", ">", 100.0, None, None, "both", "info", "LDL cholesterol is elevated ({value} {unit} > {threshold} {unit} target). Evaluating efficacy of active lipid-lowering therapy (Atorvastatin).", _STATIN_PLAN, True, False, 1),
    ("Rosuvastatin LDL Efficacy Target", "rosuvastatin", "LDL", ">", 100.0, None, None, "both", "info", "LDL cholesterol is elevated ({value} {unit} > {threshold} {unit} target). Evaluating efficacy of active lipid-lowering therapy (Rosuvastatin).", _STATIN_PLAN, True, False, 1),
    ("Insulin FBS Hypoglycemia Alert", "insulin", "FASTING_BLOOD_SUGAR", "<", 70.0, None, None, "both", "critical", "Clinical hypoglycemia detected (Fasting Blood Sugar {value} {unit} < {threshold} {unit}). Concomitant hypoglycemic drug therapy (Insulin) poses severe risk of neuroglycopenia or coma.", _HYPO_PLAN, True, False, 1),
    ("Glimepiride FBS Hypoglycemia Alert", "glimepiride", "FASTING_BLOOD_SUGAR", "<", 70.0, None, None, "both", "critical", "Clinical hypoglycemia detected (Fasting Blood Sugar {value} {unit} < {threshold} {unit}). Concomitant hypoglycemic drug therapy (Glimepiride) poses severe risk of neuroglycopenia or coma.", _HYPO_PLAN, True, False, 1),
    ("Metformin Elevated HbA1c control check", "metformin", "HBA1C", ">", 8.0, None, None, "both", "warning", "Poor glycemic control detected (HbA1c {value}% > {threshold}%). Patient is under active pharmacotherapy (Metformin). Dose escalation or therapeutic intensification is indicated.", "Evaluate patient adherence, titrate active medications, or consider dual/triple combination oral therapy.", True, False, 1),
    ("Aspirin Thrombocytopenia Bleeding Check", "aspirin", "PLATELET_COUNT", "<", 100.0, None, None, "both", "critical", "Significant thrombocytopenia detected (Platelets {value} {unit}). Active antiplatelet therapy (Aspirin) significantly increases severe hemorrhagic risks.", "Hold antiplatelet agent. Investigate etiology of thrombocytopenia. Monitor patient for clinical bleeding signs.", True, False, 1),
    ("Ramipril Creatinine AKI Check", "ramipril", "CREATININE", ">", 1.4, None, None, "both", "warning", "Concomitant RAS blocker (Ramipril) with elevated Serum Creatinine ({value} {unit} > {threshold} {unit}). Risk of acute kidney injury (AKI) or severe hyperkalemia.", "Monitor renal functions and serum potassium. Consider temporary discontinuation or dose reduction of RAS inhibitor.", True, False, 1),
    ("Atorvastatin TG Persistent Dyslipidemia", "atorvastatin", "TRIGLYCERIDES", ">", 200.0, None, None, "both", "info", "Persistent hypertriglyceridemia detected ({value} {unit} > 150 mg/dL normal) under active lipid-lowering therapy (Atorvastatin).", "Evaluate dietary habits. Consider optimization of statin dose or adding Omega-3 fatty acids/Fibrates if clinically indicated.", True, False, 1),
    ("Aspirin Mild Anemia Combined Bleeding Risk", "aspirin", "HEMOGLOBIN", "between", 10.0, 11.5, None, "both", "info", "Mild anemia detected (Hemoglobin {value} {unit}). Evaluating bleeding risk for patient taking antiplatelet agent (Aspirin).", "Monitor complete blood count regularly. Assess patient for occult gastrointestinal blood loss.", True, False, 1),
    ("Methotrexate TLC Myelosuppression Check", "methotrexate", "TLC", "<", 4.0, None, None, "both", "critical", "Leucopenia detected (Total Leucocyte Count {value} {unit} < {threshold}). Active myelosuppressive agent (Methotrexate) poses severe risk of neutropenic sepsis.", "Hold myelosuppressive agent. Perform urgent differential count. Counsel patient on immediately reporting fever/chills.", True, False, 1),
    ("Methotrexate Neutrophils Myelosuppression Check", "methotrexate", "NEUTROPHILS", "<", 40.0, None, None, "both", "warning", "Relative neutropenia detected (Neutrophils {value}% < {threshold}% range) with active myelosuppressive therapy (Methotrexate).", "Monitor absolute neutrophil count (ANC). Suspend myelosuppressive agent if ANC falls below 1500 cells/uL.", True, False, 1),
]

# Drug sets of the built-in fallback rules.
STATINS = ["atorvastatin", "rosuvastatin", "simvastatin", "pravastatin", "pitavastatin", "fluvastatin", "lovastatin"]
FALLBACK_DRUGS = {
    1: ["metformin"],
    2: ["levothyroxine"],
    3: ["aspirin"],
    4: STATINS,
    5: ["insulin", "glimepiride", "gliclazide", "glipizide"],
    6: ["metformin", "insulin", "glimepiride", "gliclazide", "sitagliptin", "empagliflozin", "pioglitazone"],
    7: ["aspirin", "clopidogrel"],
    8: ["ramipril", "enalapril", "lisinopril", "telmisartan", "losartan", "valsartan"],
    9: STATINS,
    10: ["aspirin", "clopidogrel"],
    11: ["methotrexate", "azathioprine"],
}

# One row per outcome of a fallback rule. A row holds when every bound that is
# set holds (value > gt, >= ge, < lt, <= le) and the band fits; the lowest
# branch that holds is the rule's outcome for the patient.
FALLBACK_COLUMNS = [
    "rule_id", "branch", "analyte_name", "band", "gt", "ge", "lt", "le", "severity",
    "decimals", "default_unit", "default_range", "description_template", "value_template", "management",
]
_R1 = "Metformin is contraindicated due to elevated Serum Creatinine ({value} {unit} > %s {unit} limit). Significantly elevated risk of Metformin-induced Lactic Acidosis."
_R7 = "Significant thrombocytopenia detected (Platelets {value} {unit}). Active antiplatelet therapy ({drug}) significantly increases severe hemorrhagic risks."
_R7_PLAN = "Hold antiplatelet agent. Investigate etiology of thrombocytopenia. Monitor patient for clinical bleeding signs."
_VU = "{value} {unit}"

# Thresholds, severities, default units, ranges and texts.
FALLBACK_RULES = [
    (1, 1, "CREATININE", "female", 1.5, None, None, None, "critical", 2, "mg/dL", "0.6 - 1.2 mg/dL", _R1 % "1.4", _VU, _METFORMIN_PLAN),
    (1, 2, "CREATININE", "female", 1.4, None, None, 1.5, "warning", 2, "mg/dL", "0.6 - 1.2 mg/dL", _R1 % "1.4", _VU, _METFORMIN_PLAN),
    (1, 3, "CREATININE", "male", 1.5, None, None, None, "critical", 2, "mg/dL", "0.6 - 1.2 mg/dL", _R1 % "1.5", _VU, _METFORMIN_PLAN),
    (1, 4, "CREATININE", "male", 1.4, None, None, 1.5, "warning", 2, "mg/dL", "0.6 - 1.2 mg/dL", _R1 % "1.5", _VU, _METFORMIN_PLAN),
    (2, 1, "TSH", "both", 4.5, None, None, None, "warning", 2, "uIU/mL", "0.4 - 4.5 uIU/mL", "TSH level is elevated ({value} {unit} > 4.5 uIU/mL range), indicating potential under-dosing. Levothyroxine dose adjustment may be required.", _VU, "Re-evaluate thyroid status and consider increasing Levothyroxine dose."),
    (2, 2, "TSH", "both", None, None, 0.4, None, "warning", 2, "uIU/mL", "0.4 - 4.5 uIU/mL", "TSH level is suppressed ({value} {unit} < 0.4 uIU/mL range), indicating potential over-dosing. Risk of iatrogenic hyperthyroidism.", _VU, "Re-evaluate thyroid status and consider reducing Levothyroxine dose."),
    (3, 1, "HEMOGLOBIN", "both", None, None, 10.0, None, "warning", 1, "g/dL", "12.0 - 16.0 g/dL", "Severe anemia detected (Hemoglobin {value} {unit} < 11.5 g/dL normal). Concomitant antiplatelet therapy (Aspirin) significantly elevates gastrointestinal bleeding risks.", _VU, "Evaluate anemia source. Consider adding PPIs (e.g. Pantoprazole) for gastroprotection if Aspirin is mandatory."),
    (4, 1, "LDL", "both", 100.0, None, None, None, "info", 1, "mg/dL", "< 100 mg/dL", "LDL cholesterol is elevated ({value} {unit} > 100 mg/dL target). Evaluating efficacy of active lipid-lowering therapy ({drug}).", _VU, _STATIN_PLAN),
    (5, 1, "FASTING_BLOOD_SUGAR", "both", None, None, 70.0, None, "critical", 1, "mg/dL", "70 - 100 mg/dL", "Clinical hypoglycemia detected (Fasting Blood Sugar {value} {unit} < 70 mg/dL). Concomitant hypoglycemic drug therapy ({drug}) poses severe risk of neuroglycopenia or coma.", _VU, _HYPO_PLAN),
    (6, 1, "HBA1C", "both", 8.0, None, None, None, "warning", 1, "%", "< 5.7 %", "Poor glycemic control detected (HbA1c {value}% > 8.0%). Patient is under active pharmacotherapy ({drug}). Dose escalation or therapeutic intensification is indicated.", "{value}%", "Evaluate patient adherence, titrate active medications, or consider dual/triple combination oral therapy."),
    (7, 1, "PLATELET_COUNT", "both", None, None, 100.0, None, "critical", 1, "x10^3/uL", "150 - 450 x10^3/uL", _R7, _VU, _R7_PLAN),
    (7, 2, "PLATELET_COUNT", "both", None, 1000.0, 100000.0, None, "critical", 1, "x10^3/uL", "150 - 450 x10^3/uL", _R7, _VU, _R7_PLAN),
    (8, 1, "CREATININE", "both", 1.4, None, None, None, "warning", 2, "mg/dL", "0.6 - 1.2 mg/dL", "Concomitant RAS blocker ({drug}) with elevated Serum Creatinine ({value} {unit}). Risk of acute kidney injury (AKI) or severe hyperkalemia.", _VU, "Monitor renal functions and serum potassium. Consider temporary discontinuation or dose reduction of RAS inhibitor."),
    (9, 1, "TRIGLYCERIDES", "both", 200.0, None, None, None, "info", 1, "mg/dL", "< 150 mg/dL", "Persistent hypertriglyceridemia detected ({value} {unit} > 150 mg/dL normal) under active lipid-lowering therapy ({drug}).", _VU, "Evaluate dietary habits. Consider optimization of statin dose or adding Omega-3 fatty acids/Fibrates if clinically indicated."),
    (10, 1, "HEMOGLOBIN", "both", None, 10.0, 11.5, None, "info", 1, "g/dL", "12.0 - 16.0 g/dL", "Mild anemia detected (Hemoglobin {value} {unit}). Evaluating bleeding risk for patient taking antiplatelet agent ({drug}).", _VU, "Monitor complete blood count regularly. Assess patient for occult gastrointestinal blood loss."),
    (11, 1, "TLC", "both", None, None, 4.0, None, "critical", 2, "10^3/uL", "4.0 - 11.0 10^3/uL", "Leucopenia detected (Total Leucocyte Count {value} {unit} < 4.0). Active myelosuppressive agent ({drug}) poses severe risk of neutropenic sepsis.", _VU, "Hold myelosuppressive agent. Perform urgent differential count. Counsel patient on immediately reporting fever/chills."),
    (11, 2, "NEUTROPHILS", "both", None, None, 40.0, None, "warning", 1, "%", "40.0 - 70.0 %", "Relative neutropenia detected (Neutrophils {value}% < 40.0% range) with active myelosuppressive therapy ({drug}).", "{value}%", "Monitor absolute neutrophil count (ANC). Suspend myelosuppressive agent if ANC falls below 1500 cells/uL."),
]

# A reference range holding this text marks the female band.
FEMALE_RANGE_MARK = "0.5"
DEFAULT_GENDER = "both"
DEFAULT_SEVERITY = "warning"
