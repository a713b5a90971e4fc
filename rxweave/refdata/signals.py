"""Drug to condition evidence used by the condition inference."""

SIGNAL_COLUMNS = [
    "inn", "condition_code", "condition_name", "condition_group",
    "signal_strength", "sensitivity", "specificity", "condition_prevalence",
    "medication_class", "episode_gap_tolerance", "is_prn",
    "min_prescriptions", "requires_speciality",
]

# One row per drug and condition, columns as above.
SIGNALS = [
    ("metformin", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.93, 0.85, 0.90, 0.11, "chronic_oral", 60, False, 1, None),
    ("glimepiride", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.90, 0.70, 0.85, 0.11, "chronic_oral", 60, False, 1, None),
    ("glibenclamide", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.88, 0.65, 0.85, 0.11, "chronic_oral", 60, False, 1, None),
    ("gliclazide", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.88, 0.62, 0.85, 0.11, "chronic_oral", 60, False, 1, None),
    ("sitagliptin", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.87, 0.55, 0.88, 0.11, "chronic_oral", 60, False, 2, None),
    ("vildagliptin", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.87, 0.50, 0.88, 0.11, "chronic_oral", 60, False, 2, None),
    ("dapagliflozin", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.88, 0.45, 0.88, 0.11, "chronic_oral", 60, False, 2, None),
    ("empagliflozin", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.88, 0.40, 0.88, 0.11, "chronic_oral", 60, False, 2, None),
    ("insulin glargine", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.80, 0.40, 0.70, 0.11, "chronic_injectable", 45, False, 1, None),
    ("insulin aspart", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.78, 0.38, 0.68, 0.11, "chronic_injectable", 45, False, 1, None),
    ("insulin soluble", "E11", "Type 2 Diabetes Mellitus", "metabolic", 0.75, 0.35, 0.65, 0.11, "chronic_injectable", 45, False, 1, None),
    ("levothyroxine", "E03", "Hypothyroidism", "metabolic", 0.95, 0.95, 0.97, 0.05, "chronic_oral", 60, False, 1, None),
    ("thyroxine", "E03", "Hypothyroidism", "metabolic", 0.95, 0.95, 0.97, 0.05, "chronic_oral", 60, False, 1, None),
    ("atorvastatin", "E78", "Dyslipidemia", "metabolic", 0.85, 0.80, 0.80, 0.25, "chronic_oral", 60, False, 1, None),
    ("rosuvastatin", "E78", "Dyslipidemia", "metabolic", 0.85, 0.75, 0.80, 0.25, "chronic_oral", 60, False, 1, None),
    ("simvastatin", "E78", "Dyslipidemia", "metabolic", 0.82, 0.70, 0.78, 0.25, "chronic_oral", 60, False, 1, None),
    ("fenofibrate", "E78", "Dyslipidemia", "metabolic", 0.75, 0.55, 0.80, 0.25, "chronic_oral", 60, False, 2, None),
    ("allopurinol", "M10", "Gout / Hyperuricemia", "metabolic", 0.92, 0.85, 0.95, 0.02, "chronic_oral", 60, False, 1, None),
    ("febuxostat", "M10", "Gout / Hyperuricemia", "metabolic", 0.90, 0.70, 0.95, 0.02, "chronic_oral", 60, False, 2, None),
    ("amlodipine", "I10", "Hypertension", "cardiovascular", 0.85, 0.65, 0.75, 0.28, "chronic_oral", 60, False, 1, None),
    ("telmisartan", "I10", "Hypertension", "cardiovascular", 0.90, 0.60, 0.85, 0.28, "chronic_oral", 60, False, 1, None),
    ("ramipril", "I10", "Hypertension", "cardiovascular", 0.82, 0.55, 0.70, 0.28, "chronic_oral", 60, False, 1, None),
    ("losartan", "I10", "Hypertension", "cardiovascular", 0.85, 0.50, 0.80, 0.28, "chronic_oral", 60, False, 1, None),
    ("olmesartan", "I10", "Hypertension", "cardiovascular", 0.85, 0.45, 0.80, 0.28, "chronic_oral", 60, False, 1, None),
    ("metoprolol", "I10", "Hypertension", "cardiovascular", 0.72, 0.55, 0.60, 0.28, "chronic_oral", 60, False, 1, None),
    ("bisoprolol", "I10", "Hypertension", "cardiovascular", 0.72, 0.50, 0.60, 0.28, "chronic_oral", 60, False, 1, None),
    ("hydrochlorothiazide", "I10", "Hypertension", "cardiovascular", 0.70, 0.45, 0.55, 0.28, "chronic_oral", 60, False, 1, None),
    ("clopidogrel", "Z95", "Coronary Artery Disease", "cardiovascular", 0.85, 0.75, 0.90, 0.05, "chronic_oral", 45, False, 1, None),
    ("aspirin", "Z87", "CAD Prophylaxis", "cardiovascular", 0.60, 0.80, 0.45, 0.15, "chronic_oral", 60, False, 1, None),
    ("furosemide", "I50", "Heart Failure", "cardiovascular", 0.72, 0.65, 0.60, 0.02, "chronic_oral", 45, False, 2, "cardiovascular"),
    ("spironolactone", "I50", "Heart Failure", "cardiovascular", 0.70, 0.55, 0.65, 0.02, "chronic_oral", 45, False, 2, "cardiovascular"),
    ("warfarin", "I48", "Atrial Fibrillation / DVT", "cardiovascular", 0.80, 0.70, 0.82, 0.03, "chronic_oral", 45, False, 1, None),
    ("rivaroxaban", "I48", "Atrial Fibrillation / DVT", "cardiovascular", 0.82, 0.65, 0.85, 0.03, "chronic_oral", 45, False, 1, None),
    ("dabigatran", "I48", "Atrial Fibrillation / DVT", "cardiovascular", 0.82, 0.60, 0.85, 0.03, "chronic_oral", 45, False, 1, None),
    ("salbutamol", "J45", "Asthma / COPD", "respiratory", 0.75, 0.85, 0.60, 0.06, "prn", 30, True, 1, None),
    ("montelukast", "J45", "Asthma / Allergic Rhinitis", "respiratory", 0.78, 0.60, 0.75, 0.06, "chronic_oral", 45, False, 1, None),
    ("budesonide", "J45", "Asthma / COPD", "respiratory", 0.82, 0.65, 0.78, 0.06, "chronic_inhaled", 45, False, 2, None),
    ("tiotropium", "J44", "COPD", "respiratory", 0.85, 0.70, 0.85, 0.03, "chronic_inhaled", 45, False, 2, None),
    ("formoterol", "J45", "Asthma / COPD", "respiratory", 0.80, 0.62, 0.78, 0.06, "chronic_inhaled", 45, False, 2, None),
    ("rifampicin", "A15", "Pulmonary Tuberculosis", "infectious", 0.98, 0.98, 0.99, 0.02, "acute_course", 10, False, 1, "pulmonology"),
    ("isoniazid", "A15", "Pulmonary Tuberculosis", "infectious", 0.98, 0.98, 0.99, 0.02, "acute_course", 10, False, 1, "pulmonology"),
    ("pyrazinamide", "A15", "Pulmonary Tuberculosis", "infectious", 0.97, 0.95, 0.99, 0.02, "acute_course", 10, False, 1, "pulmonology"),
    ("ethambutol", "A15", "Pulmonary Tuberculosis", "infectious", 0.97, 0.95, 0.99, 0.02, "acute_course", 10, False, 1, "pulmonology"),
    ("chloroquine", "B54", "Malaria", "infectious", 0.85, 0.80, 0.90, 0.01, "acute_course", 10, False, 1, None),
    ("artemether", "B54", "Malaria", "infectious", 0.90, 0.85, 0.92, 0.01, "acute_course", 7, False, 1, None),
    ("primaquine", "B54", "Malaria", "infectious", 0.85, 0.80, 0.90, 0.01, "acute_course", 7, False, 1, None),
    ("carbamazepine", "G40", "Epilepsy", "neurological", 0.90, 0.55, 0.88, 0.01, "chronic_oral", 45, False, 1, "neurology"),
    ("levetiracetam", "G40", "Epilepsy", "neurological", 0.90, 0.50, 0.90, 0.01, "chronic_oral", 45, False, 1, "neurology"),
    ("valproate", "G40", "Epilepsy", "neurological", 0.88, 0.55, 0.85, 0.01, "chronic_oral", 45, False, 1, "neurology"),
    ("phenytoin", "G40", "Epilepsy", "neurological", 0.88, 0.50, 0.88, 0.01, "chronic_oral", 45, False, 1, "neurology"),
    ("levodopa", "G20", "Parkinson's Disease", "neurological", 0.95, 0.90, 0.98, 0.002, "chronic_oral", 60, False, 1, "neurology"),
    ("pramipexole", "G20", "Parkinson's Disease", "neurological", 0.88, 0.70, 0.90, 0.002, "chronic_oral", 60, False, 2, "neurology"),
    ("topiramate", "G43", "Migraine Prophylaxis", "neurological", 0.82, 0.55, 0.85, 0.01, "chronic_oral", 60, False, 2, None),
    ("sumatriptan", "G43", "Migraine", "neurological", 0.88, 0.80, 0.90, 0.01, "prn", 30, True, 1, None),
    ("sertraline", "F32", "Major Depressive Disorder", "psychiatric", 0.75, 0.45, 0.70, 0.04, "chronic_oral", 60, False, 2, "psychiatry"),
    ("escitalopram", "F32", "Major Depressive Disorder", "psychiatric", 0.75, 0.45, 0.72, 0.04, "chronic_oral", 60, False, 2, "psychiatry"),
    ("fluoxetine", "F32", "Major Depressive Disorder", "psychiatric", 0.72, 0.42, 0.70, 0.04, "chronic_oral", 60, False, 2, "psychiatry"),
    ("olanzapine", "F20", "Schizophrenia / Bipolar", "psychiatric", 0.82, 0.60, 0.85, 0.01, "chronic_oral", 60, False, 2, "psychiatry"),
    ("risperidone", "F20", "Schizophrenia / Bipolar", "psychiatric", 0.82, 0.58, 0.85, 0.01, "chronic_oral", 60, False, 2, "psychiatry"),
    ("lithium", "F31", "Bipolar Affective Disorder", "psychiatric", 0.90, 0.75, 0.95, 0.01, "chronic_oral", 60, False, 2, "psychiatry"),
    ("clonazepam", "F41", "Anxiety Disorder", "psychiatric", 0.70, 0.55, 0.65, 0.04, "prn", 14, True, 1, "psychiatry"),
    ("alprazolam", "F41", "Anxiety Disorder", "psychiatric", 0.65, 0.55, 0.60, 0.04, "prn", 14, True, 1, "psychiatry"),
    ("methotrexate", "M06", "Rheumatoid Arthritis", "rheumatological", 0.88, 0.55, 0.85, 0.01, "periodic", 45, False, 2, "rheumatology"),
    ("hydroxychloroquine", "M05", "Rheumatoid Arthritis / SLE", "rheumatological", 0.78, 0.60, 0.75, 0.01, "chronic_oral", 60, False, 2, "rheumatology"),
    ("sulfasalazine", "M06", "Rheumatoid Arthritis", "rheumatological", 0.82, 0.50, 0.80, 0.01, "chronic_oral", 60, False, 2, "rheumatology"),
    ("sevelamer", "N18", "Chronic Kidney Disease", "renal", 0.85, 0.65, 0.88, 0.01, "chronic_oral", 60, False, 2, "nephrology"),
    ("erythropoietin", "N18", "Chronic Kidney Disease", "renal", 0.90, 0.70, 0.92, 0.01, "periodic", 30, False, 2, "nephrology"),
    ("ibuprofen", "M79", "Musculoskeletal Pain", "musculoskeletal", 0.45, 0.70, 0.35, 0.20, "prn", 7, True, 1, None),
    ("diclofenac", "M79", "Musculoskeletal Pain", "musculoskeletal", 0.45, 0.70, 0.35, 0.20, "prn", 7, True, 1, None),
    ("tramadol", "M79", "Musculoskeletal Pain", "musculoskeletal", 0.50, 0.50, 0.45, 0.20, "acute_course", 7, False, 1, None),
    ("alendronate", "M81", "Osteoporosis", "musculoskeletal", 0.88, 0.70, 0.90, 0.01, "periodic", 45, False, 2, None),
    ("omeprazole", "K21", "GERD / Peptic Ulcer", "gastrointestinal", 0.75, 0.80, 0.65, 0.08, "chronic_oral", 45, False, 1, None),
    ("pantoprazole", "K21", "GERD / Peptic Ulcer", "gastrointestinal", 0.75, 0.80, 0.65, 0.08, "chronic_oral", 45, False, 1, None),
    ("rabeprazole", "K21", "GERD / Peptic Ulcer", "gastrointestinal", 0.75, 0.75, 0.65, 0.08, "chronic_oral", 45, False, 1, None),
    ("mesalazine", "K51", "Inflammatory Bowel Disease", "gastrointestinal", 0.90, 0.75, 0.90, 0.003, "chronic_oral", 45, False, 2, "gastroenterology"),
    ("prednisolone", "K51", "Inflammatory Bowel Disease", "gastrointestinal", 0.65, 0.60, 0.40, 0.003, "acute_course", 14, False, 2, "gastroenterology"),
]

# Defaults for a drug without any signal row.
DEFAULT_GAP_DAYS = 45
DEFAULT_MEDICATION_CLASS = "chronic_oral"
DEFAULT_IS_PRN = False

# Likelihood ratios by (speciality group, condition group).
SPECIALITY_RATIOS = [
    ("metabolic", "metabolic", 1.40),
    ("endocrinolog", "metabolic", 1.35),
    ("cardiovascular", "cardiovascular", 1.30),
    ("respiratory", "respiratory", 1.25),
    ("neurological", "neurological", 1.25),
    ("psychiatric", "psychiatric", 1.20),
    ("rheumatological", "rheumatological", 1.30),
    ("renal", "renal", 1.25),
]

# Constants of the confidence formula.
INACTIVE_WEIGHT = 0.4
DECAY_START_DAYS = 180
DECAY_RATE = 0.005
FULL_CREDIBILITY_RX = 10
LOG_ODDS_EPS = 1e-9
MIN_CONFIDENCE = 0.30
DEFAULT_PREVALENCE = 0.10

# First keyword (in this order) found in a speciality wins.
SPECIALITY_GROUPS = [
    ("endocrinolog", "metabolic"), ("diabetolog", "metabolic"), ("endocrine", "metabolic"),
    ("cardiolog", "cardiovascular"), ("cardiac", "cardiovascular"), ("cardio", "cardiovascular"),
    ("pulmonolog", "respiratory"), ("respirator", "respiratory"), ("chest", "respiratory"), ("pulmo", "respiratory"),
    ("neurolog", "neurological"), ("neuro", "neurological"),
    ("psychiatr", "psychiatric"), ("psycholog", "psychiatric"), ("mental health", "psychiatric"),
    ("rheumatolog", "rheumatological"),
    ("nephrolog", "renal"), ("kidney", "renal"),
    ("general", "general"), ("family", "general"), ("internal", "general"),
]
SPECIALITY_DEFAULT = "general"
