"""Drug interaction knowledge, kept as data and loaded as small broadcast tables."""

# Pairs, severities, texts and source labels an interaction
# report must carry. Columns: drug, drug, severity, description, management.
PAIR_SOURCE = "CRITICAL_DDI_DB"
PAIRS = [
    ("warfarin", "ibuprofen", "major", "NSAIDs inhibit platelet function and may cause GI bleeding. Combined with warfarin's anticoagulant effect, risk of serious/fatal bleeding is significantly increased.", "Avoid combination. If unavoidable, monitor INR closely and use lowest NSAID dose for shortest duration. Consider PPI co-prescription."),
    ("warfarin", "diclofenac", "major", "Diclofenac inhibits platelet aggregation and may displace warfarin from protein binding sites, increasing anticoagulation effect and bleeding risk.", "Avoid combination. Monitor INR frequently if used together."),
    ("warfarin", "naproxen", "major", "Naproxen combined with warfarin significantly increases bleeding risk via platelet inhibition and GI mucosal irritation.", "Avoid. Use paracetamol for analgesia if anticoagulation required."),
    ("warfarin", "nimesulide", "major", "Nimesulide (commonly prescribed in India) inhibits COX-2 but also affects platelet function; increases warfarin's bleeding effect.", "Avoid combination."),
    ("warfarin", "celecoxib", "major", "COX-2 inhibitors can increase warfarin plasma levels via CYP2C9 inhibition. Bleeding risk elevated.", "Monitor INR closely. Avoid if possible."),
    ("warfarin", "aspirin", "major", "Aspirin inhibits platelet aggregation and may increase free warfarin levels. Combined use dramatically increases bleeding risk, particularly GI and intracranial.", "Avoid unless specifically indicated (e.g., mechanical heart valve). If used, limit aspirin to ≤100mg/day and co-prescribe PPI."),
    ("metformin", "iodinated contrast", "major", "Contrast-induced nephropathy may reduce metformin excretion leading to life-threatening lactic acidosis.", "Hold metformin 48 hours before and after iodinated contrast. Restart only after renal function confirmed normal."),
    ("sertraline", "tramadol", "major", "Tramadol inhibits serotonin reuptake and has weak opioid activity. Combined with SSRIs, risk of serotonin syndrome: agitation, hyperthermia, tachycardia, rigidity. Can be fatal.", "Avoid. Use alternative opioid or analgesic. If must use, start at lowest dose and monitor closely."),
    ("fluoxetine", "tramadol", "major", "Fluoxetine + tramadol: high serotonin syndrome risk. Fluoxetine also inhibits CYP2D6, increasing tramadol plasma levels.", "Avoid combination. Use non-serotonergic analgesic alternative."),
    ("escitalopram", "tramadol", "major", "Escitalopram + tramadol: serotonin syndrome risk and potential QT prolongation.", "Avoid. If pain management required, use non-serotonergic analgesic."),
    ("paroxetine", "tramadol", "major", "Paroxetine is a potent CYP2D6 inhibitor — dramatically increases tramadol exposure. Serotonin syndrome risk.", "Contraindicated. Use alternative."),
    ("sildenafil", "glyceryl trinitrate", "major", "Both sildenafil and nitrates cause vasodilation. Combination can produce severe, potentially fatal hypotension.", "CONTRAINDICATED. Sildenafil must not be used within 24 hours of any nitrate. Tadalafil requires 48-hour window."),
    ("sildenafil", "isosorbide mononitrate", "major", "Sildenafil + isosorbide mononitrate: potentially fatal hypotension. Absolute contraindication.", "CONTRAINDICATED."),
    ("methotrexate", "ibuprofen", "major", "NSAIDs reduce renal clearance of methotrexate, causing life-threatening methotrexate toxicity (bone marrow suppression, hepatotoxicity, mucositis).", "Avoid. If NSAID needed, hold methotrexate, use with extreme caution, monitor CBC and LFTs."),
    ("methotrexate", "diclofenac", "major", "Diclofenac + methotrexate: reduced renal methotrexate elimination → toxicity.", "Avoid combination."),
    ("methotrexate", "naproxen", "major", "Naproxen inhibits methotrexate renal tubular secretion → accumulation and toxicity.", "Avoid. If unavoidable, reduce methotrexate dose and monitor closely."),
    ("methotrexate", "aspirin", "major", "Aspirin competes with methotrexate for renal tubular secretion. Methotrexate toxicity risk.", "Avoid combination in rheumatoid arthritis / oncology settings."),
    ("simvastatin", "clarithromycin", "moderate", "Clarithromycin inhibits CYP3A4, the primary metabolic pathway for simvastatin. Plasma simvastatin levels rise up to 10-fold → rhabdomyolysis risk.", "AVOID simvastatin + clarithromycin. Switch to pravastatin or rosuvastatin (not CYP3A4-metabolised)."),
    ("atorvastatin", "clarithromycin", "moderate", "Clarithromycin (CYP3A4 inhibitor) increases atorvastatin exposure 2-3 fold. Myopathy and rhabdomyolysis risk.", "Use lowest atorvastatin dose during clarithromycin course. Prefer pravastatin if prolonged therapy."),
    ("rosuvastatin", "clarithromycin", "minor", "Rosuvastatin is not primarily CYP3A4 metabolised. Modest interaction; some increase in rosuvastatin AUC reported.", "Monitor for myopathy symptoms."),
    ("ciprofloxacin", "aluminium hydroxide", "moderate", "Divalent/trivalent cations in antacids chelate ciprofloxacin in the GI tract, reducing absorption by up to 90%.", "Administer ciprofloxacin at least 2 hours before or 6 hours after antacid."),
    ("ramipril", "ferrous sulfate", "minor", "ACE inhibitors may slightly increase iron absorption. Monitor.", "Administer separately by 2 hours."),
    ("lisinopril", "spironolactone", "moderate", "Both ACE inhibitors and potassium-sparing diuretics increase serum potassium. Combined use can cause life-threatening hyperkalemia.", "Monitor serum potassium closely. Use with caution, especially in renal impairment."),
    ("ramipril", "spironolactone", "moderate", "ACE inhibitor + spironolactone: hyperkalemia risk, especially in heart failure patients.", "Monitor potassium regularly. Avoid if eGFR < 30."),
    ("amlodipine", "simvastatin", "moderate", "Amlodipine inhibits CYP3A4 (weak), increasing simvastatin exposure. FDA recommends capping simvastatin at 20mg/day when co-prescribed with amlodipine.", "Do not exceed simvastatin 20mg/day. Consider switching to pravastatin or rosuvastatin."),
    ("digoxin", "amiodarone", "major", "Amiodarone inhibits P-glycoprotein and reduces renal digoxin clearance, doubling digoxin plasma levels. Digoxin toxicity (bradycardia, heart block, arrhythmias) can be fatal.", "Reduce digoxin dose by 30-50% when starting amiodarone. Monitor digoxin levels and ECG closely."),
    ("clopidogrel", "omeprazole", "moderate", "Omeprazole inhibits CYP2C19, reducing conversion of clopidogrel to its active metabolite by up to 45%. Reduced antiplatelet effect may increase cardiovascular events.", "Use pantoprazole or rabeprazole (weaker CYP2C19 inhibition) as PPI alternative."),
    ("clopidogrel", "esomeprazole", "moderate", "Esomeprazole also inhibits CYP2C19 → reduced clopidogrel antiplatelet activity.", "Switch to pantoprazole."),
    ("levothyroxine", "ferrous sulfate", "moderate", "Iron chelates levothyroxine in the GI tract, reducing thyroid hormone absorption by 30-40%. Results in hypothyroidism.", "Administer iron at least 4 hours after levothyroxine."),
    ("levothyroxine", "calcium carbonate", "moderate", "Calcium forms insoluble complex with levothyroxine, reducing absorption. TSH may rise.", "Separate administration by at least 4 hours."),
    ("lithium", "ibuprofen", "major", "NSAIDs inhibit renal prostaglandin synthesis, reducing lithium clearance and causing lithium toxicity (tremor, confusion, cardiac arrhythmias, seizures).", "Avoid. If NSAID required, use paracetamol. Monitor lithium levels closely if unavoidable."),
    ("lithium", "diclofenac", "major", "Diclofenac reduces renal lithium clearance → lithium toxicity.", "Avoid combination. Use paracetamol for pain."),
    ("lithium", "naproxen", "major", "Naproxen significantly raises lithium plasma levels via reduced renal clearance.", "Contraindicated in practice. Monitor lithium if unavoidable."),
    ("amiodarone", "azithromycin", "major", "Both drugs prolong QT interval. Combination significantly increases risk of torsades de pointes, a potentially fatal arrhythmia.", "Avoid. If antibiotic required in patient on amiodarone, choose non-QT-prolonging alternative."),
    ("amiodarone", "ciprofloxacin", "major", "Ciprofloxacin + amiodarone: additive QT prolongation risk → torsades de pointes.", "Avoid. Use alternative antibiotic."),
    ("escitalopram", "amiodarone", "major", "Escitalopram prolongs QT in a dose-dependent manner. Combined with amiodarone, risk of life-threatening arrhythmia.", "Avoid. Choose alternative antidepressant (e.g., mirtazapine)."),
    ("warfarin", "fluconazole", "major", "Fluconazole potently inhibits CYP2C9, the primary enzyme metabolising warfarin. INR can increase 2-3 fold, causing serious bleeding.", "Reduce warfarin dose by 25-50%. Monitor INR daily for first week."),
    ("warfarin", "metronidazole", "major", "Metronidazole inhibits CYP2C9 and CYP3A4 → elevated warfarin → bleeding risk.", "Monitor INR every 2-3 days. Consider dose reduction."),
    ("metformin", "alcohol", "moderate", "Alcohol potentiates metformin-associated lactic acidosis risk, especially in hepatic impairment.", "Advise patient to avoid excessive alcohol."),
    ("phenytoin", "carbamazepine", "moderate", "Both are enzyme inducers and can alter each other's plasma levels unpredictably. Both are narrow therapeutic index drugs.", "Monitor plasma levels of both drugs. Adjust doses based on levels."),
    ("ciprofloxacin", "theophylline", "major", "Ciprofloxacin inhibits CYP1A2, the primary theophylline metabolic enzyme. Theophylline toxicity (seizures, arrhythmias) can occur within 24 hours.", "Avoid or reduce theophylline dose by 30-50%. Monitor theophylline levels."),
    ("hydroxychloroquine", "amiodarone", "major", "Hydroxychloroquine prolongs QT interval. Combined with amiodarone (also QT-prolonging), risk of fatal arrhythmia.", "Avoid. Monitor ECG if unavoidable."),
    ("allopurinol", "azathioprine", "major", "Allopurinol inhibits xanthine oxidase, the enzyme that metabolises azathioprine. Azathioprine toxicity (bone marrow suppression) results.", "Reduce azathioprine dose to 25% of normal when allopurinol is added."),
]

# Drug classes used by the class-level rules. escitalopram is
# listed under its effective class only (qt_prolonging).
CLASS_MEMBERS = {
    "ssri": ["sertraline", "fluoxetine", "paroxetine", "fluvoxamine", "citalopram"],
    "nsaid": ["ibuprofen", "diclofenac", "naproxen", "nimesulide", "mefenamic acid", "indomethacin", "celecoxib", "etoricoxib", "ketorolac"],
    "statin": ["atorvastatin", "rosuvastatin", "simvastatin", "pravastatin", "fluvastatin", "pitavastatin"],
    "nitrate": ["glyceryl trinitrate", "isosorbide mononitrate", "isosorbide dinitrate"],
    "ace_inhibitor": ["lisinopril", "ramipril", "enalapril", "captopril", "perindopril", "fosinopril"],
    "qt_prolonging": ["amiodarone", "azithromycin", "ciprofloxacin", "levofloxacin", "escitalopram", "hydroxychloroquine", "haloperidol"],
    "anticoagulant": ["warfarin", "heparin", "enoxaparin", "rivaroxaban", "apixaban", "dabigatran"],
}

# Class pair, severity, description, management. The rules that
# name tramadol, clarithromycin, sildenafil or potassium_sparing_diuretic have
# no member in the class table, so they never fire; they stay for completeness.
CLASS_SOURCE = "DRUG_CLASS"
CLASS_RULES = [
    ("ssri", "nsaid", "moderate", "SSRIs reduce platelet serotonin stores, impairing platelet aggregation. Combined with NSAIDs (which also impair platelet function and cause GI mucosal damage), bleeding risk is significantly elevated.", "Avoid long-term combination. If necessary, co-prescribe PPI. Monitor for GI bleeding."),
    ("anticoagulant", "nsaid", "major", "Any anticoagulant combined with NSAIDs greatly increases bleeding risk through additive anticoagulation and GI mucosal damage.", "Avoid. If pain relief needed, use paracetamol."),
    ("ssri", "tramadol", "major", "Tramadol is serotonergic. Any SSRI + tramadol carries serotonin syndrome risk.", "Avoid. Use non-serotonergic analgesic."),
    ("statin", "clarithromycin", "moderate", "Clarithromycin (CYP3A4 inhibitor) increases plasma levels of CYP3A4-metabolised statins (atorvastatin, simvastatin), raising myopathy risk.", "Switch to pravastatin or rosuvastatin, or suspend statin during short antibiotic course."),
    ("sildenafil", "nitrate", "major", "Phosphodiesterase-5 inhibitors potentiate nitrate-induced hypotension. Combination can be fatal.", "ABSOLUTE CONTRAINDICATION. No exceptions."),
    ("qt_prolonging", "qt_prolonging", "major", "Two QT-prolonging drugs co-prescribed. Additive QT prolongation significantly increases risk of torsades de pointes and sudden cardiac death.", "Obtain ECG before prescribing. If QTc > 500ms, avoid combination."),
    ("ace_inhibitor", "potassium_sparing_diuretic", "moderate", "ACE inhibitors reduce aldosterone and potassium excretion. Combined with potassium-sparing diuretics, life-threatening hyperkalemia can result.", "Monitor serum potassium. Avoid in renal impairment."),
]

# Report order of severities; anything else sorts last.
SEVERITY_ORDER = ["major", "moderate", "minor", "unknown"]
SEVERITY_LAST = 99
LABEL_SOURCE = "OPENFDA"
LABEL_SNIPPET_CHARS = 500
LABEL_DEFAULT_TEXT = "Interaction mentioned in FDA label."
