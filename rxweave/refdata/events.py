"""Typed history events and the payload keys each must carry."""

# Event type to required payload keys (schema version 1).
REQUIRED_KEYS = {
    "MEDICATION_STARTED": ["inn", "start_date", "dosage", "frequency", "duration_days", "is_fdc", "episode_id"],
    "MEDICATION_CONTINUED": ["inn", "episode_id", "prescription_count", "refill_number"],
    "MEDICATION_DOSE_CHANGED": ["inn", "episode_id", "old_dosage", "new_dosage"],
    "MEDICATION_COMPLETED": ["inn", "episode_id", "actual_end_date"],
    "MEDICATION_DISCONTINUED": ["inn", "episode_id", "stop_reason"],
    "CONDITION_INFERRED": ["condition_code", "condition_name", "confidence", "condition_id", "inference_engine_version"],
    "CONDITION_UPDATED": ["condition_code", "condition_id", "old_confidence", "new_confidence"],
    "CONDITION_CONFIRMED": ["condition_code", "condition_id", "clinician_id"],
    "CONDITION_REJECTED": ["condition_code", "condition_id", "clinician_id", "rejection_reason"],
    "CONDITION_RESOLVED": ["condition_code", "condition_id", "resolution_reason"],
    "DOCTOR_LINKED": ["doctor_id", "doctor_name", "speciality"],
    "ALLERGY_RECORDED": ["inn", "reaction_type", "severity"],
}
SCHEMA_VERSION = 1

# Allowed enumeration values of the review records.
ALLOWED = {
    "severity": ["major", "moderate", "minor", "unknown"],
    "alert_severity": ["critical", "warning", "info"],
    "review_action": ["confirm", "reject", "resolve"],
    "reaction_type": ["allergy", "intolerance", "adr", "contraindication"],
    "reaction_severity": ["mild", "moderate", "severe", "life_threatening"],
}
