"""Lab results: latest values and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_labs(results: DataFrame) -> DataFrame:
    """Newest result per patient and analyte, by report date or, without one,
    creation time; the lowest result id wins a tie. An aggregate, so a patient
    with very many results is reduced before the shuffle."""
    at = F.coalesce(F.col("report_date").cast("timestamp"), F.col("created_at"))
    row = F.struct("result_id", "value", "unit", "ref_range", "flag", at.alias("result_at"))
    newest = F.max_by(row, F.struct(at, -F.col("result_id")))
    return (
        results.groupBy("patient_id", F.upper("analyte_name").alias("analyte_name"))
        .agg(newest.alias("r")).select("patient_id", "analyte_name", "r.*")
    )
