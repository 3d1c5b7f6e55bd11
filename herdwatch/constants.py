"""Fixed values of the herd-health domain.

Every number, word list and threshold that decides a result is stated here once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

METRICS = ("temperature", "heart_rate", "activity_level")

# Normal range per metric and animal type; types not listed get DEFAULT_RANGE.
NORMAL_RANGES = {
    "temperature": {"cattle": (38.0, 39.0), "sheep": (38.5, 40.0), "goat": (38.5, 40.5)},
    "heart_rate": {"cattle": (48.0, 84.0), "sheep": (70.0, 80.0)},
}
DEFAULT_RANGE = (0.0, 1.0)
ACTIVITY_FLOOR = 0.1

# Range in which a reading counts as valid, whatever the animal type.
VALID_RANGES = {"temperature": (35.0, 42.0), "heart_rate": (40.0, 120.0), "activity_level": (0.1, 2.0)}
REQUIRED_COLUMNS = ("tag_id", "date", "animal_type")

# Weights and penalties of the scores.
DQ_WEIGHTS = {"completeness": 0.30, "validity": 0.30, "consistency": 0.20, "timeliness": 0.20}
CONTRACT_WEIGHTS = {
    "completeness": 0.3, "accuracy": 0.3, "consistency": 0.2, "timeliness": 0.1, "validity": 0.1,
}
ENSEMBLE_WEIGHTS = {"statistical": 0.4, "isolation_forest": 0.6}
ENSEMBLE_THRESHOLD = 5.0
HEALTH_PENALTY = {"temperature": 5.0, "heart_rate": 2.0, "activity_level": 10.0}
QUALITY_GATE = {"completeness": 0.8, "accuracy": 0.9, "quality_score": 0.7}

# Orderings of levels.
LOG_LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2}

# Advice texts of the data-quality report.
DQ_ADVICE = {
    "completeness": "Add missing values or collect more complete data",
    "missing_critical_column": "Ensure all required columns are properly populated",
    "validity": "Review data collection procedures and validate sensor readings",
    "duplicates": "Remove or merge duplicate records",
    "stale_data": "Collect more recent data for accurate analysis",
}
DQ_GENERAL_ADVICE = (
    (90.0, "low", "Data quality is excellent. Continue current practices."),
    (70.0, "medium", "Data quality is good but could be improved."),
    (None, "high", "Data quality needs significant improvement before analysis."),
)
RATING_BANDS = ((90.0, "Excellent", 5), (70.0, "Good", 4), (50.0, "Fair", 3), (30.0, "Poor", 2),
                (None, "Very Poor", 1))
GRADE_BANDS = ((0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D"), (None, "F"))

# Actions recommended in an alert message, by severity ("low" is also the default).
ALERT_ACTIONS = {
    "critical": (
        "IMMEDIATELY isolate affected animals",
        "Contact veterinary authorities",
        "Implement biosecurity measures",
        "Monitor all animals closely",
        "Consider temporary movement restrictions",
    ),
    "high": (
        "Isolate symptomatic animals",
        "Increase monitoring frequency",
        "Review feeding and water sources",
        "Contact veterinary services",
    ),
    "medium": (
        "Monitor affected animals closely",
        "Check environmental conditions",
        "Review recent changes",
        "Prepare isolation areas if needed",
    ),
    "low": ("Continue monitoring", "Document observations", "Review normal ranges"),
}

# Advice bands of the summary report and the daily report.
SUMMARY_ADVICE = {
    "alerts": (
        "Review all outbreak alerts",
        "Isolate affected animals if not already done",
        "Increase monitoring frequency",
        "Consult with veterinary services",
    ),
    "many": (
        "Monitor individual anomalies closely",
        "Check environmental conditions",
        "Review feeding schedules",
    ),
    "few": ("Continue regular monitoring", "Maintain current biosecurity measures"),
}
DAILY_ADVICE = (
    (0, "All systems normal. Continue regular monitoring."),
    (3, "Minor anomalies detected. Review individual animals."),
    (10, "Moderate anomalies detected. Increase monitoring frequency."),
    (None, "Significant anomalies detected. Consider veterinary consultation."),
)

ESSENTIAL_ANOMALY_COLUMNS = (
    "tag_id", "date", "animal_type", "farm_id", "temperature", "heart_rate", "activity_level",
    "is_anomaly", "anomaly_score",
)


@dataclass(frozen=True)
class DetectionSettings:
    """Parameters of the detectors; ``method`` picks one (see ``operators.detector``)."""

    method: str = "ensemble"
    threshold: float = 3.0
    window_size: int = 7
    min_anomalies_for_alert: int = 3
    contamination: float = 0.1
    n_estimators: int = 100
    max_samples: int = 256
    random_state: int = 42
    ensemble_weights: dict = field(default_factory=lambda: dict(ENSEMBLE_WEIGHTS))
