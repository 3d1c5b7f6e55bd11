"""The whole run: collect, validate, quality, clean, normalize, detect, clusters, notify, export."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import METRICS, DetectionSettings
from ..operators import alerts as al
from ..operators import clean, ensemble, normalize, quality, reports, rules
from ..operators.clusters import with_severity
from ..operators.contracts import Contract
from ..session import write_and_read
from ..sources import writers
from .stages import Stages, input_of

log = logging.getLogger(__name__)

# The steps and what each depends on.
STEPS = {
    "data_quality": (),
    "preprocessing": (),
    "anomaly_detection": (),
    "ensemble_detection": (),
    "notifications": (),
    "email_alerts": ("notifications",),
    "export_reports": (),
    "dashboard": (),
}


@dataclass
class Results:
    """What a run produced; ``tables`` holds DataFrames."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    steps: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    files: dict[str, str] = field(default_factory=dict)
    success: bool = False
    # The kept stages of a run that can be resumed; its ``forget_others`` drops those of other runs.
    stages: Stages | None = None


def enabled(step: str, switches: dict[str, bool]) -> bool:
    """A step runs when it and all it depends on are switched on."""
    if step not in STEPS:
        raise KeyError(f"unknown step: {step}")
    return switches.get(step, True) and all(enabled(d, switches) for d in STEPS[step])


def run(
    readings: DataFrame, as_of, *, switches: dict[str, bool] | None = None,
    settings: DetectionSettings | None = None, contract: Contract | None = None, strict: bool = False,
    export_to: str | None = None, order_by: tuple[str, ...] = ("arrival_id",), hot_key_rows: int | None = None,
    resume_at: str | None = None, input_key: str | None = None,
) -> Results:
    """Run the enabled steps over a table of readings with animal type and farm.

    The cleaned and the detected table are stored once in the shared folder, because scaling and detectors,
    clusters, notification, export and reports all read them; everything else stays lazy. ``strict`` stops at invalid
    data when a contract is given. Switches apply to this run only.

    With ``resume_at``, a folder, the finished stages of an earlier run over the same readings with the same settings are
    taken from there instead of being computed: issues, cleaned and detected readings, exported files. The
    readings are known by ``input_key`` (such as ``stages.stored_input`` gives it), or else by a pass over all of them.
    """
    switches, settings = switches or {}, settings or DetectionSettings()
    for step in switches:
        enabled(step, switches)
    out = Results()
    if resume_at is not None:
        out.stages = Stages(readings.sparkSession, resume_at, input_key or input_of(readings))

    def kept(name: str, make: Callable[[], DataFrame], *about) -> DataFrame:
        """A table that later steps read several times."""
        if out.stages is None:
            return write_and_read(make(), name)
        return out.stages.table(name, make, json.dumps([str(as_of), order_by, *about], default=str))

    data, when = readings, ("date", order_by[0])

    if contract is not None and enabled("data_quality", switches):
        report = rules.validate(data, contract)
        out.tables.update({f"validation_{k}": t for k, t in report.items()})
        out.tables["contract_quality"] = rules.quality_report(data, contract, as_of, report)
        if not report["overall"].first()["is_valid"]:
            if strict:
                out.errors.append("Data validation failed")
                return out
            out.warnings.append("Data validation failed")
            log.warning("data validation failed, continuing")
        out.steps.append("data_validation")

    if enabled("data_quality", switches):
        analysis = quality.analyze(data, as_of, hot_key_rows)
        out.tables.update({f"quality_{k}": t for k, t in analysis.items()})
        if out.stages is not None:
            out.tables["quality_issues"] = kept("quality_issues", lambda: analysis["issues"])
        if not out.tables["quality_issues"].isEmpty():
            out.warnings.append("Data quality issues detected")
        out.steps.append("data_quality")

    if enabled("preprocessing", switches):
        # Scaling and both detectors read it, several passes in all.
        raw = data
        data = kept("cleaned", lambda: clean.clean(raw, order_by=order_by, hot_key_rows=hot_key_rows, keep=True))
        out.tables["cleaned"] = data
        out.tables["normalized"] = normalize.fit_transform(data, [m for m in METRICS if m in data.columns])
        out.steps.append("preprocessing")

    found = None
    if enabled("anomaly_detection", switches):
        method = settings.method
        if method == "ensemble" and not enabled("ensemble_detection", switches):
            method = "statistical"
        chosen = DetectionSettings(**{**settings.__dict__, "method": method})
        found = kept(
            "detected", lambda: ensemble.detect(data, chosen, ids=order_by[:1], order_by=when, hot_key_rows=hot_key_rows), asdict(chosen)
        )
        out.tables["detected"] = found
        out.tables["clusters"] = with_severity(ensemble.detect_outbreaks(found, chosen))
        out.steps.append("anomaly_detection")
        if method == "ensemble":
            out.steps.append("ensemble_detection")

    flag = None if found is None else ("is_anomaly" if "is_anomaly" in found.columns else "if_anomaly")
    if enabled("notifications", switches) and found is not None and not found.filter(flag).isEmpty():
        alerts = out.tables["clusters"].withColumns(
            {
                "description": F.format_string(
                    "Outbreak cluster with %d flagged readings", "anomaly_rows"
                ) if "anomaly_rows" in out.tables["clusters"].columns else F.lit("Outbreak cluster"),
                "created_at": F.lit(as_of).cast("timestamp_ntz"),
            }
        )
        messages = alerts.withColumns({"subject": al.subject(), "body": al.body(alerts, as_of)})
        out.tables["notifications"] = (
            al.over_threshold(messages) if enabled("email_alerts", switches) else al.with_defaults(alerts, as_of)
        )
        out.steps += ["email_alerts", "notifications"] if enabled("email_alerts", switches) else ["notifications"]

    if enabled("export_reports", switches) and found is not None and export_to is not None:

        def export() -> dict[str, str]:
            anomalies = writers.export_anomalies(found.filter(flag), export_to, as_of)
            clusters = writers.export(out.tables["clusters"], export_to, "clusters", as_of)
            return {**{f"anomalies_{k}": p for k, p in anomalies.items()}, **{f"clusters_{k}": p for k, p in clusters.items()}}

        out.files.update(export() if out.stages is None else out.stages.once("exported", export, export_to))
        out.steps.append("export_reports")

    if enabled("dashboard", switches) and found is not None and "is_anomaly" in found.columns:
        out.tables["timeline"] = reports.anomaly_timeline(found)
        if "farm_id" in found.columns:
            out.tables["metrics_summary"] = reports.metrics_summary(found, as_of, None)
        if "animal_type" in found.columns:
            out.tables["anomaly_by_type"] = reports.anomaly_by_type(found)
        out.steps.append("dashboard")

    out.success = True
    return out
