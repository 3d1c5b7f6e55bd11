"""Summaries and reports as tables; texts are built as one row per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DAILY_ADVICE, SUMMARY_ADVICE
from ..functions.scalars import moment
from ..session import materialize
from .filters import newest_first, recent
from .order_stats import number_rows



def metrics_summary(readings: DataFrame, as_of, days: int | None = 30) -> DataFrame:
    """Animals, rows, anomalies and farms of the last days."""
    return recent(readings, as_of, days).agg(
        F.count_distinct("tag_id").alias("total_animals"),
        F.count("*").alias("total_records"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.count_distinct("farm_id").alias("farms_monitored"),
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Active and critical alerts."""
    return alerts.filter(~F.col("is_resolved")).agg(
        F.count("*").alias("active_alerts"), F.count_if(F.col("severity") == "critical").alias("critical_alerts")
    )


def anomaly_timeline(readings: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """Rows, anomalies and mean score per day."""
    return (
        recent(readings, as_of, days)
        .groupBy(F.to_date("date").alias("day"))
        .agg(
            F.count("*").alias("total_records"),
            F.count_if("is_anomaly").alias("anomalies"),
            F.avg("anomaly_score").alias("avg_score"),
        )
        .orderBy("day")
    )


def animal_summary(livestock: DataFrame, farm_id=None) -> DataFrame:
    """Active animals: total, per type, and number of farms (animals without farm count as one)."""
    active = livestock.filter("is_active")
    if farm_id is not None:
        active = active.filter(F.col("farm_id") == farm_id)
    return (
        active.rollup("animal_type")
        .agg(
            F.grouping("animal_type").alias("_all"),
            F.count("*").alias("animals"),
            (F.count_distinct("farm_id") + F.when(F.bool_or(F.col("farm_id").isNull()), 1).otherwise(0)).alias("farms"),
        )
        .select(
            F.when(F.col("_all") == 1, "total").otherwise("by_type").alias("section"),
            F.when(F.col("_all") == 0, F.coalesce("animal_type", F.lit("unknown"))).alias("animal_type"),
            "animals",
            F.when(F.col("_all") == 1, F.col("farms")).alias("farms"),
        )
    )


def anomaly_by_type(readings: DataFrame) -> DataFrame:
    """Records and anomalies per animal type, with the anomaly rate in percent; null type = overall."""
    return (
        readings.rollup("animal_type")
        .agg(
            F.grouping("animal_type").alias("_all"),
            F.count("*").alias("records"),
            F.sum(F.col("is_anomaly").cast("int")).alias("anomalies"),
        )
        .filter((F.col("_all") == 1) | F.col("animal_type").isNotNull())
        .select(
            F.when(F.col("_all") == 1, "all").otherwise(F.col("animal_type")).alias("animal_type"),
            "records", "anomalies", (F.col("anomalies") / F.col("records") * 100).alias("anomaly_rate"),
        )
    )


def type_distribution(readings: DataFrame) -> DataFrame:
    """Records per animal type; ``pct_of_animals`` divides records by the number of animals."""
    totals = readings.agg(
        F.struct(F.count_distinct("tag_id").alias("animals"), F.count("*").alias("records"))
    ).scalar()
    return (
        readings.filter(F.col("animal_type").isNotNull())
        .groupBy("animal_type")
        .agg(F.count("*").alias("records"))
        .withColumns(
            {
                "pct_of_animals": F.col("records") / totals["animals"] * 100,
                "pct_of_records": F.col("records") / totals["records"] * 100,
            }
        )
    )


def daily_advice(anomalies: Column) -> Column:
    out = None
    for limit, text in DAILY_ADVICE:
        if limit is None:
            return out.otherwise(F.lit(text))
        hit = anomalies <= limit
        out = F.when(hit, F.lit(text)) if out is None else out.when(hit, F.lit(text))
    return out


def daily_report(readings: DataFrame, alerts: DataFrame, as_of, recent_alerts: int = 5) -> DataFrame:
    """Section, key and value: totals, animals per type, newest alerts, advice."""
    # One pass gives the totals and the animals per type.
    counted = readings.rollup("animal_type").agg(
        F.grouping("animal_type").alias("_all"), F.count_distinct("tag_id").alias("a"), F.count("*").alias("r"),
        F.count_distinct("farm_id").alias("f"), F.count_if("is_anomaly").alias("n"),
    )

    def pair(section: str, key: Column, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), key.alias("key"), value.cast("string").alias("value")
        )

    totals = F.array(
        pair("summary", F.lit("total_animals"), F.col("a")),
        pair("summary", F.lit("total_records"), F.col("r")),
        pair("summary", F.lit("farms_monitored"), F.col("f")),
        pair("anomalies", F.lit("anomaly_count"), F.col("n")),
        pair("anomalies", F.lit("anomaly_rate"), F.format_string("%.1f%%", F.col("n") / F.col("r") * 100)),
        pair("recommendations", F.lit("advice"), daily_advice(F.col("n"))),
    )
    one_type = F.array(pair("animals_by_type", F.initcap("animal_type"), F.col("a")))
    figures = counted.select(F.inline(F.when(F.col("_all") == 1, totals).otherwise(one_type)))
    newest = newest_first(
        alerts.filter(F.col("created_at") <= moment(as_of)), "created_at", "id", recent_alerts
    ).select(
        F.lit("recent_alerts").alias("section"),
        F.col("id").cast("string").alias("key"),
        F.format_string(
            "%s: Farm %s - %d animals (%s)", F.upper("severity"), "farm_id", "affected_animals",
            F.date_format("created_at", "yyyy-MM-dd"),
        ).alias("value"),
    )
    return figures.unionByName(newest)


# Marks of the severities in the markdown report.
SEVERITY_MARKS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢"}


def summary_report(
    readings: DataFrame, alerts: DataFrame, fmt: str = "txt", title: str = "Herd Health Monitoring Summary Report",
    max_rows: int | None = None,
) -> DataFrame:
    """The summary report as lines: (section, item, line_no, line), in that order.

    Alerts are numbered in parallel and written by the executors; nothing is collected, so a
    report over any number of alerts works. Write it with ``sources.writers.write_lines``.
    """
    if fmt not in ("txt", "md"):
        raise ValueError(f"unsupported report format: {fmt}")
    md = fmt == "md"

    def lines(df: DataFrame, section: int, item: Column, texts: list[Column]) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            item.cast("bigint").alias("item"),
            F.posexplode(F.array_compact(F.array(*texts))).alias("line_no", "line"),
        )

    def label(name: str, value: Column, indent: str = "") -> Column:
        return F.concat(F.lit(f"- **{name}:** " if md else f"{indent}{name}: "), value)

    def heading(text: str, level: int = 2) -> list[Column]:
        if md:
            return [F.lit("#" * level + " " + text), F.lit("")]
        return [F.lit(text.upper()), F.lit("-" * 40)]

    # One pass over the readings; what follows reads these few rows, or the alerts.
    counts = materialize(
        readings.groupBy("animal_type").agg(F.count("*").alias("r"), F.count_if("is_anomaly").alias("n"))
    )
    alerts = materialize(alerts)
    totals = counts.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    head = lines(totals, 0, F.lit(0), [F.lit("# " + title)] if md else
                 [F.lit("=" * 60), F.lit(title.upper()), F.lit("=" * 60)])
    summary = lines(
        totals.filter("r > 0"), 1, F.lit(0),
        [
            *heading("Anomaly Summary"),
            label("Total Records Analyzed", F.col("r").cast("string")),
            label("Anomalies Detected", F.col("n").cast("string")),
            label("Anomaly Rate", F.format_string("%.1f%%", F.col("n") / F.col("r") * 100)),
        ],
    )
    types = counts.filter(F.col("animal_type").isNotNull()).select("animal_type", "n")
    types = number_rows(types, ["animal_type"], "_i", max_rows=max_rows)
    per_type = lines(types, 2, F.col("_i"), [label_type(md)])
    alert_totals = alerts.agg(F.count("*").alias("alerts"))
    alert_head = lines(
        alert_totals, 3, F.lit(0),
        [*heading("Outbreak Alerts"), F.when(F.col("alerts") == 0, "No outbreak alerts generated.")],
    )
    numbered = number_rows(alerts, ["created_at", "id"], "_i", max_rows=max_rows)
    severity = F.coalesce("severity", F.lit("Unknown"))
    mark = F.lit("⚪")
    for name, sign in SEVERITY_MARKS.items():
        mark = F.when(F.lower(severity) == name, F.lit(sign)).otherwise(mark)
    number = (F.col("_i") + 1).cast("string")
    first = (
        F.concat(F.lit("### "), mark, F.lit(" Alert "), number, F.lit(": "), F.upper(severity))
        if md
        else F.concat(F.lit("Alert "), number, F.lit(":"))
    )
    per_alert = lines(
        numbered, 4, F.col("_i"),
        [
            first,
            label("Farm", F.coalesce(F.col("farm_id").cast("string"), F.lit("Unknown")), "  "),
            label("Severity", severity, "  "),
            label("Affected Animals", F.coalesce(F.col("affected_animals"), F.lit(0)).cast("string"), "  "),
            *(
                [label("Start Date", F.date_format("start_date", "yyyy-MM-dd"), "  ")]
                if "start_date" in alerts.columns
                else []
            ),
            *([label("Description", F.col("description"))] if md and "description" in alerts.columns else []),
        ],
    )
    state = F.when(F.col("alerts") > 0, "alerts").when(F.col("n") > 10, "many").otherwise("few")
    both = totals.select("n", alert_totals.scalar().alias("alerts")).withColumn("_state", state)
    advice = lines(
        both, 5, F.lit(0),
        [
            *heading("Recommendations"),
            *[
                F.when(F.col("_state") == key, F.lit(f"{i}. **{text}**" if md else f"{i}. {text}"))
                for key, texts in SUMMARY_ADVICE.items()
                for i, text in enumerate(texts, 1)
            ],
        ],
    )
    out = head
    for part in (summary, per_type, alert_head, per_alert, advice):
        out = out.unionByName(part)
    return out


def label_type(md: bool) -> Column:
    if md:
        return F.concat(F.lit("- **"), F.initcap("animal_type"), F.lit(":** "), F.col("n").cast("string"))
    return F.concat(F.lit("  "), F.initcap("animal_type"), F.lit(": "), F.col("n").cast("string"))


def html_report(
    readings: DataFrame, clusters: DataFrame, title: str = "Herd Health Monitoring Report", max_rows: int | None = None
) -> DataFrame:
    """The same figures as an HTML page, as lines (section, item, line_no, line); nothing is collected.

    Percentages divide records by animals, as the report always did.
    """
    counts = materialize(
        readings.rollup("animal_type").agg(
            F.grouping("animal_type").alias("_all"), F.count_distinct("tag_id").alias("a"),
            F.count("*").alias("r"), F.count_if("is_anomaly").alias("n"),
        )
    )
    clusters = materialize(clusters)
    found = clusters.agg(F.count("*").alias("c")).scalar()
    total = counts.filter("_all = 1")
    animals = total.select("a").scalar()

    def lines(df: DataFrame, section: int, item: Column, texts: list[Column]) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), item.cast("bigint").alias("item"),
            F.posexplode(F.array(*texts)).alias("line_no", "line"),
        )

    def box(name: str, value: Column) -> Column:
        return F.format_string(f'<div class="stat-box"><h3>{name}</h3><p>%d</p></div>', value)

    def row(*cells: Column) -> Column:
        joined = F.concat_ws("</td><td>", *[F.coalesce(c.cast("string"), F.lit("Unknown")) for c in cells])
        return F.concat(F.lit("<tr><td>"), joined, F.lit("</td></tr>"))

    def header(*names: str) -> Column:
        return F.lit("<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>")

    head = lines(
        total, 0, F.lit(0),
        [
            F.lit(f"<!DOCTYPE html><html><head><title>{title}</title></head><body><h1>{title}</h1>"),
            F.lit("<h2>Summary Statistics</h2>"),
            box("Animals Monitored", F.col("a")), box("Health Records", F.col("r")),
            box("Anomalies Detected", F.col("n")), box("Outbreak Clusters", found),
            F.lit("<h2>Animal Distribution</h2>"), header("Animal Type", "Count", "Percentage"),
        ],
    )
    kinds = number_rows(
        counts.filter("_all = 0 AND animal_type IS NOT NULL").select("animal_type", "r"), ["animal_type"], "_i",
        max_rows=max_rows,
    )
    share = F.when(animals > 0, F.col("r") / animals * 100).otherwise(0.0)
    per_type = lines(
        kinds, 1, F.col("_i"), [row(F.initcap("animal_type"), F.col("r"), F.format_string("%.1f%%", share))]
    )
    middle = lines(
        total, 2, F.lit(0),
        [
            F.lit("</table><h2>Outbreak Clusters</h2>"),
            F.when(found > 0, header("Farm ID", "Start Date", "Affected Animals", "Severity", "Metrics Affected"))
            .otherwise("<table><tr><td>No outbreak clusters detected during this period.</td></tr>"),
        ],
    )
    listed = F.concat_ws(", ", "metrics_affected") if "metrics_affected" in clusters.columns else F.lit("")
    per_cluster = lines(
        number_rows(clusters, ["start_date", "farm_id"], "_i", max_rows=max_rows), 3, F.col("_i"),
        [row(F.col("farm_id"), F.date_format("start_date", "yyyy-MM-dd"), F.col("affected_animals"),
             F.upper("severity"), listed)],
    )
    tail = lines(total, 4, F.lit(0), [F.lit("</table></body></html>")])
    return head.unionByName(per_type).unionByName(middle).unionByName(per_cluster).unionByName(tail)
