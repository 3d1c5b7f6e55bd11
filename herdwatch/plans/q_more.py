"""Queries: parts of other operators that SQL can check alone, validation modes, small operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import METRICS, DetectionSettings
from ..operators import clean, iforest, quality
from ..operators import contracts as ct
from ..operators import ensemble as en
from ..operators import rules as ru
from ..session import materialize, new_folder
from ..sources import readers, writers
from . import pipeline
from . import views as v
from .q_detection import Z_SQL, enriched
from .q_quality import ISSUES, MEASURES, readings
from .registry import query, rounded, time_text


# The forest and the ensemble, without what depends on random trees
def _scaled(m: str) -> str:
    """|z| of a metric, nulls as its mean, as a share of the greatest one."""
    spread = f"sqrt(var_pop({m}) OVER () * count({m}) OVER () / count(*) OVER ())"
    return f"abs(coalesce({m}, avg({m}) OVER ()) - avg({m}) OVER ()) / ({spread})"


@query(
    v.with_views(
        "metrics_raw",
        f"""WITH z AS (SELECT arrival_id, {", ".join(f"{_scaled(m)} AS {m}" for m in METRICS)} FROM metrics_raw)
SELECT arrival_id, {", ".join(f"{rounded(f'{m} / max({m}) OVER ()')} AS {m}_if_contribution" for m in METRICS)}, true AS in_range FROM z""",
    )
)
def iforest_contributions(spark, sf_dir):
    """Contributions do not depend on the trees; scores lie between 0 and 10."""
    found = iforest.detect(v.metrics_raw(spark, sf_dir), METRICS, ["arrival_id"], trees=20)
    return found.select("arrival_id", *[f"{m}_if_contribution" for m in METRICS], F.col("if_anomaly_score").between(0, 10).alias("in_range"))


@query(
    v.with_views(
        "metrics_raw",
        f"""WITH {Z_SQL.split("enriched AS")[0].rstrip().rstrip(",")}
SELECT arrival_id, is_anomaly AS stat_is_anomaly, {rounded("anomaly_score")} AS stat_anomaly_score, true AS flag_fits, true AS score_fits FROM flagged""",
    )
)
def ensemble_parts(spark, sf_dir):
    """The statistical part of the ensemble, and that flag and score are made of their parts."""
    found = en.detect_ensemble(
        v.metrics_raw(spark, sf_dir), METRICS, settings=DetectionSettings("ensemble", threshold=1.5, n_estimators=20),
        order_by=("date", "arrival_id"),
    )
    top = found.agg(F.max("stat_anomaly_score")).first()[0]
    score = 0.4 * 10 * F.col("stat_anomaly_score") / top + 0.6 * F.col("if_anomaly_score")
    return found.select(
        "arrival_id", "stat_is_anomaly", "stat_anomaly_score",
        (F.col("is_anomaly") == (F.col("stat_is_anomaly") | F.col("if_anomaly") | F.col("ensemble_anomaly"))).alias("flag_fits"),
        F.coalesce(F.abs(F.col("ensemble_anomaly_score") - score) < 1e-6, F.col("stat_anomaly_score").isNull()).alias("score_fits"),
    )


STEP_NAMES = ("data_quality", "preprocessing", "anomaly_detection", "ensemble_detection", "email_alerts", "notifications", "export_reports", "dashboard")


@query("SELECT unnest([" + ", ".join(f"'{s}'" for s in STEP_NAMES) + "]) AS step, unnest(range(1, 9)) AS at, 0 AS errors")
def pipeline_steps(spark, sf_dir):
    """The steps that a whole run over all readings takes, in order."""
    done = pipeline.run(
        enriched(spark, sf_dir), v.METRICS_AS_OF, settings=DetectionSettings(threshold=1.5, n_estimators=20),
        export_to=new_folder(spark, "steps"),
    )
    return spark.createDataFrame([(s, i + 1, len(done.errors)) for i, s in enumerate(done.steps)], "step string, at long, errors long")


# Validation modes
LIMIT = 60


@query(
    v.with_views(
        "metrics_raw",
        f"""WITH bad AS (SELECT count(*) > 0 AS b FROM metrics_raw WHERE heart_rate > {LIMIT})
SELECT 'strict' AS mode, NOT b AS success, b::INT AS errors, 0 AS warnings, CASE WHEN b THEN 0 ELSE 2 END AS steps FROM bad
UNION ALL SELECT 'lenient', true, 0, b::INT, 2 FROM bad""",
    )
)
def pipeline_validation(spark, sf_dir):
    """A contract that readings break, with and without strict validation."""
    contract = ct.Contract("readings", (ct.ColumnRule("heart_rate", "float", max_value=LIMIT),))
    only = {"notifications": False, "dashboard": False, "anomaly_detection": False, "data_quality": True, "preprocessing": False}
    out = []
    for strict in (True, False):
        done = pipeline.run(enriched(spark, sf_dir), v.METRICS_AS_OF, contract=contract, strict=strict, switches=only)
        told = [w for w in done.warnings if w == "Data validation failed"]
        out.append(("strict" if strict else "lenient", done.success, len(done.errors), len(told), len(done.steps)))
    return spark.createDataFrame(out, "mode string, success boolean, errors long, warnings long, steps long")


@query(
    v.with_views(
        "alerts",
        """SELECT rule, passed, severity, violations, starts FROM (
  SELECT 'fails_on_rows' AS rule, false AS passed, 'error' AS severity, 0 AS violations, 'Rule execution failed' AS starts
  UNION ALL SELECT 'many_animals', (SELECT count(*) FROM alerts WHERE affected_animals > 11) = 0, 'warning',
    (SELECT count(*) FROM alerts WHERE affected_animals > 11), 'Too many animals')""",
    )
)
def rules_that_fail(spark, sf_dir):
    """A rule that fails while rows are read is a finding; the sound rule beside it is counted."""
    own = [
        ru.Rule("fails_on_rows", lambda df: F.col("message").cast("int") > 5, "never %d", columns=("message",)),
        ru.Rule("many_animals", lambda df: F.col("affected_animals") > 11, "Too many animals in %d rows", severity=ru.WARNING, columns=("affected_animals",)),
    ]
    found = ru.rule_results(v.alerts(spark, sf_dir), own)
    return found.select("rule", "passed", "severity", "violations", F.regexp_extract("message", "^(Rule execution failed|Too many animals)", 1).alias("starts"))


# Exports and shapes
@query(
    v.with_views(
        "alerts",
        f"""SELECT form, id, farm_id, severity FROM alerts, (SELECT unnest(['csv', 'json']) AS form)
WHERE created_at > TIMESTAMP '{v.ALERTS_AS_OF}' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '{v.ALERTS_AS_OF}'""",
    )
)
def alert_export_recent(spark, sf_dir):
    """The alert log holds every day's alerts; those of the last 30 days are exported in both formats and read back."""
    folder, alerts = new_folder(spark, "recent-alerts"), v.alerts(spark, sf_dir)
    stamped = alerts.withColumn("day", F.to_date("created_at"))
    stamped.write.partitionBy("day").json(f"{folder}/log")
    files = writers.export_recent_alerts(spark, f"{folder}/log", f"{folder}/out", v.ALERTS_AS_OF, 30)
    shape = "id bigint, farm_id string, severity string"
    csv = spark.read.csv(files["csv"], header=True).select(F.col("id").cast("bigint").alias("id"), "farm_id", "severity")
    json = readers.read_json(spark, f"{files['json']}/data", shape, multi_line=False)
    return csv.select(F.lit("csv").alias("form"), "*").unionByName(json.select(F.lit("json").alias("form"), "id", "farm_id", "severity"))


@query(v.with_views("herd_daily", "SELECT unnest(['table', 'rows', 'row']) AS shape, unnest([(SELECT count(*) FROM herd_daily), 2, 1]) AS total_rows"))
def contract_input_shapes(spark, sf_dir):
    """A contract's summary of a table, of a list of records, and of one record."""
    rows = v.herd_daily(spark, sf_dir)
    first = [r.asDict() for r in rows.orderBy("farm_id", "date").limit(2).collect()]
    shapes = {"table": rows, "rows": first, "row": first[0]}
    out = None
    for name, data in shapes.items():
        one = ct.summary(ct.as_frame(spark, data), ct.DAILY_HEALTH_METRICS).select(F.lit(name).alias("shape"), "total_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    v.with_views(
        "herd_daily",
        """SELECT 'daily_health_metrics' AS contract, 12 AS columns, (SELECT count(*) FROM herd_daily) AS rows_like_it""",
    )
)
def contract_template(spark, sf_dir):
    """The example row of a contract takes the table's rows: its columns are a superset of theirs."""
    example, rows = ct.template(spark, ct.DAILY_HEALTH_METRICS), v.herd_daily(spark, sf_dir)
    both = example.limit(0).unionByName(rows.select([c for c in rows.columns if c in example.columns]), allowMissingColumns=True)
    return both.agg(F.count("*").alias("rows_like_it")).select(
        F.lit("daily_health_metrics").alias("contract"), F.lit(len(example.columns)).alias("columns"), "rows_like_it"
    )


@query(v.with_views("metrics_daily livestock", "SELECT count(*) AS rows, 0 AS out_of_order, max(date) = (SELECT max(date) FROM metrics_daily) AS complete FROM (SELECT DISTINCT tag_id, date FROM metrics_daily)"))
def clean_sorted(spark, sf_dir):
    """The cleaned table sorted by date: no row is older than the one before it."""
    rows = clean.clean(v.metrics_daily(spark, sf_dir), sort=True).select("date")
    # Places follow the order of the sorted parts; parts meet at their borders.
    kept = materialize(rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    ends = kept.groupBy(part.alias("part")).agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.min_by("date", "at").alias("first"), F.max_by("date", "at").alias("last"))
    from pyspark.sql import Window

    borders = ends.withColumn("before", F.lag("hi").over(Window.orderBy("part")))
    wrong = borders.agg(F.count_if((F.col("lo") != F.col("first")) | (F.col("hi") != F.col("last")) | (F.col("before") > F.col("lo"))).alias("w"))
    newest = v.metrics_daily(spark, sf_dir).agg(F.max("date")).scalar()
    return kept.agg(F.count("*").alias("rows"), F.max("date").alias("newest")).select(
        "rows", wrong.scalar().alias("out_of_order"), (F.col("newest") == newest).alias("complete")
    )


@query("SELECT 0 AS total_records, 0.0e0 AS quality_score, 'Very Poor' AS rating, 'no_data' AS issue, (SELECT count(*) FROM events) AS rows_left_out")
def dq_empty_input(spark, sf_dir):
    """No reading is newer than all others: the quality of none of the table's rows."""
    rows = readings(spark, sf_dir)
    none = rows.filter(F.col("date") > rows.agg(F.max("date")).scalar())
    measured = materialize(quality.measures(none, v.QUALITY_AS_OF))
    issue = quality.issues(measured).agg(F.max("type")).scalar()
    return quality.score(measured).select(
        measured.agg(F.max("total_records")).scalar().alias("total_records"), "quality_score", "rating", issue.alias("issue"),
        rows.agg(F.count("*")).scalar().alias("rows_left_out"),
    )


@query("SELECT unnest(['temperature', 'heart_rate', 'activity_level']) AS feature, round(1 / 3.0e0, 6) AS importance")
def forest_importance(spark, sf_dir):
    """The importance a forest over all readings reports: equal shares."""
    forest = iforest.grow(v.metrics_raw(spark, sf_dir), METRICS, ["arrival_id"], trees=10)
    return iforest.feature_importance(spark, forest)


class HotDetector:
    """A detector of one's own: a reading is unusual above a fixed temperature."""

    def detect_anomalies(self, df, metrics):
        hot = F.coalesce(F.col("temperature") > 37.9, F.lit(False))
        return df.withColumns({"is_anomaly": hot, "anomaly_score": F.when(hot, F.col("temperature") - 37.9).otherwise(0.0)})


@query(
    v.with_views(
        "metrics_raw livestock",
        f"""SELECT farm_id, strftime(CAST(date AS DATE), '%Y-%m-%d') AS day, count(*) AS anomalies, {rounded("avg(temperature - 37.9e0)")} AS score
FROM metrics_raw LEFT JOIN livestock USING (tag_id) WHERE temperature > 37.9e0 GROUP BY 1, 2""",
    )
)
def custom_detector(spark, sf_dir):
    found = en.detect(enriched(spark, sf_dir), custom=HotDetector())
    flagged = found.filter("is_anomaly").groupBy("farm_id", F.date_format("date", "yyyy-MM-dd").alias("day"))
    return flagged.agg(F.count("*").alias("anomalies"), F.avg("anomaly_score").alias("score"))


# The text report of the data quality
NAMES = ("completeness", "validity", "consistency", "timeliness")
RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
ADVICE = """advice AS (
  SELECT severity AS priority, CASE type
    WHEN 'completeness' THEN 'Add missing values or collect more complete data'
    WHEN 'validity' THEN 'Review data collection procedures and validate sensor readings'
    WHEN 'duplicates' THEN 'Remove or merge duplicate records'
    ELSE 'Collect more recent data for accurate analysis' END AS text FROM issues
  UNION ALL SELECT CASE WHEN score >= 90 THEN 'low' WHEN score >= 70 THEN 'medium' ELSE 'high' END,
    CASE WHEN score >= 90 THEN 'Data quality is excellent. Continue current practices.'
         WHEN score >= 70 THEN 'Data quality is good but could be improved.'
         ELSE 'Data quality needs significant improvement before analysis.' END FROM m)"""
LEVEL = "CASE WHEN score >= 90 THEN 5 WHEN score >= 70 THEN 4 WHEN score >= 50 THEN 3 WHEN score >= 30 THEN 2 ELSE 1 END"
RATING = "CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 70 THEN 'GOOD' WHEN score >= 50 THEN 'FAIR' WHEN score >= 30 THEN 'POOR' ELSE 'VERY POOR' END"
TEXT_REPORT = v.with_views(
    "metrics_daily livestock",
    f"""WITH {MEASURES}, {ISSUES}, {ADVICE},
found AS (SELECT '[' || upper(severity) || '] ' || message AS t FROM issues),
told AS (SELECT DISTINCT '[' || upper(priority) || '] ' || text AS t FROM advice)
SELECT 0 AS section, 0 AS item, 'OVERALL QUALITY SCORE' AS line
UNION ALL SELECT 0, 1, repeat('★', {LEVEL}) || repeat('☆', 5 - {LEVEL}) || ' ' || {RATING} FROM m
UNION ALL SELECT 0, 2, printf('Score: %.1f%%', score) FROM m
UNION ALL SELECT 1, 0, 'DIMENSION SCORES'
""" + "\n".join(f"UNION ALL SELECT 1, {i}, rpad('{n.title()}', 12, ' ') || ': ' || lpad(printf('%.1f', {n}), 6, ' ') || '%' FROM m" for i, n in enumerate(NAMES, 1)) + """
UNION ALL SELECT 2, 0, 'ISSUES DETECTED' FROM (SELECT 1 FROM found LIMIT 1)
UNION ALL SELECT 2, row_number() OVER (ORDER BY t), row_number() OVER (ORDER BY t) || '. ' || t FROM found
UNION ALL SELECT 3, 0, 'RECOMMENDATIONS' FROM (SELECT 1 FROM told LIMIT 1)
UNION ALL SELECT 3, row_number() OVER (ORDER BY t), row_number() OVER (ORDER BY t) || '. ' || t FROM told""",
)


@query(TEXT_REPORT)
def dq_text_report(spark, sf_dir):
    return quality.text_report(materialize(quality.measures(readings(spark, sf_dir), v.QUALITY_AS_OF)))
