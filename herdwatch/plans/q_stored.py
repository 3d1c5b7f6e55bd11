"""Queries: readers by extension and by name, stored scalers, forests, reports and contracts, row verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import METRICS
from ..functions.scalars import size_text
from ..operators import iforest, normalize, quality, stats
from ..operators import contracts as ct
from ..operators import ensemble as en
from ..operators import logs as lg
from ..operators import rules as ru
from ..session import new_folder
from ..sources import readers, writers
from . import views as v
from .q_clean import ROUNDED_METRICS, _scaled
from .q_contracts import HERD, HERD_CHECKS, severity_of
from .q_detection import Z_SQL, flagged
from .q_logs import FIELDS, RECORD
from .q_quality import ISSUES, MEASURES, readings
from .registry import query, rounded, time_text


# Sources
@query(
    v.with_views(
        "livestock",
        "SELECT 'csv' AS form, * FROM livestock UNION ALL SELECT 'parquet', * FROM livestock",
    )
)
def read_by_extension(spark, sf_dir):
    folder, herd = new_folder(spark, "herd"), v.livestock(spark, sf_dir)
    herd.write.csv(f"{folder}/herd.csv", header=True)
    herd.write.parquet(f"{folder}/herd.parquet")
    found = [
        readers.read_any(spark, f"{folder}/herd.{form}", herd.schema).select(F.lit(form).alias("form"), *herd.columns)
        for form in ("csv", "parquet")
    ]
    return found[0].unionByName(found[1])


@query(
    v.with_views(
        "logs",
        f"""SELECT {RECORD.replace("event_id, ", "")}, event_id % 2 = 1 AS rotated
FROM logs WHERE operation <> 'error'""",
    )
)
def log_rotated_readback(spark, sf_dir):
    """Half of the lines in current files (.log), half in rotated ones (.log.gz)."""
    folder, lines = new_folder(spark, "logs"), v.log_lines(spark, sf_dir)
    # Lines as they are: no quotes, nothing trimmed, files named *.log.
    raw = {
        "sep": "\x01", "quote": "\x00", "escape": "\x00", "extension": "log",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    lines.filter("event_id % 2 = 0").select("line").write.options(**raw).csv(f"{folder}/now")
    lines.filter("event_id % 2 = 1").select("line").write.options(**raw, compression="gzip").csv(f"{folder}/old")
    found = readers.read_log_lines(spark, f"{folder}/*")
    kept = [c for c in FIELDS if c != "event_id"]
    return lg.parse_lines(found).select(*kept, F.col("file").endswith(".gz").alias("rotated"))


@query(
    v.with_views(
        "alerts",
        """SELECT '[2001-08-01 00:00:00] [' || upper(severity) || '] Farm: ' || farm_id || ' | Animals: '
|| affected_animals || ' | ' || message AS line FROM alerts WHERE severity = 'high'""",
    )
)
def todays_alerts(spark, sf_dir):
    folder, alerts = new_folder(spark, "alert-log"), v.alerts(spark, sf_dir)
    writers.log_alerts(alerts.filter("severity = 'low'"), folder, "2001-07-31 00:00:00")
    writers.log_alerts(alerts.filter("severity = 'high'"), folder, v.ALERTS_AS_OF)
    return readers.todays_alert_lines(spark, folder, v.ALERTS_AS_OF)


@query(
    v.with_views(
        "metrics_raw",
        """SELECT 'as given' AS input, CASE WHEN count(*) FILTER (tag_id IS NULL) > 0
  THEN 'null values found in [''tag_id'']' ELSE 'ok' END AS outcome FROM metrics_raw
UNION ALL SELECT 'no date', 'missing required columns: [''date'']'
UNION ALL SELECT 'animal 7 unknown', CASE WHEN count(*) FILTER (tag_id = 7) > 0
  THEN 'null values found in [''tag_id'']' ELSE 'ok' END FROM metrics_raw""",
    )
)
def readings_check(spark, sf_dir):
    rows = v.metrics_raw(spark, sf_dir)
    inputs = {
        "as given": rows,
        "no date": rows.drop("date"),
        "animal 7 unknown": rows.withColumn("tag_id", F.when(F.col("tag_id") != 7, F.col("tag_id"))),
    }
    found = []
    for name, df in inputs.items():
        try:
            readers.check_readings(df, ("temperature",))
            found.append((name, "ok"))
        except ValueError as error:
            found.append((name, str(error)))
    return spark.createDataFrame(found, "input string, outcome string")


# Sinks and stored models
@query(
    v.with_views(
        "metrics_raw livestock",
        f"""WITH {Z_SQL} SELECT CAST(tag_id AS VARCHAR) AS tag_id, {time_text("date")} AS date, animal_type,
CAST(farm_id AS VARCHAR) AS farm_id, {ROUNDED_METRICS}, {rounded("anomaly_score")} AS anomaly_score
FROM enriched WHERE is_anomaly""",
    )
)
def export_anomalies_essential(spark, sf_dir):
    """The nine essential columns of the flagged rows, written as CSV and read back."""
    rows = flagged(spark, sf_dir).filter("is_anomaly")
    files = writers.export_anomalies(rows, new_folder(spark, "export"), v.METRICS_AS_OF, details=False)
    back = readers.read_csv(spark, files["csv"])
    return back.withColumn("anomaly_score", F.col("anomaly_score").cast("double")).drop("is_anomaly")


@query(
    v.with_views(
        "metrics_raw",
        "SELECT arrival_id, " + ", ".join(f"{_scaled(m, 'standard')} AS {m}_normalized" for m in METRICS)
        + " FROM metrics_raw",
    )
)
def normalize_stored(spark, sf_dir):
    path, rows = f"{new_folder(spark, 'scaler')}/fitted", v.metrics_raw(spark, sf_dir)
    normalize.save(normalize.fit(rows, METRICS), path)
    scaled = normalize.transform(rows, normalize.load(spark, path), METRICS)
    return scaled.select("arrival_id", *[f"{m}_normalized" for m in METRICS])


@query(v.with_views("metrics_raw", "SELECT arrival_id, true AS same FROM metrics_raw"))
def forest_stored(spark, sf_dir):
    """A forest that was stored and loaded flags and scores every row as the fitted one does."""
    path, rows = new_folder(spark, "forest"), v.metrics_raw(spark, sf_dir)
    forest = iforest.fit(rows, METRICS, ["arrival_id"])
    iforest.save(spark, forest, path)
    loaded = iforest.load(spark, path)
    both = iforest.apply_to_training(rows, forest).select(*rows.columns, F.struct("if_anomaly", "if_anomaly_score").alias("_f"))
    both = iforest.apply_to_training(both, loaded)
    return both.select("arrival_id", F.col("_f").eqNullSafe(F.struct("if_anomaly", "if_anomaly_score")).alias("same"))


@query(v.with_views("livestock", "SELECT animal_type, count(*) AS n FROM livestock GROUP BY 1"))
def report_stored(spark, sf_dir):
    folder = new_folder(spark, "report")
    writers.save_report({"types": stats.counts_by(v.livestock(spark, sf_dir), "animal_type")}, folder)
    return readers.load_report(spark, folder, ["types"])["types"]


@query(
    v.with_views(
        "metrics_daily livestock",
        f"""WITH {MEASURES}, {ISSUES} SELECT *, NULL::VARCHAR AS "column" FROM issues WHERE severity = 'high'""",
    )
)
def dq_issues_high(spark, sf_dir):
    return quality.issues_of(quality.issues(quality.measures(readings(spark, sf_dir), v.QUALITY_AS_OF)), "HIGH")


@query(
    """SELECT o_orderkey, CASE WHEN size = 0 THEN '0 B' WHEN size >= 1073741824 THEN printf('%.1f GB', size / 1073741824)
WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024)
ELSE printf('%.1f B', size) END AS size_text FROM (
  SELECT o_orderkey, CAST(o_orderkey % 41 AS DOUBLE) * pow(10, o_orderkey % 10) AS size FROM orders)"""
)
def size_texts(spark, sf_dir):
    size = (F.col("o_orderkey") % 41).cast("double") * F.pow(F.lit(10), F.col("o_orderkey") % 10)
    return v.table(spark, sf_dir, "orders").select("o_orderkey", size_text(size).alias("size_text"))


# Contracts and rules
_ERRORS = {c: f"{severity_of(checks)} = 'error'" for c, checks in HERD_CHECKS.items()}
_WARNINGS = {c: f"{severity_of(checks)} = 'warning'" for c, checks in HERD_CHECKS.items()}


def _names(found: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{c}' END" for c, cond in found.items()) + ")"


@query(
    v.with_views(
        "herd_daily",
        f"""SELECT farm_id, animal_type, total_animals, activity_level, {_names(_ERRORS)} AS errors,
{_names(_WARNINGS)} AS warnings FROM herd_daily""",
    )
)
def contract_row_verdicts(spark, sf_dir):
    found = ct.with_verdicts(v.herd_daily(spark, sf_dir), HERD)
    names = {level: F.transform(level, lambda item: item["column"]).alias(level) for level in ("errors", "warnings")}
    return found.select("farm_id", "animal_type", "total_animals", "activity_level", *names.values())


WORDS = ("true", "1", "YES", "y", "False", "0", "No", "maybe", "")
_WORD = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"


@query(
    f"""SELECT event_id, CASE WHEN word IS NULL THEN 'Column ''word'' cannot be null'
ELSE 'Column ''word'' must be boolean, got ' || word END AS message
FROM (SELECT event_id, {_WORD} AS word FROM events) WHERE word IS NULL OR word IN ('maybe', '')"""
)
def contract_booleans(spark, sf_dir):
    rows = v.table(spark, sf_dir, "events").select("event_id", F.expr(_WORD).alias("word"))
    contract = ct.Contract("words", (ct.ColumnRule("word", "boolean"),))
    return ct.issue_rows(rows, contract, ["event_id"]).select("event_id", "message")


@query(
    v.with_views(
        "herd_daily",
        f"""SELECT farm_id, {" OR ".join(f"({c})" for c in _ERRORS.values())} AS bad FROM herd_daily""",
    )
)
def contract_from_json(spark, sf_dir):
    """Row errors by a contract that went through JSON text."""
    rows = v.herd_daily(spark, sf_dir)
    contract = ct.Contract.from_json(HERD.to_json())
    return rows.select("farm_id", ct.has_errors(rows, contract).alias("bad"))


@query(
    v.with_views(
        "herd_daily",
        """SELECT 'large_herd' AS rule, count(*) FILTER (total_animals > 45) = 0 AS passed, 'warning' AS severity,
  count(*) FILTER (total_animals > 45) AS violations FROM herd_daily
UNION ALL SELECT 'needs_more', true, 'info', 0
UNION ALL SELECT 'broken', false, 'error', 0""",
    )
)
def contract_own_rules(spark, sf_dir):
    """Rules of the caller: one that counts, one whose column is missing, one that cannot be built."""
    own = [
        ru.Rule("large_herd", lambda df: F.col("total_animals") > 45, "%d large herds", ct.WARNING, ("total_animals",)),
        ru.Rule("needs_more", lambda df: F.col("weight") > 1, "%d heavy", columns=("weight",)),
        ru.Rule("broken", lambda df: F.col("nowhere") > 1, "%d"),
    ]
    return ru.rule_results(v.herd_daily(spark, sf_dir), own).select("rule", "passed", "severity", "violations")


# Detection steps over scores that SQL can compute as well
_SCORED = """scored AS (
  SELECT arrival_id, coalesce(heart_rate > 60, false) AS stat_is_anomaly, heart_rate / 100 AS stat_anomaly_score,
         value > 40 AS if_anomaly, least(10, value / 10) AS if_anomaly_score FROM metrics_raw),
e AS (SELECT *, coalesce(0.4e0 * 10 * stat_anomaly_score / (SELECT max(stat_anomaly_score) FROM scored)
              + 0.6e0 * if_anomaly_score >= 5, false) AS joint FROM scored)"""


@query(
    v.with_views(
        "metrics_raw",
        f"""WITH {_SCORED} SELECT coalesce(nullif(concat_ws('+', CASE WHEN stat_is_anomaly THEN 'statistical' END,
  CASE WHEN if_anomaly THEN 'isolation_forest' END, CASE WHEN joint THEN 'ensemble' END), ''), 'none') AS detection_method,
  count(*) AS n FROM e GROUP BY 1""",
    )
)
def methods_of_scores(spark, sf_dir):
    scored = v.metrics_raw(spark, sf_dir).select(
        "arrival_id",
        F.coalesce(F.col("heart_rate") > 60, F.lit(False)).alias("stat_is_anomaly"),
        (F.col("heart_rate") / 100).alias("stat_anomaly_score"),
        (F.col("value") > 40).alias("if_anomaly"),
        F.least(F.lit(10.0), F.col("value") / 10).alias("if_anomaly_score"),
    )
    return stats.counts_by(en.combine(scored), "detection_method")


_SHARES = {"temperature": "temperature / 50", "heart_rate": "heart_rate / 150", "activity_level": "activity_level"}


@query(
    v.with_views(
        "metrics_raw livestock",
        "WITH means AS (SELECT animal_type, count(*) AS anomalies, "
        + ", ".join(f"avg(coalesce({s}, 0)) AS {m}" for m, s in _SHARES.items())
        + """ FROM metrics_raw LEFT JOIN livestock USING (tag_id) WHERE value > 40 GROUP BY 1),
long AS ("""
        + " UNION ALL ".join(f"SELECT animal_type, anomalies, {m} AS w, {i} AS i, '{m}' AS f FROM means" for i, m in enumerate(METRICS))
        + """) SELECT animal_type, anomalies, string_agg(f, ',' ORDER BY w DESC, i) AS top_features FROM long GROUP BY 1, 2""",
    )
)
def top_features_of_scores(spark, sf_dir):
    herd = v.livestock(spark, sf_dir).select("tag_id", "animal_type")
    scored = v.metrics_raw(spark, sf_dir).filter("value > 40").join(herd, "tag_id", "left").withColumns(
        {f"{m}_if_contribution": F.coalesce(F.expr(s), F.lit(0.0)) for m, s in _SHARES.items()}
    )
    return scored.groupBy("animal_type").agg(
        F.count("*").alias("anomalies"), iforest.top_features(METRICS, scored.columns).alias("top_features")
    )


@query(
    v.with_views(
        "metrics_raw livestock",
        f"""WITH marked AS (
  SELECT farm_id, tag_id, animal_type, time_bucket(INTERVAL 7 DAY, date, TIMESTAMP '1970-01-01') AS start_date,
         coalesce(heart_rate > 100, false) AS a, heart_rate / 20 AS a_score, value > 40 AS f, value / 10 AS f_score
  FROM metrics_raw LEFT JOIN livestock USING (tag_id) WHERE farm_id IS NOT NULL),
figures AS (
  SELECT farm_id, start_date, count(*) FILTER (a) >= 3 AS has_a, count(*) FILTER (f) >= 3 AS has_f,
         count(DISTINCT tag_id) FILTER (a) AS a_animals, count(DISTINCT tag_id) FILTER (f) AS f_animals,
         avg(a_score) FILTER (a) AS a_mean, avg(f_score) FILTER (f) AS f_mean,
         coalesce(list(DISTINCT animal_type) FILTER (a), []) AS a_types,
         coalesce(list(DISTINCT animal_type) FILTER (f), []) AS f_types
  FROM marked GROUP BY 1, 2),
merged AS (
  SELECT farm_id, start_date, CAST(has_a AS INT) + CAST(has_f AS INT) AS methods,
         greatest(CASE WHEN has_a THEN a_animals ELSE 0 END, CASE WHEN has_f THEN f_animals ELSE 0 END) AS affected_animals,
         CASE WHEN has_a AND has_f THEN (a_mean + f_mean) / 2 WHEN has_a THEN a_mean ELSE f_mean END AS mean,
         list_sort(list_distinct(list_concat(CASE WHEN has_a THEN a_types ELSE [] END, CASE WHEN has_f THEN f_types ELSE [] END))) AS types,
         concat_ws(',', CASE WHEN has_f THEN 'isolation_forest' END, CASE WHEN has_a THEN 'statistical' END) AS detection_methods,
         CASE WHEN has_f THEN 'activity_level,heart_rate,temperature' ELSE '' END AS features_contributing
  FROM figures WHERE has_a OR has_f)
SELECT farm_id, {time_text("start_date")} AS start_date, {time_text("start_date + INTERVAL 7 DAY")} AS end_date, affected_animals,
       array_to_string(types, ',') AS animal_types, detection_methods, {rounded("mean")} AS avg_anomaly_score,
       features_contributing, {rounded("least(10, mean * methods / 2)")} AS ensemble_score,
       CASE WHEN affected_animals >= 10 OR mean >= 7 THEN 'critical' WHEN affected_animals >= 5 OR mean >= 5 THEN 'high'
            WHEN affected_animals >= 3 OR mean >= 3 THEN 'medium' ELSE 'low' END AS severity
FROM merged WHERE affected_animals >= 3""",
    )
)
def ensemble_clusters_of_scores(spark, sf_dir):
    herd = v.livestock(spark, sf_dir).select("tag_id", "animal_type", "farm_id")
    scored = v.metrics_raw(spark, sf_dir).join(herd, "tag_id", "left").withColumns(
        {
            "is_anomaly": F.coalesce(F.col("heart_rate") > 100, F.lit(False)),
            "anomaly_score": F.col("heart_rate") / 20,
            "if_anomaly": F.col("value") > 40,
            "if_anomaly_score": F.col("value") / 10,
            **{f"{m}_if_contribution": F.coalesce(F.expr(s), F.lit(0.0)) for m, s in _SHARES.items()},
        }
    )
    return en.detect_ensemble_clusters(scored)
