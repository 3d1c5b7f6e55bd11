"""Queries: sinks and sources written and read back, streams, and the whole pipeline."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..constants import METRICS, DetectionSettings
from ..operators import contracts as ct
from ..operators import logs as lg
from ..operators import storage
from ..session import new_folder
from ..sources import readers, writers
from ..streaming import jobs
from . import pipeline
from . import views as v
from .q_clean import ROUNDED_METRICS
from .q_contracts import BAD, HERD
from .q_detection import CLUSTER_SQL, Z_SQL, enriched, flagged
from .q_logs import FIELDS, RECORD
from .q_reports import ALERT_AS_OF
from .registry import query, rounded, time_text

NARROW = ("arrival_id", "tag_id", "date", *METRICS)


def timed(df):
    """Readings with ``date`` as a timestamp, as streams need it."""
    return df.withColumn("date", F.col("date").cast("timestamp"))


# Sinks and sources
@query(
    v.with_views(
        "metrics_raw",
        f"""SELECT CAST(arrival_id AS VARCHAR) AS arrival_id, CAST(tag_id AS VARCHAR) AS tag_id,
{time_text("date")} AS date, {ROUNDED_METRICS} FROM metrics_raw""",
    )
)
def export_csv_readback(spark, sf_dir):
    rows = v.metrics_raw(spark, sf_dir).select(*NARROW)
    files = writers.export_health_metrics(rows, new_folder(spark, "export"), v.METRICS_AS_OF)
    return readers.read_csv(spark, files["csv"])


@query(
    v.with_views(
        "alerts",
        f"""SELECT id, farm_id, severity, message, affected_animals, is_resolved, {time_text("created_at")} AS created_at,
(SELECT count(*) FROM alerts) AS record_count FROM alerts""",
    )
)
def export_json_readback(spark, sf_dir):
    files = writers.export_alerts(v.alerts(spark, sf_dir), new_folder(spark, "export"), v.ALERTS_AS_OF)
    about = readers.read_json(spark, f"{files['json']}/metadata", "record_count bigint", multi_line=False)
    rows = readers.read_json(
        spark, f"{files['json']}/data",
        "id bigint, farm_id string, severity string, message string, affected_animals bigint, is_resolved boolean, "
        "created_at timestamp", multi_line=False,
    )
    return rows.withColumn("record_count", about.select("record_count").scalar())


@query(
    v.with_views(
        "alerts",
        f"""SELECT id, farm_id, severity, affected_animals,
'[2001-08-01 00:00:00] [' || upper(severity) || '] Farm: ' || farm_id || ' | Animals: ' || affected_animals || ' | '
|| message AS line FROM alerts WHERE severity <> 'low'""",
    )
)
def alert_log_readback(spark, sf_dir):
    folder = new_folder(spark, "alert-log")
    alerts = v.alerts(spark, sf_dir)
    writers.log_alerts(alerts.filter("severity = 'low'"), folder, "2001-07-20 00:00:00")
    writers.log_alerts(alerts.filter("severity <> 'low'"), folder, v.ALERTS_AS_OF)
    return readers.recent_alerts(spark, folder, v.ALERTS_AS_OF, 7).select(
        "id", "farm_id", "severity", "affected_animals", "line"
    )


@query(
    v.with_views(
        "alerts", f"SELECT id, severity FROM alerts UNION ALL SELECT id, severity FROM alerts WHERE severity = 'high'"
    )
)
def alert_append(spark, sf_dir):
    folder = new_folder(spark, "alerts")
    alerts = v.alerts(spark, sf_dir).select("id", "severity")
    writers.append_alerts(alerts, folder)
    writers.append_alerts(alerts.filter("severity = 'high'"), folder)
    return spark.read.schema(alerts.schema).parquet(folder)


@query(v.with_views("livestock", "SELECT * FROM livestock WHERE is_active"))
def snapshot_latest(spark, sf_dir):
    folder = new_folder(spark, "snapshots")
    herd = v.livestock(spark, sf_dir)
    writers.save_snapshot(herd, folder, "livestock", "20240101_000000")
    writers.save_snapshot(herd.filter("is_active"), folder, "livestock", "20240201_000000")
    return readers.latest_snapshot(spark, folder, "livestock")


@query(v.with_views("logs", f"SELECT {RECORD.replace('event_id, ', '')} FROM logs WHERE operation <> 'error'"))
def log_files_readback(spark, sf_dir):
    folder = new_folder(spark, "logs")
    lines = v.log_lines(spark, sf_dir).select("line")
    lines.write.text(f"{folder}/raw", compression="gzip")
    parsed = lg.parse_lines(spark.read.text(f"{folder}/raw").withColumnRenamed("value", "line"))
    writers.export_logs([parsed], f"{folder}/export")
    return readers.read_json(
        spark, f"{folder}/export", "timestamp timestamp, level string, logger string, message string, "
        "operation string, duration_ms double", multi_line=False,
    ).select(*[c for c in FIELDS if c != "event_id"])


@query(
    v.with_views(
        "livestock",
        "SELECT animal_type, count(*) AS animals FROM livestock WHERE age_months >= 60 GROUP BY animal_type",
    )
)
def sql_over_tables(spark, sf_dir):
    return readers.run_sql(
        spark, "SELECT animal_type, count(*) AS animals FROM herd WHERE age_months >= :age GROUP BY animal_type",
        {"herd": v.livestock(spark, sf_dir)}, age=60,
    )


@query(
    v.with_views(
        "metrics_raw",
        f"""SELECT tag_id, {time_text("date")} AS date,
{rounded("CASE WHEN date >= TIMESTAMP '2024-01-20' THEN temperature + 1 ELSE temperature END")} AS temperature,
{rounded("heart_rate")} AS heart_rate FROM metrics_raw WHERE date < TIMESTAMP '2024-01-25'
UNION ALL SELECT tag_id, {time_text("date")}, {rounded("temperature + 1")}, NULL FROM metrics_raw
WHERE date >= TIMESTAMP '2024-01-25'""",
    )
)
def upsert_stored_metrics(spark, sf_dir):
    rows = v.metrics_raw(spark, sf_dir)
    folder = new_folder(spark, "metrics")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    storage.create_metrics(
        rows.filter(F.col("date") < at("2024-01-25")).select("tag_id", "date", "temperature", "heart_rate"), folder
    )
    batch = rows.filter(F.col("date") >= at("2024-01-20")).select(
        "tag_id", "date", (F.col("temperature") + 1).alias("temperature"), "arrival_id"
    )
    storage.save_metrics(batch, folder, arrival="arrival_id")
    return storage.read_metrics(spark, folder)


@query(
    v.with_views(
        "metrics_raw",
        f"""SELECT 'old' AS version, tag_id, {time_text("date")} AS date, {rounded("temperature")} AS temperature FROM metrics_raw
WHERE date < TIMESTAMP '2024-01-25' UNION ALL
SELECT 'new', tag_id, {time_text("date")}, {rounded("CASE WHEN date >= TIMESTAMP '2024-01-20' THEN temperature + 1 ELSE temperature END")}
FROM metrics_raw""",
    )
)
def stored_versions(spark, sf_dir):
    """The readings before and after a save; the old version is taken before the save and read after it."""
    rows = v.metrics_raw(spark, sf_dir).select("tag_id", "date", "temperature", "arrival_id")
    folder = new_folder(spark, "versions")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    storage.create_metrics(rows.filter(F.col("date") < at("2024-01-25")).drop("arrival_id"), folder)
    old = storage.read_metrics(spark, folder)
    batch = rows.filter(F.col("date") >= at("2024-01-20")).withColumn("temperature", F.col("temperature") + 1)
    made = storage.save_metrics(batch, folder, arrival="arrival_id")
    new = storage.read_metrics(spark, folder, made.number)
    return old.select(F.lit("old").alias("version"), "*").unionByName(new.select(F.lit("new").alias("version"), "*"))


@query(
    v.with_views(
        "livestock",
        "SELECT tag_id, CASE WHEN is_active THEN farm_id ELSE -1 END AS farm_id, age_months FROM livestock",
    )
)
def upsert_stored_animals(spark, sf_dir):
    """Animals that are not active move to another farm; only their buckets are rewritten."""
    herd = v.livestock(spark, sf_dir).select("tag_id", "farm_id", "age_months", "is_active")
    folder = new_folder(spark, "herd")
    storage.create_animals(herd.drop("is_active"), folder)
    storage.save_animals(herd.filter("not is_active").select("tag_id", F.lit(-1).cast("bigint").alias("farm_id")), folder)
    return storage.read_animals(spark, folder)


# Streams
def _stream_of(spark, df, label, files_per_batch=None):
    folder = new_folder(spark, label)
    df.write.parquet(f"{folder}/in")
    stream = jobs.read_files(spark, f"{folder}/in", df.schema, files_per_batch=files_per_batch)
    return folder, stream


@query(v.with_views("metrics_daily", f"SELECT DISTINCT tag_id, {time_text('date')} AS date FROM metrics_daily"))
def stream_dedup(spark, sf_dir):
    rows = timed(v.metrics_daily(spark, sf_dir)).select("tag_id", "date")
    folder, stream = _stream_of(spark, rows, "stream-dedup")
    jobs.dedup(stream, f"{folder}/out", f"{folder}/state", delay="40 days").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query(
    v.with_views(
        "herd_daily",
        f"""SELECT 'good' AS kind, animal_type, count(*) AS rows FROM herd_daily WHERE NOT ({BAD}) GROUP BY 2
UNION ALL SELECT 'bad', animal_type, count(*) FROM herd_daily WHERE {BAD} GROUP BY 2""",
    )
)
def stream_validate(spark, sf_dir):
    rows = timed(v.herd_daily(spark, sf_dir))
    folder, stream = _stream_of(spark, rows, "stream-validate")
    good, bad = f"{folder}/good", f"{folder}/bad"
    jobs.validate(stream, HERD, good, bad, f"{folder}/state").awaitTermination()
    parts = [
        spark.read.parquet(path).groupBy("animal_type").agg(F.count("*").alias("rows")).withColumn("kind", F.lit(kind))
        for kind, path in (("good", good), ("bad", bad))
    ]
    return parts[0].unionByName(parts[1])


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""WITH {Z_SQL}, {CLUSTER_SQL}
SELECT farm_id, {time_text("start_date")} AS start_date, {time_text("start_date + INTERVAL 7 DAY")} AS end_date,
       anomaly_rows, affected_animals, {rounded("avg_anomaly_score")} AS avg_anomaly_score, animal_types
FROM clusters WHERE start_date + INTERVAL 7 DAY <= (SELECT max(date) FROM enriched WHERE is_anomaly) - INTERVAL 1 DAY""",
    )
)
def stream_clusters(spark, sf_dir):
    rows = timed(flagged(spark, sf_dir)).select(
        "tag_id", "date", "farm_id", "animal_type", "is_anomaly", "anomaly_score"
    )
    folder, stream = _stream_of(spark, rows, "stream-clusters")
    jobs.clusters(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    shape = jobs.outbreak_clusters(rows).schema
    return spark.read.schema(shape).parquet(f"{folder}/out")


SCORED_SQL = Z_SQL.split("flagged AS")[0].rstrip().rstrip(",")
SCORES = ", ".join(f"{rounded(f'{m}_zscore')} AS {m}_zscore" for m in METRICS)


def _scored_in_parts(spark, parts, label, **options):
    """Runs the job once after each part has arrived and once after a tick that ends the readings."""
    folder, shape = new_folder(spark, label), parts[0].schema
    source = f"{folder}/in"

    def run():
        stream = jobs.read_files(spark, source, shape)
        jobs.rolling_scores(stream, f"{folder}/out", f"{folder}/state", **options).awaitTermination()

    for part in parts:
        part.write.mode("append").parquet(source)
        run()
    jobs.tick(spark, source, shape, datetime(2100, 1, 1))
    run()
    return jobs.read_flagged(spark, f"{folder}/out")


@query(v.with_views("metrics_raw", f"WITH {SCORED_SQL} SELECT arrival_id, tag_id, {time_text('date')} AS date, {SCORES} FROM scored"))
def stream_zscore(spark, sf_dir):
    """Readings in three deliveries, none of them in order, each over the whole time."""
    rows = timed(v.metrics_raw(spark, sf_dir)).select(*NARROW)
    turn = F.pmod(F.xxhash64("arrival_id"), F.lit(3))
    parts = [rows.filter(turn == k) for k in range(3)]
    return _scored_in_parts(spark, parts, "stream-zscore", delay="400 days").drop("late")


LATE_FROM, LATE_DELAY = "2024-01-20", 2
# Every 13th reading of the first days arrives after all others.
LATE_SQL = f"(arrival_id % 13 = 5 AND date < TIMESTAMP '{LATE_FROM}')"


@query(
    v.with_views(
        "metrics_raw",
        f"""WITH {SCORED_SQL.replace("FROM metrics_raw", f"FROM (SELECT * FROM metrics_raw WHERE NOT {LATE_SQL}) metrics_raw")}
SELECT arrival_id, tag_id, {time_text('date')} AS date, {SCORES}, false AS late FROM scored
UNION ALL SELECT arrival_id, tag_id, {time_text('date')}, {", ".join(["NULL"] * len(METRICS))}, true FROM metrics_raw WHERE {LATE_SQL}""",
    )
)
def stream_zscore_late(spark, sf_dir):
    """Late readings are set apart, the others are scored as if they had never been."""
    rows = timed(v.metrics_raw(spark, sf_dir)).select(*NARROW)
    late = (F.col("arrival_id") % 13 == 5) & (F.col("date") < F.lit(LATE_FROM).cast("timestamp"))
    return _scored_in_parts(spark, [rows.filter(~late), rows.filter(late)], "stream-late", delay=f"{LATE_DELAY} days")


@query(
    v.with_views(
        "metrics_daily",
        f"""WITH r AS (SELECT tag_id, date, date < TIMESTAMP '{LATE_FROM}' AND hash_ AS late FROM (
  SELECT *, CAST(tag_id AS VARCHAR) LIKE '%3' AS hash_ FROM metrics_daily))
SELECT (SELECT count(*) FROM r) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT tag_id, date FROM r WHERE NOT late)) AS rows_out,
(SELECT count(*) FROM r WHERE NOT late) - (SELECT count(*) FROM (SELECT DISTINCT tag_id, date FROM r WHERE NOT late)) AS copies,
(SELECT count(*) FROM r WHERE late) AS late, 0 AS dropped, true AS adds_up""",
    )
)
def stream_accounts(spark, sf_dir):
    """What a listener counts while readings of one group of animals arrive late and copies are dropped."""
    rows = timed(v.metrics_daily(spark, sf_dir)).select("tag_id", "date")
    late = (F.col("date") < F.lit(LATE_FROM).cast("timestamp")) & F.col("tag_id").cast("string").like("%3")
    folder, accounts = new_folder(spark, "stream-accounts"), jobs.Accounts()
    spark.streams.addListener(accounts)
    try:
        for part in (rows.filter(~late), rows.filter(late)):
            part.write.mode("append").parquet(f"{folder}/in")
            stream = jobs.read_files(spark, f"{folder}/in", rows.schema)
            gate = jobs.flag_late(stream, f"{folder}/gate", f"{folder}/s1", delay=f"{LATE_DELAY} days")
            gate.awaitTermination()
            flagged = accounts.of(gate)
        unique = jobs.dedup(jobs.on_time(spark, f"{folder}/gate", rows.schema), f"{folder}/out", f"{folder}/s2", delay="400 days")
        unique.awaitTermination()
        kept = accounts.of(unique)
    finally:
        spark.streams.removeListener(accounts)
    found = [flagged["in"], kept["out"], kept["copies"], flagged["late"], flagged["dropped"] + kept["dropped"]]
    return spark.createDataFrame(
        [(*found, flagged["in"] == kept["out"] + kept["copies"] + flagged["late"])],
        "rows_in long, rows_out long, copies long, late long, dropped long, adds_up boolean",
    )


@query(
    v.with_views(
        "metrics_raw",
        f"SELECT tag_id, {time_text('date')} AS date, {rounded('temperature')} AS temperature FROM metrics_raw",
    )
)
def stream_upsert(spark, sf_dir):
    rows = timed(v.metrics_raw(spark, sf_dir)).select("arrival_id", "tag_id", "date", "temperature")
    folder, stream = _stream_of(spark, rows, "stream-upsert")
    storage.create_metrics(
        rows.withColumn("temperature", F.lit(0.0)).filter("date < '2024-01-08'").drop("arrival_id"), f"{folder}/table"
    )
    jobs.upsert_readings(stream, f"{folder}/table", f"{folder}/state").awaitTermination()
    return storage.read_metrics(spark, f"{folder}/table")


# Pipeline
@query(
    v.with_views(
        "livestock metrics_raw",
        f"""WITH filled AS (SELECT * REPLACE ({", ".join(
            f"coalesce(last_value({m} IGNORE NULLS) OVER past, first_value({m} IGNORE NULLS) OVER future) AS {m}"
            for m in METRICS)}) FROM metrics_raw
  WINDOW past AS (PARTITION BY tag_id ORDER BY arrival_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         future AS (PARTITION BY tag_id ORDER BY arrival_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cleaned AS (SELECT * REPLACE (CASE WHEN activity_level < 0.1e0 THEN 0.1e0 ELSE activity_level END AS activity_level)
            FROM filled),
{Z_SQL.replace("FROM metrics_raw", "FROM cleaned")}, {CLUSTER_SQL}
SELECT farm_id, {time_text("start_date")} AS start_date, anomaly_rows, affected_animals,
       {rounded("avg_anomaly_score")} AS avg_anomaly_score, metrics_affected FROM clusters""",
    )
)
def pipeline_clusters(spark, sf_dir):
    done = pipeline.run(
        enriched(spark, sf_dir), v.METRICS_AS_OF, settings=DetectionSettings("statistical", threshold=1.5),
        switches={"data_quality": False},
    )
    return done.tables["clusters"].select(
        "farm_id", "start_date", "anomaly_rows", "affected_animals", "avg_anomaly_score", "metrics_affected"
    )


@query()
def pipeline_ensemble(spark, sf_dir):
    done = pipeline.run(
        enriched(spark, sf_dir), v.METRICS_AS_OF, settings=DetectionSettings(threshold=1.5),
        export_to=new_folder(spark, "pipeline"),
    )
    return done.tables["anomaly_by_type"]

