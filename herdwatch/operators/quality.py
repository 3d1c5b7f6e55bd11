"""Data-quality analysis of readings on a percent scale.

``measures`` gathers everything in one row; scores, issues and advice are expressions over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DQ_ADVICE, DQ_GENERAL_ADVICE, DQ_WEIGHTS, PRIORITY_RANK, RATING_BANDS, REQUIRED_COLUMNS, VALID_RANGES,
)
from ..functions.scalars import band, moment, ranked, whole_days_between
from ..session import materialize
from .order_stats import quantiles
from .skew import with_previous_rows

KEYS = ("tag_id", "date")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def _valid(column: str) -> Column:
    """Non-null and, for the metrics, within the valid range."""
    if column in VALID_RANGES:
        low, high = VALID_RANGES[column]
        return F.count_if(F.col(column).between(low, high))
    return F.count(column)


def basic_stats(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Rows, animals, first and last date, span in days, and readings per animal: one row."""
    sizes = df.filter(F.col("tag_id").isNotNull()).groupBy("tag_id").agg(F.count("*").alias("size"))
    median = quantiles(sizes, "size", {"records_median": 0.5}, max_rows=max_rows).scalar()
    groups = sizes.agg(
        F.count("*").alias("unique_animals"),
        F.min("size").alias("records_min"),
        F.max("size").alias("records_max"),
        F.avg("size").alias("records_mean"),
    ).withColumn("records_median", median)
    g = groups.select(F.struct("*")).scalar()
    return df.agg(
        F.count("*").alias("total_records"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    ).select(
        "total_records",
        F.coalesce(g["unique_animals"], F.lit(0)).alias("unique_animals"),
        F.date_format("first_date", "yyyy-MM-dd").alias("first_date"),
        F.date_format("last_date", "yyyy-MM-dd").alias("last_date"),
        (whole_days_between(F.col("first_date"), F.col("last_date")) + 1).alias("days"),
        *[g[c].alias(c) for c in ("records_min", "records_max", "records_mean", "records_median")],
    )


def type_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("animal_type").isNotNull()).groupBy("animal_type").agg(F.count("*").alias("records"))


def cell_counts(df: DataFrame) -> DataFrame:
    """Rows, non-null and valid cells per column, newest date: one row from one pass."""
    return df.agg(
        F.count("*").alias("_n"),
        F.max("date").alias("_latest"),
        *[F.count(c).alias(f"_c_{c}") for c in df.columns],
        *[_valid(c).alias(f"_v_{c}") for c in df.columns],
    )


def completeness(
    df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS, counts: DataFrame | None = None
) -> DataFrame:
    """Share of non-null cells per column and over all (column '*')."""
    counts = cell_counts(df) if counts is None else counts
    n = F.col("_n")

    def row(name: str, present: Column, cells: Column, critical: bool) -> Column:
        return F.struct(
            F.lit(name).alias("column"),
            _percent(present, cells).alias("complete_pct"),
            (cells - present).alias("missing_count"),
            _percent(cells - present, cells).alias("missing_pct"),
            F.lit(critical).alias("critical"),
        )

    total = sum((F.col(f"_c_{c}") for c in df.columns), F.lit(0))
    rows = [row(c, F.col(f"_c_{c}"), n, c in required) for c in df.columns]
    rows.append(row("*", total, n * len(df.columns), False))
    return counts.select(F.inline(F.array(*rows)))


def validity(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Share of valid cells per column and over all (column '*')."""
    counts = cell_counts(df) if counts is None else counts
    n = F.col("_n")

    def row(name: str, valid: Column, cells: Column, ranged: bool) -> Column:
        bad = cells - valid
        return F.struct(
            F.lit(name).alias("column"),
            _percent(valid, cells).alias("valid_pct"),
            (bad if ranged else F.lit(None).cast("long")).alias("invalid_count"),
            (_percent(bad, cells) if ranged else F.lit(None).cast("double")).alias("invalid_pct"),
        )

    total = sum((F.col(f"_v_{c}") for c in df.columns), F.lit(0))
    rows = [row(c, F.col(f"_v_{c}"), n, c in VALID_RANGES) for c in df.columns]
    rows.append(row("*", total, n * len(df.columns), False))
    return counts.select(F.inline(F.array(*rows)))


def duplicates(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows that share their key with another row (all copies count), and the score from it."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("_size") > 1, F.col("_size"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("_size"), F.lit(0)).alias("_n"),
    ).select(
        "duplicate_rows",
        _percent(F.col("duplicate_rows"), F.col("_n")).alias("duplicate_pct"),
        F.greatest(F.lit(0.0), 100 - 2 * _percent(F.col("duplicate_rows"), F.col("_n"))).alias("score"),
    )


def type_conflicts(df: DataFrame) -> DataFrame:
    """Animals recorded with more than one type."""
    return (
        df.filter(F.col("tag_id").isNotNull())
        .groupBy("tag_id")
        .agg(F.count_distinct("animal_type").alias("types"))
        .filter(F.col("types") > 1)
    )


def date_disorder(df: DataFrame, arrival: str = "arrival_id", hot_key_rows: int | None = None) -> DataFrame:
    """Animals whose dates go back in arrival order, or are missing."""
    rows = df.filter(F.col("tag_id").isNotNull()).select("tag_id", "date", arrival)
    prepared = with_previous_rows(rows, ["tag_id"], [arrival], 1, hot_key_rows)
    back = F.col("date").isNull() | (F.col("date") < F.lag("date").over(prepared.window()))
    marked = prepared.finish(prepared.df.withColumn("_back", F.coalesce(back, F.lit(False))))
    return (
        marked.groupBy("tag_id")
        .agg(F.count("*").alias("readings"), F.count_if("_back").alias("steps_back"))
        .filter((F.col("readings") > 1) & (F.col("steps_back") > 0))
    )


def update_gaps(df: DataFrame, hot_key_rows: int | None = None) -> DataFrame:
    """Mean number of whole days between the readings of each animal."""
    rows = df.filter(F.col("tag_id").isNotNull()).select("tag_id", "date")
    prepared = with_previous_rows(rows, ["tag_id"], ["date"], 1, hot_key_rows)
    gap = whole_days_between(F.lag("date").over(prepared.window()), F.col("date"))
    gaps = prepared.finish(prepared.df.withColumn("_gap", gap))
    return gaps.groupBy("tag_id").agg(F.avg("_gap").alias("gap_days")).filter(F.col("gap_days").isNotNull())


def update_frequency(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Mean and median over animals of their mean gap; consistent up to 3 days. One row."""
    gaps = update_gaps(df, max_rows)
    median = quantiles(gaps, "gap_days", {"median_days_between": 0.5}, max_rows=max_rows).scalar()
    return gaps.agg(F.avg("gap_days").alias("mean_days_between")).select(
        "mean_days_between", median.alias("median_days_between"), (F.col("mean_days_between") <= 3).alias("consistent")
    )


def recency_score(days_old: Column) -> Column:
    return F.when(days_old <= 7, 100.0).when(days_old <= 30, 70.0).when(days_old <= 90, 40.0).otherwise(10.0)


def frequency_score(mean_days: Column) -> Column:
    return (
        F.when(mean_days.isNull(), 50.0)
        .when(mean_days <= 1, 100.0)
        .when(mean_days <= 3, 80.0)
        .when(mean_days <= 7, 60.0)
        .otherwise(30.0)
    )


def timeliness(
    df: DataFrame, as_of, max_rows: int | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Age of the newest reading, update frequency, and the score from both: one row."""
    mean_days = update_gaps(df, max_rows).agg(F.avg("gap_days")).scalar()
    newest = df.agg(F.max("date").alias("latest")) if counts is None else counts.select(F.col("_latest").alias("latest"))
    return (
        newest.select(
            F.date_format("latest", "yyyy-MM-dd").alias("latest_date"),
            whole_days_between(F.col("latest"), moment(as_of)).alias("days_old"),
            mean_days.alias("mean_days_between"),
        )
        .withColumns(
            {
                "is_recent": F.col("days_old") <= 7,
                "recency_score": recency_score(F.col("days_old")),
                "frequency_score": frequency_score(F.col("mean_days_between")),
            }
        )
        .withColumn("timeliness", F.col("recency_score") * 0.7 + F.col("frequency_score") * 0.3)
    )


def rating(score: Column) -> list[Column]:
    return [band(score, RATING_BANDS, 1).alias("rating"), band(score, RATING_BANDS, 2).alias("level")]


def measures(
    df: DataFrame, as_of, required: Sequence[str] = REQUIRED_COLUMNS, max_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """All dimensions and the quality score in one row; an empty table scores zero.

    Reads the table three times at most: cells, duplicates, gaps; each pass reads only its columns.
    """
    counts = cell_counts(df) if counts is None else counts
    n = F.col("_n")
    cells = n * len(df.columns)
    dup = duplicates(df).select(F.struct("*")).scalar()
    time = timeliness(df, as_of, max_rows, counts).select(F.struct("*")).scalar()
    base = counts.select(
        n.alias("total_records"),
        _percent(sum((F.col(f"_c_{c}") for c in df.columns), F.lit(0)), cells).alias("completeness"),
        _percent(sum((F.col(f"_v_{c}") for c in df.columns), F.lit(0)), cells).alias("validity"),
        *[_percent(n - F.col(f"_c_{c}"), n).alias(f"missing_{c}_pct") for c in required if c in df.columns],
    )
    empty = F.col("total_records") == 0
    full = base.withColumns(
        {
            "consistency": F.when(empty, 0.0).otherwise(dup["score"]),
            "timeliness": F.when(empty, 0.0).otherwise(time["timeliness"]),
            "duplicate_rows": dup["duplicate_rows"],
            "duplicate_pct": dup["duplicate_pct"],
            "days_old": time["days_old"],
            "latest_date": time["latest_date"],
        }
    )
    weighted = sum((F.col(name) * weight for name, weight in DQ_WEIGHTS.items()), F.lit(0.0))
    return full.withColumn("quality_score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), weighted)))


def score(measured: DataFrame) -> DataFrame:
    """The four dimensions, the score and its rating."""
    return measured.select(*DQ_WEIGHTS, "quality_score", *rating(F.col("quality_score")))


def _found(columns: Sequence[str]) -> Column:
    """Array of (type, severity, message, column) over a row of measures."""

    def issue(when: Column, kind: str, severity: Column, message: Column, column: str | None = None) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("type"),
                severity.alias("severity"),
                message.alias("message"),
                F.lit(column).cast("string").alias("column"),
            ),
        )

    def level(high: Column) -> Column:
        return F.when(high, "high").otherwise("medium")

    c = F.col
    some = c("total_records") > 0
    found = [
        issue(~some, "no_data", F.lit("high"), F.lit("No data available for analysis")),
        issue(
            some & (c("completeness") < 90), "completeness", level(c("completeness") < 70),
            F.format_string("Data completeness is %.1f%%", "completeness"),
        ),
        *[
            issue(
                some & (c(f"missing_{name}_pct") > 10), "missing_critical_column", F.lit("high"),
                F.format_string(f'Critical column "{name}" has %.1f%% missing values', f"missing_{name}_pct"), name,
            )
            for name in REQUIRED_COLUMNS
            if f"missing_{name}_pct" in columns
        ],
        issue(
            some & (c("validity") < 90), "validity", level(c("validity") < 70),
            F.format_string("Data validity is %.1f%%", "validity"),
        ),
        issue(
            some & (c("duplicate_pct") > 5), "duplicates", level(c("duplicate_pct") >= 20),
            F.format_string("%.1f%% of records are duplicates", "duplicate_pct"),
        ),
        issue(
            some & (c("days_old") > 30), "stale_data", level(c("days_old") > 90),
            F.format_string("Data is %d days old", "days_old"),
        ),
    ]
    return F.array_compact(F.array(*found))


def issues(measured: DataFrame) -> DataFrame:
    """One row per problem found: type, severity, message, column."""
    return measured.select(F.inline(_found(measured.columns)))


def issues_of(found: DataFrame, severity: str | None = None) -> DataFrame:
    return found if severity is None else found.filter(F.col("severity") == severity.lower())


def recommendations(measured: DataFrame) -> DataFrame:
    """Advice per kind of issue plus one general line, most urgent first."""
    quality = F.col("quality_score")
    shape = ("issue", "priority", "recommendation", "details")

    def item(*values: Column) -> Column:
        return F.struct(*[v.alias(name) for name, v in zip(shape, values)])

    advice = {**DQ_ADVICE, "no_data": "Collect more data"}
    texts = F.create_map(*[F.lit(x) for pair in advice.items() for x in pair])
    specific = F.transform(
        _found(measured.columns), lambda i: item(i["type"], i["severity"], texts[i["type"]], i["message"])
    )
    general = item(
        F.lit("general"), band(quality, DQ_GENERAL_ADVICE, 1), band(quality, DQ_GENERAL_ADVICE, 2),
        F.format_string("Quality score: %.1f%%", quality),
    )
    lines = F.concat(specific, F.when(F.col("total_records") > 0, F.array(general)).otherwise(F.array()))
    # A handful of rows; of several alike the first one stays.
    return (
        measured.select(F.posexplode(lines).alias("_at", "_l"))
        .groupBy("_l.issue", "_l.recommendation")
        .agg(F.min_by(F.struct("_l.priority", "_l.details"), "_at").alias("_f"))
        .select("issue", "_f.priority", "recommendation", "_f.details")
        .orderBy(ranked(F.col("priority"), PRIORITY_RANK, 2), "issue", "recommendation")
    )


def quick_check(df: DataFrame, as_of, keys: Sequence[str] = KEYS) -> DataFrame:
    """Missing values, duplicates, out-of-range values among the present ones, and age."""
    dup = duplicates(df, keys).select(F.struct("*")).scalar()
    counts = df.agg(
        F.count("*").alias("_n"),
        F.max("date").alias("_latest"),
        *[F.count(c).alias(f"_c_{c}") for c in df.columns],
        *[
            F.count_if(~F.col(c).between(*VALID_RANGES[c])).alias(f"_o_{c}")
            for c in ("temperature", "heart_rate")
            if c in df.columns
        ],
    )
    n = F.col("_n")

    def row(check: str, column: str | None, count: Column, pct: Column | None = None) -> Column:
        return F.struct(
            F.lit(check).alias("check"),
            F.lit(column).cast("string").alias("column"),
            count.cast("long").alias("count"),
            (F.lit(None).cast("double") if pct is None else pct).alias("pct"),
        )

    rows = [row("missing", c, n - F.col(f"_c_{c}"), _percent(n - F.col(f"_c_{c}"), n)) for c in df.columns]
    rows.append(row("duplicates", None, dup["duplicate_rows"], dup["duplicate_pct"]))
    rows += [
        row("out_of_range", c, F.col(f"_o_{c}")) for c in ("temperature", "heart_rate") if c in df.columns
    ]
    found = counts.select(
        F.inline(F.array(*rows, row("days_old", "date", whole_days_between(F.col("_latest"), moment(as_of)))))
    )
    return found.filter(((F.col("check") == "days_old") & (F.col("count") > 7)) | (
        (F.col("check") != "days_old") & (F.col("count") > 0)))


def analyze(df: DataFrame, as_of, max_rows: int | None = None) -> dict[str, DataFrame]:
    """The whole analysis as tables. Counts and measures, one row each, are computed once and kept."""
    counts = materialize(cell_counts(df))
    measured = materialize(measures(df, as_of, max_rows=max_rows, counts=counts))
    return {
        "basic_stats": basic_stats(df, max_rows),
        "type_counts": type_counts(df),
        "completeness": completeness(df, counts=counts),
        "validity": validity(df, counts=counts),
        "duplicates": duplicates(df),
        "timeliness": timeliness(df, as_of, max_rows, counts),
        "measures": measured,
        "score": score(measured),
        "issues": issues(measured),
        "recommendations": recommendations(measured),
    }


def text_report(measured: DataFrame) -> DataFrame:
    """The quality report as lines: (section, item, line)."""
    dims = F.array(
        *[
            F.struct(F.lit(1).alias("section"), F.lit(i).alias("item"),
                     F.format_string("%-12s: %6.1f%%", F.lit(name.title()), F.col(name)).alias("line"))
            for i, name in enumerate(DQ_WEIGHTS, 1)
        ]
    )
    stars = F.concat(F.repeat(F.lit("★"), F.col("level")), F.repeat(F.lit("☆"), 5 - F.col("level")))
    scored = score(measured)
    head = scored.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("section"), F.lit(0).alias("item"), F.lit("OVERALL QUALITY SCORE").alias("line")),
                F.struct(F.lit(0).alias("section"), F.lit(1).alias("item"),
                         F.concat_ws(" ", stars, F.upper("rating")).alias("line")),
                F.struct(F.lit(0).alias("section"), F.lit(2).alias("item"),
                         F.format_string("Score: %.1f%%", "quality_score").alias("line")),
                F.struct(F.lit(1).alias("section"), F.lit(0).alias("item"), F.lit("DIMENSION SCORES").alias("line")),
            )
        )
    )

    def numbered(df: DataFrame, section: int, title: str, text: Column) -> DataFrame:
        # At most a dozen rows by construction.
        lines = df.agg(F.array_sort(F.collect_list(text)).alias("_t")).filter(F.size("_t") > 0)
        whole = F.concat(F.array(F.lit(title)), F.transform("_t", lambda t, i: F.format_string("%d. %s", i + 1, t)))
        return lines.select(F.lit(section).alias("section"), F.posexplode(whole).alias("item", "line"))

    return (
        head.unionByName(scored.select(F.inline(dims)))
        .unionByName(
            numbered(issues(measured), 2, "ISSUES DETECTED",
                     F.format_string("[%s] %s", F.upper("severity"), "message"))
        )
        .unionByName(
            numbered(recommendations(measured), 3, "RECOMMENDATIONS",
                     F.format_string("[%s] %s", F.upper("priority"), "recommendation"))
        )
    )


def html_report(measured: DataFrame) -> DataFrame:
    """The quality report as HTML lines: headings and list entries."""
    text = text_report(measured)
    safe = F.replace(F.replace(F.replace("line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return text.withColumn(
        "line", F.when(F.col("item") == 0, F.concat(F.lit("<h2>"), safe, F.lit("</h2>"))).otherwise(
            F.concat(F.lit("<p>"), safe, F.lit("</p>")))
    )
