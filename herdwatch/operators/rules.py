"""Rules across columns, the full validation report, the contract quality score, table constraints."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CONTRACT_WEIGHTS, GRADE_BANDS, QUALITY_GATE
from ..functions.scalars import band, moment, whole_days_between
from ..session import materialize
from . import contracts as ct
from .contracts import ERROR, INFO, WARNING, Contract
from .quality import duplicates


@dataclass(frozen=True)
class Rule:
    """A named check: ``violation`` gives a boolean column that is true in offending rows."""

    name: str
    violation: Callable[[DataFrame], Column]
    message: str
    severity: str = ERROR
    columns: tuple[str, ...] = ()


# The default rules and their limits.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "sick_animals_not_exceed_total",
        lambda df: F.col("sick_animals") > F.col("total_animals"),
        "Sick animals exceed total animals in %d rows",
        columns=("sick_animals", "total_animals"),
    ),
    Rule(
        "deceased_not_exceed_sick",
        lambda df: F.col("deceased_animals") > F.col("sick_animals"),
        "Deceased animals exceed sick animals in %d rows",
        columns=("deceased_animals", "sick_animals"),
    ),
    Rule(
        "activity_sickness_correlation",
        # Sick animals in an empty herd count as an infinite share.
        lambda df: (
            (F.try_divide(F.col("sick_animals").cast("double"), F.col("total_animals")) * 100 > 20)
            | ((F.col("total_animals") == 0) & (F.col("sick_animals") > 0))
        )
        & (F.col("activity_level") > 7),
        "High sickness with normal activity in %d rows",
        severity=WARNING,
        columns=("activity_level", "sick_animals", "total_animals"),
    ),
)
_rules: dict[str, Rule] = {r.name: r for r in DEFAULT_RULES}


def register_rule(rule: Rule) -> None:
    _rules[rule.name] = rule


def registered_rules() -> list[Rule]:
    return list(_rules.values())


def _row(name: str, passed: Column, severity: Column, violations: Column, message: Column) -> Column:
    return F.struct(
        F.lit(name).alias("rule"), passed.alias("passed"), severity.alias("severity"),
        violations.cast("long").alias("violations"), message.alias("message"),
    )


def _violations(df: DataFrame, rules: Sequence[Rule]) -> tuple[dict[str, Column], list[Column]]:
    """Conditions to count, and one result per rule over a row that holds those counts.

    A rule whose columns are missing is skipped (passed, info). A rule that cannot be built
    counts as failed with an error.
    """
    conditions: dict[str, Column] = {}
    rows: list[Column] = []
    for i, rule in enumerate(rules):
        absent = [c for c in rule.columns if c not in df.columns]
        if absent:
            rows.append(
                _row(rule.name, F.lit(True), F.lit(INFO), F.lit(0), F.lit(f"Skipped - missing columns: {absent}"))
            )
            continue
        try:
            violation = rule.violation(df)
            df.select(violation)
        except Exception as error:  # noqa: BLE001 - a broken rule is a finding, not a crash
            rows.append(
                _row(rule.name, F.lit(False), F.lit(ERROR), F.lit(0), F.lit(f"Rule execution failed: {_reason(error)}"))
            )
            continue
        conditions[f"_r{i}"] = violation
        n = F.col(f"_r{i}")
        rows.append(
            _row(rule.name, n == 0, F.lit(rule.severity), n,
                 F.when(n > 0, F.format_string(rule.message, n)).otherwise("passed"))
        )
    return conditions, rows


def _key_result(df: DataFrame, primary_key: Sequence[str]) -> list[Column]:
    """The result of the key check, which takes a shuffle by key of its own."""
    lost = [c for c in primary_key if c not in df.columns]
    if not primary_key:
        return []
    name = "duplicate_primary_key"
    if lost:
        return [_row(name, F.lit(True), F.lit(INFO), F.lit(0), F.lit(f"Skipped - missing columns: {lost}"))]
    n = duplicates(df, primary_key).select("duplicate_rows").scalar()
    return [
        _row(name, n == 0, F.lit(ERROR), n,
             F.when(n > 0, F.format_string("Found %d duplicate rows based on primary key", n))
             .otherwise("No duplicate primary keys found"))
    ]


def _reason(error: Exception) -> str:
    return str(error).splitlines()[0] if str(error) else type(error).__name__


def _counted(
    df: DataFrame, rules: Sequence[Rule], count: Callable[[dict[str, Column]], DataFrame]
) -> tuple[DataFrame, list[Column]]:
    """The stored counts of all rules, from one pass, and a result per rule.

    A rule that fails while rows are read (a cast, a division) takes the joint pass with it. Then each rule is counted
    alone; those that fail again are findings, and one more joint pass counts the others.
    """
    conditions, rows = _violations(df, rules)
    try:
        return materialize(count(conditions)), rows
    except Exception as joint:  # noqa: BLE001 - which rule it was shows when they run alone
        broken = {}
        for name, violation in conditions.items():
            try:
                df.agg(F.count_if(violation)).collect()
            except Exception as error:  # noqa: BLE001
                broken[name] = error
        if not broken:
            raise joint
    for name, error in broken.items():
        del conditions[name]
        i = int(name.removeprefix("_r"))
        rows[i] = _row(rules[i].name, F.lit(False), F.lit(ERROR), F.lit(0), F.lit(f"Rule execution failed: {_reason(error)}"))
    return materialize(count(conditions)), rows


def rule_results(
    df: DataFrame, rules: Sequence[Rule] | None = None, primary_key: Sequence[str] = ()
) -> DataFrame:
    """One row per rule; all rules are counted in one pass, which runs at once."""

    def count(conditions: dict[str, Column]) -> DataFrame:
        return df.agg(F.count("*").alias("_n"), *[F.count_if(violation).alias(name) for name, violation in conditions.items()])

    counted, rows = _counted(df, registered_rules() if rules is None else list(rules), count)
    return counted.select(F.inline(F.array(*rows, *_key_result(df, primary_key))))


def rule_totals(results: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return results.agg(
        F.count_if(failed & (F.col("severity") == ERROR)).alias("rule_errors"),
        F.count_if(failed & (F.col("severity") == WARNING)).alias("rule_warnings"),
    )


def _share_flags(df: DataFrame) -> dict[str, Column]:
    """The contradictions the consistency score looks at."""
    pairs = {"_sick": ("sick_animals", "total_animals"), "_dead": ("deceased_animals", "sick_animals")}
    return {
        name: F.col(of) > F.col(above)
        for name, (of, above) in pairs.items()
        if of in df.columns and above in df.columns
    }


def validate(df: DataFrame, contract: Contract, rules: Sequence[Rule] | None = None) -> dict[str, DataFrame]:
    """Contract and rules together.

    Cells, rules and the figures of the quality score come from one pass, the key check from
    another; both are computed once and kept. All tables returned are small.
    """
    # Nulls of declared columns are counted anyway.
    _, undeclared = ct.missing_and_extra(df, contract)
    present = {f"_p_{c}": F.col(c).isNotNull() for c in undeclared}
    date = _date_column(df)
    unreadable = {}
    if date and dict(df.dtypes)[date] == "string":
        unreadable = {"_unreadable": F.col(date).isNotNull() & _as_time(df, date).isNull()}
    timed = df.withColumn("_time", _as_time(df, date)) if date else df

    def count(conditions: dict[str, Column]) -> DataFrame:
        more = {**conditions, **present, **unreadable, **_share_flags(df)}
        return ct.counts(timed, contract, more, "_time" if date else None)

    counted, rows = _counted(df, registered_rules() if rules is None else list(rules), count)
    results = materialize(counted.select(F.inline(F.array(*rows, *_key_result(df, contract.primary_key)))))
    totals = rule_totals(results).select(F.struct("*")).scalar()
    summary = ct.summary(df, contract, counted)
    overall = summary.select(
        "contract", "version", "total_rows", F.col("errors").alias("schema_errors"),
        F.col("warnings").alias("schema_warnings"),
        totals["rule_errors"].alias("rule_errors"), totals["rule_warnings"].alias("rule_warnings"),
        (F.col("is_valid") & (totals["rule_errors"] == 0)).alias("is_valid"),
    )
    return {
        "overall": overall,
        "summary": summary,
        "column_stats": ct.column_stats(df, contract, counted),
        "rules": results,
        "counts": counted,
    }


def batch_summary(df: DataFrame, contract: Contract) -> DataFrame:
    """Records, valid and invalid ones and the rate; an empty batch is valid."""
    total, valid = F.col("total_rows"), F.col("valid_rows")
    return ct.counts(df, contract).select(
        total.alias("total_records"), valid.alias("valid_records"), (total - valid).alias("invalid_records"),
        F.when(total > 0, valid / total).otherwise(0.0).alias("validation_rate"),
        F.when(total == 0, "Empty batch").alias("message"),
    )


def split_valid(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and rows with errors together with what is wrong."""
    bad = ct.has_errors(df, contract)
    return df.filter(~bad), ct.with_verdicts(df.filter(bad), contract, infos=False).drop("warnings")


def _date_column(df: DataFrame) -> str | None:
    return next((c for c in ("date", "timestamp") if c in df.columns), None)


def _as_time(df: DataFrame, column: str) -> Column:
    return F.try_to_timestamp(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)


def quality_report(
    df: DataFrame, contract: Contract, as_of, validated: dict[str, DataFrame] | None = None
) -> DataFrame:
    """The five dimensions, the weighted score (3 places) and its grade: one row.

    Everything is read from the tables of ``validate``; the data is not scanned again.
    """
    validated = validated or validate(df, contract)
    overall = validated["overall"].select(F.struct("*")).scalar()
    rows = F.col("total_rows")
    present = F.lit(0)
    for c in df.columns:
        present = present + (rows - F.col(f"nulls_{c}") if contract.column(c) else F.col(f"_p_{c}"))
    consistency = F.lit(1.0)
    for flag in _share_flags(df):
        consistency = consistency - F.when(F.col(flag) > 0, 0.2).otherwise(0.0)
    timeliness = F.lit(0.5)
    if _date_column(df):
        age = whole_days_between(F.col("newest"), moment(as_of))
        counted = validated["counts"]
        unreadable = F.col("_unreadable") > 0 if "_unreadable" in counted.columns else F.lit(False)
        timeliness = (
            F.when(unreadable | age.isNull(), 0.5)
            .when(age <= 1, 1.0).when(age <= 3, 0.8).when(age <= 7, 0.5).otherwise(0.2)
        )
    measured = validated["counts"].select(
        rows.alias("rows"),
        F.when(rows > 0, present / (rows * len(df.columns))).otherwise(0.0).alias("completeness"),
        F.greatest(F.lit(0.0), consistency).alias("consistency"),
        timeliness.alias("timeliness"),
        F.when(rows > 0, F.col("valid_rows") / rows).otherwise(0.0).alias("accuracy"),
        F.when(overall["is_valid"], 1.0).otherwise(0.0).alias("validity"),
        overall["schema_errors"].alias("schema_errors"),
        overall["rule_errors"].alias("rule_errors"),
    )
    score = sum((F.col(name) * weight for name, weight in CONTRACT_WEIGHTS.items()), F.lit(0.0))
    return measured.withColumns(
        {"quality_score": F.round(score, 3), "grade": band(score, GRADE_BANDS), "columns": F.lit(len(df.columns))}
    )


def major_issues(validated: dict[str, DataFrame]) -> DataFrame:
    """Kind, column, count and description of what went wrong."""

    def item(count: Column, kind: str, column: Column, text: Column) -> Column:
        return F.when(
            count > 0,
            F.struct(F.lit(kind).alias("type"), column.alias("column"), count.alias("count"), text.alias("description")),
        )

    nothing = F.lit(None).cast("string")
    table_wide = validated["overall"].select(
        F.inline(
            F.array_compact(
                F.array(
                    item(F.col("schema_errors"), "schema_error", nothing,
                         F.lit("Data does not conform to expected schema")),
                    item(F.col("rule_errors"), "business_rule_error", nothing,
                         F.lit("Data violates business rules")),
                )
            )
        )
    )
    per_column = validated["column_stats"].filter("error_count > 0").select(
        F.lit("column_error").alias("type"), "column", F.col("error_count").alias("count"),
        F.format_string("Column '%s' has validation errors", "column").alias("description"),
    )
    return table_wide.unionByName(per_column)


def advice(report: DataFrame) -> DataFrame:
    """Recommendations that follow from a quality report."""
    return report.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("completeness") < 0.9, "Increase data completeness by reducing null values"),
                    F.when(F.col("accuracy") < 0.9, "Improve data accuracy by fixing validation errors"),
                    F.when(F.col("schema_errors") > 0, "Fix schema validation errors before processing"),
                    F.when(F.col("rule_errors") > 0, "Review and fix business rule violations"),
                )
            )
        ).alias("recommendation")
    )


def passes_gate(report: DataFrame, limits: dict[str, float] = QUALITY_GATE) -> DataFrame:
    """Whether the report reaches the minimum of every limited dimension."""
    ok = F.lit(True)
    for name, low in limits.items():
        ok = ok & (F.col(name) >= low)
    return report.select(*limits, ok.alias("passes"))


@dataclass(frozen=True)
class TableRules:
    """Declared constraints of a stored table."""

    types: dict[str, str]
    not_null: tuple[str, ...]
    checks: dict[str, str]
    unique: tuple[str, ...]


# The constraints of the stored tables.
STORED_TABLES: dict[str, TableRules] = {
    "livestock_health_metrics": TableRules(
        types={
            "avg_temperature": "decimal(4,1)", "feed_intake_percent": "decimal(5,2)",
            "water_intake_percent": "decimal(5,2)", "activity_level": "decimal(3,1)",
            "location_lat": "decimal(9,6)", "location_lon": "decimal(9,6)",
        },
        not_null=("farm_id", "date", "animal_type", "total_animals", "sick_animals", "deceased_animals"),
        checks={
            "total_animals": "total_animals >= 0",
            "sick_animals": "sick_animals >= 0 AND sick_animals <= total_animals",
            "deceased_animals": "deceased_animals >= 0 AND deceased_animals <= sick_animals",
            "avg_temperature": "avg_temperature BETWEEN 35 AND 45",
            "feed_intake_percent": "feed_intake_percent BETWEEN 0 AND 100",
            "water_intake_percent": "water_intake_percent BETWEEN 0 AND 100",
            "activity_level": "activity_level BETWEEN 0 AND 10",
        },
        unique=("farm_id", "date", "animal_type"),
    ),
    "outbreak_alerts": TableRules(
        types={"anomaly_score": "decimal(4,3)"},
        not_null=("alert_id", "timestamp", "farm_id", "sick_count"),
        checks={
            "severity": "severity IN ('low', 'medium', 'high', 'critical')",
            "anomaly_score": "anomaly_score BETWEEN 0 AND 1",
            "sick_count": "sick_count >= 0",
            "status": "status IN ('new', 'investigating', 'confirmed', 'false_positive', 'resolved')",
        },
        unique=("alert_id",),
    ),
    "environmental_data": TableRules(
        types={
            "temperature": "decimal(4,1)", "humidity": "decimal(5,2)", "air_quality_index": "int",
            "precipitation_mm": "decimal(6,2)", "wind_speed": "decimal(6,2)",
        },
        not_null=("location_id", "timestamp"),
        checks={
            "temperature": "temperature BETWEEN -30 AND 50",
            "humidity": "humidity BETWEEN 0 AND 100",
            "air_quality_index": "air_quality_index BETWEEN 0 AND 500",
            "precipitation_mm": "precipitation_mm >= 0",
            "wind_speed": "wind_speed BETWEEN 0 AND 200",
        },
        unique=("location_id", "timestamp"),
    ),
    "detection_results": TableRules(
        types={"anomaly_score": "decimal(4,3)", "confidence": "decimal(4,3)"},
        not_null=("detection_id", "timestamp", "farm_id", "algorithm", "anomaly_score"),
        checks={
            "anomaly_score": "anomaly_score BETWEEN 0 AND 1",
            "confidence": "confidence BETWEEN 0 AND 1",
        },
        unique=("detection_id",),
    ),
}


def constraint_violations(df: DataFrame, table: str) -> DataFrame:
    """Violations per constraint of a stored table: not null, type, check (null passes), unique."""
    rules = STORED_TABLES[table]
    typed = df.withColumns({c: F.col(c).try_cast(t) for c, t in rules.types.items() if c in df.columns})
    aggs, rows = [F.count("*").alias("_n")], []

    def add(constraint: str, violation: Column) -> None:
        aggs.append(F.count_if(violation).alias(f"_c{len(rows)}"))
        rows.append(
            F.struct(F.lit(constraint).alias("constraint"), F.col(f"_c{len(rows)}").alias("violations"))
        )

    for c in rules.not_null:
        if c in df.columns:
            add(f"not_null({c})", F.col(c).isNull())
    for name, check in rules.checks.items():
        if name in df.columns:
            add(f"check({name})", ~F.expr(check))
    repeated = duplicates(df, rules.unique).select("duplicate_rows").scalar()
    rows.append(F.struct(F.lit(f"unique({','.join(rules.unique)})").alias("constraint"), repeated.alias("violations")))
    return typed.agg(*aggs).select(F.inline(F.array(*rows)))
