"""Dataset contracts: declared columns, verdicts per cell, and counts per column and table.

A contract turns into Column expressions. Counting runs in one aggregation without building
any message; listing the issues is one projection and an explode.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_date

ERROR, WARNING, INFO = "error", "warning", "info"
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")

# The kinds of column a contract can declare.
KINDS = (
    "integer", "float", "string", "boolean", "datetime", "categorical", "percentage", "count", "temperature",
    "weight",
)
# Words read as a boolean.
BOOLEAN_WORDS = ("true", "1", "yes", "y", "false", "0", "no", "n")


@dataclass(frozen=True)
class ColumnRule:
    """One declared column."""

    name: str
    kind: str
    required: bool = True
    nullable: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed: tuple | None = None
    pattern: str | None = None
    description: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown column kind: {self.kind}")


@dataclass(frozen=True)
class Contract:
    """A declared dataset."""

    name: str
    columns: tuple[ColumnRule, ...]
    required: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    row_count: tuple[int, int] | None = None
    version: str = "1.0"
    description: str = ""
    metadata: dict = field(default_factory=dict, compare=False)

    def column(self, name: str) -> ColumnRule | None:
        return next((c for c in self.columns if c.name == name), None)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> Contract:
        raw = json.loads(text)
        columns = tuple(
            ColumnRule(**{**c, "allowed": tuple(c["allowed"]) if c.get("allowed") else None}) for c in raw["columns"]
        )
        rows = tuple(raw["row_count"]) if raw.get("row_count") else None
        return Contract(
            name=raw["name"], columns=columns, required=tuple(raw.get("required", ())),
            primary_key=tuple(raw.get("primary_key", ())), row_count=rows, version=raw.get("version", "1.0"),
            description=raw.get("description", ""), metadata=raw.get("metadata", {}),
        )


def as_frame(spark: SparkSession, data) -> DataFrame:
    """A DataFrame as it is; one dict or a list of dicts as rows."""
    if isinstance(data, DataFrame):
        return data
    rows = [data] if isinstance(data, dict) else list(data)
    names = sorted({name for row in rows for name in row})
    # No type follows from a column without a value: it is read as text.
    empty = [name for name in names if all(row.get(name) is None for row in rows)]
    if not empty:
        return spark.createDataFrame(rows)
    known = [name for name in names if name not in empty]
    if known:
        df = spark.createDataFrame([{name: row.get(name) for name in known} for row in rows])
    else:
        df = spark.range(len(rows)).select()
    return df.select(*[F.col(f"`{name}`") if name in known else F.lit(None).cast("string").alias(name) for name in names])


def missing_and_extra(df: DataFrame, contract: Contract) -> tuple[list[str], list[str]]:
    """Declared columns the data lacks, and columns nobody declared."""
    declared = [c.name for c in contract.columns]
    return [c for c in declared if c not in df.columns], [c for c in df.columns if c not in declared]


def _is_null(name: str, kind: str) -> Column:
    col = F.col(name)
    return col.isNull() | F.isnan(col) if kind in ("double", "float") else col.isNull()


def _number(name: str, kind: str) -> Column:
    if kind in NUMBERS or kind.startswith("decimal"):
        return F.col(name).cast("double")
    return F.col(name).try_cast("double")


Message = Callable[[], Column]
VALUE = object()  # stands for the value as text in a message


def verdicts(rule: ColumnRule, kind: str) -> list[tuple[Column, str, Message]]:
    """What can be wrong with a value, in order; the first that applies is the verdict.

    Messages are functions, so that counting builds none.
    """
    col, name = F.col(rule.name), rule.name
    text = col.cast("string")
    number = _number(name, kind)
    textual = kind == "string"

    def says(*parts) -> Message:
        shown = text
        return lambda: F.concat(*[shown if p is VALUE else F.lit(p) for p in parts])

    out: list[tuple[Column, str, Message]] = []
    null = _is_null(name, kind)
    if not rule.nullable:
        out.append((null, ERROR, says(f"Column '{name}' cannot be null")))
    else:
        out.append((null, "", says("Null value allowed")))

    if rule.kind in ("integer", "float") and kind != "boolean":
        endless = (F.abs(number) == float("inf")) if rule.kind == "integer" else F.lit(False)
        out.append((number.isNull() | endless, ERROR, says(f"Column '{name}' type conversion failed: ", VALUE)))
    if rule.kind == "integer" and kind != "boolean":
        out.append((number != F.rint(number), ERROR, says(f"Column '{name}' must be integer, got ", VALUE)))
        if textual or kind in ("double", "float"):
            text = F.format_string("%.0f", number + 0.0)
    if rule.kind == "boolean" and kind != "boolean":
        fits = F.lower(col).isin(*BOOLEAN_WORDS) if textual else F.lit(False)
        out.append((~fits, ERROR, says(f"Column '{name}' must be boolean, got ", VALUE)))
    if rule.kind == "datetime" and not kind.startswith(("timestamp", "date")):
        if textual:
            out.append(
                (parse_date(col).isNull(), ERROR, says(f"Column '{name}' datetime format not recognized: ", VALUE))
            )
        else:
            out.append((F.lit(True), ERROR, says(f"Column '{name}' must be datetime, got ", VALUE)))
    if rule.kind in ("percentage", "temperature", "weight"):
        out.append((number.isNull(), ERROR, says(f"Column '{name}' must be {rule.kind}, got ", VALUE)))
    if rule.kind == "percentage":
        out.append(
            (~number.between(0, 100), ERROR, says(f"Column '{name}' must be between 0 and 100, got ", VALUE))
        )
    if rule.kind == "temperature":
        out.append(
            (~number.between(-50, 50), WARNING, says(f"Column '{name}' temperature unrealistic: ", VALUE, "°C"))
        )
    if rule.kind == "weight":
        out.append((number < 0, ERROR, says(f"Column '{name}' weight cannot be negative: ", VALUE)))

    if rule.min_value is not None:
        out.append(
            (number < rule.min_value, ERROR, says(f"Column '{name}' value ", VALUE, f" below minimum {rule.min_value}"))
        )
    if rule.max_value is not None:
        out.append(
            (number > rule.max_value, ERROR, says(f"Column '{name}' value ", VALUE, f" above maximum {rule.max_value}"))
        )
    if rule.allowed is not None:
        listed = text if rule.kind == "string" else col
        out.append((~listed.isin(*rule.allowed), ERROR, says(f"Column '{name}' value ", VALUE, " not in allowed values")))
    if rule.pattern is not None and (rule.kind == "string" or textual):
        # Anchored at the start only; a string column's values are compared as text, whatever holds them.
        out.append((~F.rlike(text, F.lit(f"^(?:{rule.pattern})")), ERROR, says(f"Column '{name}' value doesn't match pattern")))
    return out


def _first(found: list[tuple[Column, str, Message]], pick, otherwise: Column) -> Column:
    out = None
    for condition, severity, message in found:
        value = pick(severity, message)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise) if out is not None else otherwise


def severity_code(rule: ColumnRule, kind: str) -> Column:
    """0 fine, 1 warning, 2 error."""
    found = verdicts(rule, kind)
    if not can_warn(rule):
        # Nothing but errors: one flat condition keeps the generated code small.
        null, when_null, _ = found[0]
        bad = F.lit(False)
        for condition, _, _ in found[1:]:
            bad = bad | condition
        bad = (null | bad) if when_null == ERROR else (~null & bad)
        return F.when(bad, 2).otherwise(0)
    code = {ERROR: 2, WARNING: 1, "": 0}
    return _first(found, lambda severity, _: F.lit(code[severity]), F.lit(0))


def verdict(rule: ColumnRule, kind: str, infos: bool = True) -> Column:
    """struct(column, severity, message) of one cell; a fine one is 'info', or null without ``infos``."""
    shape = "struct<column:string,severity:string,message:string>"

    def item(severity: str, message: Message) -> Column:
        if not severity and not infos:
            return F.lit(None).cast(shape)
        return F.struct(
            F.lit(rule.name).alias("column"), F.lit(severity or INFO).alias("severity"), message().alias("message")
        )

    fine = item("", lambda: F.lit(f"Column '{rule.name}' validation passed"))
    return _first(verdicts(rule, kind), item, fine)


def _required_missing(df: DataFrame, contract: Contract, kinds: dict) -> dict[str, Column]:
    """Per required column: true where the row lacks it."""
    return {c: _is_null(c, kinds[c]) if c in kinds else F.lit(True) for c in contract.required}


def _lacking(df: DataFrame, contract: Contract, kinds: dict) -> list[Column]:
    """An error per required column the row lacks, on top of what its own rule says."""
    return [
        F.when(
            absent,
            F.struct(
                F.lit(c).alias("column"), F.lit(ERROR).alias("severity"),
                F.lit(f"Required column '{c}' is missing or null").alias("message"),
            ),
        )
        for c, absent in _required_missing(df, contract, kinds).items()
    ]


def _issues(df: DataFrame, contract: Contract, infos: bool) -> Column:
    """All verdicts of a row as an array, null where there is nothing to say."""
    kinds = dict(df.dtypes)
    cells = [verdict(rule, kinds[rule.name], infos) for rule in contract.columns if rule.name in kinds]
    return F.array(*_lacking(df, contract, kinds), *cells)


def with_verdicts(df: DataFrame, contract: Contract, infos: bool = True) -> DataFrame:
    """Add arrays ``errors``, ``warnings`` and (if wanted) ``infos`` of (column, severity, message)."""

    def of(level: str) -> Column:
        return F.filter("_v", lambda item: item["severity"] == level)

    levels = (ERROR, WARNING, INFO) if infos else (ERROR, WARNING)
    found = df.withColumn("_v", _issues(df, contract, infos))
    return found.withColumns({f"{level}s": of(level) for level in levels}).drop("_v")


def issue_rows(df: DataFrame, contract: Contract, keep: Sequence[str] = ()) -> DataFrame:
    """One row per error or warning, with the columns to keep."""
    found = df.select(*keep, F.explode(_issues(df, contract, infos=False)).alias("_i"))
    return found.filter(F.col("_i").isNotNull()).select(*keep, "_i.*")


def has_errors(df: DataFrame, contract: Contract) -> Column:
    """True for rows with at least one error; builds no message."""
    kinds = dict(df.dtypes)
    bad = F.lit(False)
    for absent in _required_missing(df, contract, kinds).values():
        bad = bad | absent
    for rule in contract.columns:
        if rule.name in kinds:
            bad = bad | (severity_code(rule, kinds[rule.name]) == 2)
    return bad


def can_warn(rule: ColumnRule) -> bool:
    return rule.kind == "temperature"


def counts(
    df: DataFrame, contract: Contract, also: dict[str, Column] | None = None, newest: str | None = None
) -> DataFrame:
    """All counts of a contract in one row: rows, clean rows, and per column nulls, errors, warnings.

    ``also`` names further conditions to count in the same pass, ``newest`` a column whose
    maximum is wanted.
    """
    kinds = dict(df.dtypes)
    present = [rule for rule in contract.columns if rule.name in kinds]
    lacking = _required_missing(df, contract, kinds)
    also = also or {}
    coded = df.select(
        *[severity_code(rule, kinds[rule.name]).alias(f"_s_{rule.name}") for rule in present],
        *[_is_null(rule.name, kinds[rule.name]).alias(f"_n_{rule.name}") for rule in present],
        *[condition.alias(name) for name, condition in also.items()],
        *([F.col(newest).alias("_newest")] if newest else []),
    )
    # A required column that exists is missing exactly where it is null.
    required = {c: F.col(f"_n_{c}") if c in kinds and contract.column(c) else absent for c, absent in lacking.items()}
    worst = F.greatest(F.lit(0), F.lit(0), *[F.col(f"_s_{rule.name}") for rule in present])
    bad = worst == 2
    for absent in required.values():
        bad = bad | absent
    aggs = [F.count("*").alias("total_rows"), F.count_if(~bad).alias("valid_rows")]
    for rule in present:
        s = F.col(f"_s_{rule.name}")
        aggs += [
            F.count_if(f"_n_{rule.name}").alias(f"nulls_{rule.name}"),
            F.count_if(s == 2).alias(f"errors_{rule.name}"),
        ]
        if can_warn(rule):
            aggs.append(F.count_if(s == 1).alias(f"warnings_{rule.name}"))
    aggs += [F.count_if(name).alias(name) for name in also]
    if newest:
        aggs.append(F.max("_newest").alias("newest"))
    counted = coded.agg(*aggs)
    zero = F.lit(0).cast("long")
    return counted.withColumns(
        {
            **{f"warnings_{r.name}": zero for r in present if not can_warn(r)},
            **{
                f"required_{c}": F.col(f"nulls_{c}") if c in kinds and contract.column(c) else F.col("total_rows")
                for c in contract.required
            },
        }
    )


def column_stats(df: DataFrame, contract: Contract, counted: DataFrame | None = None) -> DataFrame:
    """Per declared column: kind, presence, and number of nulls, errors and warnings.

    A null in a required column counts twice, as null and as missing required value.
    """
    counted = counts(df, contract) if counted is None else counted
    zero = F.lit(0).cast("long")
    rows = []
    for rule in contract.columns:
        here = rule.name in df.columns
        extra = F.col(f"required_{rule.name}") if rule.name in contract.required else zero
        absent = F.lit(1 if rule.required else 0).cast("long")
        rows.append(
            F.struct(
                F.lit(rule.name).alias("column"),
                F.lit(rule.kind).alias("data_type"),
                F.lit(rule.required).alias("required"),
                F.lit(here).alias("present"),
                (F.col(f"nulls_{rule.name}") if here else zero).alias("null_count"),
                ((F.col(f"errors_{rule.name}") if here else absent) + extra).alias("error_count"),
                (F.col(f"warnings_{rule.name}") if here else zero).alias("warning_count"),
            )
        )
    return counted.select(F.inline(F.array(*rows)))


def summary(df: DataFrame, contract: Contract, counted: DataFrame | None = None) -> DataFrame:
    """Totals of a contract check in one row."""
    counted = counts(df, contract) if counted is None else counted
    missing, extra = missing_and_extra(df, contract)
    present = [c.name for c in contract.columns if c.name in df.columns]
    dataset_errors = sum(1 for c in missing if contract.column(c).required)
    total = F.col("total_rows")
    errors = F.lit(dataset_errors).cast("long")
    warnings = F.lit(0).cast("long")
    for c in present:
        errors = errors + F.col(f"errors_{c}")
        warnings = warnings + F.col(f"warnings_{c}")
    infos = total * len(present) - warnings
    for c in present:
        infos = infos - F.col(f"errors_{c}")
    for c in contract.required:
        errors = errors + F.col(f"required_{c}")
    note = F.lit(None).cast("string")
    if contract.row_count:
        low, high = contract.row_count
        note = F.when(total < low, F.format_string(f"Only %d rows, expected at least {low}", total)).when(
            total > high, F.format_string(f"%d rows, expected at most {high}", total)
        )
    return counted.select(
        F.lit(contract.name).alias("contract"),
        F.lit(contract.version).alias("version"),
        total.alias("total_rows"),
        F.lit(len(contract.columns)).alias("columns_checked"),
        errors.alias("errors"),
        (warnings + note.isNotNull().cast("long")).alias("warnings"),
        infos.alias("infos"),
        F.col("valid_rows"),
        (total - F.col("valid_rows")).alias("invalid_rows"),
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit(",".join(extra)).alias("extra_columns"),
        note.alias("row_count_issue"),
        (errors == 0).alias("is_valid"),
    )


def is_valid(spark: SparkSession, contract: Contract, data) -> bool:
    """True when the data has no error; anything that goes wrong counts as invalid."""
    try:
        return bool(summary(as_frame(spark, data), contract).first()["is_valid"])
    except Exception:  # noqa: BLE001 - the answer to "is it valid" is then no
        return False


# Example value per kind, for templates.
EXAMPLES = {
    "integer": 0, "float": 0.0, "string": "example", "boolean": True, "datetime": "2024-01-01",
    "percentage": 50.0, "temperature": 37.5,
}


def template(spark: SparkSession, contract: Contract) -> DataFrame:
    """One example row of a contract."""
    return spark.range(1).select(*[F.lit(EXAMPLES.get(c.kind, "")).alias(c.name) for c in contract.columns])


def _columns(*rows) -> tuple[ColumnRule, ...]:
    return tuple(ColumnRule(name, kind, **options) for name, kind, options in rows)


# The contracts of the domain.
DAILY_HEALTH_METRICS = Contract(
    name="daily_health_metrics",
    description="Daily health metrics for livestock",
    columns=_columns(
        ("farm_id", "string", {"pattern": r"^FARM-\d{4}$", "description": "Farm identifier"}),
        ("date", "datetime", {"description": "Date of measurement"}),
        ("animal_type", "categorical", {"allowed": ("cattle", "swine", "poultry", "sheep", "goat")}),
        ("total_animals", "integer", {"min_value": 0, "max_value": 10000}),
        ("sick_animals", "integer", {"min_value": 0}),
        ("deceased_animals", "integer", {"min_value": 0}),
        ("avg_temperature", "temperature", {"min_value": 35, "max_value": 45}),
        ("feed_intake_percent", "percentage", {}),
        ("water_intake_percent", "percentage", {}),
        ("activity_level", "float", {"min_value": 0, "max_value": 10}),
        ("location_lat", "float", {"min_value": -90, "max_value": 90}),
        ("location_lon", "float", {"min_value": -180, "max_value": 180}),
    ),
    required=("farm_id", "date", "animal_type", "total_animals"),
    primary_key=("farm_id", "date", "animal_type"),
    row_count=(1, 1000),
)
OUTBREAK_ALERTS = Contract(
    name="outbreak_alerts",
    description="Outbreak alert records",
    columns=_columns(
        ("alert_id", "string", {"pattern": r"^ALERT-\d{8}-\d{6}$"}),
        ("timestamp", "datetime", {}),
        ("farm_id", "string", {}),
        ("severity", "categorical", {"allowed": ("low", "medium", "high", "critical")}),
        ("anomaly_score", "float", {"min_value": 0, "max_value": 1}),
        ("sick_count", "integer", {"min_value": 0}),
        ("description", "string", {"nullable": True}),
        ("status", "categorical",
         {"allowed": ("new", "investigating", "confirmed", "false_positive", "resolved")}),
    ),
    required=("alert_id", "timestamp", "farm_id", "severity"),
    primary_key=("alert_id",),
)
ENVIRONMENTAL_DATA = Contract(
    name="environmental_data",
    description="Environmental conditions data",
    columns=_columns(
        ("location_id", "string", {}),
        ("timestamp", "datetime", {}),
        ("temperature", "temperature", {"min_value": -30, "max_value": 50}),
        ("humidity", "percentage", {}),
        ("air_quality_index", "float", {"min_value": 0, "max_value": 500}),
        ("precipitation_mm", "float", {"min_value": 0}),
        ("wind_speed", "float", {"min_value": 0, "max_value": 200}),
    ),
    required=("location_id", "timestamp", "temperature"),
    primary_key=("location_id", "timestamp"),
)

_registry: dict[str, Contract] = {
    c.name: c for c in (DAILY_HEALTH_METRICS, OUTBREAK_ALERTS, ENVIRONMENTAL_DATA)
}


def register(contract: Contract) -> None:
    _registry[contract.name] = contract


def get(name: str) -> Contract:
    if name not in _registry:
        raise ValueError(f"no contract named {name}")
    return _registry[name]


def names() -> list[str]:
    return list(_registry)


def without_row_count(contract: Contract) -> Contract:
    return replace(contract, row_count=None)
