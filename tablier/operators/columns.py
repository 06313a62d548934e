"""Column resolution, predicates and value mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions.missing import gate_missing, null_or_nan


def resolve_features(df: DataFrame, target: str | None, features: list[str] | None = None,
                     id_columns=(), excluded=(), subgroup=None, group=None, date=None) -> list[str]:
    """The configured list, else all columns minus target and role columns."""
    if features:
        return list(features)
    drop = {target, subgroup, group, date, *id_columns, *excluded}
    return [c for c in df.columns if c not in drop]


def validate_columns(df: DataFrame, features: list[str], target: str | None) -> None:
    """Raise on missing target / features (schema only, no job)."""
    if not target:
        raise ValueError("No target column selected.")
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' is missing from the dataset.")
    if not features:
        raise ValueError("No feature columns selected.")
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"Selected feature columns are missing: {missing}.")


def _unpivot_one_row(row_df: DataFrame, names: list[str], value_prefix: str, out: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{value_prefix}{n}`").alias(out)) for n in names])
    return row_df.select(F.explode(items).alias("_x")).select("_x.column", f"_x.{out}")


def missing_counts(df: DataFrame, columns: list[str], rule: str = "gate") -> DataFrame:
    """Missing count per column in ONE aggregate; ``rule`` 'gate' (C3) or 'null'."""
    types = {f.name: f.dataType for f in df.schema.fields}
    pred = gate_missing if rule == "gate" else null_or_nan
    aggs = [F.count_if(pred(F.col(f"`{c}`"), types[c])).alias(f"m_{c}") for c in columns]
    return _unpivot_one_row(df.agg(*aggs), columns, "m_", "missing")


def selected_missing_counts(df: DataFrame, features: list[str], target: str | None) -> DataFrame:
    """Gate-missing counts over features + target (each once), non-zero only."""
    cols = list(dict.fromkeys([c for c in [*features, target] if c and c in df.columns]))
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count_if(gate_missing(F.col(f"`{c}`"), types[c])).alias(f"m_{c}") for c in cols]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`m_{c}`").alias("missing")) for c in cols])
    return (
        row.select(F.explode(items).alias("_x"), "_rows")
        .select("_x.column", "_x.missing", F.col("_rows").alias("rows"))
        .where(F.col("missing") > 0)
    )


def label_encoding_candidates(df: DataFrame, selected: list[str], target: str | None) -> list[str]:
    """Selected, non-target, text or boolean columns (schema only)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in selected if c != target and isinstance(types.get(c), (StringType, BooleanType))]


def prerequisite_error(df: DataFrame, features: list[str], target: str | None) -> str | None:
    """Configured columns exist and have no missing values; message or None."""
    try:
        validate_columns(df, features, target)
    except ValueError as exc:
        return str(exc)
    bad = selected_missing_counts(df, features, target).orderBy("column").collect()
    if bad:
        parts = ", ".join(f"{r['column']} ({r['missing']})" for r in bad)
        return f"Selected modeling columns contain empty values: {parts}."
    return None


def map_levels(spark: SparkSession, df: DataFrame, column: str, mapping: dict, out: str, default: str = "Other") -> DataFrame:
    """Value consolidation via a (bounded, literal) mapping table, default for the rest."""
    m = spark.createDataFrame([(str(k), str(v)) for k, v in mapping.items()], "_raw string, _grp string")
    joined = df.join(F.broadcast(m), F.col(column).cast("string") == F.col("_raw"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_grp"), F.lit(default))).drop("_raw", "_grp")


def drop_excluded(df: DataFrame, *groups) -> DataFrame:
    """Drop every listed column that exists (leakage, ids, dates, ...)."""
    cols = [c for g in groups for c in g if c in df.columns]
    return df.drop(*cols)
