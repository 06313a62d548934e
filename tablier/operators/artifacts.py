"""Saved split artifacts and their gate.

``save_split`` writes one partitioned table plus small metadata / coverage /
distribution tables; ``run_saved_gate`` reads them back into facts (one
``groupBy(split)`` pass over the saved rows carries every per-part fact) and
applies ``SAVED_RULES`` to them, as the gate does with its own rules.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from ..functions.missing import GATE_MISSING_MARKERS, WHITESPACE
from ..sources import sinks
from . import gate as G
from . import split as S
from .ranking import MAX_STRATA, bounded_collect

BALANCED = "Train Set (Balanced)"
COVERAGE_COLUMNS = ["class", "full_count", "train_count", "validation_count", "test_count", "status"]
PARTS = {"train": "balanced training", "validation": "validation", "test": "test"}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def save_split(spark: SparkSession, full: DataFrame, parts: DataFrame, out_dir: str, features: list[str], target: str,
               split_info: dict, imbalance_info: dict, label_col: str = "label") -> None:
    """Modeling subset, partitioned split table, metadata, coverage, distributions."""
    sinks.write_modeling_subset(full, features, target, f"{out_dir}/modeling_subset")
    sinks.write_split(parts, f"{out_dir}/split")
    parts = spark.read.schema(parts.schema).parquet(f"{out_dir}/split")  # what follows counts the saved rows, and makes none anew
    present = sorted(r[0] for r in parts.select("split").distinct().collect())
    sinks.write_metadata(spark, {"target_column": target, "parts": present, **split_info}, f"{out_dir}/split_meta")
    after = parts.where("split = 'train'").groupBy(S.class_label(label_col).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    after = {r["class"]: r["n"] for r in bounded_collect(after, MAX_STRATA, "classes in the metadata")}
    kept = {"warnings": [], "errors": [], "after": after, **imbalance_info}
    sinks.write_metadata(spark, {"target_column": target, **kept}, f"{out_dir}/imbalance_meta")
    cov = S.class_coverage(parts.withColumnRenamed(label_col, "_lbl").withColumn("_t", F.col("_lbl")), "_t")
    cov.write.mode("overwrite").parquet(f"{out_dir}/class_coverage")
    dist = S.class_distribution(parts.withColumn("_t", F.col(label_col)), "_t")
    dist = dist.withColumn("split", F.when(F.col("split") == "train", F.lit(BALANCED)).otherwise(F.col("split")))
    dist.write.mode("overwrite").parquet(f"{out_dir}/class_distribution")


# The texts of the issues.
_AGAIN = "Confirm Data Split & Imbalance again to "
SAVED_RULES: tuple[G.Rule, ...] = (
    G.Rule("configuration", "saved", G.FATAL, "configuration", lambda s: not s.confirmed,
           "Please confirm Column Configuration before running edge-case checks.",
           "Confirm the selected modeling columns and target on the Column Configuration page.", last=True),
    G.Rule("configuration", "saved", G.ERROR, "features", lambda s: s.target in s.features,
           "Target column '{target}' is included in feature_columns.",
           "Remove the target from the selected feature columns and confirm Column Configuration again."),
    G.Rule("configuration", "saved", G.FATAL, "configuration", lambda s: bool(s.absent),
           "Confirmed modeling columns are missing from the dataset: {absent}.",
           "Reload the matching dataset or confirm Column Configuration again."),
    *(r for r in G.RULES if (r.step, r.subjects) == ("features", "features") and not r.listed),
    *(r for r in G.RULES if (r.step, r.subjects) == ("target", "target") and r.level == G.ERROR and "empty values" in r.message),
    G.Rule("split", "saved", G.FATAL, "split", lambda s: not s.split_saved,
           "Please confirm Data Split & Imbalance before running edge-case checks.",
           "Confirm and save the Data Split & Imbalance configuration.", last=True),
    G.Rule("metadata", "metadata", G.FATAL, "artifacts", lambda m: m.saved_target != m.target,
           "Saved {name} target '{saved_target}' does not match current target '{target}'.",
           "Confirm Data Split & Imbalance again for the current target column."),
    G.Rule("parts", "parts", G.FATAL, "artifacts", lambda p: not p.rows, "Saved {name} artifact(s) are missing: ['{part}'].",
           _AGAIN + "recreate all saved arrays."),
    G.Rule("parts", "parts", G.FATAL, "artifacts", lambda p: p.rows != p.labels,
           "Saved {name} row counts do not match: X has {rows} rows and y has {labels} rows.", _AGAIN + "recreate aligned arrays."),
    G.Rule("parts", "parts", G.FATAL, "artifacts", lambda p: p.nonfinite > 0, "Saved array 'X_{name}' contains NaN or infinite values.",
           "Clean the selected modeling columns and confirm Data Split & Imbalance again."),
    G.Rule("parts", "parts", G.FATAL, "artifacts", lambda p: p.unlabelled > 0, "Saved array 'y_{name}' contains empty or missing target values.",
           "Clean the target column and confirm Data Split & Imbalance again."),
    G.Rule("distribution", "saved", G.FATAL, "artifacts", lambda s: s.distribution_differs,
           "Balanced training distribution does not match class_distribution_after.csv.", _AGAIN + "recreate consistent artifacts."),
    G.Rule("coverage", "saved", G.FATAL, "artifacts", lambda s: s.coverage_columns is None, "Saved class coverage report is missing.",
           _AGAIN + "create class_coverage_report.csv."),
    G.Rule("coverage", "saved", G.FATAL, "artifacts", lambda s: s.coverage_columns is not None and not s.coverage_columns >= set(COVERAGE_COLUMNS),
           "Saved class coverage report has an invalid format.", _AGAIN + "recreate the coverage report."),
    *(r for r in G.RULES if r.step == "model"),
)


def _columns_of(spark: SparkSession, path: str) -> list[str] | None:
    return spark.read.parquet(path).columns if _exists(spark, path) else None


def part_facts(parts: DataFrame, label_col: str, feature_cols: list[str], expected: set[str]) -> dict[str, SimpleNamespace]:
    """Rows, labels, missing labels and rows with a value that is not finite, per expected part."""
    dtype, label = parts.schema[label_col].dataType, F.col(f"`{label_col}`")
    unlabelled = label.isNull()
    if isinstance(dtype, (DoubleType, FloatType)):
        unlabelled = unlabelled | F.isnan(label)
    elif not isinstance(dtype, NumericType):
        unlabelled = unlabelled | F.lower(F.btrim(label.cast("string"), F.lit(WHITESPACE))).isin(GATE_MISSING_MARKERS)
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in feature_cols])
    nonfinite = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = parts.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count(label).alias("labels"),
        F.count_if(unlabelled).alias("unlabelled"), F.count_if(nonfinite).alias("nonfinite"),
    )
    none = {"rows": 0, "labels": 0, "unlabelled": 0, "nonfinite": 0}
    by_part = {r["split"]: r.asDict() for r in found.where(F.col("split").isin(*PARTS)).collect()}
    return {p: SimpleNamespace(**{**none, **by_part.get(p, {}), "part": p, "name": PARTS[p]}) for p in PARTS if p in expected or p in by_part}


def saved_coverage_issues(df: DataFrame, parts: DataFrame, target: str, label_col: str) -> DataFrame:
    """Coverage of the saved parts against the classes of the dataset."""
    saved = S.class_coverage(parts.select(F.col(label_col).cast("string").alias("_t"), "split"), "_t").drop("full_count")
    full = df.select(F.col(f"`{target}`").cast("string").alias("class")).where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("full_count"))
    both = saved.join(full, "class", "full_outer").fillna(0, ["train_count", "validation_count", "test_count", "full_count"])
    return S.coverage_issues(both).withColumn("affected_column", F.lit(None).cast("string"))


def distribution_differs(parts: DataFrame, distribution: DataFrame, label_col: str) -> bool:
    """The saved counts of the balanced training part are not those of its rows."""
    claimed = distribution.where(F.col("split") == BALANCED).select("class", F.col("count").alias("claimed"))
    actual = parts.where("split = 'train'").groupBy(S.class_label(label_col).alias("class")).agg(F.count(F.lit(1)).alias("actual"))
    return not claimed.join(actual, "class", "full_outer").where(~F.col("claimed").eqNullSafe(F.col("actual"))).isEmpty()


def run_saved_gate(spark: SparkSession, df: DataFrame, cfg: G.GateConfig, out_dir: str, label_col: str = "label",
                   feature_cols: list[str] | None = None) -> DataFrame:
    """J22-J28 (+ J21) issue rows for saved artifacts."""
    at = {name: f"{out_dir}/{name}" for name in ("modeling_subset", "split", "split_meta", "imbalance_meta", "class_coverage", "class_distribution")}
    features, target = list(cfg.features or []), cfg.target
    wanted = list(dict.fromkeys([*features, target]))
    saved = SimpleNamespace(
        features=features,
        target=target,
        confirmed=bool(features and target) and _columns_of(spark, at["modeling_subset"]) == [*features, target],
        absent=[c for c in [*features, target] if c not in df.columns],
        split_saved=_exists(spark, at["split_meta"]) and _exists(spark, at["imbalance_meta"]),
        distribution_differs=False,
        coverage_columns=None,
    )
    subjects: dict[str, list[SimpleNamespace]] = {"saved": [saved]}
    coverage = None
    if saved.confirmed:
        columns = {} if saved.absent else G.column_facts(df, cfg, wanted)
        subjects["features"] = [columns[c] for c in features if c in columns]
        subjects["target"] = [columns[target]] if target in columns else []
    if saved.confirmed and saved.split_saved:
        metas = {name: sinks.read_metadata(spark, at[name]) for name in ("split_meta", "imbalance_meta")}
        subjects["metadata"] = [
            SimpleNamespace(name=name.replace("_meta", " metadata"), saved_target=m.get("target_column"), target=target) for name, m in metas.items()
        ]
        parts = spark.read.parquet(at["split"])
        inputs = feature_cols or [c for c in parts.columns if c not in ("split", label_col, "synthetic", "copy")]
        facts = part_facts(parts, label_col, inputs, set(metas["split_meta"].get("parts", PARTS)))
        subjects["parts"] = list(facts.values())
        if all(f.rows for f in facts.values()) and target in df.columns:
            coverage = saved_coverage_issues(df, parts, target, label_col)
        if _exists(spark, at["class_distribution"]):
            saved.distribution_differs = distribution_differs(parts, spark.read.parquet(at["class_distribution"]), label_col)
        columns_of_coverage = _columns_of(spark, at["class_coverage"])
        saved.coverage_columns = None if columns_of_coverage is None else set(columns_of_coverage)
        subjects["models"] = G.model_facts(df.count() if cfg.selected_models else 0, cfg)
    report = G.Report(target)
    G.evaluate(SAVED_RULES, subjects, report)
    out = spark.createDataFrame(report.rows, G.ISSUE_SCHEMA)
    return G.with_affected_column(out if coverage is None else out.unionByName(coverage), target)


def preflight(spark: SparkSession, cfg: G.GateConfig, out_dir: str, gate_issues: DataFrame, train: DataFrame,
              label_col: str = "label", cv_folds: int = 5) -> DataFrame:
    """Training preflight as (check, passed) rows."""
    subset = f"{out_dir}/modeling_subset"
    cols_ok = _exists(spark, subset) and spark.read.parquet(subset).columns == list(cfg.features) + [cfg.target]
    split_ok = _exists(spark, f"{out_dir}/split_meta")
    meta_target = sinks.read_metadata(spark, f"{out_dir}/split_meta").get("target_column") if split_ok else None
    gate_ok = bool(G.rollup(gate_issues).collect()[0]["can_continue"]) and meta_target == cfg.target
    models_ok = bool(cfg.selected_models)
    cv_ok = cv_folds < 2 or S.cv_feasibility(train, label_col, cv_folds).isEmpty()
    rows = [("columns_confirmed", cols_ok), ("split_confirmed", split_ok), ("gate_passed", gate_ok),
            ("models_selected", models_ok), ("cv_counts_sufficient", cv_ok)]
    return spark.createDataFrame(rows, "check string, passed boolean")
