"""Saved model outputs and their reports, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimators as K
from ..operators import preprocess as P
from ..operators import reports as R
from ..operators import split as S
from ..operators import stats as T
from ..operators import workflows as WF
from ..operators.running import spread, written
from ..sources import sinks
from ..sources.tables import table
from .q_eval import CLASSES, NB_SQL, PCOLS, nb_scored
from .q_learn import _CUSTOMERS, _RULE
from .q_stats import _apply_sql, _pr_points, _thresh_sql
from .registry import register
from .sqlgen import stratified_holdout_ctes

MODELS = ("decision_tree", "gaussian_nb")
KINDS = ["a", "b", "c"]
_SPLITS = f"""{stratified_holdout_ctes('h1', _CUSTOMERS, 'c_custkey', 'kind', 0.2, 42)},
rest AS (SELECT c.* FROM {_CUSTOMERS} c JOIN h1 USING (c_custkey) WHERE h1.is_test = 0),
{stratified_holdout_ctes('h2', 'rest', 'c_custkey', 'kind', 10.0 / 80.0, 43)},
sp AS (SELECT c.*, CASE WHEN h1.is_test = 1 THEN 'test' WHEN h2.is_test = 1 THEN 'validation' ELSE 'train' END AS split
  FROM {_CUSTOMERS} c JOIN h1 USING (c_custkey) LEFT JOIN h2 USING (c_custkey))"""


def outputs(spark, sf):
    """Two models trained on the rule of ``q_learn`` and written out; (base folder, cross-validation, preprocessing)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").withColumn("kind", F.expr(_RULE))
    parts = written(S.split_three_way(c, "c_custkey", "stratified", 70, 10, 20, 42, target="kind"), "parts")
    fitted = P.fit(parts.where("split = 'train'"), ["c_mktsegment"], target="kind")
    base = R.new_base(spark)
    R.save_preprocessor(spark, fitted, f"{base}/preprocessing")
    fitted = R.load_preprocessor(spark, f"{base}/preprocessing")
    data = written(spread(P.transform(parts, fitted, keep=["c_custkey", "split"], as_vector=True), parts.count(), 200), "outputs")
    train, crossed = data.where("split = 'train'"), None
    folds = WF.stratified_folds(train, "c_custkey", 3, 42)
    for model in MODELS:
        learned = K.fit_model(model, train, n_classes=3)
        for split in R.SPLITS:
            scored = K.score(learned, data.where(F.col("split") == split))
            R.write_outputs(WF.predictions_table(scored, "c_custkey", fitted.classes), base, model, split, fitted.classes)
        cv = WF.cv_summary(WF.cross_validate(train, "c_custkey", model, 3, 42, folds=folds))
        crossed = cv if crossed is None else crossed.unionByName(cv)
    return base, crossed


_ONES = ", ".join(["1.0"] * 6)


@register("results_table", f"""
SELECT * FROM (VALUES ('decision_tree', 'trained', {_ONES}, 1.0, 0.0, 1.0, 0.0, 1.0, 'true'), ('gaussian_nb', 'trained', {_ONES}, 1.0, 0.0, 1.0, 0.0, 1.0, 'true'),
 ('neural_net', 'failed', {', '.join(['NULL'] * 11)}, 'false')) AS t({', '.join(R.RESULT_COLUMNS)})""")
def q_results_table(spark, sf):
    """The 14 columns, written as CSV and read back."""
    base, cv = outputs(spark, sf)
    runs = [(m, "trained", True) for m in MODELS] + [("neural_net", "failed", False)]
    sinks.write_results_csv(R.performance_table(spark, base, runs, cv), f"{base}/training_results.csv")
    back = spark.read.option("header", "true").csv(f"{base}/training_results.csv")
    numbers = [c for c in R.RESULT_COLUMNS if c not in ("model", "status", "saved")]
    return back.select("model", "status", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in numbers], "saved")


@register("output_files", f"""WITH {_SPLITS},
m AS (SELECT * FROM (VALUES ('decision_tree'), ('gaussian_nb')) AS m(model))
SELECT model, split, 'predictions' AS output, count(*) AS rows FROM sp, m GROUP BY ALL
UNION ALL SELECT model, split, output, n FROM m, (VALUES ('train'), ('validation'), ('test')) AS s(split),
 (VALUES ('confusion', 9), ('report', 6), ('metrics', 1)) AS o(output, n)""")
def q_output_files(spark, sf):
    """A10: the rows of every output by model and split; no row is misclassified."""
    base, _ = outputs(spark, sf)
    out = None
    for name in R.OUTPUTS:
        rows = spark.read.parquet(f"{base}/{name}").groupBy("model", "split").agg(F.count("*").alias("rows")).withColumn("output", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("model", "split", "output", "rows")


@register("diagnostic_rebuilt", f"""WITH {_SPLITS},
k AS (SELECT DISTINCT kind FROM sp)
SELECT a.kind AS actual, p.kind AS predicted, count(sp.kind) AS n, 1 AS warnings
FROM k a CROSS JOIN k p LEFT JOIN sp ON sp.kind = a.kind AND a.kind = p.kind AND split = 'validation' GROUP BY ALL""")
def q_diagnostic_rebuilt(spark, sf):
    """The saved confusion is gone, so it comes from the predictions, with one warning."""
    base, _ = outputs(spark, sf)
    # the outputs of another folder, without the confusion
    partial = R.new_base(spark)
    for name in set(R.OUTPUTS) - {"confusion"}:
        at = f"{name}/model=decision_tree/split=validation"
        spark.read.parquet(f"{base}/{at}").write.parquet(f"{partial}/{at}")
    cells, warnings = R.diagnostic(spark, partial, "decision_tree", "validation")
    return cells.withColumn("warnings", F.lit(len(warnings)))


@register("final_summary_cv", """
SELECT model, 1.0 AS test_macro_f1, 1.0 AS cv_macro_f1_mean, 0.0 AS cv_macro_f1_std, 1.0 AS f1_a, 1.0 AS recall_a, 1.0 AS f1_b, 1.0 AS recall_b, 1.0 AS f1_c, 1.0 AS recall_c
FROM (VALUES ('decision_tree'), ('gaussian_nb')) AS m(model)""")
def q_final_summary_cv(spark, sf):
    base, cv = outputs(spark, sf)
    return R.final_summary(spark, base, KINDS, cv)


@register("calibrated_manifest", f"""WITH {NB_SQL}{_thresh_sql()}
SELECT 'nb' AS model, class, round(threshold, 9) AS threshold, 'nb' AS best_model, (SELECT count(*) FROM ({_apply_sql()})) AS rows FROM th""")
def q_calibrated_manifest(spark, sf):
    """Calibrated predictions, thresholds and manifest, read back."""
    cuts = written(T.calibrate_thresholds(_pr_points(spark, sf)).select(F.lit("nb").alias("model"), "class", "threshold"), "cuts")
    th = {r["class"]: r["threshold"] for r in cuts.collect()}
    made = T.apply_thresholds(nb_scored(spark, sf), CLASSES, PCOLS, th)
    base = R.new_base(spark)
    R.save_calibrated(made.select("o_orderkey", "actual", F.col("predicted_calibrated").alias("predicted"), F.lit("nb").alias("model")), cuts, base)
    manifest = R.load_manifest(spark, base)
    rows = [(m, c, float(t)) for m, by_class in manifest["thresholds"].items() for c, t in by_class.items()]
    back = spark.createDataFrame(rows, "model string, class string, threshold double")
    count = spark.read.parquet(f"{base}/predictions").agg(F.count("*").alias("rows"))
    return back.crossJoin(F.broadcast(count)).select(
        "model", "class", F.round("threshold", 9).alias("threshold"), F.lit(manifest["best_model"]).alias("best_model"), "rows"
    )


@register("target_normalized", """
SELECT 'number' AS kind, count(*) AS rows, sum(c_nationkey)::DOUBLE AS total FROM customer
UNION ALL SELECT 'text', count(*), sum(length(c_mktsegment))::DOUBLE FROM customer""")
def q_target_normalized(spark, sf):
    """A numeric target stays a number, any other becomes text."""
    c = table(spark, sf, "customer")
    number, text = c.select(P.normalized_target(c, "c_nationkey").alias("t")), c.select(P.normalized_target(c, "c_mktsegment").alias("t"))
    kind = lambda df: "text" if dict(df.dtypes)["t"] == "string" else "number"
    one = number.agg(F.lit(kind(number)).alias("kind"), F.count("*").alias("rows"), F.sum("t").cast("double").alias("total"))
    return one.unionByName(text.agg(F.lit(kind(text)).alias("kind"), F.count("*").alias("rows"), F.sum(F.length("t")).cast("double").alias("total")))
