"""Reporting and artifact queries."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import artifacts as A
from ..operators import evaluate as E
from ..operators import gate as G
from ..operators import imbalance as H
from ..operators import models as M
from ..operators import preprocess as P
from ..operators import split as S
from ..operators.running import written
from ..session import scratch_path
from ..sources.tables import ORDERS_CUSTOMER_SQL, orders_customer, table
from .q_eval import CLASSES, COUNTS_SQL, CUT, FEATS
from .q_split import THREE_WAY_SQL, three_way_orders
from .q_stats import TE, TR, nb_ctes
from .registry import register
from .sqlgen import group_holdout_ctes

OC = ORDERS_CUSTOMER_SQL
MODELS = {"nb_both": FEATS, "nb_price": ["o_totalprice"]}


# ---------------------------------------------------------------- saved artifacts


def _saved(spark, sf):
    base = written(orders_customer(spark, sf).select("o_orderkey", "o_orderstatus", *FEATS), "saved-base")
    parts = written(S.split_three_way(base, "o_orderkey", "stratified", 70, 10, 20, 42, target="o_orderstatus"), "saved-parts")
    train = parts.where("split = 'train'")
    p = P.fit(train, FEATS)
    counts = H.class_counts(train, "o_orderstatus")
    bal = H.oversample(train, "o_orderkey", "o_orderstatus", H.sampling_targets(counts, "random_oversample"), 42)
    rest = parts.where("split <> 'train'").withColumn("copy", F.lit(0).cast("long"))
    rows = bal.unionByName(rest)
    table_ = P.transform(rows, p, keep=["split", "o_orderstatus"], with_label=False).withColumn(
        "synthetic", F.lit(False)).withColumnRenamed("o_orderstatus", "label")
    out = scratch_path(spark, f"saved-split-{uuid.uuid4().hex}")
    A.save_split(spark, base, table_, out, FEATS, "o_orderstatus",
                 {"split_method": "stratified", "train_percent": 70, "validation_percent": 10, "test_percent": 20,
                  "random_seed": 42}, {"strategy": "random_oversample", "before": counts})
    return base, out


CFG = G.GateConfig(target="o_orderstatus", features=FEATS, key="o_orderkey", selected_models=["nb"])


_NO_ISSUES = """SELECT * FROM (VALUES ('', '', '', '', '')) AS t(level, category, message, suggestion, affected_column) WHERE false"""


@register("gate_saved_split", _NO_ISSUES)
def q_gate_saved_split(spark, sf):
    base, out = _saved(spark, sf)
    return A.run_saved_gate(spark, base, CFG, out, feature_cols=FEATS)


_AGAIN = "Confirm Data Split & Imbalance again"


@register("gate_saved_damaged", THREE_WAY_SQL + f"""
SELECT 'fatal' AS level, 'artifacts' AS category, message, suggestion, affected_column FROM (VALUES
 ('Saved imbalance metadata target ''other'' does not match current target ''o_orderstatus''.', '{_AGAIN} for the current target column.', 'other, o_orderstatus'),
 ('Saved validation artifact(s) are missing: [''validation''].', '{_AGAIN} to recreate all saved arrays.', 'validation'),
 ('Saved array ''X_balanced training'' contains NaN or infinite values.', 'Clean the selected modeling columns and confirm Data Split & Imbalance again.', 'X_balanced training'),
 ('Saved array ''y_test'' contains empty or missing target values.', 'Clean the target column and confirm Data Split & Imbalance again.', 'y_test'),
 ('Balanced training distribution does not match class_distribution_after.csv.', '{_AGAIN} to recreate consistent artifacts.', 'General'),
 ('Saved class coverage report has an invalid format.', '{_AGAIN} to recreate the coverage report.', 'General')) AS t(message, suggestion, affected_column)
UNION ALL SELECT 'fatal', 'artifacts', 'Saved test row counts do not match: X has ' || count(*) || ' rows and y has ' || count(*) FILTER (WHERE o_orderstatus <> 'P') || ' rows.',
 '{_AGAIN} to recreate aligned arrays.', 'General' FROM sp WHERE split = 'test'""")
def q_gate_saved_damaged(spark, sf):
    """A saved split whose files were changed after it was confirmed."""
    from ..sources import sinks

    base, out = _saved(spark, sf)
    rows = written(spark.read.parquet(f"{out}/split"), "damaged")
    price = F.when((F.col("split") == "train") & (F.col("label") == "F"), F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    label = F.when((F.col("split") == "test") & (F.col("label") == "P"), F.lit(None)).otherwise(F.col("label"))
    rest = rows.where("split <> 'validation' AND NOT (split = 'train' AND label = 'O')")
    sinks.write_split(rest.withColumn("o_totalprice", price).withColumn("label", label), f"{out}/split")
    sinks.write_metadata(spark, {"target_column": "other"}, f"{out}/imbalance_meta")
    coverage = written(spark.read.parquet(f"{out}/class_coverage").select("class"), "damaged")
    coverage.write.mode("overwrite").parquet(f"{out}/class_coverage")
    return A.run_saved_gate(spark, base, G.GateConfig(target="o_orderstatus", features=FEATS, key="o_orderkey"), out, feature_cols=FEATS)


@register("gate_unconfirmed", """
SELECT 'fatal' AS level, 'configuration' AS category, 'Please confirm Column Configuration before running edge-case checks.' AS message,
 'Confirm the selected modeling columns and target on the Column Configuration page.' AS suggestion, 'General' AS affected_column""")
def q_gate_unconfirmed(spark, sf):
    """The saved subset has other columns than the settings."""
    base, out = _saved(spark, sf)
    return A.run_saved_gate(spark, base, G.GateConfig(target="o_orderstatus", features=FEATS[:1]), out, feature_cols=FEATS)


@register("preflight_status", """
SELECT * FROM (VALUES ('columns_confirmed', true), ('split_confirmed', true), ('gate_passed', true), ('models_selected', true),
 ('cv_counts_sufficient', true)) AS t("check", passed)""")
def q_preflight_status(spark, sf):
    base, out = _saved(spark, sf)
    issues = A.run_saved_gate(spark, base, CFG, out, feature_cols=FEATS)
    train = spark.read.parquet(f"{out}/split").where("split = 'train'")
    return A.preflight(spark, CFG, out, issues, train, "label", 5)


@register("saved_split_counts", THREE_WAY_SQL + """,
c AS (SELECT split, CAST(o_orderstatus AS VARCHAR) AS label, count(*) AS n FROM sp GROUP BY 1, 2),
m AS (SELECT max(n) AS mx FROM c WHERE split = 'train')
SELECT split, sum(CASE WHEN split = 'train' THEN mx ELSE n END) AS "rows" FROM c, m GROUP BY split""")
def q_saved_split_counts(spark, sf):
    _, out = _saved(spark, sf)
    meta = out + "/split_meta"
    df = spark.read.parquet(out + "/split")
    from ..sources import sinks

    sinks.load_saved_split(spark, out + "/split", meta, "o_orderstatus", "split", "label")  # A9 rules
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- reports


def _scored(spark, sf, feats, where):
    df = orders_customer(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderdate", *FEATS)
    cut = F.lit(CUT).cast("timestamp_ntz")
    model = M.fit_gaussian_nb(df.where(F.col("o_orderdate") < cut), feats, "o_orderstatus")
    part = df.where(where(F.col("o_orderdate"), cut)).withColumnRenamed("o_orderstatus", "actual")
    return M.predict_gaussian_nb(part, model)


def performance(spark, sf):
    """One row per model, metrics of the train and test parts side by side."""
    rows = None
    for name, feats in MODELS.items():
        for split, where in (("train", lambda c, x: c < x), ("test", lambda c, x: c >= x)):
            m = E.classification_metrics(E.confusion(_scored(spark, sf, feats, where), "actual", "predicted"))
            m = m.select(F.lit(name).alias("model"), F.lit(split).alias("split"), "*")
            rows = m if rows is None else rows.unionByName(m)
    piv = rows.groupBy("model").pivot("split", ["train", "test"]).agg(
        *[F.first(c).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy", "weighted_f1")]
    )
    return piv.select("model", *[F.round(c, 9).alias(c) for c in piv.columns if c != "model"])


def _metrics_sql(sc):
    return f"""(WITH cells AS (SELECT actual AS a, predicted AS p, count(*) AS n FROM {sc} GROUP BY 1, 2),
  cls AS (SELECT a AS class FROM cells UNION SELECT p FROM cells),
  pc AS (SELECT class, coalesce((SELECT sum(n) FROM cells WHERE a = class AND p = class), 0) AS tp,
     coalesce((SELECT sum(n) FROM cells WHERE a = class), 0) AS s, coalesce((SELECT sum(n) FROM cells WHERE p = class), 0) AS q FROM cls),
  pm AS (SELECT *, CASE WHEN q > 0 THEN tp / q ELSE 0.0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0.0 END AS rc FROM pc),
  pf AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM pm)
  SELECT round(sum(tp) / sum(s), 9) AS accuracy, round(avg(f1), 9) AS macro_f1,
         round(avg(rc) FILTER (WHERE s > 0), 9) AS balanced_accuracy, round(sum(f1 * s) / sum(s), 9) AS weighted_f1 FROM pf)"""


def _perf_sql():
    ctes = []
    sel = []
    for i, (name, feats) in enumerate(MODELS.items()):
        ctes.append(nb_ctes(f"_{i}tr", TR, TR, feats))
        ctes.append(nb_ctes(f"_{i}te", TR, TE, feats))
        a, b = f"mtr{i}", f"mte{i}"
        sel.append(f"""SELECT '{name}' AS model,
  {a}.accuracy AS train_accuracy, {a}.macro_f1 AS train_macro_f1, {a}.balanced_accuracy AS train_balanced_accuracy, {a}.weighted_f1 AS train_weighted_f1,
  {b}.accuracy AS test_accuracy, {b}.macro_f1 AS test_macro_f1, {b}.balanced_accuracy AS test_balanced_accuracy, {b}.weighted_f1 AS test_weighted_f1
FROM {_metrics_sql(f'sc_{i}tr')} {a}, {_metrics_sql(f'sc_{i}te')} {b}""")
    return "WITH " + ",".join(ctes) + "\n" + "\nUNION ALL ".join(sel)


@register("performance_table", _perf_sql())
def q_performance_table(spark, sf):
    return performance(spark, sf)


@register("best_model", f"SELECT arg_max(model, test_macro_f1) AS best_model FROM ({_perf_sql()})")
def q_best_model(spark, sf):
    return performance(spark, sf).agg(F.max_by("model", "test_macro_f1").alias("best_model"))


def _final_sql():
    parts = []
    ctes = []
    for i, (name, feats) in enumerate(MODELS.items()):
        ctes.append(nb_ctes(f"_{i}", TR, TE, feats))
        per = " ".join(
            f", round(max(f1) FILTER (WHERE class = '{c}'), 4) AS f1_{c}, round(max(rc) FILTER (WHERE class = '{c}'), 4) AS recall_{c}"
            for c in CLASSES)
        parts.append(f"""SELECT '{name}' AS model, round(avg(f1), 4) AS macro_f1{per} FROM (
  WITH cells AS (SELECT actual AS a, predicted AS p, count(*) AS n FROM sc_{i} GROUP BY 1, 2),
  cls AS (SELECT a AS class FROM cells UNION SELECT p FROM cells),
  pc AS (SELECT class, coalesce((SELECT sum(n) FROM cells WHERE a = class AND p = class), 0) AS tp,
     coalesce((SELECT sum(n) FROM cells WHERE a = class), 0) AS s, coalesce((SELECT sum(n) FROM cells WHERE p = class), 0) AS q FROM cls),
  pm AS (SELECT *, CASE WHEN q > 0 THEN tp / q ELSE 0.0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0.0 END AS rc FROM pc)
  SELECT class, rc, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM pm)""")
    return "WITH " + ",".join(ctes) + f""",
fs AS ({' UNION ALL '.join(parts)})
SELECT *, CAST(row_number() OVER (ORDER BY macro_f1 DESC, model) AS INTEGER) AS rank FROM fs"""


@register("final_summary", _final_sql())
def q_final_summary(spark, sf):
    """Test macro-F1 and per-class F1 / recall, rounded to 4, ranked by macro-F1."""
    out = None
    for name, feats in MODELS.items():
        cells = E.confusion(_scored(spark, sf, feats, lambda c, x: c >= x), "actual", "predicted")
        pc = E.per_class(cells).where((F.col("support") > 0) | (F.col("predicted_n") > 0))
        row = pc.agg(
            F.round(F.avg("f1"), 4).alias("macro_f1"),
            *[x for c in CLASSES for x in (
                F.round(F.max(F.when(F.col("class") == c, F.col("f1"))), 4).alias(f"f1_{c}"),
                F.round(F.max(F.when(F.col("class") == c, F.col("recall"))), 4).alias(f"recall_{c}"))],
        ).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("macro_f1"), "model")).cast("int"))


@register("run_summary", THREE_WAY_SQL + f"""
SELECT count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'validation') AS validation_rows,
       count(*) FILTER (WHERE split = 'test') AS test_rows, {len(FEATS)} AS feature_count, {len(MODELS)} AS models_trained FROM sp""")
def q_run_summary(spark, sf):
    """One aggregate over the split table plus configuration counts."""
    sp = three_way_orders(spark, sf)
    return sp.agg(
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "validation").alias("validation_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
    ).select("*", F.lit(len(FEATS)).alias("feature_count"), F.lit(len(MODELS)).alias("models_trained"))


@register("history_comparison")
def q_history_comparison(spark, sf):
    """Per-iteration objective of several runs (CV folds), interpolated on 1..max and averaged."""
    from .q_models import ld_frame
    from ..operators.estimators import fit_model

    data, _ = ld_frame(spark, sf)
    folds = S.kfold_stratified(data.where("split = 'train'"), "doc_id", "label", 3, 42)
    rows = []
    for f in range(3):
        fitted = fit_model("logistic_regression", folds.where(F.col("fold") != f), "label", "features")
        for i, loss in enumerate(fitted.model.summary.objectiveHistory):
            rows.append((f"fold{f}", i + 1, float(loss)))
    hist = spark.createDataFrame(rows, "run string, epoch int, train_loss double")
    mx = max(e for _, e, _ in rows)
    scaled = hist.withColumn("x", (F.col("epoch") - 1) / F.lit(max(mx - 1, 1)))
    curve = E.macro_curve(scaled, "x", "train_loss", part="run", grid_points=mx)
    return curve.select((F.col("grid_index") + 1).alias("epoch"), "train_loss")


# ---------------------------------------------------------------- E9, E13, I9


@register("group_overlap", f"""
WITH {group_holdout_ctes('h', OC, 'o_custkey', 0.2, 42)}
SELECT count(*) AS overlapping_groups FROM (
  SELECT o.o_custkey FROM {OC} o JOIN h ON o.o_custkey = h.o_custkey WHERE h.is_test = 0
  INTERSECT SELECT o.o_custkey FROM {OC} o JOIN h ON o.o_custkey = h.o_custkey WHERE h.is_test = 1)""")
def q_group_overlap(spark, sf):
    df = S.split(orders_customer(spark, sf).select("o_orderkey", "o_custkey"), "o_orderkey", "group", 0.2, 42, group="o_custkey")
    tr = df.where("split = 'train'").select("o_custkey")
    te = df.where("split = 'test'").select("o_custkey")
    return tr.intersect(te).agg(F.count(F.lit(1)).alias("overlapping_groups"))


@register("ordinal_encode", """
WITH m AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS idx FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
SELECT o.o_orderkey, m.idx AS o_orderpriority_index FROM orders o JOIN m ON o.o_orderpriority = m.v""")
def q_ordinal_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    idx = StringIndexer(inputCol="o_orderpriority", outputCol="o_orderpriority_index", stringOrderType="alphabetAsc").fit(o)
    return idx.transform(o).select("o_orderkey", "o_orderpriority_index")


@register("top_features")
def q_top_features(spark, sf):
    from .q_models import _importances

    return _importances(spark, sf, "random_forest").orderBy(F.desc("importance"), "feature").limit(20)


# ---------------------------------------------------------------- evaluation artifacts


def _write_predictions(spark, sf):
    """Per-model scored test rows, partitioned by (model, split)."""
    from ..sources import sinks

    out = scratch_path(spark, f"predictions-{uuid.uuid4().hex}")
    frames = None
    for name, feats in MODELS.items():
        s = _scored(spark, sf, feats, lambda c, x: c >= x).select(
            "o_orderkey", "actual", "predicted", *[f"p_{c}" for c in CLASSES]
        ).withColumn("model", F.lit(name)).withColumn("split", F.lit("test"))
        frames = s if frames is None else frames.unionByName(s)
    sinks.write_evaluation(frames, out)
    return out


@register("model_diagnostic", f"""
WITH {nb_ctes('', TR, TE, FEATS)},
labs AS (SELECT actual AS l FROM sc UNION SELECT predicted FROM sc),
cells0 AS (SELECT actual, predicted, count(*) AS n FROM sc GROUP BY 1, 2)
SELECT a.l AS actual, p.l AS predicted, coalesce(c.n, 0) AS n
FROM labs a CROSS JOIN labs p LEFT JOIN cells0 c ON c.actual = a.l AND c.predicted = p.l""")
def q_model_diagnostic(spark, sf):
    """Confusion of one (model, split) rebuilt from the saved predictions (partition pruned)."""
    path = _write_predictions(spark, sf)
    preds = spark.read.parquet(path).where((F.col("model") == "nb_both") & (F.col("split") == "test"))
    return E.confusion(preds, "actual", "predicted")


@register("artifact_roundtrip", """
SELECT model, status, true AS encoder_reusable, 2 AS csv_rows
FROM (VALUES ('nb_both', 'trained'), ('nb_price', 'trained'), ('broken', 'failed')) AS t(model, status)""")
def q_artifact_roundtrip(spark, sf):
    """Results CSV, per-model metrics JSON read back (A12), params and class mapping."""
    import json as _json

    from ..sources import sinks

    base = scratch_path(spark, f"results-{uuid.uuid4().hex}")
    perf = performance(spark, sf)
    sinks.write_results_csv(perf, f"{base}/training_results")
    for r in perf.collect():
        doc = {"model": r["model"], "test_macro_f1": r["test_macro_f1"]}
        spark.createDataFrame([(_json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{base}/models/{r['model']}/test")
    spark.createDataFrame([(_json.dumps({"model": "broken", "error": "fit failed"}),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{base}/models/broken/test")
    scanned = sinks.read_model_results(spark, f"{base}/models/*/*")
    df = orders_customer(spark, sf).select(*FEATS, "o_orderstatus")
    p = P.fit(df, FEATS, target="o_orderstatus")
    sinks.write_params(p.params_frame(spark), f"{base}/params")
    mapping = P.class_mapping(spark, p.classes)
    sinks.write_params(mapping, f"{base}/class_mapping")
    reusable = P.encoder_covers(df, "o_orderstatus", spark.read.parquet(f"{base}/class_mapping"))
    csv_rows = spark.read.option("header", "true").csv(f"{base}/training_results").count()
    return scanned.select("model", "status").withColumn("encoder_reusable", F.lit(reusable)).withColumn(
        "csv_rows", F.lit(csv_rows))


def _curves_sql(points: str, value: str, area: str) -> str:
    """Curves of every model interpolated on the grid and averaged, with the mean area under them."""
    ctes = ",".join(nb_ctes(f"_{i}", TR, TE, feats) for i, feats in enumerate(MODELS.values()))
    per_model = []
    for i, name in enumerate(MODELS):
        per_model.append(f"""SELECT '{name}' AS model, gi AS grid_index, grid, round(avg(val), 9) AS {value}, round(any_value(mean_area), 9) AS {area} FROM (
  WITH sc AS (SELECT * FROM sc_{i}), {COUNTS_SQL}, {points},
  o AS (SELECT class, x, y, lead(x) OVER (PARTITION BY class ORDER BY x, y) AS nx, lead(y) OVER (PARTITION BY class ORDER BY x, y) AS ny,
               row_number() OVER (PARTITION BY class ORDER BY x, y) = 1 AS first FROM k),
  g AS (SELECT range AS gi, range / 200.0 AS grid FROM range(0, 201))
  SELECT o.class, g.gi, g.grid, (SELECT avg(area) FROM areas) AS mean_area,
    CASE WHEN g.grid < o.x THEN o.y WHEN o.nx IS NULL THEN o.y ELSE o.y + (o.ny - o.y) * (g.grid - o.x) / (o.nx - o.x) END AS val
  FROM o JOIN g ON (o.first AND g.grid < o.x) OR (g.grid >= o.x AND (o.nx IS NULL OR g.grid < o.nx))) GROUP BY gi, grid""")
    return f"WITH {ctes}\n" + "\nUNION ALL ".join(per_model)


_ROC_POINTS = """r AS (SELECT *, m - rank AS i FROM ct2),
  nb AS (SELECT r.*, p.tps AS tp_prev, p.fps AS fp_prev, n.tps AS tp_next, n.fps AS fp_next
        FROM r LEFT JOIN r p ON p.class = r.class AND p.i + 1 = r.i LEFT JOIN r n ON n.class = r.class AND n.i - 1 = r.i),
  k AS (SELECT class, fps / "N" AS x, tps / "P" AS y FROM nb
        WHERE i = 0 OR i = m - 1 OR m <= 2 OR (fp_next - 2 * fps + fp_prev) <> 0 OR (tp_next - 2 * tps + tp_prev) <> 0
        UNION ALL SELECT DISTINCT class, 0.0, 0.0 FROM cnt),
  areas AS (SELECT auc AS area FROM auc)"""
_PR_POINTS = """q AS (SELECT class, score, pos, "P", CASE WHEN "P" > 0 THEN tps / "P" ELSE 1.0 END AS x,
          CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0 END AS y FROM ct2),
  k AS (SELECT class, x, y FROM q UNION ALL SELECT DISTINCT class, 0.0, 1.0 FROM cnt),
  areas AS (SELECT sum(CASE WHEN "P" > 0 THEN pos / "P" ELSE 0.0 END * y) AS area FROM q GROUP BY class)"""


def _compared(spark, sf, curve, x: str, y: str, area: str, mean: str):
    """Curves of several models at once (grouped by model) with their mean area."""
    curves = None
    for name, feats in MODELS.items():
        s = _scored(spark, sf, feats, lambda c, x: c >= x)
        c = curve(E.score_counts(s, "actual", CLASSES, [f"p_{c}" for c in CLASSES])).withColumn("model", F.lit(name))
        curves = c if curves is None else curves.unionByName(c)
    mac = E.macro_curve(curves, x, y, part="class", group_cols=["model"])
    per_class = curves.groupBy("model", "class").agg(F.first(area).alias(area))
    out = mac.join(per_class.groupBy("model").agg(F.avg(area).alias(mean)), "model")
    return out.select("model", F.col("grid_index").cast("long").alias("grid_index"), "grid", F.round(y, 9).alias(y), F.round(mean, 9).alias(mean))


@register("curve_comparison", _curves_sql(_ROC_POINTS, "tpr", "mean_auc"))
def q_curve_comparison(spark, sf):
    return _compared(spark, sf, E.roc_curve, "fpr", "tpr", "auc", "mean_auc")


@register("curve_comparison_pr", _curves_sql(_PR_POINTS, "precision", "mean_average_precision"))
def q_curve_comparison_pr(spark, sf):
    return _compared(spark, sf, E.pr_curve, "recall", "precision", "average_precision", "mean_average_precision")
