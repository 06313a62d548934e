"""Evaluation (L1-L15): everything derives from two small-ish tables.

* the k x k confusion cells ``(actual, predicted, n)`` -> accuracy, macro /
  weighted scores, balanced accuracy, reports, normalised matrices;
* per (class, distinct score) counts ``(pos, neg)`` -> exact AUC with ties,
  ROC and PR curves, average precision.

Running totals over scores are a distributed prefix sum (``running.in_order``):
no window covers a whole class, however many distinct scores it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import in_order, written

ROWS_PER_BUCKET = 500_000  # distinct scores ordered together
GRID_POINTS = 201
EPS = 2.220446049250313e-16  # float64 machine epsilon (MAPE denominator floor)


def _lbl(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("null"))


# ------------------------------------------------------------------ confusion family


def observed_cells(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The cells that occur: all that the metrics need, whatever the number of labels."""
    return df.groupBy(_lbl(actual).alias("actual"), _lbl(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list[str] | None = None) -> DataFrame:
    """L1: 0-filled k x k cells over the label list (default: actual U predicted)."""
    cells = observed_cells(df, actual, predicted)
    if labels is None:
        lab = cells.select(F.col("actual").alias("l")).union(cells.select(F.col("predicted").alias("l"))).distinct()
    else:
        lab = df.sparkSession.createDataFrame([(str(x),) for x in labels], "l string")
    # the grid has k x k rows at any k; it is made where the cells are, one row of the matrix after the other
    grid = lab.select(F.col("l").alias("actual")).crossJoin(lab.select(F.col("l").alias("predicted")))
    return grid.join(cells, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def normalized_confusion(cells: DataFrame) -> DataFrame:
    """Row-normalised percentages (an all-zero row stays 0)."""
    tot = F.sum("n").over(W.partitionBy("actual"))
    return cells.withColumn("percent", F.when(tot > 0, F.col("n") * 100.0 / tot).otherwise(0.0))


def per_class(cells: DataFrame) -> DataFrame:
    """tp / fp / fn / support and precision, recall, f1 per label (0/0 -> 0)."""
    tp = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    by_actual = cells.groupBy(F.col("actual").alias("class")).agg(tp.alias("tp"), F.sum("n").alias("support"))
    by_pred = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted_n"))
    t = by_actual.join(by_pred, "class", "full_outer").fillna(0, ["tp", "support", "predicted_n"])
    prec = F.when(F.col("predicted_n") > 0, F.col("tp") / F.col("predicted_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return t.select("class", "tp", "support", "predicted_n", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def classification_metrics(cells: DataFrame) -> DataFrame:
    """One row (accuracy, macro precision/recall/f1, weighted f1, balanced accuracy).

    Macro averages run over labels in actual U predicted (L3); balanced
    accuracy only over labels present in actual (quirk Q14).
    """
    pc = per_class(cells).where((F.col("support") > 0) | (F.col("predicted_n") > 0))
    return pc.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def classification_report(cells: DataFrame) -> DataFrame:
    """Per-class rows plus 'accuracy', 'macro avg', 'weighted avg'."""
    pc = per_class(cells).where((F.col("support") > 0) | (F.col("predicted_n") > 0))
    rows = pc.select("class", "precision", "recall", "f1", "support")
    total = F.sum("support")
    acc = pc.agg(
        F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), (F.sum("tp") / total).alias("f1"), total.alias("support"),
    )
    macro = pc.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support"))
    wavg = pc.agg(
        F.lit("weighted avg").alias("class"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"),
        total.alias("support"),
    )
    return rows.unionByName(acc).unionByName(macro).unionByName(wavg)


def misclassified(df: DataFrame, actual: str, predicted: str, proba_cols: list[str]) -> DataFrame:
    """Rows with actual != predicted and the top probability as confidence."""
    return df.where(_lbl(actual) != _lbl(predicted)).withColumn(
        "confidence", F.greatest(*[F.col(c) for c in proba_cols])
    )


# ------------------------------------------------------------------ score family


def score_counts(df: DataFrame, actual: str, classes: list[str], proba_cols: list[str],
                 positive_only: bool = False) -> DataFrame:
    """(class, score, pos, neg) over distinct scores of each one-vs-rest problem.

    Binary problems use only the positive (second) class, as the reference does.
    """
    pairs = list(zip(classes, proba_cols))
    if positive_only and len(pairs) == 2:
        pairs = pairs[1:]
    items = F.array(*[F.struct(F.lit(c).alias("class"), F.col(p).cast("double").alias("score")) for c, p in pairs])
    long = df.select(_lbl(actual).alias("_a"), F.explode(items).alias("x")).select("_a", "x.class", "x.score")
    return long.groupBy("class", "score").agg(
        F.count_if(F.col("_a") == F.col("class")).alias("pos"),
        F.count_if(F.col("_a") != F.col("class")).alias("neg"),
    )


def curve_table(counts: DataFrame) -> DataFrame:
    """Per (class, distinct score): tps/fps at threshold ``score`` (score >= thr) and totals; written once."""
    counts = written(counts, "score-counts")
    low = in_order(counts, ["class"], ["score"], sums=["pos", "neg"], before=["pos", "neg"], rows_per_range=ROWS_PER_BUCKET)
    tot = counts.groupBy(F.col("class").alias("_c")).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("m"))
    t = low.join(tot, low["class"].eqNullSafe(F.col("_c")))
    out = t.select(
        "class", "score", "pos", "neg", "P", "N", "m", "rank", "pos_lower", "neg_lower",
        (F.col("P") - F.col("pos_below")).alias("tps"),
        (F.col("N") - F.col("neg_below")).alias("fps"),
        F.col("neg_below"),
    )
    return written(out, "curve")


def auc_per_class(counts: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """L7 per class: exact rank AUC with ties = sum pos*(neg_below + neg/2) / (P*N)."""
    t = table if table is not None else curve_table(counts)
    return t.groupBy("class").agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))) / (F.first("P") * F.first("N"))).alias("auc"),
        F.first("P").alias("P"), F.first("N").alias("N"),
    )


def roc_auc(counts: DataFrame) -> DataFrame:
    """Binary -> the positive class's AUC; multi-class -> macro OvR. None if undefined."""
    a = auc_per_class(counts)
    return a.agg(
        F.when(F.count_if((F.col("P") == 0) | (F.col("N") == 0)) > 0, F.lit(None).cast("double"))
        .otherwise(F.avg("auc")).alias("roc_auc")
    )


def roc_curve(counts: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """(class, fpr, tpr, threshold, auc); thresholds descending, first = +inf.

    Collinear points are dropped as in the reference: with thresholds in
    descending order, the second differences of (fps, tps) at a point equal
    (neg, pos) of the next lower score minus its own, so only the lower
    neighbour's counts are needed (no self-join).
    """
    t = curve_table(counts)
    auc = auc_per_class(counts, t).select("class", "auc")  # over every distinct score
    if drop_intermediate:
        keep = (
            (F.col("rank") == F.col("m")) | (F.col("rank") == 1) | (F.col("m") <= 2)
            | (F.col("neg_lower") != F.col("neg")) | (F.col("pos_lower") != F.col("pos"))
        )
        t = t.where(keep)
    pts = t.select("class", (F.col("fps") / F.col("N")).alias("fpr"), (F.col("tps") / F.col("P")).alias("tpr"),
                   F.col("score").alias("threshold"))
    origin = auc.select(
        "class", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return pts.unionByName(origin).join(auc, "class")


def pr_curve(counts: DataFrame) -> DataFrame:
    """(class, recall, precision, threshold, average_precision).

    One point per distinct score plus the final (recall 0, precision 1)
    point, whose threshold is the highest score.
    """
    t = curve_table(counts)
    prec = F.when(F.col("tps") + F.col("fps") > 0, F.col("tps") / (F.col("tps") + F.col("fps"))).otherwise(0.0)
    rec = F.when(F.col("P") > 0, F.col("tps") / F.col("P")).otherwise(1.0)
    pts = t.select("class", "score", "pos", "P", rec.alias("recall"), prec.alias("precision"))
    ap = pts.groupBy("class").agg(
        F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P")).otherwise(0.0) * F.col("precision")).alias("average_precision")
    )
    last = t.groupBy("class").agg(F.max("score").alias("threshold")).select(
        "class", F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), "threshold"
    )
    out = pts.select("class", "recall", "precision", F.col("score").alias("threshold")).unionByName(last)
    return out.join(ap, "class")


def macro_curve(curve: DataFrame, x: str, y: str, part: str = "class", group_cols: list[str] = (),
                grid_points: int = GRID_POINTS) -> DataFrame:
    """L12/L13 (and E8): interpolate every curve on an even grid over [0, 1], then average.

    Each point covers the grid values up to the next point: an as-of/range
    join done by exploding the few grid indices of each segment instead of
    comparing every point with every grid value.  Each point finds the next one
    of its curve by a distributed order, so a curve may have any number of
    points.  Curves with < 2 points are skipped.
    """
    keys = list(group_cols) + [part]
    n = grid_points - 1
    pts = curve.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y")
    )
    pts = in_order(written(pts, "curve-points"), keys, ["_x", "_y"], after=["_x", "_y"], rows_per_range=ROWS_PER_BUCKET)
    pts = pts.withColumnsRenamed({"_x_upper": "_nx", "_y_upper": "_ny"}).withColumn("_first", F.col("rank") == 1)
    pts = pts.where(~F.col("_first") | F.col("_nx").isNotNull())
    lo = F.when(F.col("_first"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(F.col("_x") * n) - 1))
    hi = F.when(F.col("_nx").isNull(), F.lit(n)).otherwise(F.least(F.lit(n), F.ceil(F.col("_nx") * n) + 1))
    ex = pts.withColumn("_gi", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    g = F.col("_gi") / F.lit(float(n))
    inside = (
        (F.col("_first") & (g < F.col("_x")))
        | ((g >= F.col("_x")) & (F.col("_nx").isNull() | (g < F.col("_nx"))))
    )
    val = (
        F.when(g < F.col("_x"), F.col("_y"))
        .when(F.col("_nx").isNull(), F.col("_y"))
        .otherwise(F.col("_y") + (F.col("_ny") - F.col("_y")) * (g - F.col("_x")) / (F.col("_nx") - F.col("_x")))
    )
    per_curve = ex.where(inside).select(*keys, F.col("_gi").alias("grid_index"), g.alias("grid"), val.alias("value"))
    return per_curve.groupBy(*group_cols, "grid_index", "grid").agg(F.avg("value").alias(y))


# ------------------------------------------------------------------ regression


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R2, MAPE (denominator floored at machine epsilon)."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = p - a
    stats = df.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"),
        F.sum(a).alias("_sa"), F.sum(a * a).alias("_saa"), F.count(F.lit(1)).alias("_n"),
        F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(EPS))).alias("mape"),
    )
    mean_a = df.agg(F.avg(a).alias("_mu"))
    sst = df.crossJoin(F.broadcast(mean_a)).agg(F.sum((a - F.col("_mu")) * (a - F.col("_mu"))).alias("_sst"))
    return stats.crossJoin(sst).select(
        "mae", "rmse",
        F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).otherwise(F.lit(math.nan)).alias("r2"),
        "mape",
    )
