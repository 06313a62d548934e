"""Class rebalancing of the training part.

Class counts are the only thing that reaches the driver.  Undersampling is
an exact per-class cut-off over the md5 order (no shuffle of rows);
oversampling generates its draws with ``spark.range`` (spread over
partitions, never one exploded row per class) and joins them to exact
per-class ranks.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_sort_key, uniform
from .ranking import Strata, exact_rank, mark_first, stratum_col

DRAWS_PER_PARTITION = 1_000_000

# Fixed SMOTE presets (share of the majority count) that match the reference.
SMOTE_PRESETS = {"light": 0.40, "moderate": 0.50, "strong": 0.70}


@dataclass
class ImbalanceInfo:
    strategy: str
    success: bool
    message: str
    error: str | None = None
    before: dict[str, int] = field(default_factory=dict)
    after: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    class_weights: dict[str, float] | None = None

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


# Messages the user sees.
SMOTE_NC_ADVISED = "Categorical features are present. SMOTE-NC is recommended instead of regular SMOTE."
SMOTE_NC_REFUSED = "SMOTE-NC requires categorical features; data was not resampled."
SMOTE_NC_NO_COLUMNS = "No categorical feature indices are available for SMOTE-NC."


def categorical_features(df: DataFrame, features: list[str]) -> list[str]:
    """Text and boolean columns among the features."""
    kinds = dict(df.dtypes)
    return [c for c in features if kinds.get(c) in ("string", "boolean")]


def label_col(target: str) -> Column:
    return stratum_col(target)


def class_counts(df: DataFrame, target: str) -> dict[str, int]:
    """F1 (labels in string form); bounded collect."""
    from .ranking import stratum_counts

    return stratum_counts(df, target)


def class_counts_frame(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(label_col(target).alias("class")).agg(F.count(F.lit(1)).alias("count"))


def balanced_weights(counts: dict[str, int]) -> dict[str, float]:
    """H2: n / (k * n_c)."""
    n, k = sum(counts.values()), len(counts)
    return {c: n / (k * m) for c, m in counts.items()}


def class_weights_frame(df: DataFrame, target: str) -> DataFrame:
    """H2 over the table of class counts, with its totals as a one-row join."""
    cc = class_counts_frame(df, target)
    totals = cc.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return cc.crossJoin(F.broadcast(totals)).withColumn("weight", F.col("_n") / (F.col("_k") * F.col("count"))).drop("_n", "_k")


def with_weight_column(df: DataFrame, target: str, weight_col: str = "weight") -> DataFrame:
    """Attach balanced weights for ``weightCol`` (Spark broadcasts the table where its size allows)."""
    w = class_weights_frame(df, target).select(F.col("class").alias("_wc"), F.col("weight").alias(weight_col))
    return df.join(w, label_col(target) == F.col("_wc")).drop("_wc")


def positive_class_weight(counts: dict[str, int]) -> int:
    """max(1, int(n_majority / max(1, n_minority)))."""
    return max(1, int(max(counts.values()) / max(1, min(counts.values()))))


def majority_class(counts: dict[str, int]) -> str:
    return sorted(counts, key=lambda c: (-counts[c], c))[0]


def minority_class(counts: dict[str, int]) -> str:
    return sorted(counts, key=lambda c: (counts[c], c))[0]


def sampling_targets(counts: dict[str, int], method: str, preset: str | None = None,
                     custom: dict | str | None = None) -> dict[str, int]:
    """Target count per class that is resampled (others untouched)."""
    if custom is not None:
        return custom_targets(counts, custom)
    maj = counts[majority_class(counts)]
    mino = counts[minority_class(counts)]
    if method == "random_undersample":
        mc = minority_class(counts)
        return {c: mino for c in counts if c != mc}
    if preset and preset in SMOTE_PRESETS and method in ("smote", "smote_nc", "random_oversample"):
        r = SMOTE_PRESETS[preset]
        out = {c: max(n, int(maj * r)) for c, n in counts.items()}
        return {c: t for c, t in out.items() if t > counts[c]}
    mc = majority_class(counts)
    return {c: maj for c in counts if c != mc}


def custom_targets(counts: dict[str, int], spec) -> dict[str, int]:
    """H9: class -> ratio (<= 1, of the majority) or count (> 1); never shrinks."""
    if isinstance(spec, str):
        spec = json.loads(spec)
    maj = max(counts.values())
    out = {}
    for c, v in spec.items():
        c = str(c)
        if c not in counts:
            raise ValueError(f"Unknown class '{c}' in custom sampling strategy.")
        v = float(v)
        t = int(maj * v) if v <= 1 else int(v)
        out[c] = max(counts[c], t)
    return out


def training_only(targets: dict[str, int], counts: dict[str, int]) -> dict[str, int]:
    """Drop classes absent from training."""
    return {c: t for c, t in targets.items() if c in counts}


def undersample(df: DataFrame, key, target: str, targets: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """H4: keep ``targets[c]`` rows of class c without replacement (md5 order); by default as many as the smallest class has."""

    def quotas(s: Strata) -> DataFrame:
        if targets is None:
            return s.df.withColumn("_q", F.lit(s.smallest).cast("long"))
        wanted = df.sparkSession.createDataFrame([(str(c), int(t)) for c, t in targets.items()], "_g string, _t long")
        return s.df.join(wanted, "_g", "left").select("_g", "_n", F.coalesce(F.least("_n", "_t"), F.col("_n")).alias("_q"))

    return mark_first(df, hash_sort_key(df, seed, key), target, quotas, "_kept").where("_kept").drop("_kept")


def _draws(spark: SparkSession, need: dict[str, int]) -> DataFrame:
    """(class, j) for j = 1..need[class], spread over partitions by spark.range."""
    items = [(c, d) for c, d in sorted(need.items()) if d > 0]
    total = sum(d for _, d in items)
    parts = max(1, math.ceil(total / DRAWS_PER_PARTITION))
    ids = spark.range(0, total, 1, parts)
    cls, start = None, None
    off = 0
    for c, d in items:
        cond = F.col("id") < F.lit(off + d)
        cls = (F.when(cond, F.lit(c)) if cls is None else cls.when(cond, F.lit(c)))
        start = (F.when(cond, F.lit(off)) if start is None else start.when(cond, F.lit(off)))
        off += d
    return ids.select(cls.alias("_c"), (F.col("id") - start + 1).alias("_j"))


def oversample(df: DataFrame, key, target: str, targets: dict[str, int], seed: int = 42,
               copy_col: str = "copy") -> DataFrame:
    """H3: originals plus ``t - n`` copies per class drawn with replacement.

    Draw j of class c picks the row of rank ``floor(u(seed, c, j) * n_c) + 1``
    in the class's md5 order.  Output carries ``copy`` = 0 for originals, j
    for copies.
    """
    spark = df.sparkSession
    counts = class_counts(df, target)
    need = {c: max(0, targets.get(c, n) - n) for c, n in counts.items()}
    base = df.withColumn(copy_col, F.lit(0).cast("long"))
    if not any(need.values()):
        return base
    draws = _draws(spark, need)
    n_map = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(n))])
    u = uniform(seed, F.col("_c"), F.col("_j"))
    draws = draws.withColumn("_idx", F.floor(u * F.element_at(n_map, F.col("_c"))).cast("long") + 1)
    ranked = exact_rank(df.withColumn("_c", label_col(target)), hash_sort_key(df, seed, key), ["_c"], "_rk")
    # both sides grow with the rows: neither is broadcast
    copies = ranked.join(draws.hint("merge"), (ranked["_c"] == draws["_c"]) & (ranked["_rk"] == draws["_idx"])).select(
        *[ranked[c] for c in df.columns], draws["_j"].cast("long").alias(copy_col)
    )
    return base.unionByName(copies)


def apply_strategy(df: DataFrame, key, target: str, method: str = "none", seed: int = 42,
                   preset: str | None = None, custom=None, k_neighbors: int = 5,
                   features: list[str] | None = None) -> tuple[DataFrame, ImbalanceInfo]:
    """H1 dispatcher: returns (rebalanced DataFrame, info)."""
    m = (method or "none").strip().lower()
    before = class_counts(df, target)
    if m in ("", "none", "no", "disabled"):
        return df, ImbalanceInfo("none", True, "No imbalance strategy applied.", before=before, after=before)
    if m == "class_weight":
        w = balanced_weights(before)
        # quirk Q6: counts are filled in although the data is unchanged
        return df, ImbalanceInfo("class_weight", True, "Computed class weights.", before=before, after=before,
                                 class_weights=w)
    if m not in ("random_oversample", "random_undersample", "smote", "smote_nc", "smote-nc"):
        raise ValueError(f"Unsupported imbalance_method '{m}'.")
    warnings: list[str] = []
    targets = training_only(sampling_targets(before, m, preset, custom), before)
    if not targets:
        return df, ImbalanceInfo(m, True, "No training classes require resampling.", before=before, after=before)
    if m == "random_undersample":
        out = undersample(df, key, target, targets, seed)
    elif m == "random_oversample":
        out = oversample(df, key, target, targets, seed)
    else:
        from .smote import smote

        categorical = categorical_features(df, features or [])
        if m != "smote" and not categorical:
            return df, ImbalanceInfo(m, False, SMOTE_NC_REFUSED, error=SMOTE_NC_NO_COLUMNS, before=before, after=before)
        if m == "smote" and categorical:
            warnings.append(SMOTE_NC_ADVISED)
        try:
            k = validated_k(before, targets, k_neighbors, auto=custom is None and preset is None)
        except ValueError as exc:
            return df, ImbalanceInfo(m, False, "Resampling failed; data was not resampled.", error=str(exc),
                                     before=before, after=before)
        out = smote(df, key, target, features or [], targets, k, seed, nominal=(m != "smote"))
    after = {c: targets.get(c, n) if m != "random_undersample" else min(n, targets.get(c, n)) for c, n in before.items()}
    return out, ImbalanceInfo(m, True, f"Applied {m}.", before=before, after=after, warnings=warnings)


def validated_k(counts: dict[str, int], targets: dict[str, int], requested: int = 5, auto: bool = True) -> int:
    """H7: k = max(1, min(requested, minority - 1)); a resampled class with < 2 rows fails.

    quirk Q12: 'auto' validates every class, a dict only the targeted ones.
    """
    checked = counts if auto else {c: counts[c] for c in targets}
    smallest = min(checked.values())
    if smallest < 2:
        c = sorted((c for c in checked if checked[c] == smallest))[0]
        raise ValueError(f"Class '{c}' has only {smallest} sample(s); SMOTE needs at least 2.")
    return max(1, min(int(requested), smallest - 1))
