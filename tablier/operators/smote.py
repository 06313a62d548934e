"""SMOTE and SMOTE-NC (H5, H6, H11) on exact neighbours from ``operators.knn``.

Synthetic sample j of class c: base row = rank ``floor(u1 * n_c) + 1`` in the
class's md5 order, neighbour = the ``floor(u2 * k) + 1``-th nearest of that
row, step u3; value = x + u3 * (nn - x).  u1..u3 are the portable md5
uniforms of (seed, class, j, role), so the result is reproducible and has a
brute-force SQL oracle.  SMOTE-NC takes each nominal value as the most
frequent one among the base row's k neighbours (ties -> smallest value) and
adds median(std)^2 / 2 to the squared distance per differing nominal value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_sort_key, uniform
from .imbalance import _draws, class_counts, label_col
from .knn import knn_within_groups
from .ranking import exact_rank


def _median_std(df: DataFrame, target: str, numeric: list[str], classes: list[str]) -> dict[str, float]:
    stds = df.where(label_col(target).isin(classes)).groupBy(label_col(target).alias("c")).agg(
        *[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in numeric]
    ).collect()
    out = {}
    for r in stds:
        vals = sorted(float(r[c] or 0.0) for c in numeric)
        m = len(vals)
        out[r["c"]] = 0.0 if m == 0 else (vals[m // 2] if m % 2 else (vals[m // 2 - 1] + vals[m // 2]) / 2)
    return out


def neighbours(df: DataFrame, key: str, target: str, features, classes: list[str], k: int, seed: int = 42,
               categorical: list[str] | None = None) -> DataFrame:
    """Exact k nearest same-class neighbours of the rows of ``classes`` (reusable across targets)."""
    categorical = list(categorical or [])
    sub = df.where(label_col(target).isin(classes))
    numeric = [features] if isinstance(features, str) else list(features)
    penalty = None
    if categorical:
        med = _median_std(sub, target, numeric, classes)
        penalty = {c: (m ** 2) / 2.0 for c, m in med.items()}
    return knn_within_groups(sub, key, target, features, k, seed, nominal=categorical, nominal_penalty=penalty)


def synthetic_samples(df: DataFrame, key: str, target: str, features, targets: dict[str, int], k: int,
                      seed: int = 42, categorical: list[str] | None = None, nn: DataFrame | None = None) -> DataFrame:
    """Only the synthetic rows: (class, draw, base key, neighbour key, step, _v, nominal values)."""
    spark = df.sparkSession
    categorical = list(categorical or [])
    counts = class_counts(df, target)
    need = {c: t - counts[c] for c, t in targets.items() if c in counts and t > counts[c]}
    if not need:
        return None
    classes = sorted(need)
    sub = df.where(label_col(target).isin(classes))
    numeric = [features] if isinstance(features, str) else list(features)
    if nn is None:
        nn = neighbours(df, key, target, features, classes, k, seed, categorical)
    vec = (F.col(features).cast("array<double>") if isinstance(features, str)
           else F.array(*[F.col(f"`{c}`").cast("double") for c in numeric]))
    rows = sub.select(label_col(target).alias("_c"), F.col(key).alias("_key"), vec.alias("_v"),
                      *[F.col(c).alias(f"_n_{c}") for c in categorical])
    ranked = exact_rank(rows, hash_sort_key(rows, seed, "_key"), ["_c"], "_rk")
    n_map = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(counts[c]))])
    k_map = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(min(k, counts[c] - 1)))])
    d = _draws(spark, need)
    d = d.select(
        "_c", "_j",
        (F.floor(uniform(seed, F.col("_c"), F.col("_j"), F.lit("base")) * F.element_at(n_map, F.col("_c"))) + 1).cast("long").alias("_idx"),
        (F.floor(uniform(seed, F.col("_c"), F.col("_j"), F.lit("nn")) * F.element_at(k_map, F.col("_c"))) + 1).cast("int").alias("_pick"),
        uniform(seed, F.col("_c"), F.col("_j"), F.lit("step")).alias("_step"),
    )
    base = d.join(ranked.select("_c", "_rk", "_key", "_v"), (d["_c"] == ranked["_c"]) & (d["_idx"] == ranked["_rk"])).select(
        d["_c"], "_j", "_step", "_pick", F.col("_key").alias("base_key"), F.col("_v").alias("_bv")
    )
    nb = nn.select(F.col("group").alias("_c"), F.col("key").alias("_bk"), F.col("nn_key"), F.col("nn_rank").alias("_pick"))
    with_nn = base.join(nb, (base["_c"] == nb["_c"]) & (base["base_key"].cast("string") == nb["_bk"]) & (base["_pick"] == nb["_pick"])).select(
        base["_c"], "_j", "_step", "base_key", "nn_key", "_bv"
    )
    nvec = rows.select(F.col("_c").alias("_c2"), F.col("_key").cast("string").alias("_nk2"), F.col("_v").alias("_nv"))
    syn = with_nn.join(nvec, (with_nn["_c"] == nvec["_c2"]) & (with_nn["nn_key"] == nvec["_nk2"])).select(
        "_c", "_j", "_step", "base_key", "nn_key",
        F.zip_with("_bv", "_nv", lambda a, b: a + F.col("_step") * (b - a)).alias("_v"),
    )
    if categorical:
        # most frequent nominal value among the base row's k neighbours (ties -> smallest)
        nbv = nn.join(rows.select(F.col("_c").alias("group"), F.col("_key").cast("string").alias("nn_key"),
                                  *[f"_n_{c}" for c in categorical]), ["group", "nn_key"])
        for c in categorical:
            cnt = nbv.groupBy("group", "key", f"_n_{c}").agg(F.count(F.lit(1)).alias("_m"))
            mode = cnt.groupBy("group", "key").agg(
                F.min_by(F.col(f"_n_{c}"), F.struct(-F.col("_m"), F.col(f"_n_{c}"))).alias(c)
            )
            syn = syn.join(mode, (syn["_c"] == mode["group"]) & (syn["base_key"].cast("string") == mode["key"])).drop("group", "key")
    return syn


def smote(df: DataFrame, key: str, target: str, features, targets: dict[str, int], k: int, seed: int = 42,
          nominal: bool = False, categorical: list[str] | None = None, nn: DataFrame | None = None) -> DataFrame:
    """Originals plus synthetic rows (``synthetic`` flag, key NULL for synthetic rows)."""
    if nominal and not categorical:
        categorical = [f.name for f in df.schema.fields
                       if f.dataType.simpleString() == "string" and f.name not in (key, target)]
    if isinstance(features, list) and categorical:
        features = [c for c in features if c not in categorical]
    syn = synthetic_samples(df, key, target, features, targets, k, seed, categorical, nn)
    out = df.withColumn("synthetic", F.lit(False))
    if syn is None:
        return out
    cols = []
    numeric = [features] if isinstance(features, str) else list(features)
    tdtype = df.schema[target].dataType
    for f in df.schema.fields:
        if f.name == target:
            cols.append(F.col("_c").cast(tdtype).alias(target))
        elif isinstance(features, str) and f.name == features:
            cols.append(F.col("_v").cast(f.dataType).alias(f.name))
        elif f.name in numeric:
            cols.append(F.element_at("_v", numeric.index(f.name) + 1).cast(f.dataType).alias(f.name))
        elif categorical and f.name in categorical:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return out.unionByName(syn.select(*cols, F.lit(True).alias("synthetic")))
