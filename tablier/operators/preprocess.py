"""Preprocessing (I1-I10): fitted parameters as a small table, transforms as expressions.

Fitting runs a handful of aggregates (exact medians via bracketed order
statistics, means / population std on the imputed values, sorted levels per
categorical); transforming is a pure projection, so it runs map-side on
batch and streaming DataFrames alike.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructField, StructType

from ..functions.missing import is_float
from .ranking import BROADCAST_MAX_ROWS
from .running import in_order, written
from .quantile import exact_medians, most_frequent_values

MAX_LEVELS = 10_000  # one-hot levels per column carried as literals
DEFAULT_FILL = "Unknown"


@dataclass
class Preprocessor:
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    target: str | None = None
    task_type: str | None = None
    strategy: str = "median"
    scale: bool = False
    fill_value: str = DEFAULT_FILL
    impute: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)

    @property
    def output_names(self) -> list[str]:
        names = list(self.numeric)
        for c in self.categorical:
            names += [f"{c}_{lv}" for lv in self.levels[c]]
        return names

    def params_frame(self, spark: SparkSession) -> DataFrame:
        """The fitted state as a table (column, role, impute, mean, std, levels)."""
        rows = [(c, "numeric", self.impute.get(c), self.mean.get(c), self.std.get(c), None) for c in self.numeric]
        rows += [(c, "categorical", None, None, None, self.levels[c]) for c in self.categorical]
        return spark.createDataFrame(
            rows, "column string, role string, impute double, mean double, std double, levels array<string>"
        )

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "Preprocessor":
        d = json.loads(text)
        if not isinstance(d, dict) or "features" not in d:
            raise ValueError("Saved preprocessing artifacts have an unexpected format.")
        return cls(**d)


def split_kinds(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """Numeric block (booleans included, as in the reference) and categorical block."""
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in features if isinstance(types[c], (NumericType, BooleanType))]
    return num, [c for c in features if c not in num]


def _num(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    dtype = df.schema[c].dataType
    if is_float(dtype):
        col = F.nanvl(col, F.lit(None).cast("double"))
    return col.cast("double")


def _cat(c: str, fill: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(fill))


def distinct_levels(df: DataFrame, values: dict[str, Column]) -> dict[str, list[str]]:
    """Sorted distinct values of each expression, all in one pass; raises instead of collecting an unbounded table."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("v")) for n, v in values.items()])
    distinct = df.select(F.explode(cells).alias("c")).select("c.name", "c.v").distinct()
    sizes = {r["name"]: r["n"] for r in distinct.groupBy("name").agg(F.count("*").alias("n")).collect()}
    wide = sorted(n for n, k in sizes.items() if k > MAX_LEVELS)
    if wide:
        raise ValueError(f"Column '{wide[0]}' has more than {MAX_LEVELS} levels; encode it as a sparse vector (``encode_sparse``).")
    out: dict[str, list[str]] = {n: [] for n in values}
    for r in distinct.orderBy("name", "v").collect():
        out[r["name"]].append(r["v"])
    return out


def fit(df: DataFrame, features: list[str], target: str | None = None, task_type: str | None = "classification",
        strategy: str = "median", scale: bool = False, fill_value: str = DEFAULT_FILL) -> Preprocessor:
    """Fit imputers, scaler and one-hot levels on ``df``."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"Selected feature columns are missing: {missing}.")
    num, cat = split_kinds(df, features)
    p = Preprocessor(features=list(features), numeric=num, categorical=cat, target=target,
                     task_type=task_type, strategy=strategy, scale=scale, fill_value=fill_value)
    if num:
        if strategy == "median":
            p.impute = exact_medians(df, num)
        elif strategy == "mean":
            row = df.agg(*[F.avg(_num(df, c)).alias(c) for c in num]).collect()[0]
            p.impute = {c: row[c] for c in num}
        elif strategy == "most_frequent":
            p.impute = most_frequent_values(df, num)
        else:
            raise ValueError(f"Unsupported numeric_impute_strategy '{strategy}'.")
        # scaler statistics are taken on the imputed values (imputer runs first)
        imputed = [F.coalesce(_num(df, c), F.lit(p.impute[c])) for c in num]
        aggs = []
        for c, e in zip(num, imputed):
            aggs += [F.avg(e).alias(f"m_{c}"), F.stddev_pop(e).alias(f"s_{c}")]
        row = df.agg(*aggs).collect()[0]
        p.mean = {c: row[f"m_{c}"] for c in num}
        p.std = {c: row[f"s_{c}"] for c in num}
    if cat:
        p.levels = distinct_levels(df, {c: _cat(c, fill_value) for c in cat})
    if target is not None and (task_type or "").lower() == "classification":
        p.classes = target_classes(df, target)
    return p


def numeric_expr(df: DataFrame, p: Preprocessor, c: str) -> Column:
    """I2 + I5: impute, then optionally standardise (std 0 -> 1)."""
    e = F.coalesce(_num(df, c), F.lit(p.impute[c]))
    if p.scale:
        sd = p.std[c] if p.std[c] else 1.0
        e = (e - F.lit(p.mean[c])) / F.lit(sd)
    return e


def one_hot_exprs(p: Preprocessor, c: str) -> list[Column]:
    """I3 + I4: fill, then one indicator per sorted level; unseen level -> all zeros."""
    v = _cat(c, p.fill_value)
    return [F.when(v == F.lit(lv), 1.0).otherwise(0.0).alias(f"{c}_{lv}") for lv in p.levels[c]]


def transform(df: DataFrame, p: Preprocessor, keep: list[str] = (), as_vector: bool = False,
              with_label: bool = True) -> DataFrame:
    """I8: apply fitted parameters; raises when feature columns are missing."""
    missing = [c for c in p.features if c not in df.columns]
    if missing:
        raise ValueError(f"New data is missing required feature columns: {missing}.")
    cols = [numeric_expr(df, p, c).alias(c) for c in p.numeric]
    for c in p.categorical:
        cols += one_hot_exprs(p, c)
    extra = [F.col(f"`{k}`") for k in keep]
    if with_label and p.target and p.target in df.columns:
        if p.classes:
            extra.append(encode_target_expr(p.target, p.classes).alias("label"))
        else:
            extra.append(F.col(f"`{p.target}`").cast("double").alias("label"))
    if as_vector:
        from pyspark.ml.functions import array_to_vector

        return df.select(*extra, array_to_vector(F.array(*cols)).alias("features"))
    return df.select(*extra, *cols)


def level_table(df: DataFrame, value: Column) -> DataFrame:
    """(level, index) of the sorted distinct values, any number of them, numbered without collecting them."""
    levels = written(df.select(value.alias("level")).distinct(), "levels")
    return written(in_order(levels, [], ["level"]).select("level", (F.col("rank") - 1).alias("index")), "levels")


def encode_by_table(df: DataFrame, value: Column, levels: DataFrame, out: str) -> DataFrame:
    """I6 for any number of levels: the index of each row's level, null for one the table lacks."""
    known = levels.select(F.col("level").alias("_level"), F.col("index").cast("double").alias(out))
    known = F.broadcast(known) if levels.count() <= BROADCAST_MAX_ROWS else known
    return df.join(known, value == F.col("_level"), "left").drop("_level")


def encode_sparse(df: DataFrame, column: str, levels: DataFrame, out: str, fill_value: str = DEFAULT_FILL) -> DataFrame:
    """I4 for any number of levels: one sparse indicator vector; a level the table lacks is all zeros."""
    from pyspark.ml.linalg import VectorUDT

    n = levels.count()
    indexed = encode_by_table(df, _cat(column, fill_value), levels, "_index")
    # a vector's own fields; one-hot encoders of Spark ML name every level in the column's metadata, on the driver
    hot = F.filter(F.array(F.col("_index").cast("int")), lambda i: i.isNotNull())
    vector = F.struct(F.lit(0).alias("type"), F.lit(n).alias("size"), hot.alias("indices"), F.transform(hot, lambda _: F.lit(1.0)).alias("values"))
    made = F.from_json(F.to_json(F.struct(vector.alias("v"))), StructType([StructField("v", VectorUDT())]))
    return indexed.withColumn(out, made["v"]).drop("_index")


def target_label(c) -> Column:
    """Target as text; missing -> 'null' (quirk Q4 resolved to 'null')."""
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def normalized_target(df: DataFrame, target: str) -> Column:
    """A numeric target as it is, any other as text (missing -> 'null')."""
    return F.col(f"`{target}`") if isinstance(df.schema[target].dataType, NumericType) else target_label(target)


def target_classes(df: DataFrame, target: str) -> list[str]:
    """Sorted distinct labels (text); bounded collect."""
    rows = df.select(target_label(target).alias("c")).distinct().orderBy("c").limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"Target '{target}' has more than {MAX_LEVELS} classes; encode it by a table (``level_table``).")
    return [r["c"] for r in rows]


def encode_target_expr(target: str, classes: list[str]) -> Column:
    """Label -> 0..k-1 by sorted label text; unknown label -> NULL."""
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return F.element_at(m, target_label(target))


def decode_target_expr(label_col: str, classes: list[str]) -> Column:
    """I7."""
    arr = F.array(*[F.lit(c) for c in classes])
    return F.element_at(arr, F.col(label_col).cast("int") + 1)


def class_mapping(spark: SparkSession, classes: list[str]) -> DataFrame:
    """(class_id, class_label) table."""
    return spark.createDataFrame([(i, c) for i, c in enumerate(classes)], "class_id int, class_label string")


def encoder_covers(df: DataFrame, target: str, mapping: DataFrame) -> bool:
    """A14 reuse test: every current label is already in the saved mapping."""
    cur = df.select(target_label(target).alias("class_label")).distinct()
    return cur.join(mapping, "class_label", "left_anti").isEmpty()


def check_regression_target(df: DataFrame, target: str) -> None:
    """D6."""
    bad = df.where(F.col(target).isNotNull() & F.col(target).cast("string").try_cast("double").isNull()).limit(1).count()
    bad += df.where(F.col(target).isNull()).limit(1).count()
    if bad:
        raise ValueError("Regression target must be numeric.")


def detect_task_type(df: DataFrame, target: str, current: str | None = None, saved: str | None = None) -> str:
    """One aggregate + rule on the driver."""
    if (current or "").lower() == "classification" or (saved or "").lower() == "classification":
        return "classification"
    dtype = df.schema[target].dataType
    t = F.col(f"`{target}`")
    nonnull = df.where(t.isNotNull())
    if isinstance(dtype, (StringType, BooleanType)) or not isinstance(dtype, NumericType):
        return "classification" if nonnull.limit(1).count() else "unknown"
    x = t.cast("double")
    r = nonnull.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(x).alias("u"),
        F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("nonfinite"),
        F.bool_and(F.abs(x - F.rint(x)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.rint(x))).alias("intlike"),
    ).collect()[0]
    return task_rule(int(r["n"]), int(r["u"]), int(r["nonfinite"]), bool(r["intlike"]))


def task_rule(n: int, unique: int, nonfinite: int, intlike: bool) -> str:
    if n == 0:
        return "unknown"
    if nonfinite:
        return "classification"
    limit = min(100, max(20, int(n ** 0.5)))
    if intlike and (unique <= limit or unique / n <= 0.2):
        return "classification"
    return "regression"
