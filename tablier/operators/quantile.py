"""Exact order statistics (medians, percentiles) of many columns at once.

``percentile`` / ``median`` in Spark are exact but merge a map of every
distinct value in the final task, which does not survive a high-cardinality
column at scale. Here the wanted ranks of all columns are bracketed together:
one histogram keyed by (column, bin) narrows every column's bracket to the bins
that hold its ranks, with the true smallest and largest value of each bin, until
a bracket has one value or at most ``EXACT_ROWS`` rows, which are counted per
value. The number of jobs does not depend on the number of columns.

Bins are equal steps of the value and, every other time, of its signed
logarithm, so that ranges of hundreds of decades narrow as fast as short ones;
the smallest and the largest value never share a bin, so each step narrows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 4_096
EXACT_ROWS = 200_000
_LARGEST = 1.7976931348623157e308  # fixed value: the largest double


def _scaled(x: Column, logarithmic: bool) -> Column:
    """A monotone scale of all doubles, infinities included, whose differences do not overflow."""
    x = F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST))
    return F.signum(x) * F.log1p(F.abs(x)) if logarithmic else x / 4.0


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, x) of the values that are neither null nor NaN."""
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("c")).select("c.pos", "c.x").where(F.col("x").isNotNull() & ~F.isnan("x"))


def ranked_values(df: DataFrame, columns: list[str], ranks) -> dict[str, dict[int, float]]:
    """Per column the values at its wanted 1-based ranks, ``ranks(n)`` of its n values (none if n is 0)."""
    spark, cells = df.sparkSession, _cells(df, columns)
    out: dict[str, dict[int, float]] = {c: {} for c in columns}
    # brackets: (column, smallest and largest value, rows, rows of the column below it, ranks)
    state = []
    for r in cells.groupBy("pos").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        state.append((r["pos"], r["lo"], r["hi"], r["n"], 0, sorted(set(ranks(r["n"])))))

    def inside(brackets: list[tuple]) -> DataFrame:
        """The cells of each bracket (``b``): at most two rows per column are broadcast."""
        table = spark.createDataFrame([(b, *x[:3]) for b, x in enumerate(brackets)], "b int, pos int, lo double, hi double")
        return cells.join(F.broadcast(table), "pos").where("x >= lo AND x <= hi")

    def hits(steps: DataFrame, order: str, brackets: list[tuple]) -> list:
        """The steps (of ``n`` rows, in order) that hold a wanted rank of their bracket."""
        wanted = spark.createDataFrame([(b, k - x[4]) for b, x in enumerate(brackets) for k in x[5]], "b int, k long")
        upto = steps.withColumn("le", F.sum("n").over(W.partitionBy("b").orderBy(order)))
        found = upto.join(F.broadcast(wanted), "b").where("le >= k AND le - n < k")
        return found.groupBy(*upto.columns).agg(F.collect_list("k").alias("ks")).collect()

    logarithmic = False
    while state:
        for pos, lo, hi, _, _, ks in state:
            if lo == hi:
                out[columns[pos]] |= {k: lo for k in ks}
        state = [x for x in state if x[1] != x[2] and x[5]]
        wide = [x for x in state if x[3] > EXACT_ROWS]
        if not wide:
            break
        x, lo, hi = (_scaled(F.col(c), logarithmic) for c in ("x", "lo", "hi"))
        step = F.when(F.col("x") >= F.col("hi"), BINS).when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * BINS), F.lit(BINS - 1))).otherwise(0)
        steps = inside(wide).groupBy("b", step.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        state = [x for x in state if x[3] <= EXACT_ROWS]
        for r in hits(steps, "bin", wide):
            pos, below = wide[r["b"]][0], wide[r["b"]][4]
            state.append((pos, r["lo"], r["hi"], r["n"], below + r["le"] - r["n"], [k + below for k in r["ks"]]))
        logarithmic = not logarithmic
    if state:
        for r in hits(inside(state).groupBy("b", "x").agg(F.count("*").alias("n")), "x", state):
            out[columns[state[r["b"]][0]]] |= {k + state[r["b"]][4]: r["x"] for k in r["ks"]}
    return out


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """Values of the given 1-based ranks among the non-null, non-NaN values."""
    return ranked_values(df, [column], lambda n: [r for r in ranks if 1 <= r <= n])[column]


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Interpolated medians (pandas/numpy definition) of the non-missing values of all ``columns``."""
    middle = lambda n: [(n + 1) // 2, n // 2 + 1]
    found = ranked_values(df, columns, middle)
    out: dict[str, float | None] = {}
    for c, at in found.items():
        low, high = (min(at.values()), max(at.values())) if at else (None, None)
        out[c] = low if at and low == high else None if not at else low + (high - low) * 0.5
    return out


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_medians(df, [column])[column]


def most_frequent_values(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Most frequent non-missing value of each column; ties -> smallest (as SimpleImputer)."""
    counts = _cells(df, columns).groupBy("pos", "x").agg(F.count("*").alias("n"))
    best = counts.groupBy("pos").agg(F.max(F.struct("n", (-F.col("x")).alias("minus"))).alias("b"))
    found = {columns[r["pos"]]: -float(r["b"]["minus"]) + 0.0 for r in best.collect()}
    return {c: found.get(c) for c in columns}


__all__ = ["exact_median", "exact_medians", "most_frequent_values", "order_statistics", "ranked_values"]
