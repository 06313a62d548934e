"""Exact, distributed order statistics over a string sort key.

Two primitives replace ``row_number()`` over an un-partitioned (or skewed)
window:

* :func:`mark_first` flags the first ``q`` rows of every stratum. The cut, the
  sort key of the q-th row, is searched for all strata at once, as a table
  (stratum, prefix, rows still needed, rows in the bucket): a histogram over
  growing key prefixes (16 bits a level) narrows the strata above
  ``EXACT_MAX_ROWS``, the rest is ranked in windows of at most that many rows.
  Flagging is a join with the table of cuts, of counted size, so the number of
  strata has no limit, and a map-side comparison; data rows are not shuffled.
  More than ``LOCAL_ROWS`` strata, none of them large, are dealt out by stratum
  instead, once and without sort keys, and ranked where they lie.

* :func:`exact_rank` attaches the exact 1-based rank within a stratum: counts
  per (stratum, 16-bit prefix bucket) give offsets (a small table), and rows
  are ranked inside (stratum, bucket) windows, which are balanced for hash
  keys even when one stratum holds most of the rows.

The order of :func:`mark_first` is total for any rows. Where the cut falls
among rows of one sort key (repeated or null keys), a digest of the whole row
decides; where it falls among equal rows, these are counted, collapsed and
written out again in the two shares due, so the counts are exact and nothing
depends on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import row_digest
from .running import written

PREFIX_STEP = 4  # hex digits per refinement level (16 bits)
EXACT_MAX_ROWS = 2_000_000  # rows ranked in one window partition; larger strata get histogram levels first
BROADCAST_MAX_ROWS = 1_000_000  # small-table rows we allow to broadcast
LOCAL_ROWS = 10_000  # rows of a small table that may pass through the driver; larger ones are written out
COPIES_PER_TASK = 100_000  # equal rows that one task writes out again

SELECT_ALL = "~"  # sorts after every hex / key character
SELECT_NONE = ""

NULL_STRATUM = "\u0000null"


def stratum_col(c) -> Column:
    """Stratum as non-null string (NULL becomes its own stratum)."""
    if c is None:
        return F.lit("")
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(NULL_STRATUM))


class TooManyGroups(RuntimeError):
    """A table that must reach the driver is larger than its bound; never a property of the split itself."""


def _collect_up_to(grouped: DataFrame, bound: int) -> tuple[list, bool]:
    """(rows, all of them) in ONE job: the row count rides along as a broadcast
    scalar and, above the bound, filters the rows before they leave the executors."""
    k = grouped.agg(F.count(F.lit(1)).alias("_k"))
    rows = grouped.crossJoin(F.broadcast(k)).where(F.col("_k") <= F.lit(bound)).drop("_k").collect()
    return rows, bool(rows) or grouped.isEmpty()


def bounded_collect(grouped: DataFrame, bound: int, what: str) -> list:
    """Collect a grouped (small) table, raising instead of pulling more than ``bound`` rows to the driver."""
    rows, whole = _collect_up_to(grouped, bound)
    if not whole:
        raise TooManyGroups(f"More than {bound} {what}; this table is not small enough to collect.")
    return rows


MAX_STRATA = 100_000  # classes whose counts may reach the driver as a dict, where an interface asks for one


def stratum_counts(df: DataFrame, stratum, limit: int | None = None) -> dict[str, int]:
    """Per-stratum row counts as a dict; raises instead of collecting an unbounded table."""
    g = stratum_col(stratum)
    rows = bounded_collect(df.groupBy(g.alias("_g")).count(), limit or MAX_STRATA, "strata / classes")
    return {r[0]: int(r[1]) for r in rows}


@dataclass
class Strata:
    """Sizes of strata: a table (_g, _n) of any length, its rows if they are few, and totals."""

    df: DataFrame
    rows: dict[str, int] | None
    k: int
    n: int
    smallest: int
    largest: int

    @staticmethod
    def of(df: DataFrame, g: Column) -> "Strata":
        counts = df.groupBy(g.alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
        rows = counts.limit(LOCAL_ROWS + 1).collect()
        if len(rows) <= LOCAL_ROWS:
            sizes = {r["_g"]: int(r["_n"]) for r in rows}
            local = df.sparkSession.createDataFrame(sorted(sizes.items()), "_g string, _n long")
            return Strata(local, sizes, len(sizes), sum(sizes.values()), min(sizes.values(), default=0), max(sizes.values(), default=0))
        table = written(counts, "strata")
        t = table.agg(F.count("*"), F.sum("_n"), F.min("_n"), F.max("_n")).first()
        return Strata(table, None, *(int(x) for x in t))

    def joinable(self, df: DataFrame) -> DataFrame:
        """A table of one row per stratum, broadcast when the strata were counted to be few."""
        return F.broadcast(df) if self.k <= BROADCAST_MAX_ROWS else df


#: From the strata of a population to the table (_g, _n, _q) of rows wanted first in each.
Quotas = Callable[[Strata], DataFrame]


def quota_of(q: int) -> Quotas:
    """The same number of rows from every stratum."""
    return lambda s: s.df.withColumn("_q", F.lit(int(q)).cast("long"))


def quota_all_but(held: Callable[[int], int]) -> Quotas:
    """All but ``held(n)`` rows of the one stratum of n rows."""
    return lambda s: s.df.withColumn("_q", F.lit(s.n - held(s.n)).cast("long"))


def largest_remainder(counts: dict[str, int], total_draws: int) -> dict[str, int]:
    """Per-class quota: floor share plus one for the largest remainders.

    Integer arithmetic (no float ties); equal remainders go to the class that
    sorts first.
    """
    n = sum(counts.values())
    if n == 0:
        return {g: 0 for g in counts}
    base = {g: (total_draws * c) // n for g, c in counts.items()}
    rem = {g: (total_draws * c) % n for g, c in counts.items()}
    short = total_draws - sum(base.values())
    for g in sorted(counts, key=lambda g: (-rem[g], g))[:short]:
        base[g] += 1
    return base


def remainder_quotas(s: Strata, draws: int) -> DataFrame:
    """(_g, _n, _q): ``draws`` rows over the strata by largest remainder; ``_q`` of a stratum stays, the rest is drawn."""
    if s.rows is not None:
        share = largest_remainder(s.rows, draws)
        out = [(g, c, c - share[g]) for g, c in sorted(s.rows.items())]
        return s.df.sparkSession.createDataFrame(out, "_g string, _n long, _q long")
    exact = f"cast({draws} as decimal(38,0)) * _n"
    parts = s.df.withColumn("_base", F.expr(f"cast(({exact}) div {s.n} as long)")).withColumn("_rem", F.expr(f"cast(({exact}) % {s.n} as long)"))
    parts = written(parts.withColumnRenamed("_g", "_stratum"), "quotas")
    short = draws - int(parts.agg(F.sum("_base")).first()[0])
    order = F.concat(F.lpad(F.hex(F.lit(s.n) - F.col("_rem")), 16, "0"), F.col("_stratum"))
    more = mark_first(parts, order, None, quota_of(short), "_more")
    return more.select(F.col("_stratum").alias("_g"), "_n", (F.col("_n") - F.col("_base") - F.col("_more").cast("long")).alias("_q"))


_COMMON = (
    "aggregate(sequence(0, least(length(_lo), length(_hi))), 0, "
    "(a, i) -> if(a = i - 1 and substring(_lo, i, 1) = substring(_hi, i, 1), i, a))"
)


def find_cuts(pop: DataFrame, quotas: DataFrame, strata: Strata) -> tuple[DataFrame, bool]:
    """(_g, _cut, _need, _size) per stratum, and whether a cut falls among rows of one sort key.

    ``pop`` has the stratum ``_g`` and the sort key ``_s``. A stratum's first
    ``_q`` rows are those below ``_cut`` and ``_need`` of the ``_size`` rows at it.
    """
    whole = quotas.where("_q <= 0 OR _q >= _n").select(
        "_g",
        F.when(F.col("_q") <= 0, SELECT_NONE).otherwise(SELECT_ALL).alias("_cut"),
        F.lit(0).cast("long").alias("_need"),
        F.lit(0).cast("long").alias("_size"),
    )
    state = quotas.where("_q > 0 AND _q < _n").select("_g", F.lit("").alias("_prefix"), F.col("_q").alias("_need"), F.col("_n").alias("_size"))
    done = whole
    largest = strata.largest
    while largest > EXACT_MAX_ROWS:
        rows = pop.join(strata.joinable(state), "_g").where(F.expr("substring(_s, 1, length(_prefix)) = _prefix"))
        hist = rows.groupBy("_g", "_need", F.expr(f"substring(_s, 1, length(_prefix) + {PREFIX_STEP})").alias("_p")).agg(
            F.count(F.lit(1)).alias("_size"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi")
        )
        below = F.sum("_size").over(W.partitionBy("_g").orderBy("_p")) - F.col("_size")
        at_cut = hist.withColumn("_below", below).where("_below < _need AND _need <= _below + _size")
        state = written(at_cut.select("_g", (F.col("_need") - F.col("_below")).alias("_need"), "_size", "_lo", "_hi"), "cuts")
        done = done.union(state.where("_lo = _hi").select("_g", F.col("_lo").alias("_cut"), "_need", "_size"))
        state = state.where("_lo <> _hi")
        largest = state.agg(F.max("_size")).first()[0] or 0
        state = state.select("_g", F.expr(f"substring(_lo, 1, {_COMMON})").alias("_prefix"), "_need", "_size")
    rows = pop.join(strata.joinable(state), "_g").where(F.expr("substring(_s, 1, length(_prefix)) = _prefix"))
    w = W.partitionBy("_g").orderBy("_s")
    ranked = rows.select("_g", "_s", "_need", F.row_number().over(w).alias("_rn"), F.rank().over(w).alias("_r"), F.count(F.lit(1)).over(w).alias("_le"))
    hit = ranked.where("_rn = _need").select(
        "_g", F.col("_s").alias("_cut"), (F.col("_need") - F.col("_r") + 1).alias("_need"), (F.col("_le") - F.col("_r") + 1).alias("_size")
    )
    cuts = done.union(hit)
    if strata.k <= LOCAL_ROWS:
        found = cuts.collect()
        local = pop.sparkSession.createDataFrame(found, "_g string, _cut string, _need long, _size long")
        return local, any(r["_need"] < r["_size"] for r in found)
    cuts = written(cuts, "cuts")
    return cuts, not cuts.where("_need < _size").isEmpty()


def mark_first(df: DataFrame, sort_key: Column, stratum, quotas: Quotas, flag: str, within: Column | None = None,
               content: list[str] | None = None) -> DataFrame:
    """``df`` with the boolean ``flag``: the row is among the first ``_q`` rows of its stratum.

    ``within`` restricts the population; other rows get false. ``content``
    names the columns that tell rows apart where sort keys are equal (default:
    all). The sort key may be null (such rows come first).
    """
    content = content or df.columns
    keyed = df.withColumn("_g", stratum_col(stratum)).withColumn("_s", F.coalesce(sort_key, F.lit("")))
    inside = F.lit(True) if within is None else F.coalesce(within, F.lit(False))
    pop = keyed.where(inside).select("_g", "_s")
    strata = Strata.of(pop, F.col("_g"))
    if strata.rows is None and strata.largest <= EXACT_MAX_ROWS:
        return _mark_ranked(df, sort_key, stratum, quotas(strata), flag, inside, content)
    cuts, tied = find_cuts(pop, quotas(strata), strata)
    joined = keyed.withColumn("_in", inside).join(strata.joinable(cuts), "_g", "left")
    first = F.coalesce(F.col("_in") & ((F.col("_s") < F.col("_cut")) | ((F.col("_s") == F.col("_cut")) & (F.col("_need") == F.col("_size")))), F.lit(False))
    columns = [*df.columns, flag]
    if not tied:
        return joined.withColumn(flag, first).select(columns)
    at_cut = F.coalesce(F.col("_in") & (F.col("_s") == F.col("_cut")) & (F.col("_need") < F.col("_size")), F.lit(False))
    settled = joined.where(~at_cut).withColumn(flag, first).select(columns)
    return settled.unionByName(_split_tied(joined.where(at_cut).drop("_s", "_cut", "_in"), strata, content, flag).select(columns))


def _mark_ranked(df: DataFrame, sort_key: Column, stratum, quotas: DataFrame, flag: str, inside: Column, content: list[str]) -> DataFrame:
    """The same flag where strata are many and none is large: rows are dealt out by stratum once and ranked there.

    The sort key and the digest are made behind that shuffle and do not travel.
    """
    wanted = quotas.select("_g", "_q").hint("merge")
    joined = df.withColumn("_g", stratum_col(stratum)).join(wanted, "_g", "left").withColumn("_in", inside)
    keyed = joined.withColumn("_s", F.coalesce(sort_key, F.lit(""))).withColumn("_d", F.unhex(row_digest(df, content)))
    place = F.row_number().over(W.partitionBy("_g", "_in").orderBy("_s", "_d"))
    return keyed.withColumn(flag, F.coalesce(F.col("_in") & (place <= F.col("_q")), F.lit(False))).select(*df.columns, flag)


def _split_tied(rows: DataFrame, strata: Strata, content: list[str], flag: str) -> DataFrame:
    """Flags ``_need`` of the ``_size`` rows of one sort key per stratum, in order of their content."""
    rows = rows.withColumn("_s", row_digest(rows, content))
    quotas = rows.groupBy("_g").agg(F.first("_size").alias("_n"), F.first("_need").alias("_q"))
    found, _ = find_cuts(rows.select("_g", "_s"), quotas, strata)
    cuts = found.select("_g", "_cut", F.col("_need").alias("_take"), F.col("_size").alias("_copies"))
    joined = rows.join(strata.joinable(cuts), "_g")
    other = joined.where("_s <> _cut OR _take = _copies").withColumn(flag, F.col("_s") <= F.col("_cut"))
    # equal rows: one of each stratum, written out as often as it occurs
    names = [c for c in rows.columns if c not in ("_g", "_s", "_need", "_size")]
    equal = joined.where("_s = _cut AND _take < _copies").groupBy("_g").agg(
        F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias("_row"), F.first("_take").alias("_take"), F.first("_copies").alias("_copies")
    )
    chunks = equal.withColumn("_at", F.explode(F.expr(f"sequence(0, _copies - 1, {COPIES_PER_TASK})")))
    spread = chunks.repartition("_g", "_at").withColumn("_i", F.explode(F.expr(f"sequence(_at, least(_at + {COPIES_PER_TASK}, _copies) - 1)")))
    copies = spread.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], (F.col("_i") < F.col("_take")).alias(flag))
    return other.select(*names, flag).unionByName(copies)


def exact_rank(df: DataFrame, sort_key: Column, stratum_cols: list[str], rank_col: str = "_rank") -> DataFrame:
    """Attach the exact 1-based rank of ``sort_key`` within ``stratum_cols``.

    The leading 4 characters of ``sort_key`` should be roughly uniform (md5),
    which keeps every (stratum, bucket) window small and balanced. The join
    deals rows out as the window needs them, so it costs no shuffle of its own;
    without the hint Spark may take the rows, small as files, for the side to broadcast.
    """
    sort_key = F.coalesce(sort_key, F.lit(""))  # rows without a key are ranked first, not lost
    b = F.substring(sort_key, 1, PREFIX_STEP)
    with_b = df.withColumn("_s", sort_key).withColumn("_b", b)
    keys = list(stratum_cols) + ["_b"]
    counts = with_b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    base = W.partitionBy(*stratum_cols) if stratum_cols else W
    ow = base.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = counts.withColumn("_off", F.sum("_n").over(ow) - F.col("_n")).drop("_n")
    joined = with_b.join(offsets.hint("merge"), on=keys, how="inner")
    rw = W.partitionBy(*keys).orderBy("_s")
    return joined.withColumn(rank_col, F.col("_off") + F.row_number().over(rw)).drop("_b", "_off", "_s")
