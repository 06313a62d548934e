"""Quality-gate queries (J1-J21, J29-J31) with generated oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import GATE_MISSING_MARKERS, norm_text_sql, sql_in_list
from ..operators import gate as G
from ..operators import split as S
from ..sources.tables import table
from .q_profile import DIRTY_EVENTS_SQL, dirty_events
from .registry import register

_GATE = sql_in_list(GATE_MISSING_MARKERS)

# ---------------------------------------------------------------- inputs


def gate_events(spark, sf):
    """events with missing markers, an infinity band, a text copy of the user id,
    a text date with unparseable values and a constant channel column."""
    d = dirty_events(spark, sf, keep_raw=True)
    raw = F.col("_raw")
    value = (
        F.when((raw > 440) & (raw <= 445), F.lit(float("inf")))
        .when((raw > 445) & (raw <= 450), F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return d.select(
        "event_id", "user_id", "event_type", value.alias("value"), "props",
        F.col("user_id").cast("string").alias("user_code"),
        F.when(raw > 485, F.lit("not a date")).otherwise(F.col("ts").cast("string")).alias("ts_text"),
        F.lit("app").alias("channel"),
    )


GATE_EVENTS_SQL = f"""(SELECT d.event_id, d.user_id, d.event_type,
  CASE WHEN d.value > 440 AND d.value <= 445 THEN 'Infinity'::DOUBLE WHEN d.value > 445 AND d.value <= 450 THEN '-Infinity'::DOUBLE ELSE d.value END AS value,
  d.props, CAST(d.user_id AS VARCHAR) AS user_code,
  CASE WHEN e.value > 485 THEN 'not a date' ELSE CAST(e.ts AS VARCHAR) END AS ts_text,
  'app' AS channel
FROM {DIRTY_EVENTS_SQL} d JOIN events e ON d.event_id = e.event_id)"""

# column name -> kind (float, numeric, string), in column order
GATE_EVENTS_COLS = [("event_id", "numeric"), ("user_id", "numeric"), ("event_type", "string"), ("value", "float"),
                    ("props", "string"), ("user_code", "string"), ("ts_text", "string"), ("channel", "string")]


def price_orders(spark, sf):
    o = table(spark, sf, "orders")
    band = F.when(F.col("o_totalprice") >= 499950, "extreme").when(F.col("o_totalprice") >= 250000, "high").otherwise("low")
    return o.select("o_orderkey", "o_orderpriority", "o_totalprice", band.alias("price_band"))


PRICE_ORDERS_SQL = """(SELECT o_orderkey, o_orderpriority, o_totalprice,
  CASE WHEN o_totalprice >= 499950 THEN 'extreme' WHEN o_totalprice >= 250000 THEN 'high' ELSE 'low' END AS price_band
FROM orders)"""

EVENTS_CFG = G.GateConfig(
    target="event_type", features=["user_code", "props", "value", "user_id", "ts_text"], key="event_id",
    split_method="time", date_column="ts_text", imbalance_method="smote",
    selected_models=["foundation"], row_capped_models={"foundation": 3000},
)
ORDERS_CFG = G.GateConfig(
    target="price_band", features=["o_orderpriority", "o_totalprice"], key="o_orderkey",
    split_method="stratified", imbalance_method="smote",
)

# ---------------------------------------------------------------- SQL generation


def _v(c, k):
    return f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)" if k == "float" else c


def stats_sql(src: str, cols) -> str:
    parts = []
    for pos, (c, k) in enumerate(cols):
        v = _v(c, k)
        gm = f"{v} IS NULL" + (f" OR {norm_text_sql(c)} IN ({_GATE})" if k == "string" else "")
        inf = f"count(*) FILTER (WHERE isinf({c}))" if k == "float" else "0"
        parts.append(f"""SELECT {pos} AS pos, '{c}' AS col, '{k}' AS kind, count(*) AS n_rows,
  count(DISTINCT {v}) + CASE WHEN count(*) FILTER (WHERE {v} IS NULL) > 0 THEN 1 ELSE 0 END AS levels_with_null,
  count(DISTINCT {v}) AS n_distinct, count({v}) AS non_missing,
  count(*) FILTER (WHERE {gm}) AS gate_missing,
  (SELECT min(n) FROM (SELECT count(*) AS n FROM {src} WHERE {v} IS NOT NULL GROUP BY {v})) AS min_level,
  count(*) FILTER (WHERE {v} IS NOT NULL AND TRY_CAST(CAST({v} AS VARCHAR) AS DOUBLE) IS NOT NULL) AS numeric_parse,
  {inf} AS infinite,
  count(*) FILTER (WHERE TRY_CAST(CAST({v} AS VARCHAR) AS TIMESTAMP) IS NULL) AS bad_dates
FROM {src}""")
    return "\nUNION ALL ".join(parts)


def _list(cond: str, order: str = "pos") -> str:
    """Python-style list literal of the column names satisfying cond, in the given order."""
    return f"(SELECT '[' || string_agg('''' || col || '''', ', ' ORDER BY {order}) || ']' FROM st WHERE {cond})"


def _missing_issue_sql(category: str, cols: list[str]) -> str:
    inl = ", ".join(f"'{c}'" for c in cols)
    return f"""SELECT 'error', '{category}',
  'Column ''' || col || ''' contains ' || gate_missing || ' empty values (' || printf('%.1f', gate_missing * 100.0 / n_rows) || '%). Please clean this column before training.',
  'Fill or correct every empty value in this selected modeling column. Rows will not be imputed or dropped automatically.'
FROM st WHERE col IN ({inl}) AND gate_missing > 0"""


def gate_sql(src: str, cols, cfg: G.GateConfig, checks) -> str:
    names = [c for c, _ in cols]
    ncols = len(names)
    parts = []
    if "dataset" in checks:
        grp = ", ".join(names)
        parts.append(f"""SELECT 'warning', 'dataset', 'The dataset contains ' || d || ' duplicate row(s).',
  'Review duplicates and remove them if they are not intentional repeated observations.'
FROM (SELECT coalesce(sum(n - 1), 0) AS d FROM (SELECT count(*) AS n FROM {src} GROUP BY {grp})) WHERE d > 0""")
        parts.append(f"""SELECT 'warning', 'dataset', 'The dataset has fewer than 30 rows (' || n || ' rows).',
  'Use more rows when possible; small samples can produce unstable models and explanations.'
FROM (SELECT max(n_rows) AS n FROM st) WHERE n < 30""")
        if ncols > 5000:
            parts.append(f"SELECT 'error', 'dataset', 'The dataset has more than 5000 columns ({ncols} columns).', "
                         "'Reduce dimensionality or select a smaller feature set before training.'")
        parts.append(f"""SELECT 'warning', 'dataset', 'Constant columns found: ' || {_list('levels_with_null <= 1')} || '.',
  'Exclude constant columns because they do not add predictive signal.'
WHERE EXISTS (SELECT 1 FROM st WHERE levels_with_null <= 1)""")
        parts.append(f"""SELECT 'error', 'dataset', 'Infinite numeric values found in columns: ' || {_list('infinite > 0')} || '.',
  'Replace infinite values with missing values or finite numeric values before training.'
WHERE EXISTS (SELECT 1 FROM st WHERE infinite > 0)""")
    t = cfg.target
    tk = dict(cols).get(t)
    if "target" in checks:
        parts.append(_missing_issue_sql("target", [t]))
        parts.append(f"""SELECT 'error', 'target', 'Classification target has only one class.', 'Choose a target with at least two classes.'
FROM (SELECT count(*) AS k FROM (SELECT {t} FROM {src} WHERE {t} IS NOT NULL GROUP BY 1)) WHERE k <= 1""")
        parts.append(f"""SELECT 'warning', 'target', 'Classification target has severe class imbalance.',
  'Consider class weighting, resampling, or collecting more minority-class examples.'
FROM (SELECT count(*) AS k, min(n) AS mn, sum(n) AS tot FROM (SELECT count(*) AS n FROM {src} WHERE {t} IS NOT NULL GROUP BY {t}))
WHERE k > 1 AND mn / tot < 0.05""")
    feats = list(cfg.features)
    cats = [c for c in feats if dict(cols).get(c) == "string"]
    if "features" in checks:
        parts.append(_missing_issue_sql("features", feats))
        fl = ", ".join(f"'{c}'" for c in feats)
        fpos = f"list_position([{fl}], col)"
        ids = ", ".join(f"'{c}'" for c in (cfg.id_columns or ["\u0000"]))
        id_cond = (f"col IN ({fl}) AND (col IN ({ids}) OR lower(col) IN ('id', 'uuid', 'guid') OR lower(col) LIKE '%id' "
                   f"OR (non_missing > 0 AND n_distinct = non_missing AND non_missing >= 30))")
        parts.append(f"""SELECT 'warning', 'features', 'ID-like columns are selected as features: ' || {_list(id_cond, fpos)} || '.',
  'Exclude identifiers unless they are intentionally predictive and valid at inference time.'
WHERE EXISTS (SELECT 1 FROM st WHERE {id_cond})""")
        cl = ", ".join(f"'{c}'" for c in cats) or "'\u0000'"
        for cond, msg, sug in [
            (f"col IN ({cl}) AND n_distinct > 100", "High-cardinality categorical features found: ",
             "Consider grouping rare values, target encoding, hashing, or excluding these columns."),
            (f"col IN ({cl}) AND non_missing > 0 AND numeric_parse / non_missing >= 0.9", "Numeric-looking columns are stored as text: ",
             "Convert these columns to numeric values during preprocessing."),
            (f"col IN ({cl}) AND non_missing > 0 AND min_level * 100.0 / non_missing < 1.0", "Categorical columns with rare levels found: ",
             "Consider grouping rare categories before training."),
        ]:
            parts.append(f"""SELECT 'warning', 'features', '{msg}' || {_list(cond, fpos)} || '.', '{sug}'
WHERE EXISTS (SELECT 1 FROM st WHERE {cond})""")
    m = cfg.split_method
    if "split" in checks:
        if "time" in m:
            d = cfg.date_column
            parts.append(f"""SELECT 'error', 'split', 'Date column ''{d}'' has ' || bad_dates || ' invalid date value(s).',
  'Fix invalid dates before using a time-based split.' FROM st WHERE col = '{d}' AND bad_dates > 0""")
        if "strat" in m:
            notm = f" AND {norm_text_sql(t)} NOT IN ({_GATE})" if tk == "string" else ""
            parts.append(f"""SELECT 'error', 'split', 'Class ''' || CAST({t} AS VARCHAR) || ''' has only ' || count(*) || ' samples. It may not appear in all train/validation/test subsets.',
  '{S.CLASS_COVERAGE_FIX}' FROM {src} WHERE {t} IS NOT NULL{notm} GROUP BY {t} HAVING count(*) < 3""")
    if "imbalance" in checks and "smote" in cfg.imbalance_method:
        parts.append(f"""SELECT 'error', 'imbalance', 'SMOTE selected but the minority class has fewer than 2 samples.',
  'Use class weighting, random oversampling, or add more minority-class samples.'
FROM (SELECT min(n) AS mn FROM (SELECT count(*) AS n FROM {src} WHERE {t} IS NOT NULL GROUP BY {t})) WHERE mn < 2""")
        if cfg.imbalance_method == "smote" and cats:
            lit = str(cats).replace("'", "''")
            parts.append(f"""SELECT 'warning', 'imbalance', 'SMOTE selected while categorical features exist: {lit}.',
  'Use SMOTE-NC or encode categorical features carefully before oversampling.'""")
    if "model" in checks:
        for model in cfg.selected_models:
            cap = cfg.row_capped_models.get(model)
            if cap is not None:
                parts.append(f"""SELECT 'warning', 'model', '{model} is selected with more than {cap} rows (' || n || ' rows).',
  'Subsample the data or choose another model for larger datasets.' FROM (SELECT max(n_rows) AS n FROM st) WHERE n > {cap}""")
    body = "\nUNION ALL ".join(parts)
    tgt = t or "Target"
    return f"""WITH st AS ({stats_sql(src, cols)}),
iss(level, category, message, suggestion) AS ({body})
SELECT level, category, message, suggestion,
  CASE WHEN len(regexp_extract_all(message, '''([^'']+)''', 1)) > 0 THEN array_to_string(regexp_extract_all(message, '''([^'']+)''', 1), ', ')
       WHEN category = 'target' THEN '{tgt}' ELSE 'General' END AS affected_column
FROM iss"""


def _rollup_sql(inner: str) -> str:
    return f"""WITH g AS ({inner})
SELECT count(*) FILTER (WHERE level = 'warning') AS warnings, count(*) FILTER (WHERE level = 'error') AS errors,
       count(*) FILTER (WHERE level = 'fatal') AS fatals,
       count(*) FILTER (WHERE level IN ('error', 'fatal')) = 0 AS can_continue FROM g"""


def _readiness_sql(inner: str) -> str:
    return f"""WITH g AS ({inner}),
b AS (SELECT coalesce(list(DISTINCT category) FILTER (WHERE level IN ('error', 'fatal')), []) AS b FROM g),
f AS (SELECT len(b) = 0 AS training,
   NOT list_has_any(b, ['target', 'configuration']) AS target,
   NOT list_has_any(b, ['split', 'artifacts']) AS split,
   NOT list_has_any(b, ['features', 'target', 'configuration', 'artifacts']) AS encoding,
   NOT list_has_any(b, ['split']) AS coverage,
   NOT list_has_any(b, ['imbalance', 'artifacts']) AS imbalance FROM b)
SELECT *, CAST(training AS INT) + CAST(target AS INT) + CAST(split AS INT) + CAST(encoding AS INT)
        + CAST(coverage AS INT) + CAST(imbalance AS INT) AS passed,
       printf('%d / 6 checks passed', CAST(training AS INT) + CAST(target AS INT) + CAST(split AS INT)
        + CAST(encoding AS INT) + CAST(coverage AS INT) + CAST(imbalance AS INT)) AS score FROM f"""


PRICE_COLS = [("o_orderkey", "numeric"), ("o_orderpriority", "string"), ("o_totalprice", "float"), ("price_band", "string")]
NO_COVERAGE = ("dataset", "target", "features", "split", "imbalance", "model")

# ---------------------------------------------------------------- queries


@register("gate_dataset", gate_sql(GATE_EVENTS_SQL, GATE_EVENTS_COLS, EVENTS_CFG, ("dataset",)))
def q_gate_dataset(spark, sf):
    return G.run_gate(spark, gate_events(spark, sf), EVENTS_CFG, ("dataset",))


@register("gate_target", gate_sql(GATE_EVENTS_SQL, GATE_EVENTS_COLS, EVENTS_CFG, ("target",)))
def q_gate_target(spark, sf):
    return G.run_gate(spark, gate_events(spark, sf), EVENTS_CFG, ("target",))


@register("gate_features", gate_sql(GATE_EVENTS_SQL, GATE_EVENTS_COLS, EVENTS_CFG, ("features",)))
def q_gate_features(spark, sf):
    return G.run_gate(spark, gate_events(spark, sf), EVENTS_CFG, ("features",))


@register("gate_split", gate_sql(GATE_EVENTS_SQL, GATE_EVENTS_COLS, EVENTS_CFG, ("split",)))
def q_gate_split(spark, sf):
    return G.run_gate(spark, gate_events(spark, sf), EVENTS_CFG, ("split",))


@register("gate_split_stratified", gate_sql(PRICE_ORDERS_SQL, PRICE_COLS, ORDERS_CFG, ("split",)))
def q_gate_split_stratified(spark, sf):
    return G.run_gate(spark, price_orders(spark, sf), ORDERS_CFG, ("split",))


@register("gate_imbalance", gate_sql(PRICE_ORDERS_SQL, PRICE_COLS, ORDERS_CFG, ("imbalance",)))
def q_gate_imbalance(spark, sf):
    return G.run_gate(spark, price_orders(spark, sf), ORDERS_CFG, ("imbalance",))


@register("gate_model", gate_sql(GATE_EVENTS_SQL, GATE_EVENTS_COLS, EVENTS_CFG, ("model",)))
def q_gate_model(spark, sf):
    return G.run_gate(spark, gate_events(spark, sf), EVENTS_CFG, ("model",))


@register("gate_rollup", _rollup_sql(gate_sql(GATE_EVENTS_SQL, GATE_EVENTS_COLS, EVENTS_CFG, NO_COVERAGE)))
def q_gate_rollup(spark, sf):
    return G.rollup(G.run_gate(spark, gate_events(spark, sf), EVENTS_CFG, NO_COVERAGE))


@register("gate_readiness", _readiness_sql(gate_sql(PRICE_ORDERS_SQL, PRICE_COLS, ORDERS_CFG, NO_COVERAGE)))
def q_gate_readiness(spark, sf):
    return G.readiness(G.run_gate(spark, price_orders(spark, sf), ORDERS_CFG, NO_COVERAGE))
