"""The gate on damaged data: one query per family of checks, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import row_digest_sql
from ..operators import gate as G
from ..operators import split as S
from ..sources.tables import table
from .q_gate import gate_sql
from .registry import register

# events with repeated rows, infinities, missing text, a constant and a numeric text column
_DAMAGED = """(SELECT event_id, user_id, CASE WHEN event_id % 11 = 3 THEN ' NA ' ELSE event_type END AS event_type,
  CASE WHEN event_id % 97 = 5 THEN 'Infinity'::DOUBLE WHEN event_id % 97 = 6 THEN '-Infinity'::DOUBLE
       WHEN event_id % 13 = 4 THEN 'NaN'::DOUBLE ELSE value END AS value,
  CAST(user_id AS VARCHAR) AS user_code, 'app' AS channel,
  CASE WHEN event_id % 101 = 0 THEN 'rare' ELSE 'common' END AS band
FROM events, range(2) AS again(i) WHERE i = 0 OR event_id % 20 = 0)"""
_DAMAGED_COLUMNS = [("event_id", "numeric"), ("user_id", "numeric"), ("event_type", "string"), ("value", "float"),
                    ("user_code", "string"), ("channel", "string"), ("band", "string")]


def damaged_events(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    value = (
        F.when(i % 97 == 5, F.lit(float("inf"))).when(i % 97 == 6, F.lit(float("-inf")))
        .when(i % 13 == 4, F.lit(float("nan"))).otherwise(F.col("value"))
    )
    made = e.select(
        "event_id", "user_id", F.when(i % 11 == 3, " NA ").otherwise(F.col("event_type")).alias("event_type"), value.alias("value"),
        F.col("user_id").cast("string").alias("user_code"), F.lit("app").alias("channel"),
        F.when(i % 101 == 0, "rare").otherwise("common").alias("band"),
    )
    return made.union(made.where(i % 20 == 0))


_FAULTS = G.GateConfig(
    target="band", features=["user_code", "event_type", "value", "band", "event_id"], split_method="stratified",
    imbalance_method="smote", selected_models=["foundation"], row_capped_models={"foundation": 100},
)
_STEPS = ("dataset", "target", "features", "split", "imbalance", "model")


@register("gate_damaged", gate_sql(_DAMAGED, _DAMAGED_COLUMNS, _FAULTS, _STEPS))
def q_gate_damaged(spark, sf):
    return G.run_gate(spark, damaged_events(spark, sf), _FAULTS, _STEPS)


def _issue(level: str, category: str, message: str, suggestion: str, affected: str) -> str:
    return f"SELECT '{level}' AS level, '{category}' AS category, {message} AS message, '{suggestion}' AS suggestion, {affected} AS affected_column"


# settings that name what is not there
_ABSENT = G.GateConfig(
    target="label", features=["value", "weight", "colour"], split_method="group time", group_column="household",
    date_column="day", imbalance_method="smote_nc",
)


@register("gate_absent", "\nUNION ALL ".join([
    _issue("error", "target", "'Target column ''label'' is missing from the dataset.'", "Select an existing target column.", "'label'"),
    _issue("error", "features", "'Selected feature columns are missing: [''weight'', ''colour''].'",
           "Remove missing features from the project configuration.", "'weight, colour'"),
    _issue("error", "features", "'Column ''value'' contains ' || m || ' empty values (' || printf('%.1f', m * 100.0 / n) || '%). Please clean this column before training.'",
           "Fill or correct every empty value in this selected modeling column. Rows will not be imputed or dropped automatically.", "'value'")
    + f" FROM (SELECT count(*) AS n, count(*) FILTER (WHERE isnan(value)) AS m FROM {_DAMAGED}) WHERE m > 0",
    _issue("error", "split", "'Group split selected but the group column is missing.'",
           "Select an existing group column or choose a different split method.", "'General'"),
    _issue("error", "split", "'Time split selected but the date column is missing.'",
           "Select an existing date column or choose a different split method.", "'General'"),
    _issue("warning", "imbalance", "'SMOTE-NC selected but no categorical features exist.'", "Use regular SMOTE for all-numeric features.", "'General'"),
]))
def q_gate_absent(spark, sf):
    return G.run_gate(spark, damaged_events(spark, sf), _ABSENT, ("target", "features", "split", "imbalance"))


_REGRESSION = G.GateConfig(target="event_type", features=[], task_type="regression")


@register("gate_regression", "\nUNION ALL ".join([
    _issue("error", "target", "'Regression target ''event_type'' is not numeric.'", "Choose a numeric target column or change the task type.", "'event_type'"),
    _issue("error", "features", "'No feature columns selected.'", "Select at least one feature column.", "'General'"),
]))
def q_gate_regression(spark, sf):
    return G.run_gate(spark, table(spark, sf, "events").select("event_id", "event_type"), _REGRESSION, ("target", "features"))


@register("gate_repeated_names", "\nUNION ALL ".join([
    _issue("error", "dataset", "'Duplicate column names found: [''user_id'', ''value''].'", "Rename duplicate columns before training.", "'user_id, value'"),
    _issue("warning", "dataset", "'Constant columns found: [''channel''].'", "Exclude constant columns because they do not add predictive signal.", "'channel'"),
]))
def q_gate_repeated_names(spark, sf):
    e = table(spark, sf, "events")
    again = e.select("event_id", "user_id", "value", F.lit("app").alias("channel"), F.col("value").alias("user_id"), F.col("event_type").alias("value"))
    return G.run_gate(spark, again, G.GateConfig(target="value"), ("dataset",))


# every order a class: far more classes than a report should list
_LINES = G.GateConfig(target="l_orderkey", features=["l_linenumber"], split_method="random")


@register("gate_many_classes", """
SELECT 'warning' AS level, 'target' AS category, 'Classification target has severe class imbalance.' AS message,
  'Consider class weighting, resampling, or collecting more minority-class examples.' AS suggestion, 'l_orderkey' AS affected_column
FROM (SELECT min(n) AS mn, sum(n) AS tot, count(*) AS k FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) WHERE k > 1 AND mn / tot < 0.05""")
def q_gate_many_classes(spark, sf):
    return G.run_gate(spark, table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), _LINES, ("target",))


_RARE = G.GateConfig(target="l_orderkey", features=["l_linenumber"], split_method="stratified")


@register("gate_rare_classes", f"""
SELECT 'error' AS level, 'split' AS category,
  'Class ''' || l_orderkey || ''' has only ' || count(*) || ' samples. It may not appear in all train/validation/test subsets.' AS message,
  '{S.CLASS_COVERAGE_FIX}' AS suggestion, l_orderkey::VARCHAR AS affected_column
FROM lineitem GROUP BY l_orderkey HAVING count(*) < 3""")
def q_gate_rare_classes(spark, sf):
    return G.run_gate(spark, table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), _RARE, ("split",))


# no key: the content of the rows orders them, and equal rows are shared out by number
_TALK = """SELECT CASE WHEN conv_id % 5 = 1 AND turn = 0 THEN 'topic ' || conv_id ELSE role END AS topic, turn FROM conversations"""
_NO_KEY = G.GateConfig(target="topic", features=["turn"], split_method="random")


def _place(seed: int) -> str:
    return f"row_number() OVER (ORDER BY {row_digest_sql('topic', 'turn')[:-1]} || '-'))"


@register("gate_coverage_nokey", f"""
WITH d AS ({_TALK}),
r AS (SELECT *, {_place(42)} AS rn, count(*) OVER () AS n FROM d),
rest AS (SELECT topic, turn FROM r WHERE rn <= n - CAST(ceil(0.2::DOUBLE * n) AS BIGINT)),
v AS (SELECT *, {_place(43)} AS rn, count(*) OVER () AS n FROM rest),
u AS (SELECT topic, 'test' AS split FROM r WHERE rn > n - CAST(ceil(0.2::DOUBLE * n) AS BIGINT)
      UNION ALL SELECT topic, CASE WHEN rn > n - CAST(ceil({10.0 / 80.0!r}::DOUBLE * n) AS BIGINT) THEN 'validation' ELSE 'train' END FROM v),
cov AS (SELECT topic AS class, count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'validation') AS va,
               count(*) FILTER (WHERE split = 'test') AS te FROM u GROUP BY 1),
iss AS (SELECT class, 'fatal' AS level, CASE WHEN va > 0 OR te > 0
    THEN 'Class ''' || class || ''' appears in validation/test but not training. The model cannot predict this class.'
    ELSE 'Class ''' || class || ''' is absent from the training set. The model cannot learn this class.' END AS message FROM cov WHERE tr = 0
  UNION ALL SELECT class, 'warning', 'Class ''' || class || ''' is absent from the validation set. Validation metrics for this class may be unavailable.' FROM cov WHERE tr > 0 AND va = 0
  UNION ALL SELECT class, 'warning', 'Class ''' || class || ''' is absent from the test set. Test metrics for this class may be unavailable.' FROM cov WHERE tr > 0 AND te = 0)
SELECT level, 'split' AS category, message, '{S.CLASS_COVERAGE_FIX}' AS suggestion, class AS affected_column FROM iss""")
def q_gate_coverage_nokey(spark, sf):
    c = table(spark, sf, "conversations")
    topic = F.when((F.col("conv_id") % 5 == 1) & (F.col("turn") == 0), F.concat(F.lit("topic "), F.col("conv_id").cast("string"))).otherwise(F.col("role"))
    return G.run_gate(spark, c.select(topic.alias("topic"), "turn"), _NO_KEY, ("coverage",))
