"""Missing-value predicates (two different marker sets are kept on purpose)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StringType

# Fixed values that must match the reference's behaviour.
# Markers the quality gate treats as empty (after trim + casefold):
GATE_MISSING_MARKERS = ["", "na", "n/a", "null", "none"]
# Markers the loader turns into missing (after trim + lower-case):
LOADER_MISSING_MARKERS = ["", '""', "null", "nan", "n/a", "na", "none"]
# Characters stripped around text before comparing with the markers.
WHITESPACE = " \t\n\r\x0b\x0c"


def norm_text(c) -> Column:
    """Strip surrounding whitespace, then lower-case."""
    return F.lower(F.btrim(_col(c), F.lit(WHITESPACE)))


def norm_text_sql(c: str) -> str:
    return f"lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)))"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_float(dtype: DataType) -> bool:
    return isinstance(dtype, (DoubleType, FloatType))


def null_or_nan(c, dtype: DataType) -> Column:
    c = _col(c)
    if is_float(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def gate_missing(c, dtype: DataType) -> Column:
    """Null / NaN, or trimmed case-folded text in the gate marker set."""
    c = _col(c)
    base = null_or_nan(c, dtype)
    if isinstance(dtype, StringType):
        return base | norm_text(c).isin(GATE_MISSING_MARKERS)
    return base


def normalize_missing(df, columns=None):
    """C4: loader markers in string columns become NULL; NaN in floats becomes NULL."""
    cols = []
    wanted = set(columns) if columns is not None else None
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if wanted is not None and f.name not in wanted:
            cols.append(c)
        elif isinstance(f.dataType, StringType):
            cols.append(F.when(norm_text(c).isin(LOADER_MISSING_MARKERS), F.lit(None)).otherwise(c).alias(f.name))
        elif is_float(f.dataType):
            cols.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def sql_in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
