"""Portable, partition-independent randomness.

``rand(seed)`` depends on partition layout, so every seeded operator instead
orders rows by ``md5(seed || '|' || key)``.  The same strings hash the same in
Spark and in any SQL engine with ``md5``, so every seeded result has an exact
SQL oracle and does not change with ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegralType, MapType, StructType

_SIGN_BIT = -(1 << 63)
TWO_POW_32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_md5(seed, *parts) -> Column:
    """md5 hex of 'seed|part1|part2...' (parts cast to string)."""
    pieces = [F.lit(str(seed))] + [_as_col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *pieces))


def uniform(seed, *parts) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of the seeded md5."""
    return F.conv(F.substring(seeded_md5(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def sortable_long(c) -> Column:
    """Fixed-width hex whose string order equals the signed numeric order."""
    return F.lpad(F.hex(_as_col(c).cast("long").bitwiseXOR(F.lit(_SIGN_BIT))), 16, "0")


def sortable_key(c, dtype: DataType | None) -> Column:
    """String whose order equals the order of the key column (ints or strings)."""
    if dtype is not None and isinstance(dtype, IntegralType):
        return sortable_long(c)
    return _as_col(c).cast("string")


def hash_sort_key(df, seed, key: str | list[str]) -> Column:
    """Order key of the seeded shuffle: (md5(seed|key), key) as one string.

    md5 hex has fixed width, so appending the key keeps the tuple order. A null
    key has a place in that order too, that of ``md5(seed)``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    dtypes = dict((f.name, f.dataType) for f in df.schema.fields)
    tail = [F.coalesce(sortable_key(k, dtypes.get(k)), F.lit("")) for k in keys]
    return F.concat(seeded_md5(seed, *keys), *tail)


def row_digest(df, columns: list[str]) -> Column:
    """md5 of the row's values, each as byte count, colon and text, or ``-`` if null: equal only for equal rows."""
    parts = []
    for name in columns:
        c, dtype = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(dtype, BinaryType):
            text = F.hex(c)
        elif isinstance(dtype, (StructType, ArrayType, MapType)):
            text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        else:
            text = c.cast("string")
        parts.append(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.md5(F.concat(*parts)) if parts else F.md5(F.lit(""))


def row_digest_sql(*columns: str) -> str:
    """The same digest of columns of integer or text type as SQL text (for oracles)."""
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns]
    return f"md5({' || '.join(parts)})"


def hash_sql(seed, *parts: str) -> str:
    """The same md5 expression as ANSI SQL text (for oracles)."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5({inner})"


def uniform_sql(seed, *parts: str) -> str:
    return f"(('0x' || substr({hash_sql(seed, *parts)}, 1, 8))::UBIGINT / 4294967296.0)"
