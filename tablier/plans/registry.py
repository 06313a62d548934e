"""Registry of named queries: a Spark builder and (when expressible) an oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return deco


def all_queries() -> dict[str, Builder]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load():
    # importing the modules registers their queries
    from . import q_eval, q_faults, q_gate, q_knn, q_learn, q_models, q_order, q_outputs, q_prep, q_profile, q_report, q_sources, q_split, q_stats  # noqa: F401
