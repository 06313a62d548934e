"""Small generators of oracle SQL fragments (DuckDB dialect) shared by query modules."""

from __future__ import annotations


def md5_sql(seed, *parts: str) -> str:
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5({inner})"


def stratified_holdout_ctes(name: str, src: str, key: str, target: str, size: float, seed: int) -> str:
    """CTEs ending in ``name(key, is_test)``: largest-remainder stratified hold-out."""
    h = md5_sql(seed, f"s.{key}")
    return f"""
{name}_cnt AS (SELECT CAST({target} AS VARCHAR) AS g, count(*) AS c FROM {src} GROUP BY 1),
{name}_tot AS (SELECT sum(c) AS n, CAST(ceil({size!r}::DOUBLE * sum(c)) AS BIGINT) AS m FROM {name}_cnt),
{name}_q AS (SELECT g, c, (m * c) // n AS fl, (m * c) % n AS rem, m FROM {name}_cnt, {name}_tot),
{name}_q2 AS (SELECT g, c, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, g) <= m - sum(fl) OVER () THEN 1 ELSE 0 END AS tq FROM {name}_q),
{name} AS (
  SELECT s.{key} AS {key},
         CASE WHEN row_number() OVER (PARTITION BY CAST(s.{target} AS VARCHAR) ORDER BY {h}, s.{key}) <= q.c - q.tq
              THEN 0 ELSE 1 END AS is_test
  FROM {src} s JOIN {name}_q2 q ON CAST(s.{target} AS VARCHAR) = q.g)"""


def random_holdout_ctes(name: str, src: str, key: str, size: float, seed: int) -> str:
    h = md5_sql(seed, f"s.{key}")
    return f"""
{name}_tot AS (SELECT count(*) AS n, CAST(ceil({size!r}::DOUBLE * count(*)) AS BIGINT) AS m FROM {src}),
{name} AS (
  SELECT s.{key} AS {key},
         CASE WHEN row_number() OVER (ORDER BY {h}, s.{key}) <= t.n - t.m THEN 0 ELSE 1 END AS is_test
  FROM {src} s, {name}_tot t)"""


def group_holdout_ctes(name: str, src: str, group: str, size: float, seed: int) -> str:
    """CTEs ending in ``name(group, is_test)`` over distinct groups."""
    h = md5_sql(seed, f"g.{group}")
    return f"""
{name}_g AS (SELECT DISTINCT {group} FROM {src}),
{name}_tot AS (SELECT count(*) AS n, CAST(ceil({size!r}::DOUBLE * count(*)) AS BIGINT) AS m FROM {name}_g),
{name} AS (
  SELECT g.{group} AS {group},
         CASE WHEN row_number() OVER (ORDER BY {h}, g.{group}) <= t.n - t.m THEN 0 ELSE 1 END AS is_test
  FROM {name}_g g, {name}_tot t)"""


def group_folds_ctes(name: str, src: str, group: str, target: str, k: int, seed: int) -> str:
    """CTEs ending in ``name(group, fold)``: snake deal by dominant class, size desc, md5."""
    h = md5_sql(seed, f"{group}")
    return f"""
{name}_gc AS (SELECT {group}, CAST({target} AS VARCHAR) AS cls, count(*) AS n FROM {src} GROUP BY 1, 2),
{name}_gd AS (
  SELECT {group}, cls AS dom, sum(n) OVER (PARTITION BY {group}) AS size,
         row_number() OVER (PARTITION BY {group} ORDER BY n DESC, cls) AS r
  FROM {name}_gc),
{name}_pos AS (
  SELECT {group}, row_number() OVER (PARTITION BY dom ORDER BY size DESC, {h}, {group}) - 1 AS pos
  FROM {name}_gd WHERE r = 1),
{name} AS (
  SELECT {group}, CAST(CASE WHEN pos % {2 * k} < {k} THEN pos % {2 * k} ELSE {2 * k - 1} - pos % {2 * k} END AS INTEGER) AS fold
  FROM {name}_pos)"""
