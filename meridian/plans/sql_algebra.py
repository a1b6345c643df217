"""Dense algebra as common table expressions of DuckDB SQL, for the queries whose oracle needs a matrix solved."""

from __future__ import annotations


def gauss(name: str, n: int) -> str:
    """Recursive CTE ``name`` (key, k, i, row): Gauss-Jordan elimination of ``{name}_in`` (key, i, row); solved where k = n.

    A row holds n columns of a positive definite matrix, then any others.
    """
    return f"""{name} as (select key, 0 as k, i, row from {name}_in union all
  select a.key, a.k + 1, a.i, case when a.i = a.k + 1 then list_transform(a.row, lambda v: v / a.row[a.k + 1])
    else list_transform(list_zip(a.row, p.row), lambda z: z[1] - z[2] * (a.row[a.k + 1] / p.row[a.k + 1])) end
  from {name} a join {name} p on p.key = a.key and p.i = a.k + 1 where a.k < {n})"""


def columns_of(name: str, source: str, n: int, low: int, high: int) -> str:
    """CTE ``name`` (key, j, col): columns low to high, from 1, of the solved rows of ``source``, numbered from 1."""
    return f"{name} as (select key, j - {low - 1} as j, list(row[j] order by i) as col from {source}, range({low}, {high + 1}) t(j) where k = {n} group by key, j)"


def augmented(name: str, rows: str, a: str, b: str, n: int, m: int, alphas: str, identity: bool = False) -> str:
    """CTE ``{name}_in`` (key, i, row): the normal equations [AᵀA + alpha I | AᵀB (| I)] of a table's vectors a (n) and b (m), for each (key, alpha)."""
    more = f" union all select key, i, n, (i = n - {n + m})::INT::DOUBLE from {alphas}, range(1, {n + 1}) r(i), range({n + m + 1}, {2 * n + m + 1}) s(n)" if identity else ""
    return f"""{name}_left as (select i, j, sum({a}[i] * {a}[j]) as v from {rows}, range(1, {n + 1}) r(i), range(1, {n + 1}) s(j) group by i, j),
{name}_right as (select i, j + {n} as j, sum({a}[i] * {b}[j]) as v from {rows}, range(1, {n + 1}) r(i), range(1, {m + 1}) s(j) group by i, j),
{name}_in as (select key, i, list(v order by j) as row from (
  select key, i, j, v + case when i = j then alpha else 0 end as v from {name}_left, {alphas}
  union all select key, i, j, v from {name}_right, {alphas}{more}) group by key, i)"""


def polar(name: str, rows: str, a: str, b: str, n: int, steps: int = 60) -> str:
    """CTEs that end in ``{name}_w`` (key, j, col): the columns of the orthogonal factor of AᵀB, by Newton and Schulz's iteration."""
    return f"""{name}_cell as (select i, j, sum({a}[i] * {b}[j]) as v from {rows}, range(1, {n + 1}) r(i), range(1, {n + 1}) s(j) group by i, j),
{name}_row as (select i, list(v / (select sqrt(sum(v * v)) from {name}_cell) order by j) as row from {name}_cell group by i),
{name} as (select 0 as step, list(row order by i) as m from {name}_row union all
  select step + 1, list_transform(m, lambda r: list_transform(list_zip(r, list_transform(s, lambda c: list_dot_product(r, c))), lambda z: 1.5 * z[1] - 0.5 * z[2])) from (
    select step, m, list_transform(t, lambda c: list_transform(t, lambda d: list_dot_product(c, d))) as s from (
      select step, m, list_transform(range(1, {n + 1}), lambda j: list_transform(m, lambda r: r[j])) as t from {name} where step < {steps}))),
{name}_w as (select 0 as key, j, list_transform(m, lambda r: r[j]) as col from {name}, range(1, {n + 1}) t(j) where step = {steps})"""
