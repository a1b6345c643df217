"""Vector expressions over ``ARRAY<DOUBLE>`` columns, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def doubles(v: Column | str) -> Column:
    """Cast before any product: float32 dots drift from 1 on unit vectors."""
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: a lambda that names an outer expression computes it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def l2_normalize(v: Column) -> Column:
    """Divide by max(norm, 1e-12): a zero vector stays zero."""
    return let(v, lambda w: let(F.greatest(norm(w), F.lit(TINY)), lambda n: F.transform(w, lambda x: x / n)))


def l2_normalize_or_keep(v: Column) -> Column:
    """The one-vector form: unchanged below a norm of 1e-12."""
    n = norm(v)
    return F.when(n < TINY, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Clipped to [-1, 1]; 0 where a norm is below 1e-12; null where the sizes differ."""

    def of(s: Column) -> Column:
        na, nb = norm(s["a"]), norm(s["b"])
        value = F.when((na < TINY) | (nb < TINY), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(s["a"], s["b"]) / (na * nb))))
        return F.when(F.size(s["a"]) == F.size(s["b"]), value)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def cosine_unclipped(a: Column, b: Column) -> Column:
    """0 only for an exactly zero norm, no clipping."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """0 where the sizes differ."""
    return F.when(F.size(a) == F.size(b), cosine_unclipped(a, b)).otherwise(F.lit(0.0))


def cosine_prefix(a: Column, b: Column) -> Column:
    """Cosine over the common prefix of two vectors."""
    n = F.least(F.size(a), F.size(b))
    return cosine_unclipped(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def checked(v: Column, dims: int, what: str = "vector") -> Column:
    """The vector, or an error at run time if its size or a value is wrong: arrays carry no length."""
    wrong = F.when(F.size(v) != dims, F.raise_error(F.format_string(f"{what} has %d dimensions, not {dims}", F.size(v)))).when(~is_finite(v), F.raise_error(F.lit(f"{what} has values that aren't finite")))
    return F.coalesce(wrong.cast("array<double>"), v)


def with_bias(v: Column) -> Column:
    return F.concat(v, F.array(F.lit(1.0)))


#: Breakpoints that are written out as cases; more of them are searched.
MOST_CASES = 64


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear between breakpoints in their order, constant outside; of equal breakpoints the last counts from the right."""
    if not xs or len(xs) != len(ys):
        raise ValueError("as many values as breakpoints, and one at least")
    if len(xs) > MOST_CASES:
        return F.when(x.isNotNull(), _searched(xs, ys)(x.cast("double")))
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        if x1 > x0:
            out = out.when(x < x1, F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(ys[-1]))))


def _searched(xs: list[float], ys: list[float]):
    """The same by binary search, in Arrow batches."""
    a, b = np.asarray(xs, float), np.asarray(ys, float)

    def run(v: pd.Series) -> pd.Series:
        at = v.to_numpy(float)
        high = np.searchsorted(a, at, side="right")
        inside = np.flatnonzero((at > a[0]) & (high < a.size))
        out = np.where(at <= a[0], b[0], b[-1])
        h = high[inside]
        out[inside] = b[h - 1] + (at[inside] - a[h - 1]) * ((b[h] - b[h - 1]) / (a[h] - a[h - 1]))
        return pd.Series(out)

    return F.pandas_udf(run, "double")
