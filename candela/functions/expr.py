"""Column-expression helpers shared by all operators.

They keep every computation inside Catalyst expressions (whole-stage codegen
where Spark supports it): no Python UDFs.  Rules:

* ``fdiv``: float division with IEEE results instead of an ANSI error:
  x/0 is +inf or -inf by the sign of x, 0/0 is null (NaN never enters a frame).
* ``rolling``: a frame aggregate that is null until the frame holds ``n``
  non-null values, as a fixed-size rolling window does.
* ``ema``: exponentially weighted mean with y0 = x0 and
  y = a*x + (1-a)*y_prev, a = 2/(span+1), evaluated as a fold over the last
  K values of a bounded frame; K is chosen so the dropped tail weighs < 1e-16.
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def series_window(key: str | list[str] = "Ticker", order: str | list[str] = "Date") -> WindowSpec:
    """Window of one price series: partitioned by ticker, ordered by time."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*orders)


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(~F.isnan(c), c)


def fdiv(a, b) -> Column:
    """a / b with +-inf for x/0 and null for 0/0 or NaN results."""
    a, b = col_(a), col_(b)
    q = a / b
    return (F.when(b == 0, F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)))
            .otherwise(F.when(~F.isnan(q), q)))


def pct_change(c, prev) -> Column:
    """c / prev - 1 (pandas ``pct_change``), IEEE-safe."""
    return fdiv(c, prev) - F.lit(1.0)


def rolling(fn: Callable[[Column], Column], c, n: int, w: WindowSpec, shift: int = 0) -> Column:
    """``fn`` over the n rows ending ``shift`` rows before the current one.

    Null unless all n rows exist and are non-null (fixed-size window rule).
    """
    c = col_(c)
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    return F.when(F.count(c).over(frame) == n, fn(c).over(frame))


def rolling_mean(c, n: int, w: WindowSpec, shift: int = 0) -> Column:
    return rolling(F.avg, c, n, w, shift)


def rolling_std(c, n: int, w: WindowSpec, shift: int = 0) -> Column:
    return rolling(F.stddev_samp, c, n, w, shift)


def rolling_sum(c, n: int, w: WindowSpec, shift: int = 0) -> Column:
    return rolling(F.sum, c, n, w, shift)


shifted_rolling = rolling


def sorted_frame(c, n: int, w: WindowSpec) -> Column:
    """The last n values in ascending order (shorter at the start of a series)."""
    return F.array_sort(F.collect_list(col_(c)).over(w.rowsBetween(-(n - 1), 0)))


def quantile_of_sorted(arr, n: int, p: float) -> Column:
    """Quantile p (linear interpolation, lo + (hi - lo) * frac) of a sorted
    array column; null unless the array holds exactly n values."""
    arr = col_(arr)
    pos = p * (n - 1)
    lo = int(math.floor(pos))
    frac = pos - lo
    lo_v = F.element_at(arr, lo + 1)
    v = lo_v if frac == 0 else lo_v + (F.element_at(arr, lo + 2) - lo_v) * F.lit(frac)
    return F.when(F.size(arr) == n, v)


def ema_lookback(span: int, tol: float = 1e-16) -> int:
    """Frame length K so that (1-a)^K < tol, a = 2/(span+1)."""
    alpha = 2.0 / (span + 1.0)
    return int(math.ceil(math.log(tol) / math.log(1.0 - alpha)))


def ema(c, span: int, w: WindowSpec) -> Column:
    """Exponentially weighted mean (no bias adjustment) over a bounded frame."""
    alpha = 2.0 / (span + 1.0)
    k = ema_lookback(span)
    values = F.collect_list(col_(c)).over(w.rowsBetween(-k, 0))
    return F.aggregate(
        values,
        F.lit(None).cast("double"),
        lambda acc, v: F.when(acc.isNull(), v).otherwise(F.lit(alpha) * v + F.lit(1.0 - alpha) * acc),
    )


def clamp(x, lo, hi) -> Column:
    x = col_(x)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(x, lo), hi)


# Coefficients of the published rational approximation of the
# inverse standard normal CDF (P. J. Acklam, 2003), relative error < 1.15e-9.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00]
_P_LOW = 0.02425


def _horner(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def inv_normal(p) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1."""
    p = col_(p)
    q_low = F.sqrt(F.lit(-2.0) * F.log(p))
    q_high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    q = p - F.lit(0.5)
    r = q * q
    low = _horner(_C, q_low) / (_horner(_D, q_low) * q_low + F.lit(1.0))
    high = -_horner(_C, q_high) / (_horner(_D, q_high) * q_high + F.lit(1.0))
    central = _horner(_A, r) * q / (_horner(_B, r) * r + F.lit(1.0))
    return (F.when(p < _P_LOW, low)
            .when(p > 1 - _P_LOW, high)
            .otherwise(central))
