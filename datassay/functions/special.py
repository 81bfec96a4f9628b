"""Tail probabilities as column expressions: no function of Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients of the log-gamma function (six terms).
LANCZOS = (76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.001208650973866179, -0.000005395239384953)


def log_gamma(x: Column) -> Column:
    series = F.lit(1.000000000190015)
    for i, c in enumerate(LANCZOS):
        series = series + F.lit(c) / (x + (i + 1))
    t = x + 5.5
    return F.log(F.lit(2.5066282746310002) * series / x) - (t - (x + 0.5) * F.log(t))


def _loop(steps: int, state: dict[str, Column], step, result) -> Column:
    """result of a state after `steps` applications of step(state, i)."""
    zero = F.struct(*[v.cast("double").alias(k) for k, v in state.items()])

    def merge(s: Column, i: Column) -> Column:
        new = step({k: s[k] for k in state}, i.cast("double"))
        return F.struct(*[new[k].cast("double").alias(k) for k in state])

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, merge, lambda s: result({k: s[k] for k in state}))


def gamma_upper(a: Column, x: Column, steps: int = 300) -> Column:
    """Regularised upper incomplete gamma Q(a, x): a series below a + 1, else a continued fraction."""
    front = F.exp(-x + a * F.log(x) - log_gamma(a))
    series = _loop(steps, {"t": 1 / a, "s": 1 / a}, lambda s, i: {"t": s["t"] * x / (a + i), "s": s["s"] + s["t"] * x / (a + i)}, lambda s: s["s"])

    def lentz(s: dict, i: Column) -> dict:
        an, b = -i * (i - a), x + 2 * i + 1 - a
        d = 1 / _far(an * s["d"] + b)
        c = _far(b + an / s["c"])
        return {"c": c, "d": d, "h": s["h"] * d * c}

    b0 = x + 1 - a
    fraction = _loop(steps, {"c": F.lit(1e300), "d": 1 / _far(b0), "h": 1 / _far(b0)}, lentz, lambda s: s["h"])
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - front * series).otherwise(front * fraction)


def _far(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-300, F.lit(1e-300)).otherwise(x)


def chi2_tail(chi2: Column, df: Column) -> Column:
    """P(X >= chi2) for df degrees of freedom; null where df <= 0."""
    p = F.when(chi2 <= 0, F.lit(1.0)).otherwise(gamma_upper(df / 2.0, chi2 / 2.0))
    return F.when(df > 0, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def beta_regularised(x: Column, a: Column, b: Column, steps: int = 200) -> Column:
    """Regularised incomplete beta I_x(a, b), by continued fraction on whichever side converges."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def step(s: dict, m: Column) -> dict:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1 / _far(1 + even * s["d"])
            c = _far(1 + even / s["c"])
            h = s["h"] * d * c
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / _far(1 + odd * d)
            c = _far(1 + odd / c)
            return {"c": c, "d": d, "h": h * d * c}

        d0 = 1 / _far(1 - (a + b) * x / (a + 1))
        return _loop(steps, {"c": F.lit(1.0), "d": d0, "h": d0}, step, lambda s: s["h"])

    left = front * fraction(a, b, x) / a
    right = 1 - front * fraction(b, a, 1 - x) / b
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), left).otherwise(right)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation; null under 3 rows, 0 at |r| = 1."""
    df = (n - 2).cast("double")
    t2 = r * r * df / (1 - r * r)
    return F.when(n < 3, F.lit(None)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(beta_regularised(df / (df + t2), df / 2, F.lit(0.5)))


def ks_tail(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p of the two-sample Kolmogorov-Smirnov statistic with Stephens' correction."""
    ne = F.sqrt(n * m / (n + m))
    lam = (ne + 0.12 + 0.11 / ne) * d
    term = lambda k: 2 * F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * k * k * lam * lam)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + term(k.cast("double")))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
