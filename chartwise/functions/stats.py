"""Column expressions for probabilistic losses and scores (all JVM-side).

Each function takes and returns Columns, so they fuse into whole-stage
codegen with the surrounding projection; the same formulas appear in
the oracle SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_SQRT_2PI = math.log(math.sqrt(2 * math.pi))
LOG_2PI = math.log(2 * math.pi)

# Abramowitz & Stegun 7.1.26 rational approximation of erf
# (absolute error at most 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def bce_with_logits(z: Column, y: Column) -> Column:
    """Numerically safe binary cross-entropy on a logit, one row."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def gaussian_nll(x: Column, mu: Column, logvar: Column) -> Column:
    """log √(2π) + lv/2 + (x − μ)² / (2·e^lv)."""
    return F.lit(LOG_SQRT_2PI) + logvar / 2 + F.pow(x - mu, 2) / (F.lit(2.0) * F.exp(logvar))


def obs_loss_logvar(x: Column, mu: Column, logvar: Column, constant: bool = True) -> Column:
    """0.5·((x − μ)²/e^lv + lv [+ log 2π]) before the update."""
    core = F.pow(x - mu, 2) / F.exp(logvar) + logvar
    return F.lit(0.5) * (core + F.lit(LOG_2PI) if constant else core)


def obs_loss_var(x: Column, mu: Column, v: Column, eps: float = 1e-6) -> Column:
    """0.5·((x − μ)²/var + log var) with var = |v| + eps."""
    var = F.abs(v) + F.lit(eps)
    return F.lit(0.5) * (F.pow(x - mu, 2) / var + F.log(var))


def gaussian_kl(mu1: Column, sigma1: Column, mu2: Column, sigma2: float = 0.01) -> Column:
    """KL(N(μ1, σ1) ‖ N(μ2, σ2)) for a fixed observation noise σ2."""
    s2 = F.lit(float(sigma2))
    return F.log(s2) - F.log(sigma1) + (F.pow(sigma1, 2) + F.pow(mu1 - mu2, 2)) / (F.lit(2.0) * s2 * s2) - F.lit(0.5)


def sigma_from_logvar(logvar: Column) -> Column:
    return F.exp(F.lit(0.5) * logvar)


def sigma_from_var(v: Column, eps: float = 1e-5) -> Column:
    return F.sqrt(F.abs(v) + F.lit(eps))


def erf(x: Column) -> Column:
    """erf via A&S 7.1.26, odd extension for negative arguments."""
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * ax)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    y = F.lit(1.0) - poly * F.exp(-ax * ax)
    return F.signum(x) * y


def gaussian_upper_tail(x: Column, mu: Column, logvar: Column) -> Column:
    """P(X > x) for X ~ N(μ, e^lv): ½ − ½·erf((x − μ)/(e^{lv/2}·√2))."""
    return F.lit(0.5) - F.lit(0.5) * erf((x - mu) / (F.exp(F.lit(0.5) * logvar) * F.lit(math.sqrt(2.0))))


def erf_sql(x: str) -> str:
    """The same approximation as SQL text (for the oracle)."""
    t = f"(1.0 / (1.0 + {ERF_P} * abs({x})))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly}) + {a}) * {t}"
    return f"(sign({x}) * (1.0 - ({poly}) * exp(-abs({x}) * abs({x}))))"
