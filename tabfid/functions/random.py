"""Counter-based random numbers and normal-distribution helpers in numpy.

Randomness is a pure function of (seed, row id, stream), so a generated row never
depends on how rows are split into partitions or on task retries.
"""

from __future__ import annotations

import numpy as np

# fixed constants of the public splitmix64 mixer
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


def uniforms(ids: np.ndarray, n_streams: int, seed: int) -> np.ndarray:
    """(len(ids), n_streams) uniforms in (0, 1), one independent stream per column."""
    with np.errstate(over="ignore"):
        base = splitmix64(np.asarray(ids, dtype=np.uint64) ^ splitmix64(np.array([seed], dtype=np.uint64)))
        cols = [splitmix64(base + np.uint64(j + 1) * _GOLDEN) for j in range(n_streams)]
    h = np.stack(cols, axis=1) >> np.uint64(11)
    return (h.astype(np.float64) + 0.5) * (1.0 / 9007199254740992.0)


def normals(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
    """(len(ids), k) standard normals by Box-Muller on per-row uniform streams."""
    m = (k + 1) // 2
    u = uniforms(ids, 2 * m, seed)
    r = np.sqrt(-2.0 * np.log(u[:, :m]))
    t = 2.0 * np.pi * u[:, m:]
    z = np.concatenate([r * np.cos(t), r * np.sin(t)], axis=1)
    return z[:, :k]


def norm_cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal CDF via a Chebyshev erfc approximation (fractional error < 1.2e-7)."""
    z = np.abs(x) / np.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = (-z * z - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (
        -0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (
            -0.82215223 + t * 0.17087277)))))))))
    erfc = t * np.exp(poly)
    return np.where(x >= 0, 1.0 - 0.5 * erfc, 0.5 * erfc)


# fixed coefficients of Acklam's rational approximation of the normal quantile
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
_P_LOW = 0.02425


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile (relative error about 1e-9)."""
    p = np.clip(np.asarray(p, dtype=np.float64), 1e-15, 1 - 1e-15)
    out = np.empty_like(p)
    lo, hi = p < _P_LOW, p > 1 - _P_LOW
    mid = ~(lo | hi)
    q = p[mid] - 0.5
    r = q * q
    out[mid] = ((((((_A[0] * r + _A[1]) * r + _A[2]) * r + _A[3]) * r + _A[4]) * r + _A[5]) * q /
                (((((_B[0] * r + _B[1]) * r + _B[2]) * r + _B[3]) * r + _B[4]) * r + 1))
    for mask, sign, pp in ((lo, 1.0, p[lo]), (hi, -1.0, 1 - p[hi])):
        q = np.sqrt(-2 * np.log(pp))
        out[mask] = sign * ((((((_C[0] * q + _C[1]) * q + _C[2]) * q + _C[3]) * q + _C[4]) * q + _C[5]) /
                            ((((_D[0] * q + _D[1]) * q + _D[2]) * q + _D[3]) * q + 1))
    return out
