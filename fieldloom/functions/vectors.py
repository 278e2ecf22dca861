"""Column expressions over array<double> vectors: metrics, kernels, scaling and feature maps, by name."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


def vsum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _sum2(f):
    return lambda x, y: vsum(F.zip_with(x, y, f))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def _xlog(x: Column, y: Column) -> Column:
    """x log2(1 + y / x), 0 where x is 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.log2(1 + y / x))


def cumulative(x: Column) -> Column:
    zero = F.struct(F.array().cast("array<double>").alias("v"), F.lit(0.0).alias("s"))
    step = lambda s, e: F.struct(F.concat(s["v"], F.array(s["s"] + e)).alias("v"), (s["s"] + e).alias("s"))
    return F.aggregate(x, zero, step, lambda s: s["v"])


#: Distances between two vectors. CHI2, HELL and JS need values of 0 or more; "chisq" has the factor one half.
METRICS = {
    "linf": lambda x, y: F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b))),
    "l2": _sum2(lambda a, b: (a - b) * (a - b)),
    "l1": _sum2(lambda a, b: F.abs(a - b)),
    "l0": _sum2(lambda a, b: (a != b).cast("double")),
    "chi2": _sum2(lambda a, b: _ratio((a - b) * (a - b), a + b)),
    "hell": _sum2(lambda a, b: (F.sqrt(a) - F.sqrt(b)) * (F.sqrt(a) - F.sqrt(b))),
    "js": _sum2(lambda a, b: a - _xlog(a, b) + b - _xlog(b, a)),
    "euclidean": lambda x, y: F.sqrt(METRICS["l2"](x, y)),
    "sqeuclidean": lambda x, y: METRICS["l2"](x, y),
    "cosine": lambda x, y: 1 - KERNELS["kl2"](x, y) / F.sqrt(KERNELS["kl2"](x, x) * KERNELS["kl2"](y, y)),
    "chisq": lambda x, y: METRICS["chi2"](x, y) / 2,
    "emd": lambda x, y: METRICS["l1"](cumulative(x), cumulative(y)),
    "bounded_chi2": lambda x, y: F.least(F.lit(1.0), METRICS["chi2"](x, y) / 2),
}

KERNELS = {
    "kl2": _sum2(lambda a, b: a * b),
    "kl1": _sum2(lambda a, b: F.least(a, b)),
    "kchi2": _sum2(lambda a, b: _ratio(2 * a * b, a + b)),
    "khell": _sum2(lambda a, b: F.sqrt(a * b)),
    "kjs": _sum2(lambda a, b: (_xlog(a, b) + _xlog(b, a)) / 2),
}


#: Feature groups of a segment table (n, energy), by name; each gives an array.
FEATURES = {
    "size": lambda: F.array(F.col("n") / 500),
    "energy": lambda: F.array(-F.col("energy") / 5000),
}


def assembled(*names: str) -> Column:
    """The named feature groups as one vector, in the order of the names."""
    return F.concat(*(FEATURES[n]() for n in names))


def linear_score(x: Column, w: list[float]) -> Column:
    """w[0] + w[1:] . x"""
    return KERNELS["kl2"](x, F.array(*(F.lit(float(v)) for v in w[1:]))) + F.lit(float(w[0]))


def normalized_l1(x: Column) -> Column:
    """x over its sum; all zeros where that is 0."""
    return F.transform(x, lambda a: _ratio(a, vsum(x)))


def scaled(x: Column, subtract: Column, factor: Column) -> Column:
    """(x - subtract) * factor by element; NaN becomes 0."""
    out = F.zip_with(F.zip_with(x, subtract, lambda a, b: a - b), factor, lambda a, b: a * b)
    return F.transform(out, lambda a: F.when(F.isnan(a) | a.isNull(), 0.0).otherwise(a))


def random_fourier(x: Column, omega: list[list[float]], beta: list[float]) -> Column:
    """sqrt(2) cos(x . omega_j + 2 pi beta_j)"""
    def one(w, b):
        return F.lit(math.sqrt(2)) * F.cos(KERNELS["kl2"](x, F.array(*(F.lit(float(v)) for v in w))) + F.lit(2 * math.pi * b))

    return F.array(*(one(w, b) for w, b in zip(omega, beta)))


def homogeneous_map(x: Column, n: int, step: float, kernel: str) -> Column:
    """Each x >= 0 becomes 2 n + 1 values whose dot products approximate the kernel; 0 becomes zeros."""
    sech = lambda l: 2.0 / (math.exp(math.pi * l) + math.exp(-math.pi * l))
    kappa = {
        "intersection": lambda l: 2 / math.pi / (1 + 4 * l * l),
        "chi2": sech,
        "js": lambda l: 2 / math.log(4) * sech(l) / (1 + 4 * l * l),
    }[kernel]

    def one(v):
        root = F.sqrt(F.lit(step) * v)
        out = [F.lit(math.sqrt(kappa(0.0))) * root]
        for j in range(1, n + 1):
            size, angle = F.lit(math.sqrt(2 * kappa(j * step))) * root, F.lit(j * step) * F.log(v)
            out += [size * F.cos(angle), size * F.sin(angle)]
        return F.when(v > 0, F.array(*out)).otherwise(F.array(*(F.lit(0.0) for _ in out)))

    return F.flatten(F.transform(x, one))


def blockwise(x: Column, dims: list[int], maps: list) -> Column:
    """Split x into blocks of the given sizes, map each by its own function (None: as it is), concatenate."""
    out, at = [], 1
    for d, f in zip(dims, maps):
        block = F.slice(x, at, d)
        out.append(f(block) if f else block)
        at += d
    return F.concat(*out)
