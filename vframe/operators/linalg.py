"""Small dense numerics on the driver: PCA, LDA, distribution fits. Inputs are aggregates or bounded samples."""

from __future__ import annotations

import math

import numpy as np


def _signed(weights: np.ndarray) -> np.ndarray:
    """Rows flipped so that the largest weight of each is positive."""
    top = weights[np.arange(len(weights)), np.abs(weights).argmax(1)]
    return weights * np.where(top < 0, -1.0, 1.0)[:, None]


def pca(n: int, mean: np.ndarray, cov: np.ndarray, k: int, standardize: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights on raw columns, biases and explained shares from population covariances."""
    sample = cov * n / max(1, n - 1)
    scale = np.sqrt(np.diag(sample)) if standardize else np.ones(len(mean))
    scale = np.where(scale == 0, 1.0, scale)
    values, vectors = np.linalg.eigh(sample / np.outer(scale, scale))
    order = values.argsort()[::-1][:k]
    parts = _signed(vectors[:, order].T)
    weights = parts / scale
    return weights, -(weights @ mean), np.maximum(values[order], 0) / max(values.sum(), 1e-300)


def lda(classes: list[tuple[int, np.ndarray, np.ndarray]], k: int, standardize: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discriminants from each class's count, mean and population covariance."""
    counts = np.array([c[0] for c in classes], float)
    means = np.array([c[1] for c in classes])
    n, total = counts.sum(), (counts[:, None] * means).sum(0) / counts.sum()
    within = sum(c[0] * c[2] for c in classes)
    scale = np.ones(len(total))
    if standardize:
        spread = within + sum(c * np.outer(m - total, m - total) for c, m in zip(counts, means, strict=True))
        scale = np.sqrt(np.diag(spread) / max(1, n - 1))
        scale = np.where(scale == 0, 1.0, scale)
    within, centred = within / np.outer(scale, scale), (means - total) / scale
    std = np.sqrt(np.diag(within) / n)
    std = np.where(std == 0, 1.0, std)
    values, vectors = np.linalg.eigh(within / np.outer(std, std) / max(1, n - len(classes)))
    sound = np.sqrt(np.maximum(values, 0)) > 1e-4
    whiten = (vectors[:, sound] / std[:, None]) / np.sqrt(values[sound])
    between = np.sqrt(counts / max(1, len(classes) - 1))[:, None] * centred @ whiten
    _, s, right = np.linalg.svd(between, full_matrices=False)
    parts = _signed((whiten @ right.T).T[:k])
    weights = parts / scale
    return weights, -(weights @ total), (s**2 / max((s**2).sum(), 1e-300))[:k]


# Distributions: parameters end in location and scale; each has a fit and a distribution function.


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, else a continued fraction."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - front * h)


def chi2_sf(x: float, dof: int) -> float:
    return 1 - gamma_p(dof / 2, x / 2)


def _digamma(x: float) -> float:
    shift = 0.0
    while x < 6:
        shift -= 1 / x
        x += 1
    f = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


CANDIDATES = ("normal", "uniform", "exponential", "lognormal", "gamma")
PARAMETERS = {"normal": ("loc", "scale"), "uniform": ("loc", "scale"), "exponential": ("loc", "scale"), "lognormal": ("s", "loc", "scale"), "gamma": ("a", "loc", "scale")}


def fit_distribution(name: str, stats: dict) -> tuple[float, ...]:
    """Maximum-likelihood parameters from count-free statistics: mean, std (population), min, max, log_mean, log_std.

    The location of lognormal and gamma is held at zero, where their likelihood is bounded."""
    mean, low, high = stats["mean"], stats["min"], stats["max"]
    match name:
        case "normal":
            return mean, stats["std"]
        case "uniform":
            return low, high - low
        case "exponential":
            return low, mean - low
        case "lognormal":
            return stats["log_std"], 0.0, math.exp(stats["log_mean"])
        case "gamma":
            gap = math.log(mean) - stats["log_mean"]
            a = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
            for _ in range(50):
                slope = (_digamma(a * 1.00001) - _digamma(a)) / (a * 0.00001)
                step = (math.log(a) - _digamma(a) - gap) / (1 / a - slope)
                a = a - step if a > step else a / 2
                if abs(step) < 1e-12 * a:
                    break
            return a, 0.0, mean / a
    raise ValueError(name)


def cdf(name: str, x: float, params: tuple[float, ...]) -> float:
    *shape, loc, scale = params
    if scale <= 0:
        raise ValueError("the values don't vary")
    z = (x - loc) / scale
    match name:
        case "normal":
            return normal_cdf(z)
        case "uniform":
            return min(1.0, max(0.0, z))
        case "exponential":
            return 1 - math.exp(-z) if z > 0 else 0.0
        case "lognormal":
            return normal_cdf(math.log(z) / shape[0]) if z > 0 else 0.0
        case "gamma":
            return gamma_p(shape[0], z)
    raise ValueError(name)


def sample_of(name: str, params: tuple[float, ...], n: int, rng: np.random.Generator) -> np.ndarray:
    *shape, loc, scale = params
    draw = {
        "normal": lambda: rng.standard_normal(n), "uniform": lambda: rng.random(n), "exponential": lambda: rng.standard_exponential(n),
        "lognormal": lambda: np.exp(shape[0] * rng.standard_normal(n)), "gamma": lambda: rng.standard_gamma(shape[0], n),
    }
    return loc + scale * draw[name]()


def stats_of(x: np.ndarray) -> dict:
    logs = np.log(x) if x.min() > 0 else np.array([np.nan])
    return {"mean": float(x.mean()), "std": float(x.std()), "min": float(x.min()), "max": float(x.max()), "log_mean": float(logs.mean()), "log_std": float(logs.std())}


def ks(name: str, x: np.ndarray, params: tuple[float, ...]) -> float:
    """The largest gap between the empirical distribution and the fitted one."""
    x = np.sort(x)
    f = np.array([cdf(name, float(v), params) for v in x])
    at = np.arange(len(x) + 1) / len(x)
    return float(max((at[1:] - f).max(), (f - at[:-1]).max()))
