"""Models that train from aggregates alone, and predict as native columns.

``fit`` runs on the driver on matrices of the features' size. ``predict`` returns a Column
of literals and built-in functions.  Categories that training hasn't seen count as absent
(no coefficient, all-zero columns, probability 0).  ``to_params`` and ``from_params`` keep
the flat layouts that the SQL functions exchange.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .triple import NbAgg, Triple, standardised


def _lookup(col: Column, values: list[int], weights) -> Column:
    """The weight of a category, 0 where it isn't known."""
    known = [(k, float(w)) for k, w in zip(values, weights, strict=True) if w != 0]
    if not known:
        return F.lit(0.0)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kw in known for x in kw]), col.cast("int")), F.lit(0.0))


def _linear(intercept: float, weights, num: list[Column], cat: list[Column], categories: list[list[int]]) -> Column:
    out = F.lit(float(intercept))
    for c, w in zip(num, weights, strict=False):
        out = out + F.lit(float(w)) * c.cast("double")
    at = len(num)
    for c, values in zip(cat, categories, strict=True):
        out = out + _lookup(c, values, weights[at : at + len(values)])
        at += len(values)
    return out


def _best(scores: list[Column], labels: list[int], output: str) -> Column:
    """The label (or index) of the largest score, the first of several."""
    found = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-k).alias("k"), F.lit(int(v)).alias("v")) for k, (s, v) in enumerate(zip(scores, labels, strict=True))]))
    return found["v"].cast("int") if output == "label" else (-found["k"]).cast("int")


def _columns(names) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _offsets(categories: list[list[int]]) -> list[float]:
    out = [0]
    for values in categories:
        out.append(out[-1] + len(values))
    return out


def _read_categories(p: list[float], m: int, at: int, n_offsets: int) -> tuple[list[list[int]], int]:
    if not n_offsets:
        return [], at
    offsets = [int(x) for x in p[at : at + n_offsets]]
    at += n_offsets
    values = [int(x) for x in p[at : at + offsets[-1]]]
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], at + offsets[-1]


@dataclass
class LinearRegression:
    label: int
    categories: list[list[int]]
    intercept: float
    weights: np.ndarray  # of the numbers without the label, then of the categories
    means: np.ndarray | None = None
    std: float | None = None
    iterations: int = 0

    @classmethod
    def fit(cls, triple: Triple, label: int, lam: float = 0.0, normalize: bool = False, include_variance: bool = False, solver: str = "exact", learning_rate: float = 0.001, max_iter: int = 10000) -> LinearRegression:
        """label: index among the numbers, from 0. solver: "exact" (least squares of smallest norm) or "bgd"
        (gradient descent with Barzilai-Borwein steps and backtracking)."""
        if not triple.N:
            raise ValueError("no rows")
        sigma = triple.sigma()
        n, y = triple.N, label + 1
        work, mean, std = standardised(sigma) if normalize else (sigma, np.zeros(len(sigma)), np.ones(len(sigma)))
        work = work.copy()
        if normalize:
            work[0, 0] = n
        others = [i for i in range(len(sigma)) if i != y]
        a, b = work[np.ix_(others, others)] / n, work[others, y] / n
        ridge = np.full(len(others), lam)
        ridge[0] = 0
        if solver == "exact":
            scale = np.sqrt(np.maximum(np.diag(a) + ridge, 0))
            scale[scale == 0] = 1
            theta, k = np.linalg.lstsq((a + np.diag(ridge)) / np.outer(scale, scale), b / scale, rcond=1e-13)[0] / scale, 0
        else:
            theta, k = _descend(a, b, ridge, learning_rate, max_iter)
        full = np.zeros(len(sigma))
        full[others], full[y] = theta, -1
        variance = float(full @ work @ full / n) if include_variance else None
        weights = theta[1:] / std[others][1:] * std[y]
        means = mean[others][1:] if normalize else None
        intercept = theta[0] * std[y] + mean[y] if normalize else theta[0]
        return cls(label, triple.categories(), float(intercept), weights, means, None if variance is None else math.sqrt(max(0.0, variance)) * float(std[y]), k)

    def predict(self, num, cat=(), noise: Column | None = None) -> Column:
        """num: the numbers without the label. noise: standard normal draws, scaled by the residual deviation."""
        shift = 0.0 if self.means is None else float(self.weights @ self.means)
        out = _linear(self.intercept - shift, self.weights, _columns(num), _columns(cat), self.categories)
        if noise is not None:
            if self.std is None:
                raise ValueError("trained without variance")
            out = out + noise * F.lit(self.std)
        return out

    def to_params(self) -> list[float]:
        m = len(self.categories)
        out: list[float] = [m]
        if m:
            out += [*_offsets(self.categories), *[k for c in self.categories for k in c]]
        out += [self.intercept, *self.weights]
        return [float(x) for x in [*out, *([] if self.means is None else self.means), *([] if self.std is None else [self.std])]]

    @classmethod
    def from_params(cls, p: list[float], n_num: int, normalize: bool, has_variance: bool) -> LinearRegression:
        """n_num: numbers without the label."""
        m = int(p[0])
        categories, at = _read_categories(p, m, 1, m + 1 if m else 0)
        w = n_num + sum(map(len, categories))
        weights = np.array(p[at + 1 : at + 1 + w])
        means = np.array(p[at + 1 + w : at + 1 + 2 * w]) if normalize else None
        return cls(-1, categories, p[at], weights, means, p[-1] if has_variance else None)


def _descend(a: np.ndarray, b: np.ndarray, ridge: np.ndarray, step: float, max_iter: int) -> tuple[np.ndarray, int]:
    """Minimises theta a theta / 2 - b theta + ridge theta**2 / 2."""
    loss = lambda t: t @ a @ t / 2 - b @ t + ridge @ t**2 / 2
    slope = lambda t: a @ t - b + ridge * t
    theta = np.zeros(len(b))
    g = slope(theta)
    start = np.linalg.norm(g)
    for k in range(1, max_iter + 1):
        for _ in range(500):
            new = theta - step * g
            if loss(new) <= loss(theta) - step / 2 * (g @ g):
                break
            step /= 2
        move, gn = new - theta, slope(new)
        change = gn - g
        theta, g = new, gn
        if np.linalg.norm(move) < 1e-20 or np.linalg.norm(g) / (start + 0.001) < 1e-8:
            break
        curve = move @ change
        step = (move @ move) / curve if curve > 0 else step * 2
    return theta, k


@dataclass
class LDA:
    labels: list[int]
    categories: list[list[int]]
    weights: np.ndarray  # classes x features
    intercepts: np.ndarray
    means: np.ndarray | None = None

    @classmethod
    def fit(cls, triple: Triple, label: int, shrinkage: float = 0.0, normalize: bool = False) -> LDA:
        """label: index among the categorical columns, from 0."""
        if not triple.N:
            raise ValueError("no rows")
        n = triple.N
        values, counts, sums = triple.class_sums(label)
        sigma = triple.sigma(without=label)
        mean, std = np.zeros(len(sigma)), np.ones(len(sigma))
        if normalize:
            _, mean, std = standardised(sigma)
            sums = (sums - counts[:, None] * mean) / std
            sigma = (sigma - n * np.outer(mean, mean)) / np.outer(std, std)
        within = (sigma - (sums / counts[:, None]).T @ sums)[1:, 1:]
        p = len(within)
        within = ((1 - shrinkage) * within + shrinkage * np.trace(within) / max(p, 1) * np.eye(p)) / n
        centres = sums[:, 1:] / counts[:, None]
        w = np.linalg.lstsq(within, centres.T, rcond=-1)[0].T
        b = -0.5 * np.einsum("kp,kp->k", centres, w) + np.log(counts / n)
        categories = [c for k, c in enumerate(triple.categories()) if k != label]
        return cls(values, categories, w / std[1:], b, mean[1:] if normalize else None)

    def predict(self, num, cat=(), output: str = "label") -> Column:
        """output: "label" or "index"."""
        num, cat = _columns(num), _columns(cat)
        shift = np.zeros(len(self.labels)) if self.means is None else self.weights @ self.means
        scores = [_linear(b - s, w, num, cat, self.categories) for w, b, s in zip(self.weights, self.intercepts, shift, strict=True)]
        return _best(scores, self.labels, output)

    def to_params(self) -> list[float]:
        m = len(self.categories)  # without the label's
        offsets = _offsets(self.categories) if m else []
        out = [len(self.labels), len(offsets), *offsets, *[k for c in self.categories for k in c], *self.labels, *self.weights.ravel(), *self.intercepts]
        return [float(x) for x in [*out, *([] if self.means is None else self.means)]]

    @classmethod
    def from_params(cls, p: list[float], normalize: bool, n_num: int) -> LDA:
        k = int(p[0])
        categories, at = _read_categories(p, 0, 2, int(p[1]))
        width = n_num + sum(map(len, categories))
        labels = [int(x) for x in p[at : at + k]]
        at += k
        weights = np.array(p[at : at + k * width]).reshape(k, width)
        at += k * width
        return cls(labels, categories, weights, np.array(p[at : at + k]), np.array(p[at + k : at + k + width]) if normalize else None)


@dataclass
class QDA:
    labels: list[int]
    categories: list[list[int]]
    quad: list[np.ndarray]
    lin: list[np.ndarray]
    intercepts: list[float]
    means: np.ndarray | None = None

    @classmethod
    def fit(cls, triples: list[Triple], labels: list[int], normalize: bool = False) -> QDA:
        """A triple for each class; each categorical column's smallest category is left out."""
        m = len(triples[0].lin_cat)
        categories = [sorted(set().union(*[t.lin_cat[c] for t in triples])) for c in range(m)]
        sigmas = [t.sigma(categories=categories, drop_first=True) for t in triples]
        total = sum(t.N for t in triples)
        mean, std = np.zeros(len(sigmas[0])), np.ones(len(sigmas[0]))
        if normalize:
            _, mean, std = standardised(sum(sigmas))
        out = cls(list(labels), categories, [], [], [], mean[1:] if normalize else None)
        for t, s in zip(triples, sigmas, strict=True):
            mu = s[0] / t.N
            cov = ((s / t.N - np.outer(mu, mu)) / np.outer(std, std))[1:, 1:]
            centre = ((mu - mean) / std)[1:]
            u, d, v = np.linalg.svd(cov)
            good = d > 1e-9
            inverse = (v.T[:, good] / d[good]) @ u.T[good] if good.any() else np.zeros_like(cov)
            lin = inverse @ centre
            out.quad.append(-0.5 * inverse / np.outer(std[1:], std[1:]))
            out.lin.append(lin / std[1:])
            out.intercepts.append(float(-0.5 * centre @ lin - 0.5 * np.log(d[good]).sum() + math.log(t.N / total)))
        return out

    def predict(self, num, cat=()) -> Column:
        num, cat = _columns(num), _columns(cat)
        x = [c.cast("double") for c in num] + [
            F.coalesce((c.cast("int") == F.lit(int(k))).cast("double"), F.lit(0.0)) for c, values in zip(cat, self.categories, strict=True) for k in values[1:]
        ]
        if self.means is not None:
            x = [v - F.lit(float(m)) for v, m in zip(x, self.means, strict=True)]
        scores = []
        for q, w, b in zip(self.quad, self.lin, self.intercepts, strict=True):
            s = F.lit(b)
            for i, v in enumerate(x):
                inner = F.lit(float(w[i])) + F.lit(float(q[i, i])) * v
                for j in range(i + 1, len(x)):
                    inner = inner + F.lit(float(q[i, j] + q[j, i])) * x[j]
                s = s + v * inner
            scores.append(s)
        return _best(scores, self.labels, "label")

    def to_params(self) -> list[float]:
        offsets = _offsets(self.categories) if self.categories else []
        out = [len(self.labels), len(offsets), *offsets, *[k for c in self.categories for k in c], *self.labels]
        for q, w, b in zip(self.quad, self.lin, self.intercepts, strict=True):
            out += [*q.ravel(), *w, b]
        return [float(x) for x in [*out, *([] if self.means is None else self.means)]]

    @classmethod
    def from_params(cls, p: list[float], normalize: bool, n_num: int) -> QDA:
        k = int(p[0])
        categories, at = _read_categories(p, 0, 2, int(p[1]))
        width = n_num + sum(len(c) - 1 for c in categories)
        out = cls([int(x) for x in p[at : at + k]], categories, [], [], [])
        at += k
        for _ in range(k):
            out.quad.append(np.array(p[at : at + width * width]).reshape(width, width))
            out.lin.append(np.array(p[at + width * width : at + width * width + width]))
            out.intercepts.append(p[at + width * width + width])
            at += width * width + width + 1
        if normalize:
            out.means = np.array(p[at : at + width])
        return out


@dataclass
class NaiveBayes:
    labels: list[int]
    categories: list[list[int]]
    priors: list[float]
    numbers: list[list[tuple[float, float]]]  # (mean, variance) by class and number
    shares: list[list[dict[int, float]]]  # by class and categorical column

    @classmethod
    def fit(cls, aggs: list[NbAgg], labels: list[int]) -> NaiveBayes:
        total = sum(a.N for a in aggs)
        m = len(aggs[0].lin_cat)
        categories = [sorted(set().union(*[a.lin_cat[c] for a in aggs])) for c in range(m)]
        numbers = [[(s / a.N, max(0.0, q / a.N - (s / a.N) ** 2)) for s, q in zip(a.lin, a.quad, strict=True)] for a in aggs]
        return cls(list(labels), categories, [a.N / total for a in aggs], numbers, [[{k: v / a.N for k, v in c.items()} for c in a.lin_cat] for a in aggs])

    def predict(self, num, cat=()) -> Column:
        """In logarithms; where every class has probability 0 the first label."""
        num, cat = _columns(num), _columns(cat)
        scores = []
        for prior, numbers, shares in zip(self.priors, self.numbers, self.shares, strict=True):
            s = F.lit(math.log(prior))
            for c, (mean, var) in zip(num, numbers, strict=True):
                v = var + 1e-9
                d = c.cast("double") - F.lit(mean)
                s = s - d * d / F.lit(2 * v) - F.lit(0.5 * math.log(2 * math.pi * v))
            for c, known in zip(cat, shares, strict=True):
                logs = [F.lit(x) for k, f in known.items() if f > 0 for x in (int(k), math.log(f))]
                s = s + (F.coalesce(F.element_at(F.create_map(*logs), c.cast("int")), F.lit(float("-inf"))) if logs else F.lit(float("-inf")))
            scores.append(s)
        return _best(scores, self.labels, "label")

    def to_params(self) -> list[float]:
        offsets = _offsets(self.categories) if self.categories else []
        out = [len(self.labels), len(offsets), *offsets, *[k for c in self.categories for k in c], *self.labels, *self.priors]
        for numbers, shares in zip(self.numbers, self.shares, strict=True):
            out += [x for pair in numbers for x in pair] + [s.get(k, 0.0) for values, s in zip(self.categories, shares, strict=True) for k in values]
        return [float(x) for x in out]

    @classmethod
    def from_params(cls, p: list[float], n_num: int) -> NaiveBayes:
        k = int(p[0])
        categories, at = _read_categories(p, 0, 2, int(p[1]))
        out = cls([int(x) for x in p[at : at + k]], categories, list(p[at + k : at + 2 * k]), [], [])
        at += 2 * k
        for _ in range(k):
            out.numbers.append([(p[at + 2 * i], p[at + 2 * i + 1]) for i in range(n_num)])
            at += 2 * n_num
            shares = []
            for values in categories:
                shares.append({v: f for v, f in zip(values, p[at : at + len(values)], strict=True) if f > 0})
                at += len(values)
            out.shares.append(shares)
        return out
