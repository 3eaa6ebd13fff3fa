"""Aggregates as values on the driver: ring algebra and the matrices that models train on."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..types import pairs


def _merged(a: dict, b: dict, sign: int = 1) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, 0.0) + sign * v
    return {k: out[k] for k in sorted(out) if out[k] != 0} if sign < 0 else {k: out[k] for k in sorted(out)}


def _ring(a, b, sign: int):
    """Element by element; a value without rows is neutral whatever its shape."""
    if not a.N and not a.lin.size and not a.lin_cat:
        a = type(a).zero(len(b.lin), len(b.lin_cat))
    if not b.N and not b.lin.size and not b.lin_cat:
        b = type(b).zero(len(a.lin), len(a.lin_cat))
    if len(a.lin) != len(b.lin) or len(a.lin_cat) != len(b.lin_cat):
        raise ValueError("the columns differ")
    return a, b


@dataclass
class NbAgg:
    N: int = 0
    lin: np.ndarray = field(default_factory=lambda: np.zeros(0))
    quad: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lin_cat: list[dict] = field(default_factory=list)

    @classmethod
    def zero(cls, n: int, m: int) -> NbAgg:
        return cls(0, np.zeros(n), np.zeros(n), [{} for _ in range(m)])

    @classmethod
    def from_row(cls, row) -> NbAgg:
        n, lin, quad, lin_cat = row[:4]
        return cls(int(n), np.array(lin, float), np.array(quad, float), [{e[0]: e[1] for e in es} for es in lin_cat])

    def __mul__(self, other: NbAgg) -> NbAgg:
        a, b = self, other
        cats = [{k: v * b.N for k, v in d.items()} for d in a.lin_cat] + [{k: v * a.N for k, v in d.items()} for d in b.lin_cat]
        return NbAgg(a.N * b.N, np.concatenate([a.lin * b.N, b.lin * a.N]), np.concatenate([a.quad * b.N, b.quad * a.N]), cats)

    def to_row(self) -> tuple:
        return (self.N, self.lin.tolist(), self.quad.tolist(), [[(k, v) for k, v in sorted(d.items())] for d in self.lin_cat])

    def __add__(self, other: NbAgg) -> NbAgg:
        a, b = _ring(self, other, 1)
        return NbAgg(a.N + b.N, a.lin + b.lin, a.quad + b.quad, [_merged(x, y) for x, y in zip(a.lin_cat, b.lin_cat, strict=True)])


@dataclass
class Triple:
    """quad is the upper triangle row by row; quad_num_cat goes by number, then category; quad_cat is an upper triangle too."""

    N: int = 0
    lin: np.ndarray = field(default_factory=lambda: np.zeros(0))
    quad: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lin_cat: list[dict] = field(default_factory=list)
    quad_num_cat: list[dict] = field(default_factory=list)
    quad_cat: list[dict] = field(default_factory=list)

    @classmethod
    def zero(cls, n: int, m: int) -> Triple:
        return cls(0, np.zeros(n), np.zeros(n * (n + 1) // 2), [{} for _ in range(m)], [{} for _ in range(n * m)], [{} for _ in range(m * (m + 1) // 2)])

    @classmethod
    def from_row(cls, row) -> Triple:
        n, lin, quad, lin_cat, num_cat, cat = row
        one = lambda lists: [{e[0]: e[1] for e in es} for es in lists]
        return cls(int(n), np.array(lin, float), np.array(quad, float), one(lin_cat), one(num_cat), [{(e[0], e[1]): e[2] for e in es} for es in cat])

    @classmethod
    def from_long(cls, rows, n: int, m: int) -> Triple:
        """From rows of block, pos, key1, key2, value (of one group)."""
        out = cls.zero(n, m)
        for r in rows:
            block, pos, value = r["block"], r["pos"], r["value"] or 0.0
            if block == "N":
                out.N = int(value)
            elif block in ("lin", "quad"):
                getattr(out, block)[pos] = value
            else:
                getattr(out, block)[pos][(r["key1"], r["key2"]) if block == "quad_cat" else r["key1"]] = value
        return out

    def _with(self, other: Triple, sign: int) -> Triple:
        a, b = _ring(self, other, sign)
        lists = lambda f: [_merged(x, y, sign) for x, y in zip(getattr(a, f), getattr(b, f), strict=True)]
        if sign < 0:  # a key goes with its last row
            counts = lists("lin_cat")
            m = len(counts)
            num_cat = [
                {k: x.get(k, 0.0) - y.get(k, 0.0) for k in counts[i % m]} for i, (x, y) in enumerate(zip(a.quad_num_cat, b.quad_num_cat, strict=True))
            ]
            return Triple(a.N - b.N, a.lin - b.lin, a.quad - b.quad, counts, num_cat, lists("quad_cat"))
        return Triple(a.N + b.N, a.lin + b.lin, a.quad + b.quad, *map(lists, ("lin_cat", "quad_num_cat", "quad_cat")))

    def __add__(self, other: Triple) -> Triple:
        return self._with(other, 1)

    def __sub__(self, other: Triple) -> Triple:
        return self._with(other, -1)

    def __mul__(self, other: Triple) -> Triple:
        """The triple of the product of two tables: columns of self, then of other."""
        a, b = self, other
        n, m, na, ma, mb = a.N, b.N, len(a.lin), len(a.lin_cat), len(b.lin_cat)
        times = lambda d, f: {k: v * f for k, v in d.items()}
        cross = lambda x, y: {(k, l): v * w for k, v in x.items() for l, w in y.items()}
        quad, num_cat, cat, at = [], [], [], 0
        for i in range(na):
            quad += [*(a.quad[at : at + na - i] * m), *(a.lin[i] * b.lin)]
            at += na - i
            num_cat += [times(d, m) for d in a.quad_num_cat[i * ma : (i + 1) * ma]] + [times(d, a.lin[i]) for d in b.lin_cat]
        for i in range(len(b.lin)):
            num_cat += [times(d, b.lin[i]) for d in a.lin_cat] + [times(d, n) for d in b.quad_num_cat[i * mb : (i + 1) * mb]]
        at = 0
        for i in range(ma):
            cat += [times(d, m) for d in a.quad_cat[at : at + ma - i]] + [cross(a.lin_cat[i], d) for d in b.lin_cat]
            at += ma - i
        return Triple(
            n * m,
            np.concatenate([a.lin * m, b.lin * n]),
            np.array([*quad, *(b.quad * n)], float),
            [times(d, m) for d in a.lin_cat] + [times(d, n) for d in b.lin_cat],
            num_cat,
            cat + [times(d, n) for d in b.quad_cat],
        )

    def to_row(self) -> tuple:
        """The nested value, by position."""
        one = lambda ds: [[(k, v) for k, v in sorted(d.items())] for d in ds]
        return (self.N, self.lin.tolist(), self.quad.tolist(), one(self.lin_cat), one(self.quad_num_cat), [[(*k, v) for k, v in sorted(d.items())] for d in self.quad_cat])

    def categories(self) -> list[list[int]]:
        return [sorted(c) for c in self.lin_cat]

    def sigma(self, without: int | None = None, categories: list[list[int]] | None = None, drop_first: bool = False) -> np.ndarray:
        """Sums of products over 1, the numbers and one column for each category. without: a categorical column to leave out."""
        cats = categories if categories is not None else self.categories()
        n, m = len(self.lin), len(self.lin_cat)
        at, p = {}, 1 + n
        for c in range(m):
            if c != without:
                for k in cats[c][1 if drop_first else 0 :]:
                    at[c, k] = p
                    p += 1
        out = np.zeros((p, p))
        out[0, 0] = self.N
        out[0, 1 : n + 1] = self.lin
        for (i, j), v in zip(pairs(n), self.quad, strict=True):
            out[1 + i, 1 + j] = v
        for c in range(m):
            for k, v in self.lin_cat[c].items():
                if (c, k) in at:
                    out[0, at[c, k]] = v
            for i in range(n):
                for k, v in self.quad_num_cat[i * m + c].items():
                    if (c, k) in at:
                        out[1 + i, at[c, k]] = v
        for (c, d), entries in zip(pairs(m), self.quad_cat, strict=True):
            for (k, l), v in entries.items():
                if (c, k) in at and (d, l) in at:
                    out[at[c, k], at[d, l]] = v
        return np.triu(out) + np.triu(out, 1).T

    def class_sums(self, label: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Of a categorical column: its values, their counts, and the sums of the other columns for each."""
        n, m = len(self.lin), len(self.lin_cat)
        values = sorted(self.lin_cat[label])
        cats = self.categories()
        at, p = {}, 1 + n
        for c in range(m):
            if c != label:
                for k in cats[c]:
                    at[c, k] = p
                    p += 1
        where = {v: i for i, v in enumerate(values)}
        out = np.zeros((len(values), p))
        for v, count in self.lin_cat[label].items():
            out[where[v], 0] = count
        for i in range(n):
            for v, s in self.quad_num_cat[i * m + label].items():
                out[where[v], 1 + i] = s
        for (c, d), entries in zip(pairs(m), self.quad_cat, strict=True):
            if c != d and label in (c, d):
                for (k, l), s in entries.items():
                    mine, other, key = (k, d, l) if c == label else (l, c, k)
                    out[where[mine], at[other, key]] = s
        return values, out[:, 0], out


def standardised(sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centred and scaled sums of products, with means and standard deviations; a constant column keeps its scale."""
    n = sigma[0, 0]
    mean = sigma[0] / n
    std = np.sqrt(np.maximum(np.diag(sigma) / n - mean**2, 0))
    std[std < 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    out = (sigma - n * np.outer(mean, mean)) / np.outer(std, std)
    out[0, :] = out[:, 0] = 0
    return out, mean, std
