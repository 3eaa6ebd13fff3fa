"""Triples over joins without the join.

Each side is reduced to the distinct combinations of its key and categories, flat rows of a
count, sums and sums of products.  The reduced sides are joined on the key, a pair of rows
giving the count, sums and products of all pairs of rows behind it (the ring's product, flat),
and these are summed by category at once.  Nothing is nested until the result.  The work is
that of the distinct combinations, so the larger the fan-out the more is saved; where
every key has a row or two on either side it costs about what the join would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ring import multiply_nb_agg, multiply_triple
from .aggregate import arity, assemble, blocks, cofactor, nb_agg, products, reduced


def _times(left: DataFrame, right: DataFrame, nb: bool) -> DataFrame:
    """The product of two tables without a common key: one row a side."""
    name = "nb_agg" if nb else "triple"
    n, m = (a + b for a, b in zip(arity(left, name), arity(right, name), strict=True))
    joined = left.withColumnRenamed(name, "__a").crossJoin(right.withColumnRenamed(name, "__b"))
    product = (multiply_nb_agg if nb else multiply_triple)("__a", "__b")
    return joined.select(product.cast(left.schema[name].dataType).alias(name, metadata={"ring": {"num": n, "cat": m}}))


class Flat:
    """A reduced table and its shape: numbers, categories, the names of its keys."""

    def __init__(self, rows: DataFrame, n: int, m: int, keys):
        self.rows, self.n, self.m, self.keys = rows, n, m, list(keys)

    @classmethod
    def of(cls, df: DataFrame, num, cat, keys, nulls: str, nb: bool) -> Flat:
        rows = reduced(df, num, cat, keys, nulls, nb).withColumnsRenamed({f"__b{k}": c for k, c in enumerate(keys)})
        return cls(rows, len(num), len(cat), keys)

    def _named(self, side: str, on) -> DataFrame:
        """Columns with the side's letter, but for the keys that are joined on and those of the side's own."""
        return self.rows.withColumnsRenamed({c: side + c for c in self.rows.columns if c not in self.keys})

    def times(self, other: Flat, on, keep, nb: bool) -> Flat:
        """The join on ``on``, reduced to the keys ``keep`` and the categories of both."""
        a, b = self, other
        joined = a._named("a", on).join(b._named("b", on), list(on))
        col = lambda side, kind, i="": F.col(f"{side}__{kind}{i}")
        na, nc = col("a", "n"), col("b", "n")
        at = {side: {p: k for k, p in enumerate(products(x.n, nb))} for side, x in (("a", a), ("b", b))}

        def product(i: int, j: int):
            if j < a.n:
                return col("a", "q", at["a"][i, j]) * nc
            if i >= a.n:
                return col("b", "q", at["b"][i - a.n, j - a.n]) * na
            return col("a", "s", i) * col("b", "s", j - a.n)

        cats = [col("a", "c", i) for i in range(a.m)] + [col("b", "c", i) for i in range(b.m)]
        sums = [col("a", "s", i) * nc for i in range(a.n)] + [col("b", "s", i) * na for i in range(b.n)]
        quads = [product(i, j) for i, j in products(a.n + b.n, nb)]
        rows = joined.groupBy(*keep, *[c.alias(f"__c{i}") for i, c in enumerate(cats)]).agg(
            F.sum(na * nc).alias("__n"), *[F.sum(x).alias(f"__s{i}") for i, x in enumerate(sums)], *[F.sum(x).alias(f"__q{k}") for k, x in enumerate(quads)]
        )
        return Flat(rows, a.n + b.n, a.m + b.m, keep)

    def long(self, nb: bool) -> DataFrame:
        return blocks(self.rows, self.n, self.m, self.keys, nb)


def factorized_flat(tables: list[dict], nb: bool = False, nulls: str = "error") -> Flat:
    """The reduced triple over a chain of joins. tables: dicts with df, num, cat, and ``on``, the keys shared with the next table (none for the last)."""
    now = None
    for k, t in enumerate(tables):
        before, after = list(tables[k - 1]["on"]) if k else [], list(t.get("on", ()))
        own = Flat.of(t["df"], t.get("num", ()), t.get("cat", ()), list(dict.fromkeys(before + after)), nulls, nb)
        now = own if now is None else now.times(own, before, after, nb)
    return now


def factorized_long(tables: list[dict], nb: bool = False, nulls: str = "error") -> DataFrame:
    """block, pos, key1, key2, value of the triple over the chain: see factorized_flat."""
    return factorized_flat(tables, nb, nulls).long(nb)


def factorized_chain(tables: list[dict], nb: bool = False, nulls: str = "error") -> DataFrame:
    """The triple over the chain, one row: see factorized_flat."""
    flat = factorized_flat(tables, nb, nulls)
    return assemble(flat.long(nb), flat.n, flat.m, [], nb, "nb_agg" if nb else "triple")


def factorized_cofactor(left: DataFrame, right: DataFrame, on, left_num=(), left_cat=(), right_num=(), right_cat=(), nulls: str = "error", nb: bool = False) -> DataFrame:
    """The triple of left join right on ``on``: columns of left, then of right; without ``on``, of all pairs of rows."""
    if not on:
        of = nb_agg if nb else cofactor
        return _times(of(left, left_num, left_cat, (), nulls), of(right, right_num, right_cat, (), nulls), nb)
    return factorized_chain([{"df": left, "num": left_num, "cat": left_cat, "on": on}, {"df": right, "num": right_num, "cat": right_cat}], nb, nulls)
