"""Multiple imputation by chained equations over aggregates.

Nulls are filled (mean; most frequent category, the smallest of several), then every
column with nulls is predicted in turn from all others, ``iterations`` times, by a model
trained on the rows where it was observed: linear regression for numbers, discriminant
analysis for categories.  Only rows where the column was null change.

The three strategies give the same result and differ in what they aggregate in a step:

* ``baseline``: the observed rows.
* ``low`` (few nulls): a running triple of all rows, minus the triple of the rows where the
  column is null; afterwards plus the triple of those rows as imputed.  The rows as imputed and
  those of the next column are aggregated together, so a step reads the null rows once.
* ``high`` (many nulls): the triple of the rows without any null, computed once, plus the
  triple of the other rows where the column was observed.

``null_pattern`` (bit k: column k was null) makes the partitions: they are filters on it,
disjoint by construction, and a sink may be partitioned by it.  Each step is one
aggregation and a projection; the table is written to the shared folder after every
iteration and the one before is dropped, so plans stay short, lost executors cost a reread and
no more than two tables are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ml.models import LDA, LinearRegression
from ..ml.triple import Triple
from ..operators.aggregate import cofactor_long
from ..scratch import Scratch

MASK = "null_pattern"


def count_nulls(columns) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def count_not_nulls(columns) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def null_pattern(columns) -> Column:
    return sum((F.when(F.col(c).isNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(columns)), F.lit(0).cast("long"))


def partition_of(columns, mask: str = MASK, inverse: bool = False) -> Column:
    """The partition's name: by nulls ("0", the column, "2", "3" for all null), or inverse, by observed columns."""
    k = len(columns)
    bits = F.bit_count(F.col(mask))
    n = (F.lit(k) - bits) if inverse else bits
    hit = [F.when((n == 1) & ((F.col(mask).bitwiseAND(F.lit(1 << i)) != 0) != F.lit(inverse)), F.lit(c)) for i, c in enumerate(columns)]
    return F.when(n == 0, "0").when(n == k, "3").otherwise(F.coalesce(*hit, F.lit("2")))


def partition(df: DataFrame, columns, inverse: bool = False, name: str = "partition") -> DataFrame:
    """Adds null_pattern and the partition's name; counts come from the pattern."""
    return df.withColumn(MASK, null_pattern(columns)).withColumn(name, partition_of(columns, inverse=inverse))


def fills(df: DataFrame, num_nulls, cat_nulls) -> dict:
    """One aggregation: means, and the most frequent category (the smallest of several)."""
    exprs = [F.avg(c).alias(c) for c in num_nulls] + [F.mode(c, True).alias(c) for c in cat_nulls]
    return df.agg(*exprs).first().asDict() if exprs else {}


def init(df: DataFrame, num_nulls, cat_nulls) -> DataFrame:
    """The filled table with null_pattern over num_nulls + cat_nulls."""
    columns = [*num_nulls, *cat_nulls]
    with_mask = df.withColumn(MASK, null_pattern(columns))
    values = fills(df, num_nulls, cat_nulls)
    kinds = {c: "double" for c in num_nulls} | {c: "int" for c in cat_nulls}
    return with_mask.withColumns({c: F.coalesce(F.col(c).cast(kinds[c]), F.lit(0 if values[c] is None else values[c]).cast(kinds[c])) for c in columns})


class _Tables:
    """The table as it was last written; the one before goes."""

    def __init__(self, spark):
        self.scratch, self.k = Scratch(spark, "mice"), 0

    def save(self, df: DataFrame) -> DataFrame:
        self.k += 1
        out = self.scratch.save(df, f"table{self.k}")
        self.scratch.drop(f"table{self.k - 1}")
        return out


def mice(
    df: DataFrame,
    num,
    cat,
    num_nulls,
    cat_nulls,
    iterations: int = 1,
    strategy: str = "baseline",
    order: str = "cat_first",
    noise: bool = True,
    seed: int = 0,
    shrinkage: float | None = None,
    solver: str = "exact",
    key=None,
) -> DataFrame:
    """num, cat: the columns of the model; num_nulls, cat_nulls: those with nulls. Returns df's columns and rows.

    order: "cat_first" or "num_first". noise: draws from the residuals for numbers, seeded; with ``key`` columns
    a draw depends on the row's key alone and so not on the partitioning."""
    if strategy not in ("baseline", "low", "high"):
        raise ValueError(strategy)
    if shrinkage is None:
        shrinkage = 0.001 if strategy == "baseline" else 0.4
    num, cat, nulls = list(num), list(cat), [*num_nulls, *cat_nulls]
    if not nulls:
        return df
    bit = {c: 1 << k for k, c in enumerate(nulls)}
    was_null = lambda c: F.col(MASK).bitwiseAND(F.lit(bit[c])) != 0
    tables = _Tables(df.sparkSession)
    table = tables.save(init(df, num_nulls, cat_nulls))
    aggregate = lambda rows: Triple.from_long(cofactor_long(rows, num, cat).collect(), len(num), len(cat))
    turns = [*cat_nulls, *num_nulls] if order == "cat_first" else [*num_nulls, *cat_nulls]
    steps = [(step, c) for step in range(iterations) for c in turns]
    full = aggregate(table) if strategy == "low" else None
    static = aggregate(table.where(F.col(MASK) == 0)) if strategy == "high" else None
    gone = aggregate(table.where(was_null(turns[0]))) if strategy == "low" and steps else None
    for k, (step, c) in enumerate(steps):
        following = steps[k + 1][1] if k + 1 < len(steps) else None
        if strategy == "baseline":
            train = aggregate(table.where(~was_null(c)))
        elif strategy == "low":
            train = full - gone
        else:
            train = static + aggregate(table.where(~was_null(c) & (F.col(MASK) != 0)))
        if train.N:  # else never observed: the fill stays
            if c in num:
                label = num.index(c)
                model = LinearRegression.fit(train, label, include_variance=True, solver=solver)
                draw = None
                if noise:
                    at = seed + 1000 * step + label
                    draw = _normal(key, at) if key else F.randn(at)
                value = model.predict([x for x in num if x != c], cat, draw)
            else:
                model = LDA.fit(train, cat.index(c), shrinkage)
                value = model.predict(num, [x for x in cat if x != c])
            table = table.withColumn(c, F.when(was_null(c), value).otherwise(F.col(c)))
        if (noise and c in num) or c == turns[-1]:
            table = tables.save(table)  # a draw is made once
        if strategy == "low" and following:
            # Bit 0: null in this column, now imputed; bit 1: null in the next one.
            flag = was_null(c).cast("int") + 2 * was_null(following).cast("int")
            rows = cofactor_long(table.withColumn("__flag", flag).where("__flag > 0"), num, cat, ["__flag"]).collect()
            parts = {f: Triple.from_long([r for r in rows if r["__flag"] == f], len(num), len(cat)) for f in (1, 2, 3)}
            total = lambda bit: sum((t for f, t in parts.items() if f & bit), Triple())  # noqa: B023, E731
            full, gone = train + total(1), total(2)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return table.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in nulls else F.col(f"`{c}`") for c in df.columns])


def _normal(key, seed: int) -> Column:
    """A standard normal draw by Box and Muller from two MD5 sums of the key."""

    def uniform(k: int) -> Column:
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)), F.lit(str(k)))
        return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))

    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * F.lit(math.pi) * uniform(1))


def knock_out(df: DataFrame, columns, key: str, every: int = 5) -> DataFrame:
    """Nulls for testing: column i loses the values of rows whose (key * 7 + i) is divisible by ``every``."""
    return df.withColumns({c: F.when((F.col(key) * 7 + i) % every == 0, F.lit(None)).otherwise(F.col(c)) for i, c in enumerate(columns)})
