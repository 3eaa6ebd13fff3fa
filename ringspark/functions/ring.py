"""Ring functions as native column expressions: lift, multiply, and the demo greeting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ONE, TWO, nb_type, pairs, triple_type


def _columns(names) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _typed(items: list[Column], kind: str) -> Column:
    return F.array(*items).cast(kind)


def to_cofactor(num, cat=()) -> Column:
    """A row's triple: count 1, values, products, and one entry for each category."""
    x, c = [v.cast("double") for v in _columns(num)], [v.cast("int") for v in _columns(cat)]
    one = lambda k, v: F.array(F.struct(k.alias("key"), v.alias("value")))
    two = lambda a, b: F.array(F.struct(a.alias("key1"), b.alias("key2"), F.lit(1.0).alias("value")))
    return F.struct(
        F.lit(1).cast("long").alias("N"),
        _typed(x, "array<double>").alias("lin_num"),
        _typed([x[i] * x[j] for i, j in pairs(len(x))], "array<double>").alias("quad_num"),
        _typed([one(k, F.lit(1.0)) for k in c], ONE).alias("lin_cat"),
        _typed([one(k, v) for v in x for k in c], ONE).alias("quad_num_cat"),
        _typed([two(c[i], c[j]) for i, j in pairs(len(c))], TWO).alias("quad_cat"),
    )


def to_nb_agg(num, cat=()) -> Column:
    """A row's naive Bayes aggregate: squares instead of products, no pairs."""
    x, c = [v.cast("double") for v in _columns(num)], [v.cast("int") for v in _columns(cat)]
    return F.struct(
        F.lit(1).cast("long").alias("N"),
        _typed(x, "array<double>").alias("lin_num"),
        _typed([v * v for v in x], "array<double>").alias("quad_num"),
        _typed([F.array(F.struct(k.alias("key"), F.lit(1.0).alias("value"))) for k in c], ONE).alias("lin_cat"),
    )


def _positional(value: Column, kind: str) -> Column:
    """Either set of field names, by position."""
    return value.cast(kind)


def _scaled(values: Column, by: Column) -> Column:
    return F.transform(values, lambda v: v * by)


def _lists(lists: Column, by: Column) -> Column:
    return F.transform(lists, lambda entries: F.transform(entries, lambda e: F.struct(e["key"].alias("key"), (e["value"] * by).alias("value"))))


def _pair_lists(lists: Column, by: Column) -> Column:
    return F.transform(lists, lambda entries: F.transform(entries, lambda e: F.struct(e["key1"].alias("key1"), e["key2"].alias("key2"), (e["value"] * by).alias("value"))))


def _count(values: Column) -> Column:
    return F.sequence(F.lit(0), F.size(values) - 1)


def _each(values: Column, f, kind: str) -> Column:
    """flatten(f(i) for the indexes of values); an empty list of the kind where there are none."""
    return F.when(F.size(values) > 0, F.flatten(F.transform(_count(values), f))).otherwise(F.array().cast(kind))


def _row(quad: Column, n: Column, i: Column) -> Column:
    """Row i of an upper triangle over n columns."""
    return F.slice(quad, (i * n - F.floor(i * (i - 1) / 2) + 1).cast("int"), (n - i).cast("int"))


def _crossed(a: Column, b: Column) -> Column:
    """All pairs of two lists of categories with the products of their values."""
    return F.flatten(
        F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x["key"].alias("key1"), y["key"].alias("key2"), (x["value"] * y["value"]).alias("value"))))
    )


def multiply_triple(a, b) -> Column:
    """The triple of the product: columns of a, then columns of b."""
    a, b = (_positional(v, triple_type()) for v in _columns((a, b)))
    n, m = a["N"].cast("double"), b["N"].cast("double")
    la, lb = a["lin_agg"], b["lin_agg"]
    quad = F.concat(
        _each(la, lambda i: F.concat(_scaled(_row(a["quad_agg"], F.size(la), i), m), F.transform(lb, lambda y: F.get(la, i) * y)), "array<double>"), _scaled(b["quad_agg"], n)
    )
    ma, mb = F.size(a["lin_cat"]), F.size(b["lin_cat"])
    block = lambda lists, width, i: F.slice(lists, i * width + 1, width)
    num_cat = F.concat(
        _each(la, lambda i: F.concat(_lists(block(a["quad_num_cat"], ma, i), m), _lists(b["lin_cat"], F.get(la, i))), ONE),
        _each(lb, lambda i: F.concat(_lists(a["lin_cat"], F.get(lb, i)), _lists(block(b["quad_num_cat"], mb, i), n)), ONE),
    )
    cat = F.concat(
        _each(
            a["lin_cat"],
            lambda i: F.concat(
                _pair_lists(_row(a["quad_cat"], ma, i), m), F.transform(b["lin_cat"], lambda other: _crossed(F.get(a["lin_cat"], i), other))
            ),
            TWO,
        ),
        _pair_lists(b["quad_cat"], n),
    )
    return F.struct(
        (a["N"] * b["N"]).alias("N"),
        F.concat(_scaled(la, m), _scaled(lb, n)).alias("lin_num"),
        quad.alias("quad_num"),
        F.concat(_lists(a["lin_cat"], m), _lists(b["lin_cat"], n)).alias("lin_cat"),
        num_cat.alias("quad_num_cat"),
        cat.alias("quad_cat"),
    ).cast(triple_type("num"))


def multiply_nb_agg(a, b) -> Column:
    a, b = (_positional(v, nb_type()) for v in _columns((a, b)))
    n, m = a["N"].cast("double"), b["N"].cast("double")
    return F.struct(
        (a["N"] * b["N"]).alias("N"),
        F.concat(_scaled(a["lin_agg"], m), _scaled(b["lin_agg"], n)).alias("lin_num"),
        F.concat(_scaled(a["quad_agg"], m), _scaled(b["quad_agg"], n)).alias("quad_num"),
        F.concat(_lists(a["lin_cat"], m), _lists(b["lin_cat"], n)).alias("lin_cat"),
    ).cast(nb_type("num"))


def quack(name) -> Column:
    return F.concat(F.lit("Quack "), _columns([name])[0], F.lit(" \U0001f425"))
