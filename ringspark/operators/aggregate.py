"""The aggregates.

``cofactor`` computes a triple for each group without a per-row struct: rows are first
reduced to the distinct combinations of group and categories (partial and final hash
aggregation, one pass over the data), and every block of the triple is then a grouping
set over those few rows.  The long form, one row for each entry, is what the engine works
on; the nested form is assembled from it for groups whose entries fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import ONE, TWO, nb_type, pairs, triple_type

ENTRY = "struct<block:string,pos:int,key1:int,key2:int,value:double>"


def _entry(block: str, pos: int | Column, value: Column, key1: Column | None = None, key2: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit(block).alias("block"),
        (F.lit(pos) if isinstance(pos, int) else pos).cast("int").alias("pos"),
        (none if key1 is None else key1).cast("int").alias("key1"),
        (none if key2 is None else key2).cast("int").alias("key2"),
        value.cast("double").alias("value"),
    )


def prepared(df: DataFrame, num, cat, by, nulls: str) -> DataFrame:
    """The columns of use, with their types checked and nulls refused or left out."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    for c in num:
        if not isinstance(fields[c], T.NumericType):
            raise TypeError(f"{c} is {fields[c].simpleString()}, not a number")
    for c in cat:
        if not isinstance(fields[c], T.IntegralType):
            raise TypeError(f"{c} is {fields[c].simpleString()}; categories are integer codes (see encode)")
    if nulls == "skip":
        df = df.dropna(subset=[*num, *cat]) if num or cat else df
        check = F.col
    elif nulls == "error":
        check = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}"))).otherwise(F.col(c))
    else:
        raise ValueError(nulls)
    return df.select(
        *[F.col(c).alias(f"__b{k}") for k, c in enumerate(by)],
        *[check(c).cast("double").alias(f"__x{k}") for k, c in enumerate(num)],
        *[check(c).cast("int").alias(f"__c{k}") for k, c in enumerate(cat)],
    )


def products(n: int, nb: bool) -> list[tuple[int, int]]:
    """The pairs of numbers whose products are summed."""
    return [(i, i) for i in range(n)] if nb else pairs(n)


def reduced(df: DataFrame, num, cat, by, nulls: str = "error", nb: bool = False) -> DataFrame:
    """A row for each combination of group (__b0, ...) and categories (__c0, ...): count __n, sums __s0, ..., sums of products __q0, ..."""
    rows = prepared(df, num, cat, by, nulls)
    sums = [F.sum(f"__x{i}").alias(f"__s{i}") for i in range(len(num))]
    sums += [F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"__q{k}") for k, (i, j) in enumerate(products(len(num), nb))]
    return rows.groupBy(*[f"__b{k}" for k in range(len(by))], *[f"__c{k}" for k in range(len(cat))]).agg(F.count(F.lit(1)).alias("__n"), *sums)


def _entries(n: int, m: int, nb: bool):
    """From a set of categories to the entries that its row of count, sums and products gives."""
    triangle = {p: k for k, p in enumerate(pairs(m))}
    c = lambda i: F.col(f"__c{i}")

    def entries(s: tuple[int, ...]) -> Column:
        if not s:
            return F.array(
                _entry("N", 0, F.col("__n")),
                *[_entry("lin", i, F.col(f"__s{i}")) for i in range(n)],
                *[_entry("quad", k, F.col(f"__q{k}")) for k in range(len(products(n, nb)))],
            )
        if len(s) == 2:
            return F.array(_entry("quad_cat", triangle[s], F.col("__n"), c(s[0]), c(s[1])))
        out = [_entry("lin_cat", s[0], F.col("__n"), c(s[0]))]
        if not nb:
            out += [_entry("quad_num_cat", i * m + s[0], F.col(f"__s{i}"), c(s[0])) for i in range(n)]
            out.append(_entry("quad_cat", triangle[s[0], s[0]], F.col("__n"), c(s[0]), c(s[0])))
        return F.array(*out)

    return entries


def _sets(m: int, nb: bool) -> list[tuple[int, ...]]:
    return [(), *[(i,) for i in range(m)], *([] if nb else [(i, j) for i, j in pairs(m) if i < j])]


def blocks(small: DataFrame, n: int, m: int, keys: list[str], nb: bool) -> DataFrame:
    """The long rows of a reduced table: every block is a grouping set over its rows."""
    entries = _entries(n, m, nb)
    if not m:
        return small.select(*keys, F.inline(entries(())))
    values = ["__n", *[f"__s{i}" for i in range(n)], *[f"__q{k}" for k in range(len(products(n, nb)))]]
    cats = [f"__c{k}" for k in range(m)]
    sets = _sets(m, nb)
    grouped = small.groupingSets([[*map(F.col, keys), *[F.col(cats[i]) for i in s]] for s in sets], *keys, *cats)
    grouped = grouped.agg(F.grouping_id().alias("__g"), *[F.sum(v).alias(v) for v in values])
    chosen = None
    for s in sets:
        gid = sum(1 << (m - 1 - i) for i in range(m) if i not in s)
        chosen = F.when(F.col("__g") == gid, entries(s)) if chosen is None else chosen.when(F.col("__g") == gid, entries(s))
    return grouped.select(*keys, F.inline(chosen))


def _long(df: DataFrame, num, cat, by, nulls: str, nb: bool, having=None) -> DataFrame:
    if not num and not cat:
        raise ValueError("no columns")
    if having is not None:
        # Of group columns alone (else this fails), so groups can be left out row by row, at the scan.
        df.sparkSession.createDataFrame([], T.StructType([df.schema[c] for c in by])).where(having)
        df = df.where(having)
    keys = [f"__b{k}" for k in range(len(by))]
    return blocks(reduced(df, num, cat, by, nulls, nb), len(num), len(cat), keys, nb)


def _named(df: DataFrame, by) -> DataFrame:
    for k, c in enumerate(by):
        df = df.withColumnRenamed(f"__b{k}", c)
    return df


def cofactor_long(df: DataFrame, num, cat=(), by=(), nulls: str = "error", having=None) -> DataFrame:
    """by, block (N, lin, quad, lin_cat, quad_num_cat, quad_cat), pos, key1, key2, value: a row for each entry."""
    return _named(_long(df, num, cat, by, nulls, False, having), by)


def nb_long(df: DataFrame, num, cat=(), by=(), nulls: str = "error", having=None) -> DataFrame:
    return _named(_long(df, num, cat, by, nulls, True, having), by)


def assemble(long: DataFrame, n: int, m: int, keys, nb: bool, alias: str, names: str = "agg") -> DataFrame:
    """The nested form of long rows: a row for each group; without groups one row, of zeros where there is no input."""
    long = long.repartition(*keys) if keys else long.repartition(1)  # one exchange for both groupings
    parts = long.groupBy(*keys, "block", "pos").agg(F.array_sort(F.collect_list(F.struct("key1", "key2", "value"))).alias("items"))
    whole = parts.groupBy(*keys).agg(F.collect_list(F.struct("block", "pos", "items")).alias("__all"))

    def items(block: str, pos: Column) -> Column:
        return F.get(F.filter("__all", lambda p: (p["block"] == block) & (p["pos"] == pos)), F.lit(0))["items"]

    def many(count: int, f, kind: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), f) if count else F.array().cast(kind)

    dense = lambda block, count: many(count, lambda p: F.coalesce(F.get(items(block, p), F.lit(0))["value"], F.lit(0.0)), "array<double>")
    one = lambda block, count: many(
        count, lambda p: F.coalesce(F.transform(items(block, p), lambda e: F.struct(e["key1"].alias("key"), e["value"].alias("value"))), F.array().cast(ONE[6:-1])), ONE
    )
    two = lambda block, count: many(count, lambda p: F.coalesce(items(block, p), F.array().cast(TWO[6:-1])), TWO)
    fields = [
        F.coalesce(F.get(items("N", F.lit(0)), F.lit(0))["value"], F.lit(0.0)).cast("long").alias("N"),
        dense("lin", n).alias(f"lin_{names}"),
        dense("quad", n if nb else n * (n + 1) // 2).alias(f"quad_{names}"),
        one("lin_cat", m).alias("lin_cat"),
    ]
    if not nb:
        fields += [one("quad_num_cat", n * m).alias("quad_num_cat"), two("quad_cat", m * (m + 1) // 2).alias("quad_cat")]
    kind = nb_type(names) if nb else triple_type(names)
    return whole.select(*keys, F.struct(*fields).cast(kind).alias(alias, metadata={"ring": {"num": n, "cat": m}}))


def cofactor(df: DataFrame, num, cat=(), by=(), nulls: str = "error", alias: str = "triple", having=None) -> DataFrame:
    """A triple for each group (one row without groups). nulls: "error" or "skip" (rows with a null in num or cat).
    having: a predicate on the group's columns (SQL text or Column), applied at the scan."""
    long = _long(df, num, cat, by, nulls, False, having)
    return _named(assemble(long, len(num), len(cat), [f"__b{k}" for k in range(len(by))], False, alias), by)


def nb_agg(df: DataFrame, num, cat=(), by=(), nulls: str = "error", alias: str = "nb_agg", having=None) -> DataFrame:
    long = _long(df, num, cat, by, nulls, True, having)
    return _named(assemble(long, len(num), len(cat), [f"__b{k}" for k in range(len(by))], True, alias), by)


def arity(df: DataFrame, col: str) -> tuple[int, int]:
    """Numeric and categorical columns of a triple column: from its metadata, else from one row."""
    known = next(f for f in df.schema.fields if f.name == col).metadata.get("ring")
    if known:
        return known["num"], known["cat"]
    lin = df.schema[col].dataType.fieldNames()[1]
    row = df.where(F.col(f"{col}.N") > 0).select(F.size(f"{col}.{lin}"), F.size(f"{col}.lin_cat")).first()
    return (row[0], row[1]) if row else (0, 0)


def entries_of(col: str, df: DataFrame, nb: bool) -> Column:
    """The entries of a nested value, as an array of ENTRY."""
    _, lin, quad = df.schema[col].dataType.fieldNames()[:3]
    v = lambda f: F.col(f"`{col}`.{f}")
    dense = lambda block, field: F.transform(v(field), lambda x, i: _entry(block, i, x))
    one = lambda block: F.flatten(F.transform(v(block), lambda es, i: F.transform(es, lambda e: _entry(block, i, e["value"], e["key"]))))
    out = [F.array(_entry("N", 0, v("N"))), dense("lin", lin), dense("quad", quad), one("lin_cat")]
    if not nb:
        out.append(one("quad_num_cat"))
        out.append(F.flatten(F.transform(v("quad_cat"), lambda es, i: F.transform(es, lambda e: _entry("quad_cat", i, e["value"], e["key1"], e["key2"])))))
    return F.concat(*out)


def explode_triple(df: DataFrame, col: str, by=(), nb: bool = False) -> DataFrame:
    return df.select(*by, F.inline(entries_of(col, df, nb)))


def summed(df: DataFrame, col: str, by, nb: bool) -> DataFrame:
    """The long rows of the ring sum. A triple is a dense row, a row for each category (its count and sums side
    by side, as the lists of a column share their keys) and one for each pair of categories; those are summed."""
    n, m = arity(df, col)
    _, lin, quad = df.schema[col].dataType.fieldNames()[:3]
    v = lambda f: F.col(f"`{col}`.{f}")
    values = [*[f"__s{i}" for i in range(n)], *[f"__q{k}" for k in range(len(products(n, nb)))]]
    names = ["__n", *values]
    none = F.lit(None).cast("double")

    def row(s: int, given: list[Column], *keys: Column) -> Column:
        at = [*keys, *[F.lit(None).cast("int")] * (2 - len(keys))]
        cells = [*given, *[none] * (len(names) - len(given))]
        return F.struct(F.lit(s).alias("__set"), at[0].alias("__k1"), at[1].alias("__k2"), *[x.cast("double").alias(c) for x, c in zip(cells, names, strict=True)])

    def of_key(e: Column, i: Column, items: Column) -> Column:
        other = F.get(items, i)
        return F.when(other["key"] == e["key"], other["value"]).otherwise(F.raise_error(F.lit("the lists of a triple differ in their keys")).cast("double"))

    sets = _sets(m, nb)
    triangle = {p: k for k, p in enumerate(pairs(m))}
    found = [F.array(row(0, [v("N"), *[F.get(v(lin), F.lit(i)) for i in range(n)], *[F.get(v(quad), F.lit(k)) for k in range(len(products(n, nb)))]]))]
    kind = f"array<struct<__set:int,__k1:int,__k2:int,{','.join(c + ':double' for c in names)}>>"

    def of_pair(at: int, s: tuple[int, int]) -> Column:
        return F.transform(F.get(v("quad_cat"), F.lit(triangle[s])), lambda e: row(at, [e["value"]], e["key1"], e["key2"]))

    def of_one(at: int, j: int) -> Column:
        sums = [] if nb else [F.get(v("quad_num_cat"), F.lit(x * m + j)) for x in range(n)]
        return F.transform(F.get(v("lin_cat"), F.lit(j)), lambda e, i: row(at, [e["value"], *[of_key(e, i, x) for x in sums]], e["key"]))

    for at, s in enumerate(sets[1:], 1):
        found.append(F.coalesce(of_pair(at, s) if len(s) == 2 else of_one(at, s[0]), F.array().cast(kind)))
    long = df.where(F.col(f"`{col}`").isNotNull()).select(*by, F.inline(F.concat(*found)))
    long = long.groupBy(*by, "__set", "__k1", "__k2").agg(*[F.sum(c).alias(c) for c in names])
    # The second key belongs to the second category of a pair.
    cats = {f"__c{i}": F.coalesce(*[F.when(F.col("__set") == at, F.col(f"__k{s.index(i) + 1}")) for at, s in enumerate(sets) if i in s]) for i in range(m)}
    long = long.withColumns(cats) if cats else long
    entries, chosen = _entries(n, m, nb), None
    for at, s in enumerate(sets):
        chosen = F.when(F.col("__set") == at, entries(s)) if chosen is None else chosen.when(F.col("__set") == at, entries(s))
    return long.select(*by, F.inline(chosen))


def _sum(df: DataFrame, col: str, by, alias: str, nb: bool) -> DataFrame:
    n, m = arity(df, col)
    return assemble(summed(df, col, list(by), nb), n, m, list(by), nb, alias)


def sum_triple(df: DataFrame, col: str, by=(), alias: str = "triple") -> DataFrame:
    """The ring sum: element by element, and key by key; entries are summed before they are gathered."""
    return _sum(df, col, by, alias, False)


def sum_nb_agg(df: DataFrame, col: str, by=(), alias: str = "nb_agg") -> DataFrame:
    return _sum(df, col, by, alias, True)
