"""The queries of the library's own operators, with their oracles.

Inputs are made whole numbers, so that sums are exact in either engine whatever their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ring import multiply_nb_agg, multiply_triple, quack, to_cofactor, to_nb_agg
from ..ml.models import LDA, QDA, LinearRegression, NaiveBayes
from ..ml.triple import NbAgg, Triple
from ..operators.aggregate import cofactor, cofactor_long, explode_triple, nb_agg, nb_long, sum_nb_agg, sum_triple
from ..operators.encode import encode, unique_categories
from ..operators.factorized import factorized_cofactor, factorized_long
from ..sources.tables import table
from ..types import pairs
from . import algebra_sql, sql
from .mice import MASK, count_not_nulls, count_nulls, init, knock_out, mice, partition

NUM, CAT = ["q", "p", "d", "t"], ["rf", "ls", "ln"]
VALUES = {"rf": [65, 78, 82], "ls": [70, 79], "ln": [1, 2, 3, 4, 5, 6, 7]}  # the codes of A N R, F O, and line numbers
LINE = """(select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_orderkey * 10 + l_linenumber as id, l_quantity::double as q, floor(l_extendedprice / 100)::double as p,
  round(l_discount * 100)::double as d, round(l_tax * 100)::double as t, ascii(l_returnflag)::int as rf, ascii(l_linestatus)::int as ls, l_linenumber::int as ln from lineitem)"""
ORDERS = "(select o_orderkey, o_custkey, floor(o_totalprice / 1000)::double as total, ascii(o_orderstatus)::int as os from orders)"
CUSTOMERS = "(select c_custkey, c_nationkey, floor(c_acctbal / 10)::double as bal, c_nationkey::int as cn from customer)"
SUPPLIERS = "(select s_suppkey, s_nationkey, floor(s_acctbal / 10)::double as sb, (s_suppkey % 3)::int as sk from supplier)"


def line(spark: SparkSession, sf: str) -> DataFrame:
    whole = lambda c: F.round(F.col(c) * 100).cast("double")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_quantity").cast("double").alias("q"),
        F.floor(F.col("l_extendedprice") / 100).cast("double").alias("p"),
        whole("l_discount").alias("d"),
        whole("l_tax").alias("t"),
        F.ascii("l_returnflag").alias("rf"),
        F.ascii("l_linestatus").alias("ls"),
        F.col("l_linenumber").cast("int").alias("ln"),
    )


def orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("total"), F.ascii("o_orderstatus").alias("os"))


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 10).cast("double").alias("bal"), F.col("c_nationkey").cast("int").alias("cn"))


def suppliers(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 10).cast("double").alias("sb"), (F.col("s_suppkey") % 3).cast("int").alias("sk"))


def long_sql(source: str, num, cat=(), by=(), nb: bool = False, rows: bool = False) -> str:
    """The long form in SQL: a GROUP BY for each block, or, with rows, that of each row."""
    head = "".join(f"{b}, " for b in by)
    part = lambda block, pos, value, keys=(): (
        f"select {head}'{block}' as block, {pos}::int as pos, {f'{keys[0]}::int' if keys else 'null::int'} as key1, {f'{keys[1]}::int' if len(keys) > 1 else 'null::int'} as key2, "
        f"({value})::double as value from src" + (f" group by {', '.join([*by, *dict.fromkeys(keys)])}" if (by or keys) and not rows else "")
    )
    if rows:
        total, count = (lambda x: x), "1"
    else:
        total, count = (lambda x: f"sum({x})"), "count(*)"
    m = len(cat)
    out = [part("N", 0, count), *[part("lin", i, total(x)) for i, x in enumerate(num)]]
    products = [(i, i) for i in range(len(num))] if nb else pairs(len(num))
    out += [part("quad", k, total(f"{num[i]} * {num[j]}")) for k, (i, j) in enumerate(products)]
    out += [part("lin_cat", i, count, (c,)) for i, c in enumerate(cat)]
    if not nb:
        out += [part("quad_num_cat", i * m + j, total(x), (c,)) for i, x in enumerate(num) for j, c in enumerate(cat)]
        out += [part("quad_cat", k, count, (cat[i], cat[j])) for k, (i, j) in enumerate(pairs(m))]
    return f"with src as (select * from {source}) " + " union all ".join(out)


def _flat(df: DataFrame, col: str, by=(), nb: bool = False) -> DataFrame:
    return explode_triple(df, col, by, nb)


def _lifted(spark, sf, nb: bool = False) -> DataFrame:
    of = to_nb_agg if nb else to_cofactor
    return line(spark, sf).select("id", of(NUM[:2], CAT[:2]).alias("triple"))


def _regression(spark, sf) -> LinearRegression:
    return LinearRegression.fit(Triple.from_row(cofactor(line(spark, sf), ["q", "p"]).first()["triple"]), 1, include_variance=True)


def _by_class(spark, sf, num, cat, of, value):
    rows = of(line(spark, sf), num, cat, ["rf"]).orderBy("rf").collect()
    return [value.from_row(r[1]) for r in rows], [r[0] for r in rows]


def _predicted(spark, sf, column) -> DataFrame:
    return line(spark, sf).select("id", "rf", column.alias("predicted"))


def linreg_fit(spark, sf) -> DataFrame:
    m = _regression(spark, sf)
    return spark.createDataFrame([(round(float(m.weights[0]), 6), round(m.intercept, 6))], "slope double, intercept double")


def linreg_predict(spark, sf) -> DataFrame:
    return line(spark, sf).select("id", F.round(_regression(spark, sf).predict(["q"]), 4).alias("predicted"))


def linreg_bgd(spark, sf) -> DataFrame:
    t = Triple.from_row(cofactor(line(spark, sf), NUM, CAT[:1]).first()["triple"])
    exact, bgd = (LinearRegression.fit(t, 0, lam=0.01, normalize=True, include_variance=True, solver=s) for s in ("exact", "bgd"))
    value, descended = (m.predict(NUM[1:], CAT[:1]) for m in (exact, bgd))
    return line(spark, sf).select("id", F.round(value, 4).alias("exact"), F.round(F.abs(descended - value), 3).alias("apart"))


def nb_fit(spark, sf) -> DataFrame:
    m = NaiveBayes.fit(*_by_class(spark, sf, ["q", "d"], ["ls"], nb_agg, NbAgg))
    rows = [(k, round(p, 8), *[round(float(x), n) for x, n in zip((*a, *b), (6, 4, 6, 4), strict=True)]) for k, p, (a, b) in zip(m.labels, m.priors, m.numbers, strict=True)]
    return spark.createDataFrame(rows, "label int, prior double, q_mean double, q_var double, d_mean double, d_var double")


def nb_predict(spark, sf) -> DataFrame:
    m = NaiveBayes.fit(*_by_class(spark, sf, ["q", "d"], ["ls"], nb_agg, NbAgg))
    return _predicted(spark, sf, m.predict(["q", "d"], ["ls"]))


def lda_1d(spark, sf) -> DataFrame:
    t = Triple.from_row(cofactor(line(spark, sf), ["q"], ["rf"]).first()["triple"])
    return _predicted(spark, sf, LDA.fit(t, 0).predict(["q"]))


def lda_mixed(spark, sf) -> DataFrame:
    t = Triple.from_row(cofactor(line(spark, sf), NUM, CAT).first()["triple"])
    return _predicted(spark, sf, LDA.fit(t, 0, 0.1, True).predict(NUM, CAT[1:]))


def qda_1d(spark, sf) -> DataFrame:
    return _predicted(spark, sf, QDA.fit(*_by_class(spark, sf, ["q"], [], cofactor, Triple)).predict(["q"]))


def qda_mixed(spark, sf) -> DataFrame:
    return _predicted(spark, sf, QDA.fit(*_by_class(spark, sf, NUM, ["ls"], cofactor, Triple), normalize=True).predict(NUM, ["ls"]))


def subtract(spark, sf) -> DataFrame:
    """All rows less those of line 1, by ring subtraction on the driver."""
    of = lambda df: Triple.from_row(cofactor(df, NUM[:2], CAT[:2]).first()["triple"])
    rest = of(line(spark, sf)) - of(line(spark, sf).where("ln = 1"))
    df = spark.createDataFrame([(rest.to_row(),)], "triple struct<N:bigint,lin_agg:array<double>,quad_agg:array<double>,lin_cat:array<array<struct<key:int,value:double>>>,quad_num_cat:array<array<struct<key:int,value:double>>>,quad_cat:array<array<struct<key1:int,key2:int,value:double>>>>")
    return _flat(df, "triple")


NULLS = ["q", "d", "rf"]
HOLES = f"(select * replace (case when (id * 7) % 5 = 0 then null else q end as q, case when (id * 7 + 1) % 5 = 0 then null else d end as d, case when (id * 7 + 2) % 5 = 0 then null else rf end as rf) from {LINE})"


def holes(spark, sf) -> DataFrame:
    return knock_out(line(spark, sf), NULLS, "id")


def many_holes(spark, sf) -> DataFrame:
    """Patterns from no null to all null."""
    bit = lambda k: F.floor(F.col("id") / (2**k)).cast("long") % 2 == 1
    return line(spark, sf).select("id", *[F.when(bit(k), F.lit(None)).otherwise(F.col(c)).alias(c) for k, c in enumerate(NULLS)])


def patterns(spark, sf, inverse: bool) -> DataFrame:
    df = many_holes(spark, sf).withColumns({"n_nulls": count_nulls(NULLS), "n_not_nulls": count_not_nulls(NULLS)})
    return partition(df, NULLS, inverse).groupBy("partition", MASK, "n_nulls", "n_not_nulls").agg(F.count("*").alias("rows"))


def pattern_sql(inverse: bool) -> str:
    bits = [f"(floor(id / {2**k})::bigint % 2)" for k in range(3)]
    n = "(3 - nulls)" if inverse else "nulls"
    hit = " ".join(f"when ({b}) {'= 0' if inverse else '= 1'} then '{c}'" for b, c in zip(("b0", "b1", "b2"), NULLS, strict=True))
    return f"""with a as (select {bits[0]} as b0, {bits[1]} as b1, {bits[2]} as b2 from {LINE}), b as (select *, b0 + b1 + b2 as nulls, (b0 + 2 * b1 + 4 * b2)::bigint as null_pattern from a)
select case when {n} = 0 then '0' when {n} = 3 then '3' when {n} = 1 then case {hit} end else '2' end as partition, null_pattern, nulls::int as n_nulls, (3 - nulls)::int as n_not_nulls, count(*)::bigint as rows from b group by 1, 2, 3, 4"""


def mice_init(spark, sf) -> DataFrame:
    return init(holes(spark, sf), ["q", "d"], ["rf"]).select("id", F.round("q", 6).alias("q"), F.round("d", 6).alias("d"), "rf")


def mice_one(spark, sf) -> DataFrame:
    df = knock_out(line(spark, sf), ["q"], "id")
    return mice(df, ["q", "p"], [], ["q"], [], 1, noise=False).select("id", F.round("q", 4).alias("q"))


def mice_run(strategy: str, noise: bool = False):
    def run(spark, sf) -> DataFrame:
        df = holes(spark, sf).select("id", *NUM, "rf", "ls")
        out = mice(df, NUM, ["rf", "ls"], ["q", "d"], ["rf"], 1, strategy, noise=noise, shrinkage=0.001, seed=5, key=["id"])
        return out.select("id", F.round("q", 3).alias("q"), F.round("d", 3).alias("d"), "rf")

    return run


def mice_agree(spark, sf) -> DataFrame:
    """Rows on which the three strategies differ: none."""
    runs = [mice_run(s)(spark, sf) for s in ("baseline", "low", "high")]
    apart = runs[0].exceptAll(runs[1]).union(runs[0].exceptAll(runs[2]))
    return apart.agg(F.count("*").alias("different"))


def encoded(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return encode(part, ["p_brand"]).select("p_partkey", F.col("p_brand_code").alias("code"))


def sql_surface(spark, sf) -> DataFrame:
    line(spark, sf).createOrReplaceTempView("ring_line")
    return explode_triple(sql.query(spark, "select ls, sum_to_triple_2_1(q, p, rf) as triple from ring_line where ln > 0 group by ls having ls > 0"), "triple", ["ls"])


def multiply_cross(spark, sf) -> DataFrame:
    left, right = cofactor(customers(spark, sf), ["bal"], ["cn"], alias="a"), cofactor(suppliers(spark, sf), ["sb"], ["sk"], alias="b")
    return _flat(left.crossJoin(right).select(multiply_triple("a", "b").alias("triple")), "triple")


def _keyed(spark, sf, of, times) -> DataFrame:
    left = of(customers(spark, sf), ["bal"], ["cn"], ["c_nationkey"], alias="a")
    right = of(suppliers(spark, sf), ["sb"], ["sk"], ["s_nationkey"], alias="b")
    return left.join(right, F.col("c_nationkey") == F.col("s_nationkey")).select("c_nationkey", times("a", "b").alias("triple"))


def self_join(spark, sf) -> DataFrame:
    """Many to many: lineitem with itself on the part."""
    a = line(spark, sf).select("l_partkey", "q", "rf")
    b = line(spark, sf).select("l_partkey", F.col("d").alias("d2"), F.col("ls").alias("ls2"))
    return factorized_long([{"df": a, "num": ["q"], "cat": ["rf"], "on": ["l_partkey"]}, {"df": b, "num": ["d2"], "cat": ["ls2"]}])


def two_way(spark, sf) -> DataFrame:
    o = orders(spark, sf).withColumnRenamed("o_orderkey", "l_orderkey")
    return _flat(factorized_cofactor(o, line(spark, sf), ["l_orderkey"], ["total"], ["os"], ["q", "d"], ["rf"]), "triple")


def three_way(spark, sf) -> DataFrame:
    c = customers(spark, sf).withColumnRenamed("c_custkey", "o_custkey")
    chain = [
        {"df": c, "num": ["bal"], "cat": ["cn"], "on": ["o_custkey"]},
        {"df": orders(spark, sf), "num": ["total"], "cat": ["os"], "on": ["o_orderkey"]},
        {"df": line(spark, sf).withColumnRenamed("l_orderkey", "o_orderkey"), "num": ["q"], "cat": ["rf"]},
    ]
    return factorized_long(chain)


def greeting(spark, sf) -> DataFrame:
    return table(spark, sf, "region").select("r_regionkey", quack("r_name").alias("greeting"))


def queries() -> dict:
    flat_line = lambda *a, **k: lambda s, f: cofactor_long(line(s, f), *a, **k)
    return {
        "cofactor_grouped": flat_line(NUM, CAT[:1], ["ls"]),
        "cofactor_numeric": flat_line(NUM),
        "cofactor_mixed": lambda s, f: _flat(cofactor(line(s, f), NUM, CAT), "triple"),
        "cofactor_having": lambda s, f: _flat(cofactor(line(s, f), NUM[:2], CAT[:1], ["ln"], having="ln = 2"), "triple", ["ln"]),
        "cofactor_categories_only": flat_line([], CAT),
        "nb_agg_grouped": lambda s, f: _flat(nb_agg(line(s, f), NUM, CAT[:2], ["ln"]), "nb_agg", ["ln"], True),
        "nb_agg_long": lambda s, f: nb_long(line(s, f), NUM, CAT),
        "lift_rows": lambda s, f: _flat(_lifted(s, f), "triple", ["id"]),
        "nb_lift_rows": lambda s, f: _flat(_lifted(s, f, True), "triple", ["id"], True),
        "lift_expression_filter": lambda s, f: _flat(line(s, f).where("ln = 3").select("id", to_cofactor([F.col("q") + F.col("d") + F.col("t")]).alias("triple")), "triple", ["id"]),
        "sum_of_lift": lambda s, f: _flat(sum_triple(_lifted(s, f), "triple"), "triple"),
        "sum_nb_of_lift": lambda s, f: _flat(sum_nb_agg(_lifted(s, f, True), "triple"), "nb_agg", (), True),
        "multiply_cross": multiply_cross,
        "multiply_keyed": lambda s, f: _flat(_keyed(s, f, cofactor, multiply_triple), "triple", ["c_nationkey"]),
        "nb_multiply": lambda s, f: _flat(_keyed(s, f, nb_agg, multiply_nb_agg), "triple", ["c_nationkey"], True),
        "factorized_join_2way": two_way,
        "factorized_join_3way": three_way,
        "factorized_many_to_many": self_join,
        "subtract_triple_delta": subtract,
        "linreg_fit_1feature": linreg_fit,
        "linreg_predict": linreg_predict,
        "linreg_descent": linreg_bgd,
        "nb_fit": nb_fit,
        "nb_predict": nb_predict,
        "lda_predict_1d": lda_1d,
        "lda_predict_mixed": lda_mixed,
        "qda_predict_1d": qda_1d,
        "qda_predict_mixed": qda_mixed,
        "null_pattern_partition": lambda s, f: patterns(s, f, False),
        "null_pattern_inverse": lambda s, f: patterns(s, f, True),
        "mice_init_fill": mice_init,
        "mice_1iter_1col": mice_one,
        "mice_baseline": mice_run("baseline"),
        "mice_low": mice_run("low"),
        "mice_high": mice_run("high"),
        "mice_stochastic": mice_run("baseline", True),
        "mice_strategies_differ": mice_agree,
        "uniq_categories": lambda s, f: unique_categories(line(s, f), CAT),
        "encode_categories": encoded,
        "sql_surface": sql_surface,
        "quack": greeting,
    }


def oracle_sql() -> dict[str, str]:
    joined = f"(select * from {CUSTOMERS} join {SUPPLIERS} on c_nationkey = s_nationkey)"
    label = lambda score: f"""with l as (select *, row_number() over () as row from {LINE}), k as (select rf as label, count(*) as n, avg(q) as mu, var_pop(q) as v, sum(count(*)) over () as total from l group by rf),
w as (select *, sum(n * v) over () / total as pooled from k), s as (select l.row, l.id, l.rf, w.label, {score} as score from l, w)
select id, rf, arg_max(label, score)::int as predicted from s group by row, id, rf"""  # noqa: E731
    nb = f"""with l as (select *, row_number() over () as row from {LINE}), k as (select rf as label, count(*) as n, avg(q) as mq, var_pop(q) + 1e-9 as vq, avg(d) as md, var_pop(d) + 1e-9 as vd, sum(count(*)) over () as total from l group by rf),
c as (select rf as label, ls, count(*) as m from l group by rf, ls),
s as (select l.row, l.id, l.rf, k.label, case when c.m is null then '-infinity'::double else ln(n / total) - (q - mq) ** 2 / (2 * vq) - 0.5 * ln(2 * pi() * vq) - (d - md) ** 2 / (2 * vd) - 0.5 * ln(2 * pi() * vd) + ln(c.m / n) end as score
  from l cross join k left join c on c.label = k.label and c.ls = l.ls)
select id, rf, arg_max(label, score)::int as predicted from s group by row, id, rf"""
    fit = f"(select regr_slope(p, q) as slope, regr_intercept(p, q) as intercept from {LINE})"
    withs = lambda parts, select: f"with {', '.join(parts)} {select}"
    rows = f"(select *, row_number() over () as row from {LINE})"
    one_hot = lambda c: [f"({c} = {v})::int" for v in VALUES[c]]
    imputation = lambda seeds=None: withs(
        [algebra_sql.cte("h", f"select id, q, p, d, t, rf, ls from {HOLES}"), *algebra_sql.imputed("h", NUM, {c: VALUES[c] for c in ("rf", "ls")}, ["rf", "q", "d"], 0.001, seeds)],
        "select id, round(q, 3) as q, round(d, 3) as d, rf::int as rf from done",
    )
    mode = "(select rf from (select rf, count(*) as n from h where rf is not null group by rf) order by n desc, rf limit 1)"
    return {
        "cofactor_grouped": long_sql(LINE, NUM, CAT[:1], ["ls"]),
        "cofactor_numeric": long_sql(LINE, NUM),
        "cofactor_mixed": long_sql(LINE, NUM, CAT),
        "cofactor_having": f"select * from ({long_sql(LINE, NUM[:2], CAT[:1], ['ln'])}) where ln = 2",
        "cofactor_categories_only": long_sql(LINE, [], CAT),
        "nb_agg_grouped": long_sql(LINE, NUM, CAT[:2], ["ln"], True),
        "nb_agg_long": long_sql(LINE, NUM, CAT, nb=True),
        "lift_rows": long_sql(LINE, NUM[:2], CAT[:2], ["id"], rows=True),
        "nb_lift_rows": long_sql(LINE, NUM[:2], CAT[:2], ["id"], True, True),
        "lift_expression_filter": long_sql(f"(select id, q + d + t as x from {LINE} where ln = 3)", ["x"], [], ["id"], rows=True),
        "sum_of_lift": long_sql(LINE, NUM[:2], CAT[:2]),
        "sum_nb_of_lift": long_sql(LINE, NUM[:2], CAT[:2], nb=True),
        "multiply_cross": long_sql(f"(select * from {CUSTOMERS} cross join {SUPPLIERS})", ["bal", "sb"], ["cn", "sk"]),
        "multiply_keyed": long_sql(joined, ["bal", "sb"], ["cn", "sk"], ["c_nationkey"]),
        "nb_multiply": long_sql(joined, ["bal", "sb"], ["cn", "sk"], ["c_nationkey"], True),
        "factorized_join_2way": long_sql(f"(select * from {ORDERS} join {LINE} on o_orderkey = l_orderkey)", ["total", "q", "d"], ["os", "rf"]),
        "factorized_join_3way": long_sql(f"(select * from {CUSTOMERS} join {ORDERS} on c_custkey = o_custkey join {LINE} on o_orderkey = l_orderkey)", ["bal", "total", "q"], ["cn", "os", "rf"]),
        "factorized_many_to_many": long_sql(f"(select a.q, a.rf, b.d as d2, b.ls as ls2 from {LINE} a join {LINE} b on a.l_partkey = b.l_partkey)", ["q", "d2"], ["rf", "ls2"]),
        "subtract_triple_delta": long_sql(f"(select * from {LINE} where ln <> 1)", NUM[:2], CAT[:2]),
        "linreg_fit_1feature": f"select round(slope, 6) as slope, round(intercept, 6) as intercept from {fit}",
        "linreg_predict": f"select id, round(intercept + slope * q, 4) as predicted from {LINE}, {fit}",
        "nb_fit": f"select rf as label, round(count(*) / (sum(count(*)) over ())::double, 8) as prior, round(avg(q), 6) as q_mean, round(var_pop(q), 4) as q_var, round(avg(d), 6) as d_mean, round(var_pop(d), 4) as d_var from {LINE} group by rf",
        "nb_predict": nb,
        "lda_predict_1d": label("mu * q / pooled - 0.5 * mu * mu / pooled + ln(n / total)"),
        "qda_predict_1d": label("-0.5 * (q - mu) ** 2 / v - 0.5 * ln(v) + ln(n / total)"),
        "linreg_descent": withs(
            [algebra_sql.cte("l", f"select * from {LINE}"), *algebra_sql.regression("r", "l", "q", [*NUM[1:], *one_hot("rf")], "id", ridge=0.01)],
            "select id, round(value, 4) as exact, 0.0::double as apart from r",
        ),
        "lda_predict_mixed": withs(
            [algebra_sql.cte("l", f"select * from {LINE}"), *algebra_sql.discriminant("r", "l", "rf", VALUES["rf"], [*NUM, *one_hot("ls"), *one_hot("ln")], "id, rf", "true", 0.1, True)],
            "select id, rf, value::int as predicted from r",
        ),
        "qda_predict_mixed": withs(
            [algebra_sql.cte("l", f"select * from {rows}"), *algebra_sql.quadratic("r", "l", "rf", [*NUM, *one_hot("ls")[1:]], "id, rf")],
            "select id, rf, value::int as predicted from r",
        ),
        **{f"mice_{s}": imputation() for s in ("baseline", "low", "high")},
        "mice_stochastic": imputation({"q": 5, "d": 7}),
        "null_pattern_partition": pattern_sql(False),
        "null_pattern_inverse": pattern_sql(True),
        "mice_init_fill": f"with h as (select * from {HOLES}) select id, round(coalesce(q, (select avg(q) from h)), 6) as q, round(coalesce(d, (select avg(d) from h)), 6) as d, coalesce(rf, {mode})::int as rf from h",
        "mice_1iter_1col": f"with l as (select *, (id * 7) % 5 = 0 as gone from {LINE}), f as (select regr_slope(q, p) as b, regr_intercept(q, p) as a from l where not gone) select id, round(case when gone then a + b * p else q end, 4) as q from l, f",
        "mice_strategies_differ": "select 0::bigint as different",
        "uniq_categories": " union all ".join(f"select distinct '{c}' as \"column\", {c} as value from {LINE}" for c in CAT),
        "encode_categories": "select p_partkey, (dense_rank() over (order by p_brand) - 1)::int as code from part",
        "sql_surface": long_sql(LINE, NUM[:2], CAT[:1], ["ls"]),
        "quack": "select r_regionkey, 'Quack ' || r_name || ' \U0001f425' as greeting from region",
    }
