"""The functions as SQL sees them."""

import re
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException

from ringspark.functions.ring import multiply_nb_agg, multiply_triple
from ringspark.operators.aggregate import cofactor, nb_agg
from ringspark.plans.sql import query, register

ROWS = [(1, 1.0, 2.0, 3.0, 4, 5, 6), (1, 5.0, 6.0, 7.0, 8, 9, 10), (2, 2.0, 1.0, 3.0, 4, 6, 8), (2, 5.0, 7.0, 6.0, 8, 10, 12), (2, 2.0, 1.0, 3.0, 4, 6, 8)]
NUM, CAT = ["a", "b", "c"], ["d", "e", "f"]


@pytest.fixture(scope="module")
def toy(spark):
    df = spark.createDataFrame(ROWS, "gb int, a double, b double, c double, d int, e int, f int").cache()
    df.createOrReplaceTempView("toy_sql")
    register(spark, [(3, 3), (2, 1)])
    return df


def python_nodes(df):
    return re.findall(r"ArrowAggregatePython|ArrowEvalPython|BatchEvalPython|MapInArrow", df._jdf.queryExecution().executedPlan().toString())


def test_every_shape_registers(spark):
    start = time.time()
    register(spark)
    assert time.time() - start < 120 and spark.sql("select sum_to_triple_0_1(id) from (select 1 as id)").first()[0].N == 1
    for n, m in ((19, 19), (0, 19), (19, 0)):
        assert spark.catalog.functionExists(f"sum_to_triple_{n}_{m}") and spark.catalog.functionExists(f"sum_to_nb_agg_{n}_{m}")


def test_grouped_having(spark, toy):
    for name, of in (("sum_to_triple_3_3", cofactor), ("sum_to_nb_agg_3_3", nb_agg)):
        got = query(spark, f"select gb, {name}(a, b, c, d, e, f) as t from toy_sql group by gb having gb = 2")
        assert not python_nodes(got) and got.collect() == of(toy, NUM, CAT, ["gb"]).where("gb = 2").collect()
        assert query(spark, f"SELECT {name}(a,b,c,d,e,f) FROM toy_sql").first()[0] == of(toy, NUM, CAT).first()[0]
    with pytest.raises(PySparkException):
        query(spark, "select gb, sum_to_triple_2_1(a, b, d) from toy_sql group by gb having a > 1")


def test_having_reaches_the_scan(spark, tmp_path, toy):
    toy.write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    plan = cofactor(stored, ["a"], ["d"], ["gb"], having="gb = 2")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gb,2)" in plan
    with pytest.raises(PySparkException):
        cofactor(stored, ["a"], ["d"], ["gb"], having="a = 2")


def test_sums_of_lifts_and_several_at_once(spark, toy):
    text = "select gb, sum_triple(to_cofactor(a, b, c, d, e, f)) as s, sum_to_triple_3_3(a, b, c, d, e, f) as t, sum_nb_agg(to_nb_agg(a, b, c, d, e, f)) as u from toy_sql group by gb order by gb desc"
    got = query(spark, text).collect()
    assert [r.gb for r in got] == [2, 1] and all(r.s == r.t for r in got)
    assert [r.u for r in got] == [r[1] for r in nb_agg(toy, NUM, CAT, ["gb"]).orderBy("gb", ascending=False).collect()]
    assert got == spark.sql(text).collect()
    beside = query(spark, "select gb, count(*) as n, sum_to_triple_2_1(a, b, d) as t from toy_sql group by gb").collect()
    assert {(r.gb, r.n, r.t.N) for r in beside} == {(1, 2, 2), (2, 3, 3)}


def test_types_decide(spark, toy):
    t = spark.sql("select to_cofactor(1.5, 2) as t").first().t
    assert t.lin_num == [1.5] and [tuple(e) for e in t.lin_cat[0]] == [(2, 1.0)] and t.N == 1
    n = spark.sql("select to_nb_agg(cast(1.5 as decimal(10, 3)), 2.5f, 7L) as t").first().t
    assert n.lin_num == [1.5, 2.5] and n.quad_num == [2.25, 6.25] and [tuple(e) for e in n.lin_cat[0]] == [(7, 1.0)]
    for bad in ("to_cofactor('x')", "to_cofactor(1.5, cast(null as int))", "to_cofactor(true)"):
        with pytest.raises(PySparkException):
            spark.sql(f"select {bad}").collect()


def test_products_are_native(spark, toy):
    x, y = cofactor(toy.where("gb = 1"), ["b", "c"], ["d", "e"], alias="x"), cofactor(toy.where("gb = 2"), ["a", "c"], ["d", "f"], alias="y")
    u, v = nb_agg(toy.where("gb = 1"), ["b", "c"], ["d", "e"], alias="u"), nb_agg(toy.where("gb = 2"), ["a", "c"], ["d", "f"], alias="v")
    x.crossJoin(y).crossJoin(u).crossJoin(v).createOrReplaceTempView("sides")
    got = spark.sql("select multiply_triple(x, y) as t, multiply_nb_agg(u, v) as n, quack('x') as q from sides")
    assert not python_nodes(got)
    t, n, q = got.first()
    assert t == x.crossJoin(y).select(multiply_triple("x", "y")).first()[0] and n == u.crossJoin(v).select(multiply_nb_agg("u", "v")).first()[0] and q.startswith("Quack x")
    only = spark.sql("select multiply_triple(to_cofactor(1), to_cofactor(2.5D)) as t").first().t
    assert only.lin_num == [2.5] and [tuple(e) for e in only.lin_cat[0]] == [(1, 1.0)] and [tuple(e) for e in only.quad_num_cat[0]] == [(1, 2.5)]


def test_models_score_as_expected(spark):
    """Train, then predict over the test rows, as a user of SQL would; numpy gives the expected scores."""
    rng = np.random.default_rng(8)
    k = rng.integers(0, 3, 900)
    x = np.column_stack([rng.normal(2 * k, 1), rng.normal(-k, 1), rng.normal(0, 1, 900), rng.normal(k == 1, 1)])
    y = x @ [1.5, -2.0, 0.5, 3.0] + 4 + rng.normal(0, 0.1, 900)
    rows = [(i, *map(float, x[i]), float(y[i]), int(k[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, s double, t double, u double, v double, y double, k int")
    df.where("id < 600").createOrReplaceTempView("blob_train")
    df.where("id >= 600").createOrReplaceTempView("blob_test")
    register(spark, [(4, 1), (4, 0), (5, 0)])
    score = lambda text: spark.sql(text).first()[0]
    train, test = slice(0, 600), slice(600, 900)
    mu, share = np.array([x[train][k[train] == c].mean(0) for c in range(3)]), [(k[train] == c).mean() for c in range(3)]
    covs = [np.cov(x[train][k[train] == c].T, bias=True) for c in range(3)]
    within = sum(s * c for s, c in zip(share, covs, strict=True))
    linear = x[test] @ np.linalg.solve(within, mu.T) - 0.5 * np.einsum("kp,pk->k", mu, np.linalg.solve(within, mu.T)) + np.log(share)
    gauss = lambda c, cov: -0.5 * np.einsum("ip,pq,iq->i", x[test] - mu[c], np.linalg.inv(cov), x[test] - mu[c]) - 0.5 * np.log(np.linalg.det(cov)) + np.log(share[c])
    accuracy = lambda s: (np.argmax(s, 1) == k[test]).mean()
    got = score("with m as (select lda_train(sum_to_triple_4_1(s, t, u, v, k), 0, 0.0D, false) as p from blob_train) select avg(int(lda_predict(p, false, s, t, u, v) = k)) from blob_test, m")
    assert got == pytest.approx(accuracy(linear), abs=0.005)
    classes = "with c as (select k, {0}_4_0(s, t, u, v) as a from blob_train group by k), l as (select array_sort(collect_list(struct(k, a))) as x from c), m as (select {1} as p from l)"
    got = score(classes.format("sum_to_triple", "qda_train(x.a, x.k, false)") + " select avg(int(qda_predict(p, false, s, t, u, v) = k)) from blob_test, m")
    assert got == pytest.approx(accuracy(np.column_stack([gauss(c, covs[c]) for c in range(3)])), abs=0.005)
    got = score(classes.format("sum_to_nb_agg", "nb_train(x.a, x.k)") + " select avg(int(nb_predict(p, false, s, t, u, v) = k)) from blob_test, m")
    assert got == pytest.approx(accuracy(np.column_stack([gauss(c, np.diag(np.diag(covs[c]))) for c in range(3)])), abs=0.005)
    fit = "with m as (select linreg_train(sum_to_triple_5_0(y, s, t, u, v), 0, 0.001D, 0.0D, 10000, true, {0}) as p from blob_train), r as (select y, linreg_predict(p, {1}, {0}, s, t, u, v) as f from blob_test, m)"
    r2 = "select 1 - sum((y - f) * (y - f)) / (count(*) * var_pop(y)) from r"
    design = np.column_stack([np.ones(900), x])
    beta = np.linalg.lstsq(design[train], y[train], rcond=None)[0]
    want = 1 - ((y - design @ beta)[test] ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum()
    for normalize in ("true", "false"):
        assert score(fit.format(normalize, "false") + r2) == pytest.approx(want, abs=0.001)
    noisy = score(fit.format("true", "true") + "select stddev_pop(y - f) from r")
    assert 0.1 < noisy < 0.2  # the residual's deviation and the draw's
