import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from ringspark.functions.ring import multiply_nb_agg, multiply_triple, to_cofactor, to_nb_agg
from ringspark.ml.triple import Triple
from ringspark.operators.aggregate import cofactor, nb_agg, sum_nb_agg, sum_triple
from ringspark.operators.factorized import factorized_cofactor
from ringspark.plans.sql import lift_values, register

ROWS = [(1, 1.0, 2.0, 3.0, 4, 5, 6), (1, 5.0, 6.0, 7.0, 8, 9, 10), (2, 2.0, 1.0, 3.0, 4, 6, 8), (2, 5.0, 7.0, 6.0, 8, 10, 12), (2, 2.0, 1.0, 3.0, 4, 6, 8)]


@pytest.fixture(scope="module")
def toy(spark):
    df = spark.createDataFrame(ROWS, "gb int, a double, b double, c double, d int, e int, f int").cache()
    df.createOrReplaceTempView("toy")
    return df


def test_global(toy):
    t = cofactor(toy, ["a", "b", "c"], ["d", "e", "f"]).first()["triple"]
    assert t.N == 5 and t.lin_agg == [15, 17, 22] and t.quad_agg == [59, 71, 80, 91, 96, 112]
    assert [tuple(e) for e in t.lin_cat[0]] == [(4, 3), (8, 2)]
    assert [tuple(e) for e in t.quad_cat[1]] == [(4, 5, 1), (4, 6, 2), (8, 9, 1), (8, 10, 1)]


def test_sum_of_lift_is_fused(toy):
    num, cat = ["a", "b", "c"], ["d", "e", "f"]
    lifted = toy.select("gb", to_cofactor(num, cat).alias("t"), to_nb_agg(num, cat).alias("n"))
    assert sorted(sum_triple(lifted, "t", ["gb"]).collect()) == sorted(cofactor(toy, num, cat, ["gb"]).collect())
    assert sorted(sum_nb_agg(lifted, "n", ["gb"]).collect()) == sorted(nb_agg(toy, num, cat, ["gb"]).collect())


def test_products_of_groups(toy):
    """Products of mixed groups; all four together equal the product of the sums."""
    left = cofactor(toy, ["b", "c"], ["d", "e"], ["gb"], alias="x").withColumnRenamed("gb", "g")
    right = cofactor(toy, ["a", "c"], ["d", "f"], ["gb"], alias="y")
    got = {(r.g, r.gb): r.z for r in left.crossJoin(right).select("g", "gb", multiply_triple("x", "y").alias("z")).collect()}
    assert got[1, 2].lin_num == [24, 30, 18, 24] and got[1, 2].quad_num == [120, 144, 72, 96, 174, 90, 120, 66, 84, 108]
    assert got[2, 1].lin_num == [18, 24, 18, 30] and got[2, 1].quad_num == [102, 96, 54, 90, 108, 72, 120, 78, 114, 174]
    total = sum((Triple.from_row(v) for v in got.values()), Triple())
    whole = Triple.from_row(cofactor(toy, ["b", "c"], ["d", "e"]).first()[0]) * Triple.from_row(cofactor(toy, ["a", "c"], ["d", "f"]).first()[0])
    assert total.to_row() == whole.to_row()


def test_nb_products(toy):
    x, y = nb_agg(toy.where("gb = 1"), ["b", "c"], ["d", "e"], alias="x"), nb_agg(toy.where("gb = 2"), ["a", "c"], ["d", "f"], alias="y")
    z = x.crossJoin(y).select(multiply_nb_agg("x", "y").alias("z")).first().z
    assert z.N == 6 and z.lin_num == [24, 30, 18, 24] and z.quad_num == [120, 174, 66, 108]


@pytest.mark.parametrize("nb", [False, True])
def test_factorized_equals_join(toy, nb):
    left, right = toy.select("gb", "b", "d"), toy.selectExpr("gb", "a as p", "f as q")
    of = nb_agg if nb else cofactor
    assert factorized_cofactor(left, right, ["gb"], ["b"], ["d"], ["p"], ["q"], nb=nb).first()[0] == of(left.join(right, "gb"), ["b", "p"], ["d", "q"]).first()[0]


def test_categories_only_product(toy):
    x, y = cofactor(toy, [], ["d"], alias="x"), cofactor(toy, [], ["f"], alias="y")
    z = x.crossJoin(y).select(multiply_triple("x", "y").alias("z")).first().z
    assert z.N == 25 and [tuple(e) for e in z.lin_cat[0]] == [(4, 15), (8, 10)] and z.lin_num == []


def test_empty_and_nulls(spark, toy):
    t = cofactor(toy.where("gb = 9"), ["a"], ["d"]).first()["triple"]
    assert t.N == 0 and t.lin_agg == [0] and t.lin_cat == [[]]
    assert cofactor(toy.where("gb = 9"), ["a"], ["d"], ["gb"]).count() == 0
    holes = spark.createDataFrame([(1.0, 1), (None, 2), (3.0, None)], "x double, k int")
    assert cofactor(holes, ["x"], ["k"], nulls="skip").first()["triple"].N == 1
    with pytest.raises(PySparkException):
        cofactor(holes, ["x"], ["k"]).collect()
    with pytest.raises(TypeError):
        cofactor(toy.selectExpr("cast(d as string) as d"), [], ["d"])


table = st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5), st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=12)


def lifted(rows):
    a = np.array(rows)
    return lift_values([a[:, 0], a[:, 1], a[:, 2], a[:, 3]], 2)


@settings(max_examples=60, deadline=None)
@given(table, table, table)
def test_ring_laws(x, y, z):
    a, b, c = lifted(x), lifted(y), lifted(z)
    assert ((a + b) + c).to_row() == (a + (b + c)).to_row() and (a + b).to_row() == (b + a).to_row()
    assert (a + b).to_row() == lifted(x + y).to_row()
    assert ((a + b) - b).to_row() == a.to_row()
    assert ((a + b) * c).to_row() == (a * c + b * c).to_row()


def test_sql_names(spark, toy):
    register(spark, [(3, 3)])
    fused, summed = spark.sql("select sum_to_triple_3_3(a, b, c, d, e, f), sum_triple(to_cofactor(a, b, c, d, e, f)) from toy").first()
    assert fused == summed == cofactor(toy, ["a", "b", "c"], ["d", "e", "f"]).first()[0]
    labels = spark.sql(
        "with m as (select lda_train(sum_to_triple_3_3(a, b, c, d, e, f), 0, 0.4D, false) as p from toy) select lda_predict(p, false, a, b, c, e, f) as k from toy, m"
    ).collect()
    assert sorted(r.k for r in labels) == [0, 0, 0, 1, 1]
    assert spark.sql("select quack('x')").first()[0].startswith("Quack x")
