import pytest
from pyspark.sql import functions as F

from ringspark.plans.catalogue import line
from ringspark.plans.mice import init, knock_out, mice, partition

SF = "/root/testdata/sf0.001"
NUM, CAT = ["q", "p", "d"], ["rf", "ls"]


@pytest.fixture(scope="module")
def holes(spark):
    return knock_out(line(spark, SF).dropDuplicates(["id"]).select("id", *NUM, *CAT), ["q", "d", "rf"], "id").cache()


@pytest.mark.parametrize("order", ["cat_first", "num_first"])
def test_strategies_agree(holes, order):
    rows = [
        mice(holes, NUM, CAT, ["q", "d"], ["rf"], 2, s, order, noise=False, shrinkage=0.01).orderBy("id").toPandas() for s in ("baseline", "low", "high")
    ]
    assert list(rows[0].columns) == holes.columns and rows[0].notna().all().all()
    for other in rows[1:]:
        assert (rows[0] - other).abs().max().max() < 1e-6


def test_observed_values_stay(holes):
    out = mice(holes, NUM, CAT, ["q", "d"], ["rf"], 1, key=["id"], seed=4).withColumnsRenamed({c: "new_" + c for c in ("q", "d", "rf")})
    both = holes.join(out.select("id", "new_q", "new_d", "new_rf"), "id")
    for c in ("q", "d", "rf"):
        assert both.where(F.col(c).isNotNull() & (F.col(c) != F.col("new_" + c))).count() == 0
    again = mice(holes.repartition(3), NUM, CAT, ["q", "d"], ["rf"], 1, key=["id"], seed=4)
    a, b = (d.orderBy("id").toPandas().q for d in (out.withColumnRenamed("new_q", "q").select("id", "q"), again.select("id", "q")))
    assert (a - b).abs().max() < 1e-6


def test_one_column(holes):
    df = holes.select("id", "q", "p")
    frames = [mice(df, ["q", "p"], [], ["q"], [], 1, s, noise=False).orderBy("id").toPandas() for s in ("baseline", "low", "high")]
    assert all((frames[0] - f).abs().max().max() < 1e-6 for f in frames[1:])


def test_partitions_are_disjoint(holes):
    parts = partition(holes, ["q", "d", "rf"]).groupBy("partition").count().collect()
    assert sum(r["count"] for r in parts) == holes.count() and {r["partition"] for r in parts} <= {"0", "2", "3", "q", "d", "rf"}
    assert init(holes, ["q", "d"], ["rf"]).where("q is null or d is null or rf is null").count() == 0


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0)], "id int, q double, p double")
    assert mice(df, ["q", "p"], [], ["q"], [], 1, noise=False).where("q = 0").count() == 2
