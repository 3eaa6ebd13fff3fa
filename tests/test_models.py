import numpy as np
import pytest

from ringspark.ml.models import LDA, QDA, LinearRegression, NaiveBayes
from ringspark.ml.triple import NbAgg, Triple
from ringspark.operators.aggregate import cofactor, nb_agg

NUM = ["x", "y", "z"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    k = rng.integers(0, 3, 600)
    c = rng.integers(1, 4, 600)
    x = rng.normal(k, 1)
    y = rng.normal(2 * (k == 1), 0.5)
    z = 3 * x - y + c + 0.1 * rng.normal(size=600)
    rows = [(i, *map(float, v), int(a) + 5, int(b)) for i, (*v, a, b) in enumerate(zip(x, y, z, k, c, strict=True))]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, k int, c int").cache()
    return df, np.array([r[1:] for r in rows])


def predicted(df, column):
    return np.array([r[0] for r in df.orderBy("id").select(column).collect()], float)


@pytest.mark.parametrize("normalize", [False, True])
@pytest.mark.parametrize("solver", ["exact", "bgd"])
def test_linear(data, normalize, solver):
    df, a = data
    t = Triple.from_row(cofactor(df, NUM, ["c"]).first()["triple"])
    m = LinearRegression.fit(t, 2, normalize=normalize, include_variance=True, solver=solver)
    design = np.column_stack([np.ones(len(a)), a[:, :2], *[a[:, 4] == k for k in (1, 2, 3)]])
    want = design @ np.linalg.lstsq(design, a[:, 2], rcond=None)[0]
    got = predicted(df, m.predict(["x", "y"], ["c"]))
    assert np.abs(got - want).max() < (1e-6 if solver == "exact" else 1e-2)
    assert m.std == pytest.approx(np.std(a[:, 2] - want), rel=1e-2)
    again = LinearRegression.from_params(m.to_params(), 2, normalize, True)
    assert np.allclose(predicted(df, again.predict(["x", "y"], ["c"])), got)
    import pyspark.sql.functions as F

    assert np.isfinite(predicted(df, m.predict(["x", "y"], [F.lit(99)]))).all()


@pytest.mark.parametrize("normalize", [False, True])
def test_lda(data, normalize):
    df, a = data
    t = Triple.from_row(cofactor(df, NUM[:2], ["k", "c"]).first()["triple"])
    m = LDA.fit(t, 0, 0.0, normalize)
    x = np.column_stack([a[:, :2], *[a[:, 4] == k for k in (1, 2, 3)]])
    within = sum(np.cov(x[a[:, 3] == k].T, bias=True) * (a[:, 3] == k).sum() for k in (5, 6, 7)) / len(a)
    mu = np.array([x[a[:, 3] == k].mean(0) for k in (5, 6, 7)])
    w = mu @ np.linalg.pinv(within)
    scores = x @ w.T - 0.5 * np.einsum("kp,kp->k", mu, w) + np.log([(a[:, 3] == k).mean() for k in (5, 6, 7)])
    got = predicted(df, m.predict(NUM[:2], ["c"]))
    assert (got == scores.argmax(1) + 5).mean() > 0.99
    assert (predicted(df, m.predict(NUM[:2], ["c"], "index")) + 5 == got).all()
    assert (predicted(df, LDA.from_params(m.to_params(), normalize, 2).predict(NUM[:2], ["c"])) == got).all()


def classes(df, of, value, num, cat):
    rows = of(df, num, cat, ["k"]).orderBy("k").collect()
    return [value.from_row(r[1]) for r in rows], [r[0] for r in rows]


@pytest.mark.parametrize("normalize", [False, True])
def test_qda(data, normalize):
    df, a = data
    m = QDA.fit(*classes(df, cofactor, Triple, NUM[:2], ["c"]), normalize=normalize)
    x = np.column_stack([a[:, :2], a[:, 4] == 2, a[:, 4] == 3])
    scores = []
    for k in (5, 6, 7):
        part = x[a[:, 3] == k]
        cov, mu = np.cov(part.T, bias=True), part.mean(0)
        d = x - mu
        scores.append(-0.5 * np.einsum("ip,pq,iq->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)) + np.log(len(part) / len(x)))
    got = predicted(df, m.predict(NUM[:2], ["c"]))
    assert (got == np.argmax(scores, 0) + 5).all()
    assert (predicted(df, QDA.from_params(m.to_params(), normalize, 2).predict(NUM[:2], ["c"])) == got).all()


def test_bayes(data):
    df, a = data
    m = NaiveBayes.fit(*classes(df, nb_agg, NbAgg, NUM[:2], ["c"]))
    scores = []
    for k in (5, 6, 7):
        part = a[a[:, 3] == k]
        s = np.log(len(part) / len(a)) + np.zeros(len(a))
        for i in range(2):
            v = part[:, i].var() + 1e-9
            s -= (a[:, i] - part[:, i].mean()) ** 2 / (2 * v) + 0.5 * np.log(2 * np.pi * v)
        scores.append(s + np.log([(part[:, 4] == c).mean() for c in a[:, 4]]))
    got = predicted(df, m.predict(NUM[:2], ["c"]))
    assert (got == np.argmax(scores, 0) + 5).all()
    assert (predicted(df, NaiveBayes.from_params(m.to_params(), 2).predict(NUM[:2], ["c"])) == got).all()


def test_single_class_and_constant(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0, 7), (2, 2.0, 3.0, 7)], "id int, x double, y double, k int")
    t = Triple.from_row(cofactor(df, ["x", "y"], ["k"]).first()["triple"])
    assert set(predicted(df, LDA.fit(t, 0, 0.1, True).predict(["x", "y"]))) == {7}
    assert np.isfinite(LinearRegression.fit(t, 1, normalize=True).to_params()).all()
