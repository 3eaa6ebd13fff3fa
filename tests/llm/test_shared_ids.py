"""Vectors whose ids are null or repeat."""

from ringspark.llm import embeddings


def test_vectors_that_share_an_id_are_not_one(spark):
    a, b, c, d = ([float(k == j) for k in range(4)] for j in range(4))
    near = lambda v: [x + 0.01 for x in v]
    rows = [(None, a), (1, near(a)), (2, a), (None, b), (3, near(b)), (4, b), (7, c), (8, near(c)), (7, d), (9, near(d)), (None, [1.0, 1.0, 0.0, 0.0]), (None, [1.01, 1.0, 0.0, 0.0])]
    for block in (2, 8192):
        out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()
        got = sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in out if r.component_id is not None)
        want = [(None, 2, 1, False), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 3, False), (3, 2, 3, True), (4, 2, 3, False), (7, 1, 7, True), (8, 1, 7, False), (7, 1, 7, True), (9, 1, 7, False)]
        assert got == sorted(map(str, want))
        assert sorted((r.n_links, r.kept) for r in out if r.component_id is None) == [(1, False), (1, True)]
