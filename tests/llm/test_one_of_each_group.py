"""The pipeline's near-dedup where ids repeat or are null."""

from ringspark.llm import neardup


def test_one_row_of_each_group_stays(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(100)) for k in "abcde"}
    rows = [(1, text["a"], "s")] * 3 + [(None, text["a"], "s"), (2, text["a"] + " end", "s"), (7, text["a"], "s"), (7, text["b"], "s")]
    rows += [(None, text["c"], "s"), (None, text["c"], "t"), (None, text["c"] + " end", "s"), (8, text["d"], "t"), (8, text["d"], "s"), (None, text["e"], None)]
    rows += [(3, None, "s"), (3, None, "s"), (None, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [tuple(r) for r in neardup.stage(spark, docs, None).collect()]
    own = [x for x in out if x[1] and x[1][0] == "c"]
    assert len(own) == 1 and own[0][0] is None
    want = [(1, text["a"], "s"), (7, text["b"], "s"), (8, text["d"], "s"), (None, text["e"], None), (3, None, "s"), (3, None, "s"), (None, "", "s")]
    assert sorted(map(str, out)) == sorted(map(str, want + own))
