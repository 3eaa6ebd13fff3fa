"""Callers' columns that have the names of results, of every operator and every stage."""

import pytest
from pyspark.sql import functions as F

from ringspark.llm import common, embeddings, language, lines, media, mixing, neardup, toxicity, urls
from tests.llm.test_operators import SCHEMA

NAMES = "toxicity mix language media features lines pii n_links component_id kept host path rule verdict size target id h copies part score words at __0 __h __id __copy __own __row".split()


@pytest.fixture(scope="module")
def docs(spark):
    body = "\n".join(f"line number {k} of a passage that several share" for k in range(6))
    rows = [(k, f"own words of {k} come first {k} {k}\n{body}\nand these are the last of {k}", "en", "ab"[k % 2], 9) for k in range(8)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (None, "no id here at all", "en", None, 4), (3, "another text with the id of three", "en", "a", 3)]
    out = spark.createDataFrame(rows, SCHEMA)
    return out.withColumns({n: F.concat(F.lit(n + " of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in NAMES})


def kept(before, after, results, same_rows=True):
    """Every column of before is there, under its name or the next free one, with its values."""
    now = {c: c if c not in results else c + "_1" for c in before.columns if c != "text"}
    assert set(now.values()) | set(results) <= set(after.columns) and len(after.columns) == len(set(after.columns))
    got = after.select(*[F.col(f"`{new}`").alias(old) for old, new in now.items()])
    want = before.select(*now)
    assert got.exceptAll(want).count() == 0 and (not same_rows or got.count() == want.count())


def test_operators_keep_the_callers_columns(docs):
    kept(docs, toxicity.score(docs, toxicity.Lexicon({" bad": 1.0}, (), (0.0, 1.0, 0.0, 0.0))), ["toxicity"])
    kept(docs, mixing.mix(docs), ["mix"])
    kept(docs, language.predict(docs, language.train(docs)), ["language"])
    kept(docs, media.to_media(docs), ["media", "features"])
    kept(docs, lines.dedup(docs), ["lines"])


def test_urls_keep_the_callers_columns(spark):
    pages = spark.createDataFrame([(1, "https://a.com/en/1", "x"), (1, "https://a.com/en/1", "x"), (2, None, "y")], "page_id long, host string, PATH string")
    listed = spark.createDataFrame([("a.com",)], "key string")
    out = urls.judge(pages, listed, (), url_col="host")
    assert out.columns == ["page_id", "host_1", "PATH_1", "host", "path", "rule", "verdict"]
    assert sorted((r.host_1, r.PATH_1, r.host, r.path, r.verdict) for r in out.where("page_id = 1").collect()) == [("https://a.com/en/1", "x", "a.com", "/en/1", "block")] * 2
    assert urls.judge(pages.limit(0), listed, (), url_col="host").count() == 0
    long = spark.createDataFrame([(1, "http://" + "a" * 200_000 + ".com/" + "b" * 200_000)], "page_id long, url string")
    assert F and urls.judge(long, listed, ()).first().path == "/" + "b" * 200_000


def test_vectors_keep_the_callers_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a", 5), (2, [1.0, 0.01], "b", 6)], "kept long, embedding array<double>, n_links string, __root int")
    out = embeddings.near_duplicates(df, id_col="kept")
    assert sorted((r.kept_1, r.n_links_1, r["__root"], r.n_links, r.component_id, r.kept) for r in out.collect()) == [(1, "a", 5, 1, 1, True), (2, "b", 6, 1, 1, False)]


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    """Nulls, repeats, empty and long texts and clashing names through the whole chain, and empty tables."""
    import corpus_pipeline as C

    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    long = docs.limit(1).withColumns({"doc_id": F.lit(999).cast("long"), "text": F.repeat(F.lit("many words in a row "), 40_000)})
    for start in (docs.union(long).union(docs.where("doc_id = 5")), docs.limit(0)):
        now, scratch = scratch_of(spark, start)
        for name, stage in C.STAGES[:-1]:
            now = scratch.save(stage(spark, now, str(tmp_path)), name)
            assert now.columns == docs.columns, name
        packed = C.STAGES[-1][1](spark, now, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def scratch_of(spark, df):
    scratch = common.Scratch(spark, "test")
    return scratch.save(df, "docs"), scratch


def test_a_large_bucket_of_several_components(spark, monkeypatch):
    """Blocks of the largest component and of the others, forced by a small block."""
    monkeypatch.setattr(neardup, "HEAVY", 4)
    monkeypatch.setattr(neardup, "FEW", 2)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(60):  # families that share buckets but not the threshold
        words = list(base)
        for j in range(k % 4):
            words[20 * j : 20 * j + 6] = [f"f{k % 4}{j}{i}" for i in range(6)]
        words[-1] = f"end{k}"
        docs.append((k, " ".join(words)))
    got = {r.id: r.component_id for r in neardup.classify(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    from tests.llm.test_operators import jaccard

    want = {k: k for k, _ in docs}
    for i, a in docs:
        for j, b in docs[:i]:
            if want[i] != want[j] and jaccard(a, b) >= 0.85:
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert got == want and 1 < len(set(want.values())) < 60
