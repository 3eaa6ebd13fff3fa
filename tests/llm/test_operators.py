"""The operators on small tables with nulls, empties, ties, repeats and clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringspark.llm import common, components, embeddings, language, lines, media, mixing, neardup, packing, pii, registry, toxicity, urls
from tests.oracle import agrees

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BODY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "b", 0),
        (3, " \n\t", "en", "a", 3),
        (4, BODY, "en", "a", 9),
        (5, BODY, None, "b", 9),
        (5, BODY, None, "b", 9),
        (6, BODY.upper(), "de", None, 9),
        (7, "word " * 30_000, "en", "a", 9),
        (8, "three short words", "fr", "c", 3),
        (None, "no id here at all", "en", "a", 4),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit(1), "key": F.lit("k"), "h": F.lit(2), "target": F.lit(3)}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    agrees(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 7), (50, 51), (51, 52), (60, 60)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long"), common.Scratch(spark, "t"), "c").collect())
    assert got == {**dict.fromkeys([*range(31), 100], 0), **dict.fromkeys([50, 51, 52], 50)}
    assert components.components(spark.createDataFrame([], "u long, v long"), common.Scratch(spark, "t"), "c").count() == 0


def test_toxicity(spark, odd, none):
    docs = spark.createDataFrame([(k, ("you idiot and fool " if k % 4 == 0 else "a kind word for you ") * (1 + k % 3)) for k in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    got = toxicity.score(odd, model)
    assert got.where("toxicity.score is null or toxicity.score > 0.3").count() == 0 and got.count() == odd.count()
    bad = spark.createDataFrame([("an 1D10T indeed",), ("thank you",)], "text string")
    assert [r.toxicity.score > 0.3 for r in toxicity.score(bad, model).collect()] == [True, False]
    assert toxicity.train(docs, labels.where("toxic = 0")).constant == 0.0
    assert toxicity.score(none, model).count() == 0


def test_toxicity_held_out(spark):
    got = toxicity.query(spark, "/root/testdata/sf0.1").join(common.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").toPandas()
    tp = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert tp / (got.predicted == 1).sum() > 0.8 and tp / (got.toxic == 1).sum() > 0.8


def test_language(spark, odd, none):
    got = language.query(spark, SF.replace("0.001", "0.1")).join(common.documents(spark, SF.replace("0.001", "0.1")).select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = language.train(odd)
    out = {r.doc_id: r.language for r in language.predict(odd, model).collect()}
    assert out[1].lang == out[2].lang == out[3].lang == "und" and out[1].score == 0
    assert out[4].lang in model.languages
    assert language.predict(odd, language.train(none)).where("language.lang <> 'und'").count() == 0


def test_media(odd):
    rows = media.to_media(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert media.decode(bytes(r.media)) == media.payload(r.text) and r.features.payload_bytes % 576 == 0


def test_mixing_matches_brute_force(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(rows[0].asDict())
    words = {k: 0 for k in ("a", "b", "c", None)}
    taken = dict(words)
    for r in rows:
        assert r.mix.size == len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.mix.taken <= 2 * r.mix.size
        words[r.source] += r.mix.size
        taken[r.source] += r.mix.taken
    weights, most = dict(zip(("a", "b", "c", None), (3, 1, 2, 3), strict=True)), {k: 2.0 * v for k, v in words.items()}
    want, left, budget = {}, set(weights), 1.5 * sum(words.values())
    while True:
        level = (budget - sum(want.values())) / sum(weights[k] for k in left)
        full = {k for k in left if most[k] <= weights[k] * level}
        if not full:
            break
        want |= {k: most[k] for k in full}
        left -= full
    want |= {k: weights[k] * level for k in left}
    assert {r.source: round(r.mix.target, 6) for r in rows} == {k: round(v, 6) for k, v in want.items()}
    assert all(abs(taken[k] - want[k]) < 1 for k in want)
    assert sorted(map(str, mixing.mix(odd.repartition(5)).select("doc_id", "mix").collect())) == sorted(str(r) for r in mixing.mix(odd).select("doc_id", "mix").collect())
    flat = mixing.materialise(mixing.mix(odd))
    assert flat.columns == odd.columns and flat.agg(F.sum(mixing.words(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix(none).count() == 0


def test_urls_exact(spark):
    pages = spark.createDataFrame([(k, f"https://H{k}.Example.com/en/{k}?q") for k in range(3000)] + [(-1, None), (-2, "nothing"), (-3, "http://"), (-4, "x://com/en/a://b")], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{k}.example.com",) for k in range(0, 4000, 3)] + [(None,)], "key string")
    for limit in (1 << 20, 16):  # the cascade, and the join beyond its bound
        got = {r.page_id: r for r in urls.judge(pages, listed, (("allow", "example.com", "/en/1"),), max_bytes=limit).collect()}
        assert len(got) == 3004 and got[-1].host == got[-2].path == "" and got[-4].host == "com" and got[-4].path == "/en/a://b"
        for k in range(3000):
            rule = str(k).startswith("1")
            assert got[k].rule == ("example.com/en/1" if rule else None) and got[k].verdict == ("allow" if rule or k % 3 else "block")


def test_pii(spark, odd, none):
    text = "a Bob.7@x1.example.com 4337166598464399, (212) 555-0187 1.2.3.4 219-47-4181 2024-02-29 end 4337166598464398 300.1.1.1 2023-02-29 000-12-1234"
    rows = spark.createDataFrame([(1, text), (2, text + " Bob.7@x1.example.com"), (3, None), (4, "")], "doc_id int, text string")
    a, b, c, d = pii.pseudonymise(rows, "key").orderBy("doc_id").collect()
    assert c.text is None and d.text == "" and a.pii.n_found == 6
    import re

    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    plain = lambda s: re.sub(r"\b9+(\.9+){3}\b", "ip", shape(s))
    assert plain(a.text) == plain(text) and b.text.startswith(a.text) and a.text.split()[1] == b.text.split()[-1]
    assert a.text.split()[-4:] == text.split()[-4:]
    digits = [int(x) for x in re.search(r"\d{16}", a.text)[0]][::-1]
    assert sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(digits)) % 10 == 0
    ids = spark.range(2500).select("id", pii.feistel(F.col("id"), 50, 50, "k", "t").alias("v"))
    assert ids.select("v").distinct().count() == 2500 and ids.where("v < 0 or v >= 2500").count() == 0
    assert ids.where(pii.feistel(F.col("v"), 50, 50, "k", "t", back=True) != F.col("id")).count() == 0
    assert pii.pseudonymise(odd, "key").count() == odd.count() and pii.pseudonymise(none, "key").count() == 0
    long = spark.createDataFrame([("x@" + "a." * 30_000 + " Bob.7@x1.example.com",), ("1.2.3.4 " * 3_000,)], "text string")
    one, many = pii.pseudonymise(long, "key").collect()
    assert one.pii.n_found == 1 and one.text.split()[1] == b.text.split()[-1] and many.pii.n_found == 3_000


def jaccard(a, b):
    from .test_units import jaccard_set

    x, y = jaccard_set(a), jaccard_set(b)
    return len(x & y) / len(x | y) if x and y else 0


def test_neardup_brute_force(spark, odd, none):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(500)]
    docs, base = [], [list(rng.choice(vocabulary, 120)) for _ in range(12)]
    for k in range(150):
        t = list(base[k % 12])
        for _ in range(int(rng.integers(0, 6))):
            t[int(rng.integers(0, len(t)))] = str(rng.choice(vocabulary))
        docs.append((k, " ".join(t)))
    got = {r.id: r.component_id for r in neardup.classify(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {k: k for k, _ in docs}
    for i, a in docs:
        for j, b in docs[:i]:
            if want[i] != want[j] and jaccard(a, b) >= 0.85:
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert got == want
    out = {r.id: r for r in neardup.classify(odd).collect()}
    assert out[6].component_id == 4 and out[5].component_id == 4 and out[1].n_shingles == out[2].n_shingles == 0 and out[2].component_id == 2
    assert out[8].n_shingles == 1 and out[None].component_id is None
    assert neardup.classify(none).count() == 0


def test_neardup_repeated_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(100)) for k in "abcdefgh"}
    near = text["b"] + " and more"
    rows = [(5, text["a"]), (5, text["b"]), (9, text["b"]), (10, text["b"]), (11, near), (12, text["a"])]
    rows += [(0, text[k]) for k in "cdefgh"] + [(20 + i, text[k] + " end") for i, k in enumerate("cdefgh")]
    out = sorted((r.id, r.component_id) for r in neardup.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == sorted([(5, 5), (5, 5), (9, 5), (10, 5), (11, 5), (12, 5)] + [(0, 0)] * 6 + [(20 + i, 0) for i in range(6)])


def test_line_dedup(spark, odd, none):
    passage = "\n".join(f"shared line number {k} of a passage" for k in range(12))
    rows = [(k, f"own start {k} a\nown start {k} b\n{passage}\nown end {k} a\nown end {k} b") for k in range(20)] + [(30, passage), (31, passage), (32, "alone"), (33, "alone")]
    out = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    before = dict(rows)
    assert out[0].text == before[0] and out[32].text == out[33].text == "alone"
    # The first documents with a boundary of their own keep a chunk that later ones lose.
    assert all(out[k].lines.n_removed >= 4 and f"own start {k} a" in out[k].text and f"own end {k} b" in out[k].text for k in range(1, 20))
    assert all(out[k].lines.n_removed >= 10 for k in range(3, 20))
    assert out[31].text == "" and out[31].lines.n_removed == 12
    # What stays of all texts together holds every line of before.
    assert {x for t in before.values() for x in t.split("\n")} <= {x for r in out.values() for x in r.text.split("\n")}
    same = lines.dedup(odd)
    assert same.columns == [*odd.columns, "lines"] and same.count() == odd.count() and same.where("doc_id = 1 and text is null").count() == 1
    assert lines.dedup(none).count() == 0


def test_line_dedup_cuts_every_later_copy(spark):
    rows = []
    for size in range(1, 7):
        for copy in range(30):
            own = [f"own line {size} {copy} {k} of this document" for k in range(2 + (copy * 7 + size) % 9)]
            at = 1 + copy % (len(own) - 1)
            rows.append((size * 1000 + copy, "\n".join([*own[:at], *(f"passage of {size} lines, number {k}" for k in range(size)), *own[at:]])))
    # Blank lines inside a passage go with it; short lines count as a run; the id is repeated with other texts.
    rows += [(9000 + k, f"mine {k} before it\nfirst line of a passage\n\n\n\nlast line of a passage\nmine {k} after it") for k in range(5)]
    rows += [(9100, f"mine {k} before the menu\n" + "\n".join("abcdefghijklmnopqrstuvwxyz") + f"\nmine {k} after the menu") for k in range(5)]
    out = [(r.doc_id, r.lines.n_removed) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    for size in range(1, 7):
        lost = {k % 1000: n for k, n in out if k // 1000 == size}
        assert lost == {copy: size if copy and size > 1 else 0 for copy in range(30)}, size
    assert sorted(n for k, n in out if 9000 <= k < 9100) == [0, 5, 5, 5, 5]
    assert sorted(n for k, n in out if k == 9100) == [0, 26, 26, 26, 26]


def test_packing(spark, odd, none):
    rows = packing.pack(packing.pieces(odd, with_ids=False), part_rows=3).toPandas()
    assert len(rows) >= odd.count() and rows.length.max() <= 2048
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert (part.offset.to_numpy() == np.cumsum(part.length) - part.length).all() and part.length.sum() <= 2048
    ids = packing.pieces(odd, with_ids=True).where("id = 7").orderBy("piece").collect()
    whole = [x for r in ids for x in r.ids]
    assert whole[-1] == 0 and whole[:-1] == packing._exact(None).encode("word " * 30_000, add_special_tokens=False).ids
    assert packing.pack(packing.pieces(none)).count() == 0


def test_embeddings_copies_go_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 4)).repeat(5, 0) + rng.normal(size=(150, 4)) * 0.05
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(v)] + [(1000, [1.0, 2.0]), (1001, [2.0, 4.0])], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    links = ((unit @ unit.T >= 0.95).sum(1) - 1).tolist() + [1, 1]
    monkeypatch.setattr(embeddings, "COPIES", 7)
    got = embeddings.near_duplicates(df, block=4).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == links and got[-1].component_id == 1000


def test_embeddings_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.01]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]), (10, [1.0]), (11, [1.0]), (12, [1.0, 0.0]), (12, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(0))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block=2).collect())
    linked = {1: 3, 2: 3, 3: 3, 10: 1, 11: 1}
    assert [g for g in got if g[0] != 12] == sorted((k, linked.get(k, 0), {2: 1, 3: 1, 11: 10}.get(k, k)) for k, _ in rows[:11])
    assert (12, 3, 1) in got and len(got) == 13
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = common.documents(spark, SF)
    columns = docs.columns
    scratch = common.Scratch(spark, "test")
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        if name != "mixing":
            assert docs.count() <= before.count() and docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
