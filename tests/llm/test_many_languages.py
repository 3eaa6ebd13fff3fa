"""More languages than the sample is laid out for."""

import numpy as np

from ringspark.llm import language


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(20)]
        rows += [(len(rows) + i, " ".join("".join(rng.choice(letters, 5)) for _ in range(30)), f"l{k:02}") for i in range(8 if k < 64 else 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == [f"l{k:02}" for k in range(70)]
    assert [model.predict(text)[0] for _, text, _ in rows] == [lang for _, _, lang in rows]
