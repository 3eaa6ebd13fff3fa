"""Language identification: sparse multinomial logistic regression on TF-IDF
weighted character n-grams (1 to 4 letters, hashed to 2**15 slots).

* Document frequencies are counted over all training documents.
* The weights are trained by follow-the-regularised-leader (FTRL-proximal, L1 and
  L2 penalty) on a bounded sample: the first ``per_class`` documents of each
  language by a hash of the id, whole texts.  Every language is learned; of more than
  ``classes`` each gives fewer documents, so that the sample doesn't grow, down to
  ``LEAST``.  The driver gets one sparse vector of 2**15 slots at most for each
  document, and holds 2**15 weights with their state for each language.
* A temperature is then fitted on the fifth of the sample kept out of training.

Term frequency is a slot's share of the text's n-grams, so a text's logits are one
sum over its n-grams: time and memory follow the text's length.

Defined results: ``und`` with score 0 where the text is null or holds no letter, or
where nothing could be learned; rows without a language teach nothing; repeated rows
get the same answer; a text's language, source and id never enter a prediction; of
equally likely languages the first by code point is the answer; an empty table gives an
empty result.  A caller's column with the result's name is kept under the next free
name (``language_1``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import documents, fold, make_room

SLOTS = 1 << 15
ORDERS = (1, 2, 3, 4)
LEAST = 20  # documents of a language that are learned from however many languages there are
BLOCK = 1 << 16  # characters that are worked on at once
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def _blank() -> np.ndarray:
    """True where a code point under 2**16 is no letter."""
    return np.array([not chr(c).isalpha() for c in range(1 << 16)])


_tables: dict[str, np.ndarray] = {}


def _codes(text: str) -> np.ndarray:
    """Lower-case code points; each run of others than letters becomes one space."""
    if "blank" not in _tables:
        _tables["blank"] = _blank()
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    blank = _tables["blank"][np.minimum(codes, 0xFFFF)] & (codes < 0x10000)
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[0] = True
    return np.where(blank, np.uint32(32), codes)[keep]


def slots_of(codes: np.ndarray, n: int) -> np.ndarray:
    """The slots of all n-grams of one order."""
    h = np.full(max(0, len(codes) - n + 1), n * 374761393 % (1 << 32), np.uint32)
    for k in range(n):
        h += codes[k : len(codes) - n + 1 + k]
        h *= _MIX[k]
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(17)).astype(np.int32)


def slots(text: str) -> np.ndarray:
    """All slots of a text of at most BLOCK characters, in one array."""
    codes = _codes(text)
    return np.concatenate([slots_of(codes, n) for n in ORDERS if len(codes) >= n])


def tally(text: str) -> np.ndarray:
    """Counts by slot; the blocks overlap so that no n-gram is lost or counted twice."""
    out = np.zeros(SLOTS, np.int64)
    codes = _codes(text)
    for at in range(0, len(codes), BLOCK):
        for n in ORDERS:
            part = codes[at : at + BLOCK + n - 1]
            if len(part) >= n:
                out += np.bincount(slots_of(part, n), minlength=SLOTS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # SLOTS x languages: idf times weight times scale
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        if len(text) <= BLOCK:
            found = slots(text)
            total, count = self.table[found].sum(0, dtype=np.float64), len(found)
        else:
            counts = tally(text)
            total, count = counts @ self.table.astype(np.float64), int(counts.sum())
        return total / max(1, count) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.languages[k], float(p[k] / p.sum())


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each slot, and how many texts there are. Each task sends SLOTS + 1 sums at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(SLOTS + 1, np.int64), 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                if text:
                    if len(text) <= BLOCK:
                        held = np.zeros(SLOTS, bool)
                        held[slots(text)] = True
                    else:
                        held = tally(text) > 0
                    sums[:SLOTS] += held
                    rows += 1
        sums[SLOTS] = rows
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "n": pa.array(sums[at], pa.int64())})

    rows = docs.select("text").mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS + 1, np.int64)
    out[rows.slot.to_numpy()] = rows.n.to_numpy()
    return out[:SLOTS], int(out[SLOTS])


def _vectors(sample: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch["text"].to_pylist():
                counts = tally(text)
                at = np.flatnonzero(counts)
                out.append((at.astype(np.int32), (counts[at] / counts[at].sum()).astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], batch["h"], pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.float32()))], ["lang", "h", "slots", "shares"]
            )

    rows = sample.select("lang", "h", "text").mapInArrow(vectors, "lang string, h long, slots array<int>, shares array<float>").toArrow()
    lists = lambda name: [np.asarray(x.values) for x in rows[name].combine_chunks()] if rows.num_rows else []
    out = list(zip(rows["lang"].to_pylist(), rows["h"].to_pylist(), lists("slots"), lists("shares"), strict=True))
    return sorted(out, key=lambda r: (r[1], r[0], len(r[2])))


def ftrl(data, labels: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """FTRL-proximal for softmax; the last of SLOTS + 1 coordinates is the bias, without penalty."""
    kind = np.float64 if classes <= 64 else np.float32  # the state is 2 * SLOTS numbers a class
    z, n = np.zeros((SLOTS + 1, classes), kind), np.zeros((SLOTS + 1, classes), kind)

    def weights(at):
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        w[np.abs(zz) <= l1] = 0
        bias = at == SLOTS
        w[bias] = -zz[bias] / ((beta + np.sqrt(nn[bias])) / alpha)
        return w

    for _ in range(epochs):
        for (at, x), y in zip(data, labels, strict=True):
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return np.concatenate([weights(at) for at in np.array_split(np.arange(SLOTS + 1), 16)])


def train(
    docs: DataFrame, per_class: int = 300, classes: int = 64, epochs: int = 3, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.02, l2: float = 0.05, seed: int = 11
) -> Model:
    """docs: text, lang, doc_id. Rows without text or language are left out."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    frequency, rows = document_frequency(docs)
    if not rows:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    known = docs.select("lang").distinct().count()
    per_class = min(per_class, max(LEAST, per_class * classes // known))
    # Ids first: the row number's limit is applied before the exchange, and texts follow for the chosen ids alone.
    picked = (
        docs.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(seed)).alias("h"))
        # First within 32 shares of a language: the last window gets 32 * per_class rows of one at most, at any size.
        .withColumn("k", F.row_number().over(W.Window.partitionBy("lang", F.pmod("h", F.lit(32))).orderBy("h", "doc_id")))
        .where(F.col("k") <= per_class)
        .withColumn("k", F.row_number().over(W.Window.partitionBy("lang").orderBy("h", "doc_id")))
        .where(F.col("k") <= per_class)
        .select("doc_id", "h")
        .distinct()
    )
    sample = docs.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "lang"])
    data = [r for r in _vectors(sample) if len(r[2])]
    languages = sorted({r[0] for r in data})
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    where = {x: k for k, x in enumerate(languages)}
    vectors = [(at, share * idf[at]) for _, _, at, share in data]
    scale = 1 / np.mean([np.linalg.norm(x) for _, x in vectors])
    vectors = [(np.append(at, SLOTS), np.append(x * scale, 1.0)) for at, x in vectors]
    y = np.array([where[r[0]] for r in data])
    # The first of each language is learned from.
    first = np.isin(np.arange(len(y)), np.unique(y, return_index=True)[1])
    out = ~first & (np.arange(len(y)) % 5 == 4) if len(data) >= 20 else np.zeros(len(data), bool)
    w = ftrl([v for v, o in zip(vectors, out, strict=True) if not o], y[~out], len(languages), epochs, alpha, beta, l1, l2)
    model = Model(languages, (w[:SLOTS] * idf[:, None] * scale).astype(np.float32), w[SLOTS])
    if out.any():
        logits = np.array([x @ w[at] for (at, x), o in zip(vectors, out, strict=True) if o])
        model.temperature = _temperature(logits, y[out])
    return model


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section on its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    a, b, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column: lang, score. The model (SLOTS floats, 128 kB, a language) goes out as one broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(x) for x in texts], columns=["lang", "score"])

    return make_room(docs, out).withColumn(out, predicted(F.col(text_col)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.where(fold("doc_id", 3) != 1))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )
