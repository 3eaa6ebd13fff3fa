"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded (case, accents, homoglyphs, digit substitutions), the automaton
finds lexicon entries and exception phrases in one pass, an entry inside an
exception phrase does not count, and the summed weight is set against the
text's length.

Training: entries are words and word beginnings; an entry's weight is its
smoothed log odds between toxic and clean documents.  The classifier is fitted
on a bounded sample of labelled rows, the ``per_class`` rows of each class that
come first by a hash of the id (documented bound: 2 * per_class documents, whole
texts).  Half of the sample gives the lexicon and the exceptions; the other half
fits the logistic curve, including the power of the length.

Defined results: null and empty texts have no match and get the curve's value at
zero; no labels, or labels of one class only, give every text the share of toxic
labels (0 without labels); repeated rows score alike; a label table that repeats
an id counts it once, toxic if any of its rows is; of several texts with one id any
one is learned from.  Ties: ids of equal hash come in the order of the ids, entries
of equal certainty shorter first, then by code point.  An empty table gives an empty
result.  A caller's column with the result's name is kept under the next free name
(``toxicity_1``).  The lexicon has ``entries`` entries and ``exceptions`` phrases at most,
chosen from the 8 * ``entries`` surest features: bounds on the model, not on rows.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, make_room, own_prefix, table

# Digits and signs that stand for letters. Both l and 1 become i, so that either reading meets.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
SHORTEST, LONGEST = 4, 8


@functools.cache
def _table() -> dict[int, str | None]:
    """One entry for each character of the Latin, Greek, Cyrillic, punctuation and full-width blocks."""
    out: dict[int, str | None] = {}
    for code in [*range(0x0, 0x530), *range(0x1E00, 0x2070), *range(0xFF01, 0xFF5F)]:
        char = chr(code)
        kind = unicodedata.category(char)
        if kind in ("Cf", "Mn"):
            out[code] = None
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", char.lower()) if unicodedata.category(x) != "Mn")
        plain = "".join(SUBSTITUTES.get(y := LOOKALIKES.get(x, x), y) for x in plain)
        plain = "".join(x if x.isalnum() else " " for x in plain)
        if plain != char:
            out[code] = plain
    return out


def fold_text(text: str | None) -> str:
    """Folded words, each with a space before and after it."""
    words = (text or "").translate(_table()).split()
    return f" {' '.join(words)} " if words else ""


def features(text: str) -> set[str]:
    """Of a folded text: its words as ' word ' and their beginnings as ' wor'."""
    words = set(text.split())
    out = {f" {w} " for w in words if len(w) >= 3}
    for w in words:
        for n in range(SHORTEST, min(len(w), LONGEST + 1)):
            out.add(" " + w[:n])
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    constant: float | None = None

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            auto.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            auto.add_word(phrase, (len(phrase), None))
        if len(auto):
            auto.make_automaton()
        return auto

    def score(self, weight: float, entries: int, words: int) -> float:
        if self.constant is not None:
            return self.constant
        z = float(np.dot(self.curve, (1.0, math.log1p(weight), math.log1p(entries), math.log1p(words))))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def matches(auto, folded: str) -> dict[int, float]:
    """Start of a word -> the largest weight of an entry that begins there, without those in exception phrases."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if folded and len(auto):
        for end, (length, weight) in auto.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if spared and found:
            # Sorted, with the furthest end so far: a long text's phrases are passed once.
            spared.sort()
            starts = [a for a, _ in spared]
            reach = list(accumulate((b for _, b in spared), max))
            found = {s: w for s, w in found.items() if not (k := bisect_right(starts, s)) or s >= reach[k - 1]}
    return found


def _measures(lexicon: Lexicon, texts: Iterable[str | None]) -> Iterator[tuple[float, int, int, int]]:
    auto = lexicon.automaton()
    for text in texts:
        folded = fold_text(text)
        found = matches(auto, folded)
        yield sum(found.values()), len({folded[s : s + SHORTEST + 1] for s in found}), max(0, folded.count(" ") - 1), len(found)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct column: score, weight, n_words, n_matches."""

    @F.pandas_udf("score double, weight double, n_words long, n_matches long")
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = [(lexicon.score(w, e, n), w, n, k) for w, e, n, k in _measures(lexicon, texts)]
        return pd.DataFrame(rows, columns=["score", "weight", "n_words", "n_matches"])

    return make_room(docs, out).withColumn(out, measure(F.col(text_col)))


def _count(sample: DataFrame, of) -> DataFrame:
    """Documents of each class that hold a feature, pre-aggregated in each task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                sums[toxic].update(of(fold_text(text)))
            if len(sums[0]) + len(sums[1]) > 200_000:
                yield _counted(sums)
                sums = (Counter(), Counter())
        yield _counted(sums)

    return sample.select("text", "toxic").mapInArrow(counted, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counted(sums) -> pa.RecordBatch:
    names = list(sums[0].keys() | sums[1].keys())
    return pa.RecordBatch.from_pydict(
        {"feature": pa.array(names, pa.string()), "toxic": pa.array([sums[1][x] for x in names], pa.int64()), "clean": pa.array([sums[0][x] for x in names], pa.int64())}
    )


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, entries: int = 1000, exceptions: int = 200, seed: int = 7) -> Lexicon:
    """labels: doc_id, toxic; docs: doc_id, text. See the module's text."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    if len(totals) < 2:
        return Lexicon(constant=float(bool(totals.get(1))))
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = None
    for kind in (0, 1):
        part = one.where(F.col("toxic") == kind).withColumn("h", order).orderBy("h", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    picked = chosen.select("doc_id", "toxic", F.pmod("h", F.lit(2)).alias("half")).collect()  # 2 * per_class rows of three numbers at most
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([tuple(r) for r in picked], "doc_id long, toxic int, half long"))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").dropDuplicates(["doc_id"]).persist()
    try:
        first = sample.where("half = 0")
        n = Counter((r["half"], r["toxic"]) for r in picked)
        base = math.log((n[0, 1] + 1) / (n[0, 0] + 1))
        counts = _count(first, features).withColumn("weight", F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - F.lit(base))
        # Entries whose weight is large for certain: its lower confidence limit counts.
        sure = F.col("weight") - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        best = counts.withColumn("sure", sure).where("toxic >= 3 and sure >= 1").orderBy(F.desc("sure"), F.length("feature"), "feature").limit(8 * entries).collect()
        weights: dict[str, float] = {}
        for r in sorted(best, key=lambda r: (len(r["feature"]), r["feature"])):
            name = r["feature"]
            parents = [weights[name[:k]] for k in range(SHORTEST + 1, len(name)) if name[:k] in weights]
            if r["weight"] > max(parents, default=0) + 0.3:
                weights[name] = round(r["weight"], 4)
        rank = {r["feature"]: k for k, r in enumerate(best)}
        weights = {k: weights[k] for k in sorted(weights, key=rank.__getitem__)[:entries]}
        lexicon = Lexicon(weights)

        def contexts(folded: str) -> set[str]:
            words, out, at, starts = folded.split(), set(), 0, {}
            for k, w in enumerate(words):
                starts[at], at = k, at + len(w) + 1
            for s in matches(auto_of(weights), folded):
                k = starts[s]
                out.add(f" {words[k]} ")
                out.add(f" {' '.join(words[max(0, k - 1) : k + 1])} ")
                out.add(f" {' '.join(words[k : k + 2])} ")
            return out

        spared = _count(first, contexts).where("clean >= 3 and toxic = 0").orderBy(F.desc("clean"), "feature").limit(exceptions).collect()
        lexicon.exceptions = tuple(r["feature"] for r in spared)
        held = sample.where("half = 1")

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_measures(lexicon, batch["text"].to_pylist()))
                yield pa.RecordBatch.from_pydict(
                    {"toxic": batch["toxic"].cast(pa.int64()), **{k: pa.array([r[i] for r in rows], pa.float64()) for i, k in enumerate(("w", "e", "n"))}}
                )

        rows = held.select("text", "toxic").mapInArrow(measured, "toxic long, w double, e double, n double").toPandas()
    finally:
        sample.unpersist()
    if rows.toxic.nunique() < 2:
        lexicon.constant = totals[1] / (totals[0] + totals[1])
        return lexicon
    lexicon.curve = _logistic(rows, totals)
    return lexicon


def auto_of(weights: dict[str, float]):
    key = id(weights)
    if _autos.get("key") != key:
        _autos.update(key=key, auto=Lexicon(weights).automaton(), weights=weights)
    return _autos["auto"]


_autos: dict = {}


def _logistic(rows: pd.DataFrame, totals: dict[int, int]) -> tuple[float, ...]:
    """Newton steps with a small ridge; classes weigh as they occur among all labels."""
    rows = rows.sort_values(["toxic", "w", "e", "n"])  # the order rows arrive in must not show
    x = np.column_stack([np.ones(len(rows)), *(np.log1p(rows[k].to_numpy(float)) for k in ("w", "e", "n"))])
    y = rows.toxic.to_numpy(float)
    share = totals[1] / (totals[0] + totals[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    beta = np.zeros(4)
    ridge = np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(b), 10) for b in beta)


def learn(spark, docs: DataFrame, sf_dir: str) -> Lexicon:
    """From the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return train(docs, labels.where(fold("doc_id", 4) != 2))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs.select("doc_id", "text"), learn(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.3).cast("int").alias("predicted"),
        F.col("toxicity.n_matches").alias("n_matches"),
        F.col("toxicity.n_words").alias("n_words"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the lexicon is learned from the same documents' labels."""
    own = own_prefix(docs) + "toxicity"
    return score(docs, learn(spark, docs, sf_dir), out=own).where(f"{own}.score < 0.3").drop(own)
