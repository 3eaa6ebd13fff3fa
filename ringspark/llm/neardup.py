"""MinHash near-dedup with tensored banding, verified on full shingle sets.

Tables: two collections of ``m`` short hashes are made of ``r`` minhashes each; the key of
table (i, j) combines hash i of the first with hash j of the second.  So m * m tables of
2 * r minhashes a key take 2 * m * r minhashes, roughly the square root of what separate
keys would need.  A pair of similarity s shares a table with probability
(1 - (1 - s**r)**m)**2: 99.96 % at 0.85 with m = 9 and r = 3 (81 tables, 54 minhashes).

From there on no group emits all its pairs, and of the pairs that met only those are left out
that a sketch rules out:

1. Equal shingle sets are one class; a class is handled once.
2. Every class is paired with the hub of its buckets: of the classes it meets, the one that
   meets most others over all tables.  Pairs whose sizes or 512-bin sketches rule the
   threshold out go; the others are verified on full sets, and the links make first
   components.  A sketch rules a pair out where it lies more than 4.5 standard deviations and
   one bin below the threshold: about three in a million of the pairs that lie at the threshold
   itself, and fewer the more similar they are.
3. Buckets whose members are in several components are gone through again: members of
   different components are compared by sketch, block against block inside a task, and only
   those pairs that the sketch can't rule out are emitted, verified and linked.  Members of
   one component need no comparison; so copies around a hub cost no pairs, and of a large
   bucket the members of its largest component go to the blocks of the others alone.  What is
   left is quadratic in a bucket's members outside its largest component.

Components are found by label propagation over the links.  Sets are made again from the
texts of the classes that take part in a pair, and only of those.

Words: A-Z lower-cased, split at ASCII white space; shingles of five words are hashed to 64
bits.  Defined results: a text of fewer than five words is one shingle; null and texts without
words have an empty set and are linked with nothing; rows that repeat an id with different
texts are compared each for itself, and ids enter only as the least id of a component; a null
id is no node and is kept (the pipeline's stage compares it as well); an empty table gives
no rows.  The result has columns of its own, so the caller's can't clash with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, own_prefix
from .components import components

WORDS = 5
M, R = 9, 3
BINS = 512
MARGIN = 4.5
HEAVY = 2048  # members of a bucket's block
FEW = 8  # a bucket of so many is small
GROUP = 20_000  # rows of buckets that a task compares at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_state: dict = {}


def _setup() -> dict:
    if not _state:
        rng = np.random.default_rng(20240229)
        table = rng.integers(0, 1 << 64, 256, np.uint64)
        table[65:91] = table[97:123]  # A-Z count as a-z
        space = np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        _state.update(
            bytes=table,
            space=space,
            order=rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1),
            mul=rng.integers(0, 1 << 64, 2 * M * R, np.uint64) | np.uint64(1),
            add=rng.integers(0, 1 << 64, 2 * M * R, np.uint64),
            up=np.ones(0, np.uint64),
            down=np.ones(0, np.uint64),
        )
    return _state


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = _setup()
    if len(s["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            s[name] = np.multiply.accumulate(out)
    return s["up"], s["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A polynomial hash modulo 2**64 of every word, over random values of its bytes, from prefix sums."""
    s = _setup()
    raw = np.frombuffer(data, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = s["space"][raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(s["bytes"][raw] * up[: len(raw)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    order = _setup()["order"]
    n = min(WORDS, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * order[k]
        total ^= total >> np.uint64(29)
    return np.unique(_mix(total))


def minhashes(found: np.ndarray) -> np.ndarray:
    s = _setup()
    out = np.empty(2 * M * R, np.uint64)
    for k in range(2 * M * R):
        out[k] = (found * s["mul"][k] + s["add"][k]).min()
    return out


def sketch(found: np.ndarray) -> np.ndarray:
    """One permutation in BINS ranges: 8 bits of the least hash of each; 0 where a range is empty."""
    out = np.zeros(BINS, np.uint8)
    bins, first = np.unique((found >> np.uint64(55)).astype(np.int64), return_index=True)
    out[bins] = (found[first] >> np.uint64(20)).astype(np.uint8) % np.uint8(255) + np.uint8(1)
    return out


def may_link(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Row by row: False where two sketches rule the similarity ``least`` out.  The ranges in use are a sample
    of the union, drawn without replacement; of a small union they are nearly all."""
    used = ((x > 0) | (y > 0)).sum(1)
    equal = ((x == y) & (x > 0)).sum(1)
    rest = np.maximum(0.02, 1 - used * (1 + least) / np.maximum(nx + ny, 1))
    return equal >= least * used - MARGIN * np.sqrt(used * least * (1 - least) * rest) - 1


def _apart(pdf: pd.DataFrame, least: float) -> np.ndarray:
    """The distinct pairs of members of a bucket, in different components, that their sketches don't rule out.
    Rows are sorted by bucket and pair of blocks."""
    bins = np.frombuffer(b"".join(pdf.sketch), np.uint8).reshape(-1, BINS)
    n, comp, rep, lo, hi, own = (pdf[c].to_numpy() for c in ("n", "comp", "rep", "lo", "hi", "own"))
    key = pdf[["bucket", "lo", "hi"]].to_numpy()
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    end = np.append(start[1:], len(key))
    found = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        some = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[some], j[some]
        for at in range(0, len(i), 1 << 13):
            x, y = i[at : at + (1 << 13)], j[at : at + (1 << 13)]
            ok = may_link(bins[x], bins[y], n[x], n[y], least)
            found.append(np.column_stack([np.minimum(rep[x[ok]], rep[y[ok]]), np.maximum(rep[x[ok]], rep[y[ok]])]))
        if len(found) > 1 and sum(map(len, found)) > 1 << 18:
            found[:] = [np.unique(np.concatenate(found), axis=0)]

    few = np.repeat(end - start <= FEW, end - start) & (lo == hi)
    group = np.repeat(np.arange(len(start)), end - start)
    for off in range(1, FEW):  # small buckets all at once
        i = np.flatnonzero(few[:-off] & (group[:-off] == group[off:]))
        keep(i, i + off)
    for a, b in zip(start, end, strict=True):
        if few[a] if b > a else True:
            continue
        rows = np.arange(a, b)
        left, right = (rows, rows) if lo[a] == hi[a] else (rows[own[a:b] == lo[a]], rows[own[a:b] == hi[a]])
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            cross = comp[part][:, None] != comp[right][None, :]
            if lo[a] == hi[a]:
                cross &= part[:, None] < right[None, :]
            i, j = np.nonzero(cross)
            keep(part[i], right[j])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, digest, tensor, bins = [], [], [], []
        for text in batch["text"].to_pylist():
            found = shingles(text)
            size.append(len(found))
            if len(found):
                digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                grouped = minhashes(found).reshape(2 * M, R)
                tensor.append(_mix(grouped[:, 0] * np.uint64(3) + _mix(grouped[:, 1] + _mix(grouped[:, 2]))).view(np.int64))
                bins.append(sketch(found).tobytes())
            else:
                digest.append(None)
                tensor.append(None)
                bins.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["h"], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(tensor, pa.list_(pa.int64())), pa.array(bins, pa.binary())],
            ["id", "h", "n", "digest", "tensor", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: set[int] = set()
    for batch in batches:
        rows, found = [], []
        for k, (rep, text, digest) in enumerate(zip(*(batch[c].to_pylist() for c in ("rep", "text", "digest")), strict=True)):
            if rep in done:  # rows that repeat an id and a text
                continue
            own = shingles(text)
            if xxhash.xxh3_128_digest(own.tobytes()) == digest:
                done.add(rep)
                rows.append(k)
                found.append(own.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch["rep"].take(pa.array(rows, pa.int64())), pa.array(found, pa.list_(pa.int64()))], ["rep", "shingles"])


def classify(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document row: id, n_shingles, component_id. threshold: the similarity in hundredths."""
    out = _classified(docs, threshold, id_col, text_col, F.col("id").isNotNull())
    least = F.when(F.col("id").isNotNull(), F.col("least.id"))
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce(least, "id").alias("component_id"))


def _classified(docs: DataFrame, threshold: int, id_col: str, text_col: str, which: Column) -> DataFrame:
    """A row for each document row: id, h (hash of the text), n, least: the least id (nulls last) and text hash of its
    component. Rows that aren't ``which`` make no class."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    least = threshold / 100
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    signed = scratch.save(slim.mapInArrow(_signatures, "id long, h long, n long, digest binary, tensor array<long>, sketch binary"), "signatures")
    # A class is known by a number of its own (rep), which the saved table fixes: ids may repeat with other texts.
    # Its text is found by the least id and that row's text hash.
    classes = signed.where(F.col("digest").isNotNull() & which).groupBy("digest", "n").agg(
        F.min(_place()).alias("least"), F.min("tensor").alias("tensor"), F.min("sketch").alias("sketch")
    )
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("rep"), "least.id", "least.h", "digest", "n", "tensor", "sketch"), "classes")

    # Tables: (i, j) joins hash i of the first collection with hash j of the second.
    first, second = F.slice("tensor", 1, M), F.slice("tensor", M + 1, M)
    keys = F.flatten(F.transform(first, lambda a, i: F.transform(second, lambda b, j: F.xxhash64(i, a, j, b))))
    rows = classes.select("rep", F.explode(keys).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    rows = scratch.save(rows.join(shared, "bucket"), "buckets")

    # Hubs.
    score = rows.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("score"))
    score = score.join(classes.select("rep", "id"), "rep")
    # Of equal scores the least id: copies mostly come after what they were made of, which is closest to all of them.
    hub = rows.join(score, "rep").groupBy("bucket").agg(F.max(F.struct("score", F.bitwise_not("id").alias("early"), (-F.col("rep")).alias("low"))).alias("top"))
    met = rows.join(hub, "bucket").where(F.col("rep") != -F.col("top.low")).groupBy("rep").agg(F.max("top").alias("top"))
    star = met.select((-F.col("top.low")).alias("u"), F.col("rep").alias("v"))

    def ruled(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, BINS) for c in (a, b))
        return pd.Series(may_link(x, y, na.to_numpy(), nb.to_numpy(), least))

    possible = F.pandas_udf(ruled, "boolean")
    small = classes.select("rep", "n", "sketch")
    side = lambda name: small.select(F.col("rep").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    sized = star.join(side("u"), "u").join(side("v"), "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * threshold)
    star = scratch.save(sized.where(possible("su", "sv", "nu", "nv")).select("u", "v", "nu", "nv"), "star")
    links = scratch.save(_verified(star, slim, classes, scratch, threshold, "a"), "links")
    near = components(links, scratch, "near")

    # What the hubs left apart.
    placed = rows.select("bucket", "rep").join(near.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("size")).where("a <> b")
    mixed = scratch.save(mixed.select("bucket", "size"), "mixed")
    # Buckets of more than HEAVY members are compared block against block; a member goes to each pair of blocks that
    # has its own. Members of the largest component fill blocks of their own, which meet those of the others alone.
    counts = placed.join(mixed.where(F.col("size") > HEAVY).select("bucket"), "bucket").groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    heavy = counts.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"))
    blocks = lambda n: F.ceil(n / HEAVY).cast("long")
    heavy = heavy.select("bucket", F.col("top.comp").alias("main"), blocks(F.col("size") - F.col("top.c")).alias("bo"), blocks(F.col("top.c")).alias("bm"), F.col("top.c").alias("c"), "size")
    heavy = scratch.save(heavy, "heavy")
    copies = heavy.agg(F.sum((F.col("size") - F.col("c")) * (F.col("bo") + F.col("bm")) + F.col("c") * F.col("bo"))).first()[0] or 0
    total = copies + (mixed.where(F.col("size") <= HEAVY).agg(F.sum("size")).first()[0] or 0)
    placed = placed.join(mixed.select("bucket"), "bucket").join(heavy.select("bucket", "main", "bo", "bm"), "bucket", "left").join(small, "rep")
    main, number = F.coalesce(F.col("comp") == F.col("main"), F.lit(False)), F.xxhash64("rep")
    one = F.lit(1).cast("long")
    own = F.when(main, F.col("bo") + F.pmod(number, F.col("bm"))).otherwise(F.pmod(number, F.coalesce("bo", one)))
    meets = F.when(main, F.col("bo")).otherwise(F.coalesce(F.col("bo") + F.col("bm"), one))
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)))
    placed = placed.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "comp", "n", "sketch")
    # Many pairs of blocks share a group, which holds GROUP rows on average: as many groups as the copies ask for.
    placed = placed.withColumn("deal", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(-(-total // GROUP) or 1)))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = _apart(pdf.sort_values(["bucket", "lo", "hi", "rep"], kind="stable"), least)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    rest = placed.groupBy("deal").applyInPandas(compared, "u long, v long").distinct()
    rest = rest.join(star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
    sizes = lambda name: classes.select(F.col("rep").alias(name), F.col("n").alias(f"n{name}"))
    rest = scratch.save(rest.join(sizes("u"), "u").join(sizes("v"), "v"), "rest")
    more = _verified(rest, slim, classes, scratch, threshold, "b")
    comps = components(links.union(more), scratch, "final")
    of = classes.select("digest", "id", "h", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    of = of.select("digest", "comp").join(of.groupBy("comp").agg(F.min(_place()).alias("least")), "comp").select("digest", "least")
    return signed.select("id", "h", "n", "digest").join(of, "digest", "left").select("id", "h", "n", "least")


def _place() -> Column:
    """Orders rows by id, nulls last, then by the text's hash."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "h")


def _verified(pairs: DataFrame, slim: DataFrame, classes: DataFrame, scratch: Scratch, threshold: int, name: str) -> DataFrame:
    """The pairs u, v (sizes nu, nv) whose full sets are as similar as asked."""
    takes_part = pairs.select(F.col("u").alias("rep")).union(pairs.select(F.col("v").alias("rep"))).distinct()
    wanted = classes.select("rep", "id", "h", "digest").join(takes_part, "rep")
    same = slim["id"].eqNullSafe(wanted["id"]) & (slim["h"] == wanted["h"])
    sets = scratch.save(slim.join(wanted, same).select("rep", "text", "digest").mapInArrow(_sets, "rep long, shingles array<long>"), f"sets-{name}")
    side = lambda of: sets.select(F.col("rep").alias(of), F.col("shingles").alias(f"s{of}"))
    both = F.size(F.array_intersect("su", "sv")).cast("long")
    joined = pairs.join(side("v"), "v").join(side("u"), "u")
    return joined.where(both * 100 >= (F.col("nu") + F.col("nv") - both) * threshold).select("u", "v")


def query(spark, sf_dir: str) -> DataFrame:
    out = classify(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, of the smallest id (nulls last; then the least text hash); groups at the similarity of 0.8.
    Rows that repeat an id and a text are copies as well, and so are rows without an id; texts without words all stay."""
    scratch = Scratch(spark, "neardup-stage")
    rows = _classified(docs.select("doc_id", "text"), 80, "doc_id", "text", F.lit(True)).where("least is not null")
    rows = rows.withColumn("gone", ~_place().eqNullSafe(F.col("least")))
    marked = rows.groupBy("id", "h").agg(F.min("gone").alias("gone"), F.count("*").alias("times")).where("gone or times > 1")
    p = own_prefix(docs)
    i, h, g, own = (p + x for x in ("id", "h", "gone", "own"))
    marked = scratch.save(marked.select(F.col("id").alias(i), F.col("h").alias(h), F.col("gone").alias(g)), "marked")
    hashed = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = hashed.join(marked, same, "left_anti").select(*columns)
    repeated = marked.where(~F.col(g))
    if not repeated.limit(1).count():
        return out
    # Of equal rows one, chosen by partial aggregation: however many there are, none gathers in a task.
    one = hashed.join(repeated, same, "left_semi").groupBy("doc_id", own).agg(F.min(F.struct(*columns)).alias(p + "row"))
    return out.union(one.select(p + "row.*"))


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as shingle from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.both >= 85 * (x.n + y.n - p.both)),
r as (select doc_id as node, doc_id as seen from documents union select r.node, l.b from r join l on l.a = r.seen),
c as (select node, min(seen) as component_id from r group by node)
select c.node as doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, c.node = c.component_id as kept from c left join n on n.doc_id = c.node
"""
