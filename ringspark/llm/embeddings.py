"""Embedding near-duplicates by a cover tree and a dual traversal.

On the unit sphere cosine >= c is distance <= sqrt(2 - 2c).  The tree's top is a set of
at most 256 pivots, chosen from a sample of at most 4096 vectors; each vector belongs to
its nearest pivot's cell.  Cells are cut by hash into blocks of ``block`` vectors on
average, and each block is given a cover tree with nested levels of radius 1/2, 1/4 and
1/8.  A vector goes to another cell's blocks only if that cell's covering radius lets it;
then each pair of blocks is traversed: pairs of nodes whose centres are further apart
than both covering radii and the threshold are pruned, pairs that lie within the
threshold altogether are counted without looking inside, others are opened, and vectors
are compared in double precision.  The links found are all there are.

What bounds it: pruning needs vectors that cluster.  Where vectors without near
duplicates spread over many dimensions, almost all centres stay apart as leaves, and the
work is that of comparing all pairs of blocks (by matrix products), the square of the
number of vectors.

Equal vectors are one class of which a single row is compared.  A task reports a vector's
number of links and one root for each of its vectors that has any, never pairs.

Defined results: a vector that is null, empty or zero or holds a null or non-finite
component links with nothing; vectors of different lengths don't link; rows that repeat
an id are vectors of their own.  Vectors are known by a number of their own; ids enter only
as the least id of a component.  A component without any id has a null one, and the rows
of one of its vectors are kept.  Callers' columns with the names of results are kept under
the next free names (``kept_1``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, make_room, own_prefix, table
from .components import components

LEVELS = (0.5, 0.25, 0.125)
PIVOTS, SAMPLE = 256, 4096
STRIP = 1024
COPIES = 16_384  # rows of vectors on their way to blocks that a task holds at once


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def choose(sample: np.ndarray, n: int) -> np.ndarray:
    """n pivots of the unit vectors, each the furthest from those before."""
    chosen = [0]
    far = distance(sample @ sample[0])
    while len(chosen) < min(n, len(sample)):
        k = int(far.argmax())
        chosen.append(k)
        far = np.minimum(far, distance(sample @ sample[k]))
    return sample[chosen]


def nodes(vectors: np.ndarray) -> np.ndarray:
    """Rows x levels: the number of the node that holds the vector. Centres are the first of their nodes."""
    out = np.zeros((len(vectors), len(LEVELS)), np.int64)
    small = vectors.astype(np.float32)
    parent = np.zeros(len(vectors), np.int64)
    for level, radius in enumerate(LEVELS):
        least = 1 - radius * radius / 2 + 1e-5
        count = 0
        order = np.argsort(parent, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(parent[order])) + 1):
            left = part
            while len(left):
                heads = left[:256]
                near = small[heads] @ small[left].T >= least
                near[np.arange(len(heads)), np.arange(len(heads))] = True
                taken = np.zeros(len(left), bool)
                for k in range(len(heads)):
                    if not taken[k]:
                        own = near[k] & ~taken
                        out[left[own], level] = count
                        taken |= own
                        count += 1
                left = left[~taken]
        parent = out[:, level]
    return out


class Tree:
    """Of the vectors of a block that are here: rows sorted so that nodes are ranges; covering radii as they are."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort(labels.T[::-1])
        self.v = vectors[self.order]
        labels = labels[self.order]
        self.starts, self.ends, self.radius, self.children = [], [], [], []
        for level in range(len(LEVELS)):
            new = np.ones(len(labels), bool)
            new[1:] = (labels[1:, : level + 1] != labels[:-1, : level + 1]).any(1)
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(labels))
            to = distance(np.einsum("ij,ij->i", self.v, self.v[np.repeat(start, end - start)]))
            self.radius.append(np.maximum.reduceat(to, start) if len(start) else np.zeros(0))
            self.radius[-1][end - start == 1] = 0.0
            self.starts.append(start)
            self.ends.append(end)
        for level in range(len(LEVELS) - 1):
            self.children.append((np.searchsorted(self.starts[level + 1], self.starts[level]), np.searchsorted(self.starts[level + 1], self.ends[level])))


class Links:
    """Weights of what each row is linked to, and the components of what has been linked."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, rows: np.ndarray) -> None:
        """All of these rows are one component."""
        at = self.root[rows]
        low = at.min()
        if (at != low).any():
            self.root[np.isin(self.root, np.unique(at))] = low


def traverse(a: Tree, b: Tree, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights linked to a's rows and to b's rows (in tree order), and roots over a's rows followed by b's (or a's alone if same)."""
    limit = float(distance(np.float64(cosine)))
    la, lb = np.zeros(len(wa), np.int64), np.zeros(len(wb), np.int64)
    links, shift = Links(len(wa) + (0 if same else len(wb))), 0 if same else len(wa)

    def centres(t: Tree, level: int) -> np.ndarray:
        return t.v[t.starts[level]]

    def compare(i0: int, i1: int, j0: int, j1: int) -> None:
        for at in range(i0, i1, STRIP):
            top = min(i1, at + STRIP)
            for bt in range(j0, j1, STRIP):
                end = min(j1, bt + STRIP)
                hit = a.v[at:top] @ b.v[bt:end].T >= cosine
                if same:
                    hit &= np.arange(at, top)[:, None] != np.arange(bt, end)[None, :]
                if hit.any():
                    la[at:top] += hit @ wb[bt:end]
                    if not same:
                        lb[bt:end] += wa[at:top] @ hit
                    for k in np.flatnonzero(hit.any(1)):
                        links.join(np.append(np.flatnonzero(hit[k]) + bt + shift, at + k))

    def whole(i0: int, i1: int, j0: int, j1: int) -> None:
        la[i0:i1] += wb[j0:j1].sum()
        if same:
            both = max(i0, j0), min(i1, j1)
            if both[0] < both[1]:
                la[both[0] : both[1]] -= wb[both[0] : both[1]]
        else:
            lb[j0:j1] += wa[i0:i1].sum()
        links.join(np.concatenate([np.arange(i0, i1), np.arange(j0, j1) + shift]))

    def first() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # Leaves (radius 0) against leaves need one comparison with a constant; they are most nodes where nothing clusters.
        kinds = [[(at, centres(t, 0)[at].astype(np.float32)) for at in (np.flatnonzero(t.radius[0] == 0), np.flatnonzero(t.radius[0] > 0))] for t in (a, b)]
        for x, (ia, ca) in enumerate(kinds[0]):
            for y, (ib, cb) in enumerate(kinds[1]):
                if not len(ia) or not len(ib):
                    continue
                for at in range(0, len(ia), STRIP):
                    if x == y == 0:
                        least = np.float32(1 - (limit + 1e-3) ** 2 / 2 - 1e-5)
                    else:
                        reach = np.minimum(2.0, a.radius[0][ia[at : at + STRIP], None] + b.radius[0][ib][None, :] + limit + 1e-3).astype(np.float32)
                        least = 1 - reach * reach / 2 - np.float32(1e-5)
                    hit = np.flatnonzero(ca[at : at + STRIP] @ cb.T >= least)
                    yield ia[at + hit // len(ib)], ib[hit % len(ib)]

    stack = [(0, i, j) for i, j in first()]
    while stack:
        level, i, j = stack.pop()
        if len(i) > 200_000:  # bounded memory
            stack += [(level, i[at : at + 200_000], j[at : at + 200_000]) for at in range(0, len(i), 200_000)]
            continue
        d = distance(np.einsum("ij,ij->i", a.v[a.starts[level][i]], b.v[b.starts[level][j]]))
        slack = a.radius[level][i] + b.radius[level][j]
        keep = d <= slack + limit + 1e-7
        i, j, d, slack = i[keep], j[keep], d[keep], slack[keep]
        inside = d + slack <= limit - 1e-7
        for x, y in zip(i[inside], j[inside], strict=True):
            whole(a.starts[level][x], a.ends[level][x], b.starts[level][y], b.ends[level][y])
        i, j = i[~inside], j[~inside]
        if not len(i):
            continue
        if level == len(LEVELS) - 1:
            for x, y in zip(i, j, strict=True):
                compare(a.starts[level][x], a.ends[level][x], b.starts[level][y], b.ends[level][y])
            continue
        (fa, ta), (fb, tb) = a.children[level], b.children[level]
        na, nb = ta[i] - fa[i], tb[j] - fb[j]
        n = na * nb
        at = np.repeat(np.arange(len(i)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        stack.append((level + 1, fa[i][at] + within // nb[at], fb[j][at] + within % nb[at]))
    return la, lb, links.root


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192) -> DataFrame:
    """vectors with the columns n_links, component_id (least id reachable, its own included) and kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))
    classes = scratch.save(
        rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).select(
            F.xxhash64("v").alias("key"), F.monotonically_increasing_id().alias("node"), "rep", "weight", F.size("v").alias("dim"), "v"
        ),
        "classes",
    )
    dims = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return _finish(vectors, rows, classes, None, scratch, id_col, vector_col)
    main, count = dims[0]["dim"], dims[0]["n"]
    sample = classes.where(F.col("dim") == main).orderBy("key", "node").limit(SAMPLE).select("v").toPandas()
    pivots = choose(unit(_stack(sample.v)), min(PIVOTS, -(-count // block)))
    element = classes.schema["v"].dataType.simpleString()
    base = "key long, node long, weight long, dim int, v " + element

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int64)
            to = np.zeros(batch.num_rows)
            at = np.flatnonzero(batch["dim"].to_numpy() == main)
            if len(at):
                d = distance(unit(np.asarray(batch["v"].take(pa.array(at)).flatten(), np.float64).reshape(-1, main)) @ pivots.T)
                cell[at], to[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(to)], [*batch.schema.names, "cell", "far"])

    assigned = scratch.save(classes.drop("rep").mapInArrow(assign, base + ", cell long, far double"), "assigned")
    cells = {r["cell"]: r for r in assigned.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()}  # PIVOTS rows at most
    cuts = {c: -(-r["n"] // block) for c, r in cells.items()}
    bases, total = {}, 0
    for c in sorted(cells):
        bases[c], total = total, total + cuts[c]
    apart = distance(pivots @ pivots.T)
    limit = float(distance(np.float64(cosine)))
    reach = np.array([cells[c]["r"] if c in cells else -9.0 for c in range(len(pivots))]) + limit + 1e-6
    slots = {c: np.arange(bases[c], bases[c] + cuts[c]) for c in cells}
    n_main = F.get(F.array(*[F.lit(cuts.get(c, 1)) for c in range(len(pivots))]), F.col("cell").cast("int"))
    b_main = F.get(F.array(*[F.lit(bases.get(c, 0)) for c in range(len(pivots))]), F.col("cell").cast("int"))
    # Vectors of another length than most: a cell for each length, in blocks by their share.
    other = assigned.where("cell < 0").groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("long").alias("blocks")).withColumnRenamed("dim", "od")
    located = assigned.join(other, F.col("dim") == F.col("od"), "left").withColumn("blocks", F.coalesce("blocks", n_main)).withColumn(
        "g", F.pmod(F.col("key"), F.col("blocks")) + F.coalesce(b_main, F.lit(0))
    ).drop("od")

    def planted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "node"], kind="stable")
        labels = nodes(unit(_stack(pdf.v)))
        return pdf.assign(l0=labels[:, 0], l1=labels[:, 1], l2=labels[:, 2])

    treed = scratch.save(
        located.groupBy("dim", "g").applyInPandas(planted, base + ", cell long, far double, blocks long, g long, l0 long, l1 long, l2 long"), "trees"
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, cell, g, blocks = (batch[n].to_numpy() for n in ("dim", "cell", "g", "blocks"))
            several = batch.select(["node", "weight", "dim", "v", "l0", "l1", "l2", "g"])

            def copies(rows: np.ndarray, partner: np.ndarray) -> Iterator[pa.RecordBatch]:
                for at in range(0, len(rows), COPIES):
                    own, to = g[rows[at : at + COPIES]], partner[at : at + COPIES]
                    taken = several.take(pa.array(rows[at : at + COPIES]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.minimum(own, to)), pa.array(np.maximum(own, to))], [*taken.schema.names, "lo", "hi"])

            at = np.flatnonzero(cell >= 0)
            if len(at):
                u = unit(np.asarray(batch["v"].take(pa.array(at)).flatten(), np.float64).reshape(-1, main))
                goes = (distance(u @ pivots.T) <= reach[None, :]) & (apart[cell[at]] <= reach[cell[at]][:, None] + reach[None, :])
                for c in cells:
                    some = at[goes[:, c] | (cell[at] == c)]
                    if len(some):
                        for part in np.array_split(slots[c], -(-len(slots[c]) * len(some) // COPIES)):  # however many blocks a cell has
                            yield from copies(np.repeat(some, len(part)), np.tile(part, len(some)))
            for k in np.flatnonzero(cell < 0):
                for first in range(0, int(blocks[k]), COPIES):
                    part = np.arange(first, min(int(blocks[k]), first + COPIES))
                    yield from copies(np.full(len(part), k), part)

    pairs = treed.mapInArrow(spread, f"node long, weight long, dim int, v {element}, l0 long, l1 long, l2 long, g long, lo long, hi long")

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf.lo.iloc[0], pdf.hi.iloc[0]
        sides = []
        for g in (lo,) if lo == hi else (lo, hi):
            part = pdf[pdf.g == g].sort_values("node", kind="stable")
            if not len(part):
                return pd.DataFrame({"node": [], "links": [], "root": []})
            tree = Tree(unit(_stack(part.v)), part[["l0", "l1", "l2"]].to_numpy())
            sides.append((tree, part.weight.to_numpy()[tree.order], part.node.to_numpy()[tree.order]))
        (a, wa, ra), (b, wb, rb) = sides[0], sides[-1]
        la, lb, root = traverse(a, b, wa, wb, cosine, lo == hi)
        own, links = (ra, la) if lo == hi else (np.concatenate([ra, rb]), np.concatenate([la, lb]))
        return pd.DataFrame({"node": own, "links": links, "root": own[root]})[links > 0]

    found = scratch.save(pairs.groupBy("dim", "lo", "hi").applyInPandas(linked, "node long, links long, root long"), "links")
    return _finish(vectors, rows, classes, found, scratch, id_col, vector_col)


def _finish(vectors, rows, classes, found, scratch, id_col, vector_col) -> DataFrame:
    if found is not None:
        sums = found.groupBy("node").agg(F.sum("links").alias("links"))
        comps = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch, "components")
        comps = classes.select("node", "rep").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        comps = comps.select("node", "comp").join(comps.groupBy("comp").agg(F.min("rep").alias("first")), "comp")
        of = classes.select("v", "node", "weight").join(sums, "node", "left").join(comps, "node")
        of = of.select(
            F.col("v").alias("__v"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
            F.col("first").alias("component_id"),
            (F.col("node") == F.col("comp")).alias("__root"),
        )
    else:
        of = classes.select(F.col("v").alias("__v"), F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"), F.lit(True).alias("__root"))
    p = own_prefix(vectors)
    left = vectors.withColumns({p + "i": F.col(id_col).cast("long"), p + "v": F.col(vector_col)})
    left = make_room(left, "n_links", "component_id", "kept")
    of = of.withColumnsRenamed({"__v": p + "of", "__root": p + "root"})
    out = left.join(of, F.col(p + "v") == F.col(p + "of"), "left")
    component = F.coalesce("component_id", F.col(p + "i"))
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0).cast("long")), "component_id": component})
    unnamed = F.col("component_id").isNull() & F.coalesce(p + "root", F.lit(True))
    return out.withColumn("kept", F.coalesce(F.col(p + "i") == F.col("component_id"), unnamed)).drop(p + "i", p + "v", p + "of", p + "root")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


ORACLE = r"""
with recursive n as (select vec_id, embedding::double[] as v from embeddings where embedding is not null),
u as (select vec_id, v, sqrt(list_dot_product(v, v)) as s from n),
l as (select a.vec_id as a, b.vec_id as b from u a, u b where a.vec_id <> b.vec_id and a.s > 0 and b.s > 0 and list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.95),
r as (select vec_id as node, vec_id as seen from embeddings union select r.node, l.b from r join l on l.a = r.seen),
c as (select node, min(seen) as component_id from r group by node)
select e.vec_id, (select count(*) from l where l.a = e.vec_id)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.node = e.vec_id
"""
