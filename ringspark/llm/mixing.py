"""Mixing sources to target weights.

Every document gets a hash-random key (md5 of the seed and its id); within a source
the documents stand in the order of their keys.  The key's first three hex digits cut
each source into 4096 ranges, so a prefix sum is the sum of the ranges before (a
small table) plus a running sum within the range: no task ever holds a source.  A
source whose target is R words over whole epochs takes each document once for every
epoch and once more while the running sum stays under R; the document at the cut is
taken in part, so each source's words meet its target to the word.

Targets: the budget is shared by weight; no target exceeds ``most`` times its source's
size, and the excess is reshared among the others until none is above.

Defined results: null and empty texts have size 0; a null source is a source of its
own, the last; rows that repeat an id follow one another by size; an empty table
gives an empty result; a budget above what all sources allow gives each its most.
A caller's column with the result's name is kept under the next free name (``mix_1``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, documents, make_room, own_prefix

WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, scratch: Scratch, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """sizes: source, source_size and more. Adds target. Sources may be many: they are ranked by a
    range sort with a prefix sum over its partitions, and only sums reach the driver."""
    ordered = scratch.save(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id()), "sources"
    )
    before = ordered.groupBy("pid").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int")).cast("long")
    ranked = ordered.join(before, "pid").withColumn("rank", rank).withColumn("weight", weight).drop("pid", "n", "before", "rank")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    level = 0.0
    while True:
        full = F.col("source_size") * most <= F.col("weight") * F.lit(level)
        got = ranked.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not got[1]:
            level = float("inf")
            break
        new = (budget - (got[0] or 0) * most) / got[1]
        if new <= level:
            break
        level = new
    least = F.col("source_size") * F.lit(float(most))
    shared = least if level == float("inf") else F.least(least, F.col("weight") * F.lit(level))
    return ranked.withColumn("target", shared.cast("double"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
    out: str = "mix",
) -> DataFrame:
    """docs with a struct column: size, source_size, target, taken (words), copies
    (whole or begun), rest (words of the last copy where that is cut, else null).
    size_col: a column that has the sizes already."""
    docs = make_room(docs, out)
    at = "__" + uuid.uuid4().hex[:8]
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    # A source's name in the exchange is never null, so that the join and the window ask for the same one.
    src, cell = f"{at}s", f"{at}c"
    name = F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    size = F.col(size_col) if size_col else words(F.col(text_col))
    keyed = docs.select(
        "*", name.alias(src), F.substring(key, 1, 3).alias(cell), F.struct(size.alias("size"), F.col(source_col).alias("source"), key.alias("key")).alias(at)
    )
    slim = scratch.save(keyed.groupBy(f"{at}.source", src, cell).agg(F.sum(f"{at}.size").alias("size")), "cells")
    goal = targets(slim.groupBy("source", src).agg(F.sum("size").alias("source_size")), scratch, share, most, weights)
    prior = F.coalesce(F.sum("size").over(Window.partitionBy(src).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = slim.withColumn("before", prior).join(goal.select(src, "source_size", "target"), src)
    cells = scratch.save(cells.select(src, cell, *[F.col(c).alias(f"{at}_{c}") for c in ("before", "source_size", "target")]), "offsets")
    # A merge join at every size: documents move once, whatever the size of the offsets.
    joined = keyed.join(cells.hint("merge"), [src, cell])
    running = Window.partitionBy(src, cell).orderBy(f"{at}.key", id_col, f"{at}.size").rowsBetween(Window.unboundedPreceding, -1)
    size, whole, target = F.col(f"{at}.size"), F.col(f"{at}_source_size"), F.col(f"{at}_target")
    epochs = F.when(whole > 0, F.floor(target / whole)).otherwise(F.lit(0)).cast("long")
    left = F.floor(target).cast("long") - epochs * whole
    begin = F.col(f"{at}_before") + F.coalesce(F.sum(f"{at}.size").over(running), F.lit(0))
    joined = joined.withColumns({f"{at}e": epochs, f"{at}p": left - begin})
    part = F.greatest(F.lit(0), F.least(F.col(f"{at}p"), size))
    result = F.struct(
        size.alias("size"),
        whole.alias("source_size"),
        target.alias("target"),
        (F.col(f"{at}e") * size + part).cast("long").alias("taken"),
        (F.col(f"{at}e") + (F.col(f"{at}p") > 0).cast("long")).alias("copies"),
        F.when((part > 0) & (part < size), part).alias("rest"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], result.alias(out))


def materialise(mixed: DataFrame, text_col: str = "text", out: str = "mix") -> DataFrame:
    """A row for each copy; the copy at a cut keeps its first ``rest`` words."""
    copy = own_prefix(mixed) + "copy"
    rows = mixed.where(F.col(f"{out}.copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{out}.copies"))))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col(f"{out}.rest").cast("int")), "")
    text = F.when((F.col(copy) == F.col(f"{out}.copies")) & F.col(f"{out}.rest").isNotNull(), cut).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).drop(copy, out)


def query(spark, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", words(F.col("text")).alias("words"))
    out = mix(Scratch(spark, "sizes").save(sized, "sizes"), size_col="words")
    return out.select("doc_id", "mix.size", "mix.source_size", F.round("mix.target", 6).alias("target"), "mix.taken")


ORACLE = r"""
with d as (select doc_id, source, md5('mix' || doc_id) as k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::double as source_size, 2 * sum(size)::double as most from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight from s),
r as (select *, (1.5 * (select sum(source_size) from s) - coalesce(sum(most) over (order by most / weight, source rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by most / weight, source rows between current row and unbounded following) as level from w),
t as (select source, source_size::bigint as source_size,
  least(most, weight * (select level from r where level <= most / weight order by most / weight, source limit 1)) as target from r),
e as (select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as epochs,
  coalesce(sum(size) over (partition by d.source order by k, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, round(target, 6) as target,
  (epochs * size + greatest(0, least(floor(target)::bigint - epochs * source_size - before, size)))::bigint as taken from e
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: documents of sources under target repeat, those over it are thinned."""
    own = own_prefix(docs) + "mix"
    return materialise(mix(docs, out=own), out=own)
