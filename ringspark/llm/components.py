"""Connected components by alternating min-label propagation and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``edges``: columns u, v (long; any direction, repeats allowed, no nulls).

    Returns node, comp for every node of an edge, comp being the smallest node
    reachable.  Each round takes the least label among the neighbours (a
    partially aggregated min, so hubs are harmless) and then jumps to the
    label's label; a path of length L takes O(log L) rounds on the stars and
    short chains met here.  Labels are written to the shared folder each round;
    only a count of changes reaches the driver.  No edges: no rows.
    """
    both = scratch.save(
        edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(),
        f"{name}-both",
    )
    labels = scratch.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("comp")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        least = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # Hooking: a label's own node learns the least label that its members saw.
        hook = least.groupBy(F.col("old").alias("node")).agg(F.min("comp").alias("hooked"))
        hooked = least.join(hook, "node", "left").select("node", "old", F.least("comp", F.coalesce("hooked", "comp")).alias("comp"))
        hooked = scratch.save(hooked, f"{name}-h{k}")
        jump = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = scratch.save(
            hooked.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")), f"{name}-{k}"
        )
        changed = new.where("comp <> old").limit(1).count()
        scratch.drop(f"{name}-h{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        labels = new.select("node", "comp")
        if not changed:
            return labels
