"""Cofactor triples over a stream.

A triple is a sum, so windows of a stream keep only counts and sums: the long form's
entries of each row are exploded (a fixed number, by the columns) and summed by window and
key.  A watermark bounds the state.  Finished windows, or a batch's changed ones, go to
``assemble`` like any long rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ring import to_cofactor
from ..operators.aggregate import entries_of


def windowed_cofactor(stream: DataFrame, time: str, every: str, num, cat=(), late: str = "10 minutes") -> DataFrame:
    """window, block, pos, key1, key2, value, in append or update mode."""
    lifted = stream.withWatermark(time, late).select(F.col(time), to_cofactor(num, cat).alias("triple"))
    rows = lifted.select(F.col(time), F.inline(entries_of("triple", lifted, False)))
    return rows.groupBy(F.window(time, every), "block", "pos", "key1", "key2").agg(F.sum("value").alias("value"))
