"""What the operators share: scratch tables, stable folds, word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch that goes to a Python worker. The engine's own limit, 64 MB, asks for
#: many times that much memory in a worker that holds texts and what it makes of them.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "64MB", "4MB")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size unless it has been set."""
    name, usual, small = BATCH
    if str(spark.conf.get(name, usual)).lower() in ("64mb", "67108864b", "67108864"):
        spark.conf.set(name, small)


class Scratch(scratch.Scratch):
    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        super().__init__(spark, name)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """df with columns of these names (in any case) renamed to the next free one, ``name_1`` and so on, so that
    an operator's results can take the names and the caller's columns are kept."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    for c in [c for c in df.columns if c.lower() in {n.lower() for n in names}]:
        k = next(k for k in range(1, len(taken) + 2) if f"{c}_{k}".lower() not in taken)
        df = df.withColumnRenamed(c, f"{c}_{k}")
        taken.add(f"{c}_{k}".lower())
    return df


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column of df has: for columns that come and go within an operator."""
    k = 0
    while any(c.lower().startswith(f"__{k}") for c in df.columns):
        k += 1
    return f"__{k}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
