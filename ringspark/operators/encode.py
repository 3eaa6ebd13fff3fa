"""Dense integer codes for categories of any type, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def categories(df: DataFrame, columns) -> dict[str, DataFrame]:
    """Of each column: its distinct non-null values in order, with codes from 0."""
    out = {}
    for c in columns:
        distinct = df.select(F.col(c).alias("value")).where(F.col(c).isNotNull()).distinct()
        ranged = distinct.repartitionByRange("value").withColumn("pid", F.spark_partition_id()).persist()
        counts = ranged.groupBy("pid").agg(F.count("*").alias("n"))
        before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        code = F.row_number().over(Window.partitionBy("pid").orderBy("value")) - 1 + F.col("before")
        out[c] = ranged.join(before, "pid").select("value", code.cast("int").alias("code"))
    return out


def encode(df: DataFrame, columns, known: dict[str, DataFrame] | None = None, suffix: str = "_code") -> DataFrame:
    """Adds <column><suffix>; null and values that aren't known get null. The engine picks the join by the sizes."""
    for c, values in (known or categories(df, columns)).items():
        v = values.select(F.col("value").alias("__v"), F.col("code").alias(c + suffix))
        df = df.join(v, df[c] == F.col("__v"), "left").drop("__v")
    return df


def decode(df: DataFrame, column: str, values: DataFrame, alias: str) -> DataFrame:
    v = values.select(F.col("value").alias(alias), F.col("code").alias("__k"))
    return df.join(v, df[column] == F.col("__k"), "left").drop("__k")


def unique_categories(df: DataFrame, columns) -> DataFrame:
    """column, value: the ordered distinct values of all categorical columns, in one job."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("int").alias("value")) for c in columns])))
    return long.where("value is not null").distinct()
