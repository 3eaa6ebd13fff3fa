"""Sources and sinks: files of several formats, values, pandas frames, and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header. Without a schema the file is read twice, once for its types."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def from_values(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def from_pandas(spark: SparkSession, frame, view: str | None = None) -> DataFrame:
    """A pandas frame, also as a view that SQL can name."""
    df = spark.createDataFrame(frame)
    if view:
        df.createOrReplaceTempView(view)
    return df


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
    """CREATE TABLE AS, or INSERT with mode="append"."""
    df.write.mode(mode).saveAsTable(name)
    return df.sparkSession.table(name)
