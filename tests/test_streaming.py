from pyspark.sql import functions as F

from ringspark.operators.aggregate import cofactor_long
from ringspark.sources import tables
from ringspark.streaming.cofactor import windowed_cofactor

SF = "/root/testdata/sf0.001"


def test_windows_equal_batch(spark, tmp_path):
    events = tables.table(spark, SF, "events")
    time = next(f.name for f in events.schema.fields if f.dataType.simpleString().startswith("timestamp"))
    flat = events.select(F.col(time).cast("timestamp").alias("at"), F.round("value").alias("v"), F.ascii("event_type").alias("k"))
    tables.write(flat, str(tmp_path / "in"))
    stream = spark.readStream.schema(flat.schema).parquet(str(tmp_path / "in"))
    query = windowed_cofactor(stream, "at", "1 hour", ["v"], ["k"]).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    want = cofactor_long(flat.withColumn("h", F.window("at", "1 hour").start), ["v"], ["k"], ["h"])
    got = spark.sql("select window.start as h, block, pos, key1, key2, value from windows")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_formats(spark, tmp_path):
    df = tables.from_values(spark, [(1, 2.5, "a")], "k int, x double, s string")
    for fmt in ("csv", "parquet", "json", "orc"):
        tables.write(df, str(tmp_path / fmt), fmt)
    assert tables.read_csv(spark, str(tmp_path / "csv")).collect() == df.collect()
    assert tables.from_pandas(spark, df.toPandas(), "frame").count() == 1
