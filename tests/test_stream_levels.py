"""Three levels of a stream's rollup in one chain, against batch rollups of the same rows."""

import random
import tempfile

from pyspark.sql import functions as F

from meshlens.streaming import ingest

STEPS = ["1 minute", "10 minutes", "1 hour"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_three_levels_equal_batch(spark):
    rng = random.Random(2)
    facts = [(3600 + i * 40 - rng.randrange(60), rng.choice(["a", "b", None]), rng.randrange(100), rng.randrange(1500)) for i in range(600)]
    df = spark.createDataFrame(facts, "s long, k string, v long, m long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    source = tempfile.mkdtemp(prefix="spark-")
    for i in range(4):  # rows a minute late at most
        part = df.where((F.unix_seconds("ts") >= 3600 + i * 6000) & (F.unix_seconds("ts") < (3600 + (i + 1) * 6000 if i < 3 else 10**9)) | (F.unix_seconds("ts") < 3600) & F.lit(i == 0))
        part.coalesce(1).write.mode("append").parquet(source)
    df.limit(1).withColumns({"ts": F.timestamp_seconds(F.lit(10**7)), "k": F.lit("end")}).coalesce(1).write.mode("append").parquet(source)
    for i, step in enumerate(STEPS):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = tempfile.mkdtemp(prefix="spark-")
        level = ingest.rollup_levels(stream, "ts", ["k"], STEPS[: i + 1], "2 minutes", ["v"], ["m"])[-1]
        query = level.writeStream.format("parquet").option("path", out).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        batch = df.groupBy(F.window("ts", step), "k").agg(F.sum("v").alias("v"), F.max("m").alias("m")).select("window.start", "window.end", "k", "v", "m")
        got = spark.read.schema(level.schema).parquet(out).where("k IS NULL OR k <> 'end'")
        assert rows(got) == rows(batch)


def test_partial_rows_are_merged(spark):
    df = spark.createDataFrame([(0, 60, "a", 1, 5), (0, 60, "a", 2, 9), (0, 60, None, 4, 1), (60, 120, "a", 8, 2)], "start long, stop long, k string, v long, m long")
    assert rows(ingest.merged(df, ["k"], ["v"], ["m"])) == rows(spark.createDataFrame([(0, 60, "a", 3, 9), (0, 60, None, 4, 1), (60, 120, "a", 8, 2)], df.schema))
