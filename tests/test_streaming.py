"""Streams against the same rows in batch."""

from pyspark.sql import functions as F

from sparkglyph.streaming import streams

LOG = """--- BEGIN app t#1
 allocated:     1     2
REP 1
 allocated:     3     4
--- END
 allocated:     5     6
"""


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_log(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    got = run(streams.repetitions(streams.log_stream(spark, str(tmp_path))), "reps")
    assert [(r.test, r.rep, r.allocated.split()[0]) for r in got.collect()] == [("app t#1", None, "1"), ("app t#1", 1, "3"), (None, None, "5")]


def test_samples(spark, tmp_path):
    rows = spark.range(300).select((F.timestamp_seconds(F.col("id") * 7)).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), (F.col("id") % 2).alias("user_id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    got = {tuple(r) for r in run(streams.samples(stream, "60 seconds"), "samples", "complete").collect()}
    want = {tuple(r) for r in rows.groupBy(F.window("ts", "60 seconds").alias("w"), "event_type").count().select("w.start", "event_type", "count").collect()}
    assert got == want
    assert run(streams.sessions(stream, "30 seconds"), "sessions", "complete").agg(F.sum("n")).first()[0] == 300


def test_incremental(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(3).write.parquet(str(src))
    go = lambda: streams.incremental(spark, str(src), "id long", "parquet", lambda d: d, str(tmp_path / "out"), str(tmp_path / "cp"))
    go()
    spark.range(3, 5).write.mode("append").parquet(str(src))
    go()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]
