from annalist.streaming import reigns
from pyspark.sql import functions as F


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def stream(spark, tmp_path):
    spark.createDataFrame([("k", "a", 0), ("k", "a", 60), ("k", "b", 120), ("j", "a", 0), ("j", "a", 0), ("z", "q", 90000)], "key string, holder string, s long").select("key", "holder", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("key string, holder string, ts timestamp").parquet(str(tmp_path / "in"))


def test_changes(spark, tmp_path):
    got = run(reigns.holder_changes(stream(spark, tmp_path), "key", "holder", "ts"), "changes")
    assert sorted((r.key, r.holder, r.previous) for r in got.collect() if r.key != "z") == [("j", "a", None), ("k", "a", None), ("k", "b", "a")]


def test_duplicates(spark, tmp_path):
    assert run(reigns.deduplicated(stream(spark, tmp_path), ["key", "holder"], "ts", "1 hour"), "unique_rows").count() == 4


def test_sessions(spark, tmp_path):
    got = run(reigns.sessions(stream(spark, tmp_path), "key", "ts", "10 minutes", "1 hour"), "sessions").collect()
    assert {(r.key, r.n) for r in got if r.key != "z"} == {("k", 3), ("j", 2)}
