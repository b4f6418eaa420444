import datetime as dt

from strataspark.streaming import series

T = dt.datetime(2025, 1, 1)


def write(spark, rows, path):
    spark.createDataFrame(rows, "scope_key string, taken_at timestamp_ntz, gini_in_degree double").coalesce(1).write.mode("append").parquet(path)


def drain(df, tmp_path, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_windows_and_trends(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, [("a", T, 0.5), ("a", T + dt.timedelta(days=1), 0.6), ("b", T, 0.1), (None, T, 0.3)], path)
    write(spark, [("a", T + dt.timedelta(days=2), 0.6), ("a", T + dt.timedelta(days=30), 0.4), ("b", None, 0.2), ("b", T + dt.timedelta(days=30), None)], path)
    schema = spark.read.parquet(path).schema
    stream = series.snapshot_stream(spark, path, schema, 10)
    counts = drain(series.windowed(stream, "taken_at", width="7 days"), tmp_path, "counts", "complete")
    assert sum(r.n for r in counts) == 7
    got = drain(series.trends(stream, "scope_key", "taken_at", "gini_in_degree"), tmp_path, "trends", "append")
    assert sorted((r.scope_key, r.gini_in_degree, r.trend) for r in got) == sorted(
        [("a", 0.5, "unknown"), ("a", 0.6, "rising"), ("a", 0.6, "stable"), ("a", 0.4, "falling"), ("b", 0.1, "unknown")]
    )


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, [("a", T + dt.timedelta(minutes=m), 0.0) for m in (0, 10, 20)], path)
    write(spark, [("a", T + dt.timedelta(minutes=500), 0.0)], path)
    stream = series.snapshot_stream(spark, path, spark.read.parquet(path).schema, 1)
    got = drain(series.sessions(stream, "taken_at", "scope_key").select("start", "n"), tmp_path, "sess", "append")
    assert [r.n for r in got] == [3]  # the other one is still open
