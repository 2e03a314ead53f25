"""Streaming sessions equal the batch islands once all events have come."""

from trowel.streaming.sessions import sessions, windowed_totals


def test_sessions(spark, tmp_path):
    rows = [("u", f"2024-01-01 0{h}:{m:02}:00") for h, m in ((1, 0), (1, 30), (2, 10), (5, 0))] + [("v", "2024-01-01 01:00:00"), ("z", "2024-01-03 00:00:00")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "user string, ts string").coalesce(1).write.json(source)
    stream = spark.readStream.schema("user string, ts string").json(source)
    for n, (df, want) in enumerate(((sessions(stream, "user", "ts"), {("u", 3), ("u", 1), ("v", 1)}), (windowed_totals(stream, "user", "ts"), {("u", 4), ("v", 1)}))):
        query = df.writeStream.format("memory").queryName(f"out{n}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert {(r.user, r.n) for r in spark.table(f"out{n}").collect() if r.user != "z"} == want
