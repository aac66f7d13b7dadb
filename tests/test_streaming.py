from pyspark.sql import functions as F

from inkwell.streaming.gate import gate
from inkwell.streaming.windows import sessions, tumbling

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def streamed(spark, path, make, mode, name):
    """The final rows of a streaming query over the files of a folder, one file a micro-batch."""
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query = make(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted(map(str, spark.table(name).collect()))


def test_streams_equal_their_batch_twins(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.range(60).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 400 + F.col("id") % 7 * 900).alias("ts"), (F.col("id") % 4).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "view").otherwise("buy").alias("event_type"), (F.col("id") * 1.5).alias("value"))
    rows.where("event_id < 30").coalesce(1).write.parquet(path)
    rows.where("event_id >= 30").coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    late = "10 days"
    assert streamed(spark, path, lambda s: tumbling(s, "1 hour", late), "complete", "t_tumbling") == sorted(map(str, tumbling(batch, "1 hour").collect()))
    assert streamed(spark, path, lambda s: sessions(s, "30 minutes", late), "complete", "t_sessions") == sorted(map(str, sessions(batch, "30 minutes").collect()))


def test_streaming_gate(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.range(24).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), (F.col("id") % 2).alias("user_id"),
        F.concat(F.lit("t"), (F.col("id") % 9).cast("string")).alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(path)
    shaped = lambda df: df.select("user_id", "event_id", F.unix_millis("ts").alias("ms"), F.col("event_type").alias("fingerprint"))
    assert streamed(spark, path, lambda s: gate(shaped(s)), "append", "t_gate") == sorted(map(str, gate(shaped(spark.read.parquet(path))).collect()))


def test_registry_keeps_the_newest_values(spark, tmp_path):
    from inkwell.streaming.registry import newest_first, register, registry

    held, events = register(["a", "b"], ["b", "c", "d", "a"], 3)
    assert held == ["c", "d", "a"] and events == [("c", "added"), ("a", "evicted"), ("d", "added"), ("b", "evicted"), ("a", "added")]
    path = str(tmp_path / "events")
    rows = spark.range(40).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), (F.col("id") % 2).alias("user_id"), F.concat(F.lit("v"), (F.col("id") / 2).cast("int").cast("string")).alias("event_type"),
        F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(path)
    shaped = lambda df: df.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), "ts")
    got = streamed(spark, path, lambda s: registry(shaped(s), 5), "append", "t_registry")
    left = {}
    for r in spark.table("t_registry").collect():
        left[r.key, r.value] = left.get((r.key, r.value), 0) + (1 if r.event == "added" else -1)
    assert len(got) > 40 and {k for k, n in left.items() if n} == {(r.key, r.value) for r in newest_first(shaped(spark.read.parquet(path)), "key", 5).collect()}


def test_snapshot_of_a_stream_ends_as_that_of_the_table(spark, tmp_path):
    from inkwell.streaming.registry import snapshot

    path = str(tmp_path / "events")
    rows = spark.range(30).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.where("event_id < 10").coalesce(1).write.parquet(path)
    rows.where("event_id >= 10").coalesce(1).write.mode("append").parquet(path)
    assert streamed(spark, path, snapshot, "complete", "t_snapshot") == sorted(map(str, snapshot(spark.read.parquet(path)).collect()))


def test_failed_labels_are_rows_and_can_be_resumed(spark):
    from inkwell.operators.labelling import label_rows, unfinished

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)] + [(9, None)], "id long, text string")
    told = label_rows(rows, lambda t: {"t1": "one", "t2": "two"}[t], pause=0.0)
    got = {r.id: (r.label, r.error is not None, r.attempts) for r in told.collect()}
    assert got[1] == ("one", False, 1) and got[0] == (None, True, 2) and got[9][1] and len(got) == 7
    assert sorted(r.id for r in unfinished(rows, told).collect()) == [0, 3, 4, 5, 9]
