"""What sessions carry: in segments, from stored states, and as a stream, against one pass."""

import random

from pyspark.sql import functions as F

from meterloom.operators.events import carried_states, usage_events
from meterloom.schemas import RECORDS
from meterloom.streaming import sessions


def random_records(seed, n_sessions=30, length=40):
    rng = random.Random(seed)
    counts = lambda top: tuple(rng.choice([0, 0, rng.randrange(top)]) for _ in range(5))
    rows = []
    for s in range(n_sessions):
        spawned, forked = rng.random() < 0.3, rng.random() < 0.2
        for i in range(rng.randrange(1, length)):
            kind = rng.choice(["usage", "usage", "usage", "context", "message", "other"])
            last, total = (counts(50) if kind == "usage" and rng.random() < p else None for p in (0.5, 0.5))
            rows.append((
                f"s{s}", i, rng.choice([None, i * 60 + rng.randrange(60)]) if kind in ("usage", "message") else None, kind, rng.choice([None, "m1", "m2"]) if kind != "other" else None, last, total,
                counts(9) if kind == "message" else None, spawned and i == 0, rng.random() < 0.04, rng.randrange(0, 600) if forked and rng.random() < 0.1 else None,
            ))
    return rows


def table(spark, seed):
    rows = [(*r[:2], None, *r[3:10], None, r[2], r[10]) for r in random_records(seed)]
    raw = spark.createDataFrame(rows, RECORDS + ", at bigint, fork_at bigint")
    return raw.withColumns({"ts": F.timestamp_seconds("at"), "fork_ts": F.timestamp_seconds("fork_at")}).drop("at", "fork_at")


def values(df):
    return sorted(map(str, df.select("session_id", "seq", "ts", "model", "is_fallback", "input", "cached_input", "output", "reasoning_output", "total").collect()))


def test_segments_and_states(spark):
    records = table(spark, 1).cache()
    want, final = values(usage_events(records)), sorted(map(str, carried_states(records).collect()))
    assert len(want) > 100
    for size in (1, 7):
        segment = F.floor(F.col("seq") / size)
        assert values(usage_events(records, segment=segment)) == want
        assert sorted(map(str, carried_states(records, segment=segment).collect())) == final
    for cut in (5,):
        early, rest = records.where(F.col("seq") < cut), records.where(F.col("seq") >= cut)
        state = carried_states(early)
        assert sorted(values(usage_events(early)) + values(usage_events(rest, segment=F.floor(F.col("seq") / 5), state=state))) == want
        assert sorted(map(str, carried_states(rest, state=state).collect())) == final


def test_one_long_session_is_many_tasks(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("session_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.lit("usage").alias("kind"),
        F.lit(None).cast("string").alias("model"), F.when(F.col("id") % 7 > 0, F.struct(*[F.lit(1).cast("bigint").alias(c) for c in ("input", "cached_input", "output", "reasoning_output", "total")])).alias("last"),
        F.when(F.col("id") % 7 == 0, F.struct(*[F.col("id").alias(c) for c in ("input", "cached_input", "output", "reasoning_output", "total")])).alias("cumulative"),
        F.lit(None).cast("struct<input:bigint,cached_input:bigint,output:bigint,reasoning_output:bigint,total:bigint>").alias("message"), F.lit(False).alias("is_spawned"), F.lit(False).alias("is_boundary"), F.lit(None).cast("timestamp").alias("fork_ts"),
    )
    cut = usage_events(rows, segment=F.floor(F.col("seq") / 2000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = cut.where("session_id = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 15_000
    total = lambda df: df.groupBy("session_id").agg(F.sum("input"), F.sum("total"), F.count("*")).orderBy("session_id").collect()
    assert total(cut) == total(usage_events(rows))


def test_a_stream_in_three_batches(spark, tmp_path):
    records = table(spark, 2).withColumn("reset", F.lit(False)).cache()
    for n, (low, high) in enumerate([(0, 4), (4, 20), (20, 1000)]):
        records.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.parquet(str(tmp_path / f"in/b={n}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = sessions.session_events(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None and len([p for p in query.recentProgress if p.numInputRows]) == 3
    assert values(spark.read.parquet(str(tmp_path / "out")).where("is_event")) == values(usage_events(records).where("ts IS NOT NULL"))
