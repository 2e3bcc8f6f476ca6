"""The live monitor: appended lines, the events they give, and a snapshot at every tick.

Lines are parsed by a stateful operator (see sessions), so a batch reads its own lines only. Events are kept by UTC day as
long as a snapshot can look at them: late events join their day while it is kept, days before it are deleted, and a
snapshot reads the folders of its days alone. What a batch writes goes to folders named by its number, which a second run
of the batch overwrites. A file that was begun anew leaves a row which voids the events of its earlier epochs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterloom.functions import parse
from meterloom.operators import live
from meterloom.schemas import EVENTS, ReportOptions
from meterloom.sources.tail import TailSource
from meterloom.streaming import sessions

STORED = f"{EVENTS}, epoch int, is_event boolean, day date, batch bigint"
#: The day of rows that void epochs.
VOIDS = date(9999, 12, 31)


def _path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def first_day(now: datetime, tz: str) -> date:
    """The first UTC day that a snapshot at now looks at."""
    return live.retention_start(now, tz).astimezone(UTC).date()


def stored_events(spark: SparkSession, store: str, since: date | None = None) -> DataFrame:
    """The events of each session's latest epoch from the day since on; none for a store without a batch."""
    fs, path = _path(spark, f"{store}/events")
    if not fs.exists(path):
        return spark.createDataFrame([], EVENTS)
    rows = spark.read.schema(STORED).parquet(f"{store}/events")
    kept = rows.where(F.col("day") >= F.lit(since)) if since else rows
    latest = rows.where(F.col("day") == F.lit(VOIDS)).groupBy("session_id").agg(F.max("epoch").alias("latest"))
    kept = kept.where("is_event").join(latest, "session_id", "left").where(F.col("epoch") >= F.coalesce("latest", F.lit(0)))
    return kept.drop("latest", "epoch", "is_event", "day", "batch")


def apply_batch(events: DataFrame, number: int, store: str, now: datetime, tz: str) -> None:
    """Keep the events of a batch (sessions.session_events) whose day is kept at now, and delete the days before."""
    spark, since = events.sparkSession, first_day(now, tz)
    day = F.when(F.col("is_event"), F.to_date(F.from_utc_timestamp(F.to_utc_timestamp("ts", F.current_timezone()), "UTC"))).otherwise(F.lit(VOIDS))
    rows = events.withColumns({"day": day, "batch": F.lit(number).cast("bigint")}).where(F.col("day") >= F.lit(since))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{store}/events")
    fs, path = _path(spark, f"{store}/events")
    for status in fs.listStatus(path) if fs.exists(path) else []:
        found = re.fullmatch(r"day=(\d{4}-\d{2}-\d{2})", status.getPath().getName())
        if found and date.fromisoformat(found[1]) < since:
            fs.delete(status.getPath(), True)


def snapshot(spark: SparkSession, store: str, pricing: DataFrame, now: datetime, options: ReportOptions) -> dict[str, DataFrame]:
    """Totals of the current day, hourly rates, rates by model and the history, all at now."""
    events = stored_events(spark, store, first_day(now, options.timezone))
    return {
        "totals": live.current_day_totals(events, pricing, now, options),
        "rates": live.burn_rate(events, pricing, now, options),
        "models": live.burn_by_model(events, pricing, now, options),
        "history": live.burn_history(events, pricing, now, options),
    }


def start(
    spark: SparkSession, root: str, store: str, pricing: DataFrame, options: ReportOptions = ReportOptions(), every: str = "5 seconds",
    clock: Callable[[], datetime] = lambda: datetime.now(UTC), once: bool = False,
) -> StreamingQuery:
    """Follow the log files below root. Every tick, also one without new lines, updates the store and writes the snapshot
    at clock() beside it; in between snapshot() may be called with a later time. Date bounds make no sense here and are
    refused. The state store of the session is set to RocksDB, which the stateful operator needs."""
    if options.since or options.until or options.last_days:
        raise ValueError("the monitor takes no date bounds")
    spark.dataSource.register(TailSource)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)

    def tick(events: DataFrame, number: int) -> None:
        now = clock()
        apply_batch(events, number, store, now, options.timezone)
        for name, part in snapshot(spark, store, pricing, now, options).items():
            part.coalesce(1).write.mode("overwrite").parquet(f"{store}/snapshot/{name}/batch={number}")

    lines = spark.readStream.format("log_tail").option("path", root).load()
    records = parse.line_records(lines, keep=("reset",), always=F.col("reset") & (F.col("value") == ""))
    writer = sessions.session_events(records).writeStream.foreachBatch(tick).option("checkpointLocation", f"{store}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
