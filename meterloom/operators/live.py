"""The current-day monitor at a logical time: totals, trailing-hour rates and an eight-hour cost history.

Every part reads only events from the retention start on, so partitions and row groups before it are skipped.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions.formats import cost_per_hour, local_day, per_hour, window_minutes
from meterloom.operators.reports import model_sums, priced
from meterloom.schemas import COUNTERS, ReportOptions

POINTS, STEP, SPAN = 33, timedelta(minutes=15), timedelta(minutes=30)


def micros(x: timedelta) -> int:
    return x // timedelta(microseconds=1)


def day_start(now: datetime, tz: str) -> datetime:
    """The instant (UTC) at which now's local day starts: the first valid minute, the earlier of two."""
    zone, local = ZoneInfo(tz), now.astimezone(ZoneInfo(tz))
    at = datetime(local.year, local.month, local.day)
    for _ in range(24 * 60):
        instant = at.replace(tzinfo=zone).astimezone(UTC)
        if instant.astimezone(zone).replace(tzinfo=None) == at:
            return instant
        at += timedelta(minutes=1)
    raise ValueError(f"no start of day in {tz}")


def window_start(now: datetime, tz: str) -> datetime:
    return max(now - timedelta(hours=1), day_start(now, tz))


def retention_start(now: datetime, tz: str) -> datetime:
    """The earliest instant that any part of the monitor looks at."""
    return min(now - timedelta(hours=8, minutes=30), day_start(now, tz))


def retained(events: DataFrame, now: datetime, tz: str) -> DataFrame:
    """Events that can matter at now; later ones stay hidden until now reaches them."""
    return events.where((F.col("ts") >= F.lit(retention_start(now, tz))) & (F.col("ts") <= F.lit(now)))


def current_day(events: DataFrame, now: datetime, tz: str) -> DataFrame:
    today = now.astimezone(ZoneInfo(tz)).date()
    return retained(events, now, tz).where(local_day(F.col("ts"), tz) == F.lit(today))


def current_day_totals(events: DataFrame, pricing: DataFrame, now: datetime, options: ReportOptions = ReportOptions()) -> DataFrame:
    rows = priced(model_sums(current_day(events, now, options.timezone)), pricing, options)
    return _added(rows).withColumn("date", F.lit(now.astimezone(ZoneInfo(options.timezone)).date()))


def _added(rows: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return rows.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in COUNTERS], F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def burn_window(events: DataFrame, now: datetime, tz: str) -> DataFrame:
    """Events of the trailing hour, cut off at local midnight; both ends belong to it."""
    return current_day(events, now, tz).where(F.col("ts") >= F.lit(window_start(now, tz)))


def burn_rate(events: DataFrame, pricing: DataFrame, now: datetime, options: ReportOptions = ReportOptions()) -> DataFrame:
    width = F.lit(micros(now - window_start(now, options.timezone)))
    sums = _added(priced(model_sums(burn_window(events, now, options.timezone)), pricing, options))
    rates = [per_hour(F.col(c), width).alias(f"{c}_per_hour") for c in COUNTERS]
    return sums.select(window_minutes(width).alias("window_minutes"), *rates, cost_per_hour(F.col("cost_usd"), width).alias("cost_usd_per_hour"))


def burn_by_model(events: DataFrame, pricing: DataFrame, now: datetime, options: ReportOptions = ReportOptions()) -> DataFrame:
    """(label, metric, value): hourly rates of every model with usage or cost, explicit and fallback apart."""
    width = F.lit(micros(now - window_start(now, options.timezone)))
    rows = priced(model_sums(burn_window(events, now, options.timezone)), pricing, options)
    own = [F.greatest(F.col(c) - F.col(f"fallback_{c}"), F.lit(0)).alias(c) for c in COUNTERS]
    parts = F.array(
        F.struct(F.col("model").alias("label"), *own, F.col("explicit_cost_usd").alias("cost_usd")),
        F.struct(F.concat("model", F.lit(" (fallback)")).alias("label"), *[F.col(f"fallback_{c}").alias(c) for c in COUNTERS], F.col("fallback_cost_usd").alias("cost_usd")),
    )
    rows = rows.select(F.inline(parts)).where(" OR ".join(f"{c} > 0" for c in (*COUNTERS, "cost_usd")))
    values = [F.struct(F.lit(c).alias("metric"), per_hour(F.col(c), width).cast("double").alias("value")) for c in COUNTERS]
    values.append(F.struct(F.lit("cost_usd").alias("metric"), cost_per_hour(F.col("cost_usd"), width).alias("value")))
    return rows.select("label", F.inline(F.array(*values)))


def burn_history(events: DataFrame, pricing: DataFrame, now: datetime, options: ReportOptions = ReportOptions(), points: int = POINTS) -> DataFrame:
    """(sample, end_ts, cost_usd_per_hour): cost of the 30 minutes before each quarter hour back from now, both ends
    included, events before midnight too. Each event meets the two or three samples that hold it by arithmetic."""
    first = now - STEP * (POINTS - 1)
    ends = events.sparkSession.range(POINTS).select(F.col("id").cast("int").alias("sample"), F.timestamp_micros(F.lit(micros(first - datetime(1970, 1, 1, tzinfo=UTC))) + F.col("id") * micros(STEP)).alias("end_ts"))
    after = F.unix_micros("ts") - micros(first - datetime(1970, 1, 1, tzinfo=UTC))
    low = F.greatest(F.ceil(after / micros(STEP)), F.lit(0))
    high = F.least(F.floor((after + micros(SPAN)) / micros(STEP)), F.lit(POINTS - 1))
    rows = retained(events, now, options.timezone).withColumns({"low": low.cast("int"), "high": high.cast("int")}).where("low <= high")
    rows = rows.withColumn("sample", F.explode(F.sequence("low", "high")))
    costs = priced(model_sums(rows, "sample"), pricing, options).groupBy("sample").agg(F.sum("cost_usd").alias("cost_usd"))
    out = ends.join(costs, "sample", "left").select("sample", "end_ts", cost_per_hour(F.coalesce("cost_usd", F.lit(0.0)), F.lit(micros(SPAN))).alias("cost_usd_per_hour"))
    return out.where(F.col("sample") >= POINTS - points)
