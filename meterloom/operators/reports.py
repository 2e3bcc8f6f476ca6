"""Daily, monthly and session reports over usage events.

Events are summed by group and model first; prices join the few sums. Every report is one shuffle of partial sums.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.formats import directory_of, leaf_of, local_day, minus, month_of, rfc3339
from meterloom.operators.pricing import cost, with_prices
from meterloom.schemas import COUNTERS, ReportOptions

FALLBACK = tuple(f"fallback_{c}" for c in COUNTERS)


def with_local_day(events: DataFrame, options: ReportOptions, today: date | None = None) -> DataFrame:
    """Events with local_day in the report's zone, within its bounds (both included)."""
    rows = events.withColumn("local_day", local_day(F.col("ts"), options.timezone))
    since, until = options.bounds(today)
    rows = rows.where(F.col("local_day") >= F.lit(since)) if since else rows
    return rows.where(F.col("local_day") <= F.lit(until)) if until else rows


def model_sums(events: DataFrame, *keys: Column | str) -> DataFrame:
    """Sums of all counters, and of those of fallback events, by keys and model."""
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    fallback = [F.coalesce(F.sum(F.when(F.col("is_fallback"), F.col(c))), F.lit(0)).cast("bigint").alias(f"fallback_{c}") for c in COUNTERS]
    return events.groupBy(*keys, "model").agg(*sums, *fallback, F.bool_or("is_fallback").alias("is_fallback"), F.max("ts").alias("last_activity"))


def shown(rows: DataFrame, options: ReportOptions, prefix: str = "") -> DataFrame:
    """Counters as presented: without cached input if the options exclude it."""
    if not options.exclude_cached:
        return rows
    cached = F.least(F.col(f"{prefix}cached_input"), F.col(f"{prefix}input"))
    return rows.withColumns({
        f"{prefix}input": minus(F.col(f"{prefix}input"), cached), f"{prefix}total": minus(F.col(f"{prefix}total"), cached), f"{prefix}cached_input": F.lit(0).cast("bigint"),
    })


def priced(sums: DataFrame, pricing: DataFrame, options: ReportOptions) -> DataFrame:
    """Adds cost_usd of all counters, and explicit_cost_usd and fallback_cost_usd of their parts, to rows of a model."""
    free = options.cached_is_free
    out = shown(with_prices(sums, pricing), options)
    out = shown(out, options, "fallback_")
    own = [minus(F.col(c), F.col(f"fallback_{c}")) for c in ("input", "cached_input", "output")]
    return out.withColumns({
        "cost_usd": cost(F.col("input"), F.col("cached_input"), F.col("output"), free),
        "explicit_cost_usd": cost(*own, free),
        "fallback_cost_usd": cost(F.col("fallback_input"), F.col("fallback_cached_input"), F.col("fallback_output"), free),
    })


def breakdown() -> Column:
    """Map of model to breakdown, by name, from the rows of a group."""
    entry = F.struct("model", F.struct(*COUNTERS, *FALLBACK, "is_fallback", "explicit_cost_usd", "fallback_cost_usd").alias("value"))
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key from priced rows of key and model."""
    sums = [F.sum(c).alias(c) for c in (*COUNTERS, "cost_usd")]
    return rows.groupBy(*keys).agg(*sums, F.max("last_activity").alias("last_activity"), breakdown().alias("models"))


def daily_report(events: DataFrame, pricing: DataFrame, options: ReportOptions = ReportOptions(), today: date | None = None) -> DataFrame:
    rows = priced(model_sums(with_local_day(events, options, today), "local_day"), pricing, options)
    return by_key(rows, "local_day").withColumnRenamed("local_day", "date").drop("last_activity").orderBy("date")


def monthly_report(events: DataFrame, pricing: DataFrame, options: ReportOptions = ReportOptions()) -> DataFrame:
    if options.last_days is not None:
        raise ValueError("last_days is for the daily report")
    rows = priced(model_sums(with_local_day(events, options), month_of(F.col("local_day")).alias("month")), pricing, options)
    return by_key(rows, "month").drop("last_activity").orderBy("month")


def session_report(events: DataFrame, pricing: DataFrame, options: ReportOptions = ReportOptions(), roots: DataFrame | None = None) -> DataFrame:
    """Sessions by last activity; roots (session_id, root_id) folds spawned sessions into their root ancestors."""
    if options.last_days is not None:
        raise ValueError("last_days is for the daily report")
    return session_rows(model_sums(with_local_day(events, options), "session_id"), pricing, options, roots)


def session_rows(sums: DataFrame, pricing: DataFrame, options: ReportOptions, roots: DataFrame | None = None) -> DataFrame:
    """The session report from sums by session and model. Folding regroups sums, not events."""
    if roots is not None:
        sums = regroup(sums.join(roots, "session_id", "left").withColumn("session_id", F.coalesce("root_id", "session_id")), "session_id")
    rows = by_key(priced(sums, pricing, options), "session_id")
    shape = rows.withColumns({"directory": directory_of(F.col("session_id")), "session_file": leaf_of(F.col("session_id"))})
    return shape.orderBy("last_activity", "session_id").withColumn("last_activity", rfc3339(F.col("last_activity"), options.timezone))


def regroup(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums of sums by keys and model."""
    added = [F.sum(c).alias(c) for c in (*COUNTERS, *FALLBACK)]
    return sums.groupBy(*keys, "model").agg(*added, F.bool_or("is_fallback").alias("is_fallback"), F.max("last_activity").alias("last_activity"))


def totals(report: DataFrame) -> DataFrame:
    """Grand totals over the rows of a report; zeros for an empty one."""
    return report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def display_rows(rows: DataFrame, key: str) -> DataFrame:
    """Subtotal, model and grand total rows from priced rows of key and model.

    A model gives a row of explicit usage and one marked (fallback), each where it has usage. level: 0 model, 1 key,
    3 all.
    """
    own = [minus(F.col(c), F.col(f"fallback_{c}")).alias(c) for c in COUNTERS]
    parts = F.array(
        F.struct(F.col("model").alias("label"), *own, F.col("explicit_cost_usd").alias("cost_usd")),
        F.struct(F.concat("model", F.lit(" (fallback)")).alias("label"), *[F.col(f"fallback_{c}").alias(c) for c in COUNTERS], F.col("fallback_cost_usd").alias("cost_usd")),
    )
    long = rows.select(key, F.inline(parts)).where(" OR ".join(f"{c} > 0" for c in COUNTERS))
    sums = [F.sum(c).alias(c) for c in (*COUNTERS, "cost_usd")]
    out = long.groupingSets([[F.col(key), F.col("label")], [F.col(key)], []], F.col(key), F.col("label")).agg(F.grouping_id().alias("level"), *sums)
    return out.withColumn("label", F.when(F.col("level") == 0, F.col("label")).otherwise("TOTAL"))


def json_report(report: DataFrame, kind: str, missing: list[str]) -> DataFrame:
    """One JSON text for each row of a report; is_fallback stands only where it is true, costs of models are left out."""
    models = F.transform_values("models", lambda _, v: F.struct(*[v[c].alias(c) for c in COUNTERS], F.when(v["is_fallback"], F.lit(True)).alias("is_fallback")))
    row = F.struct(*[F.col(c) for c in report.columns if c != "models"], models.alias("models"))
    missing_dirs = F.array(*[F.lit(m) for m in missing]).cast("array<string>")
    return report.select(F.to_json(F.struct(F.lit(kind).alias("kind"), row.alias("row"), missing_dirs.alias("missing_directories"))).alias("value"))
