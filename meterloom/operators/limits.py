"""Rate-limit windows from a table of payload texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limit that is looked for, and the widths of its two windows in minutes.
LIMIT_ID, FIVE_HOURS, WEEK = "codex", 300, 10_080

_P_WINDOW = "struct<used_percent:double,usedPercent:double,window_duration_mins:bigint,windowDurationMins:bigint,resets_at:bigint,resetsAt:bigint>"
_SNAPSHOT = f"struct<limit_id:string,limitId:string,primary:{_P_WINDOW},secondary:{_P_WINDOW}>"
_B_WINDOW = "struct<used_percent:double,usedPercent:double,limit_window_seconds:bigint,limitWindowSeconds:bigint,reset_at:bigint,resetAt:bigint,resetsAt:bigint>"
_DETAILS = f"struct<primary_window:{_B_WINDOW},primaryWindow:{_B_WINDOW},primary:{_B_WINDOW},secondary_window:{_B_WINDOW},secondaryWindow:{_B_WINDOW},secondary:{_B_WINDOW}>"
_EXTRA = f"array<struct<metered_feature:string,meteredFeature:string,limit_name:string,limitName:string,rate_limit:{_DETAILS},rateLimit:{_DETAILS}>>"
PAYLOAD = (
    f"struct<rate_limits:{_SNAPSHOT},rateLimits:{_SNAPSHOT},rate_limits_by_limit_id:map<string,{_SNAPSHOT}>,rateLimitsByLimitId:map<string,{_SNAPSHOT}>,"
    f"rate_limit:{_DETAILS},rateLimit:{_DETAILS},additional_rate_limits:{_EXTRA},additionalRateLimits:{_EXTRA}>"
)


def _window(used: Column, minutes: Column, resets: Column) -> Column:
    """A window struct, null without a finite percentage."""
    sound = used.isNotNull() & ~F.isnan(used) & (F.abs(used) < float("inf"))
    fields = F.struct(F.greatest(F.lit(0.0), F.least(F.lit(100.0), used)).alias("used_percent"), F.when(minutes > 0, minutes).cast("bigint").alias("window_minutes"), resets.alias("resets_at"))
    return F.when(sound, fields)


def _protocol(w: Column) -> Column:
    return _window(F.coalesce(w["used_percent"], w["usedPercent"]), F.coalesce(w["window_duration_mins"], w["windowDurationMins"]), F.coalesce(w["resets_at"], w["resetsAt"]))


def _backend(w: Column) -> Column:
    seconds = F.coalesce(w["limit_window_seconds"], w["limitWindowSeconds"])
    minutes = F.when(seconds > 0, F.floor((seconds + 59) / 60))
    return _window(F.coalesce(w["used_percent"], w["usedPercent"]), minutes, F.coalesce(w["reset_at"], w["resetAt"], w["resetsAt"]))


def _details(d: Column) -> Column:
    return F.array(_backend(F.coalesce(d["primary_window"], d["primaryWindow"], d["primary"])), _backend(F.coalesce(d["secondary_window"], d["secondaryWindow"], d["secondary"])))


def _first_wide(windows: Column, minutes: int) -> Column:
    return F.get(F.filter(windows, lambda w: w["window_minutes"] == minutes), F.lit(0))


def _chosen(rows: DataFrame, name: str, windows: Column) -> DataFrame:
    """Adds column name: the first window of each width; windows without a width fill what is missing, in order.

    Each step is a column of its own, so that nothing is evaluated again for every use.
    """
    rows = rows.withColumn("_w", F.filter(windows, lambda w: w.isNotNull()))
    rows = rows.withColumn("_u", F.filter("_w", lambda w: w["window_minutes"].isNull()))
    rows = rows.withColumn("_five", _first_wide(F.col("_w"), FIVE_HOURS)).withColumn("_week", _first_wide(F.col("_w"), WEEK))
    rest = F.when(F.col("_five").isNull(), F.get("_u", F.lit(1))).otherwise(F.get("_u", F.lit(0)))
    both = F.struct(F.coalesce("_five", F.get("_u", F.lit(0))).alias("five_hour"), F.coalesce("_week", rest).alias("weekly"))
    return rows.withColumn(name, both).drop("_w", "_u", "_five", "_week")


def limit_windows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Adds five_hour, weekly (window structs) and status: available, malformed or no_limit_data.

    The protocol form wins where it has a window; else the plain limit and the additional ones of the same name.
    """
    p = F.from_json(column, PAYLOAD)
    rows = payloads.withColumn("_p", p)
    by_id = F.coalesce("_p.rate_limits_by_limit_id", "_p.rateLimitsByLimitId")
    name = lambda s: F.coalesce(s["limit_id"], s["limitId"])
    single = F.coalesce("_p.rate_limits", "_p.rateLimits")
    single = F.when(F.coalesce(name(single) == LIMIT_ID, F.lit(True)), single)
    values = F.transform(F.array_sort(F.map_entries(by_id), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: e["value"])
    named = F.get(F.filter(values, lambda s: name(s) == LIMIT_ID), F.lit(0))
    snapshot = F.coalesce(F.try_element_at(by_id, F.lit(LIMIT_ID)), named, single)
    rows = rows.withColumn("_s", snapshot)
    protocol = F.array(_protocol(F.col("_s.primary")), _protocol(F.col("_s.secondary")))
    extra = F.filter(
        F.coalesce("_p.additional_rate_limits", "_p.additionalRateLimits"),
        lambda x: (F.coalesce(x["metered_feature"], x["meteredFeature"]) == LIMIT_ID) | F.coalesce(F.coalesce(x["limit_name"], x["limitName"]) == LIMIT_ID, F.lit(False)),
    )
    more = F.flatten(F.transform(extra, lambda x: _details(F.coalesce(x["rate_limit"], x["rateLimit"]))))
    plain = _details(F.coalesce("_p.rate_limit", "_p.rateLimit"))
    backend = F.concat(plain, F.coalesce(more, F.slice(plain, 1, 0)))
    rows = _chosen(_chosen(rows, "_a", protocol), "_b", backend)
    has = lambda s: s["five_hour"].isNotNull() | s["weekly"].isNotNull()
    rows = rows.withColumn("_c", F.when(has(F.col("_a")), F.col("_a")).otherwise(F.col("_b")))
    status = F.when(F.expr(f"try_parse_json({column})").isNull(), "malformed").when(has(F.col("_c")), "available").otherwise("no_limit_data")
    return rows.withColumn("status", status).select("*", "_c.five_hour", "_c.weekly").drop("_p", "_c", "_s", "_a", "_b")
