"""Usage events from log records: carried totals, model, replay and fork rules as windows over each session or segment of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.functions.formats import minus
from meterloom.operators import carry
from meterloom.schemas import COUNTERS, DEFAULT_MODEL


def billable(usage: Column) -> Column:
    """The total of a usage struct, input and output where it has none."""
    return F.when(usage["total"] > 0, usage["total"]).otherwise(usage["input"] + usage["output"])


def normal(raw: dict[str, Column]) -> dict[str, Column]:
    """Counters with cached input within input and a total."""
    total = F.when(raw["total"] > 0, raw["total"]).otherwise(raw["input"] + raw["output"])
    return raw | {"cached_input": F.least(raw["cached_input"], raw["input"]), "total": total}


def _local(records: DataFrame, *keys: str) -> DataFrame:
    """Records with running sums of their deltas (_sum_) and, once there was a cumulative count, what it adds to those
    sums (_base_), both within the keys."""
    so_far = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    token = F.col("kind") == "usage"
    rows = records.withColumns({"_last": F.when(token, F.col("last")), "_total": F.when(token, F.col("cumulative"))})
    step = {c: F.when(F.col("_total").isNull(), billable(F.col("_last")) if c == "total" else F.col(f"_last.{c}")) for c in COUNTERS}
    rows = rows.withColumns({f"_sum_{c}": F.coalesce(F.sum(step[c]).over(so_far), F.lit(0).cast("bigint")) for c in COUNTERS})
    # what is carried is the last cumulative count and the deltas since: their sum so far less the sum up to that count
    return rows.withColumns({f"_base_{c}": F.last(F.when(F.col("_total").isNotNull(), F.col(f"_total.{c}") - F.col(f"_sum_{c}")), ignorenulls=True).over(so_far) for c in COUNTERS})


def _judged(rows: DataFrame, before: dict[str, Column]) -> DataFrame:
    """Rows with the counters of their event and whether they are one (_event), from what was carried before them."""
    raw = {c: F.coalesce(F.col(f"_last.{c}"), minus(F.col(f"_total.{c}"), before[c])) for c in COUNTERS}
    rows = rows.withColumns({c: F.when(F.col("kind") == "message", F.col(f"message.{c}")).otherwise(x) for c, x in normal(raw).items()})
    used = F.coalesce((F.col("input") > 0) | (F.col("cached_input") > 0) | (F.col("output") > 0) | (F.col("reasoning_output") > 0), F.lit(False))
    return rows.withColumn("_event", F.when(F.col("kind") == "message", (F.col("input") > 0) | (F.col("output") > 0)).otherwise((F.col("kind") == "usage") & used))


def _named() -> Column:
    return F.when((F.col("kind") == "context") | F.col("_event"), F.col("model"))


def _finished(rows: DataFrame, *keys: str) -> DataFrame:
    """The events of _local rows that have what is carried into their keys (_carry_, _carry_model, _spawned, _past, _fork)."""
    order = Window.partitionBy(*keys).orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_base_{c}": F.coalesce(F.col(f"_base_{c}"), F.col(f"_carry_{c}")) for c in COUNTERS})
    rows = rows.withColumns({f"_before_{c}": F.coalesce(F.lag(F.col(f"_base_{c}") + F.col(f"_sum_{c}")).over(order), F.col(f"_carry_{c}")) for c in COUNTERS})
    rows = _judged(rows, {c: F.col(f"_before_{c}") for c in COUNTERS})
    rows = rows.withColumns({
        "_model": F.coalesce(F.last(_named(), ignorenulls=True).over(so_far), F.col("_carry_model")),
        "_inherited": F.coalesce(F.col("_spawned"), F.first("is_spawned").over(so_far), F.lit(False)) & ~(F.col("_past") | F.coalesce(F.max("is_boundary").over(so_far), F.lit(False))),
        "_fork": F.coalesce(F.col("_fork"), F.first("fork_ts", ignorenulls=True).over(so_far)),
    })
    rows = rows.where(F.col("_event") & ~F.col("_inherited") & (F.col("_fork").isNull() | (F.col("ts") >= F.col("_fork"))))
    return rows.select(
        "session_id", "seq", "ts", F.coalesce("_model", F.lit(DEFAULT_MODEL)).alias("model"), F.col("_model").isNull().alias("is_fallback"), *COUNTERS
    )


def usage_events(records: DataFrame, segment: Column | None = None, state: DataFrame | None = None) -> DataFrame:
    """Events of records (schemas.RECORDS), with one sort of each session, or of each segment of it.

    A cumulative count resets what is carried and a delta advances it; a delta wins over a cumulative count of the same
    record. Before the first model an event has the default one and is marked. Records that a spawned agent inherits
    carry counts and models on but give no events until the boundary; events before the time of a fork are dropped.

    segment, which must not fall with seq in a session, spreads a long session over many tasks; state (carry.STATE) is
    what was carried by the sessions' records before these. The events are the same as in one piece.
    """
    if segment is None and state is None:
        start = {f"_carry_{c}": F.lit(0).cast("bigint") for c in COUNTERS} | {"_carry_model": F.lit(None).cast("string"), "_spawned": F.lit(None).cast("boolean"), "_past": F.lit(False), "_fork": F.lit(None).cast("timestamp")}
        return _finished(_local(records, "session_id").withColumns(start), "session_id")
    return _handed(*_segments(records, segment, state))


def _handed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    handed = parts.where("stage = 1").select("session_id", "segment", *[f"_carry_{c}" for c in COUNTERS], "_carry_model", "_spawned", "_past", "_fork")
    return _finished(rows.join(handed, ["session_id", "segment"]), "session_id", "segment")


def _segments(records: DataFrame, segment: Column | None, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows with local sums, combined summaries of their segments)."""
    rows = _local(records.withColumn("segment", F.lit(0) if segment is None else segment), "session_id", "segment")
    order = Window.partitionBy("session_id", "segment").orderBy("seq")
    # null where nothing in the segment says what was carried before the row
    before = {c: F.lag(F.col(f"_base_{c}") + F.col(f"_sum_{c}")).over(order) for c in COUNTERS}
    known = rows.withColumns({f"_before_{c}": x for c, x in before.items()})
    uncertain = F.col("_total").isNotNull() & F.col("_last").isNull() & F.col("_before_input").isNull()
    judged = _judged(known, {c: F.col(f"_before_{c}") for c in COUNTERS})
    certain = F.when(~uncertain, _named())
    return rows, carry.combined(carry.with_state(carry.summaries(judged, certain, uncertain), state))


def carried_states(records: DataFrame, segment: Column | None = None, state: DataFrame | None = None) -> DataFrame:
    """carry.STATE of each session of records or state, after these records."""
    return carry.last_states(_segments(records, segment, state)[1])


def events_and_states(records: DataFrame, kept: Callable[[DataFrame], DataFrame], segment: Column | None = None, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """usage_events and carried_states of the same records, by way of one table of summaries, which kept() may store."""
    rows, parts = _segments(records, segment, state)
    parts = kept(parts)
    return _handed(rows, parts), carry.last_states(parts)
