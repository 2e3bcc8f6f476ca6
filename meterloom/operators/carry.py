"""What a session carries from its earlier records to later ones, as summaries of ranges that compose.

A range of a session's records acts on what came before it in a way that needs few figures: the counts it adds, or those
it sets if it has a cumulative count, the last model it names, its boundary and its fork. So a session can be cut into
segments that are summed up apart, the summaries combined in order, and each segment finished by what it is handed. A
stored state is the summary of all records before, which is how a store parses only what a file gained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.functions.formats import minus
from meterloom.schemas import COUNTERS, USAGE

#: What is carried after a session's records so far.
STATE = f"session_id string, carried {USAGE}, model string, spawned boolean, past_boundary boolean, fork_ts timestamp"


def _zero(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def summaries(rows: DataFrame, certain: Column, uncertain: Column) -> DataFrame:
    """One row for each segment of rows that have _sum_ and _base_ (see events); certain: the model that a row is sure
    to name; uncertain: whether it names its model only if counts grew since what is carried into the segment."""
    counts = lambda prefix: F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in COUNTERS])
    after = F.struct(*[(_zero(F.col(f"_base_{c}")) + F.col(f"_sum_{c}")).alias(c) for c in COUNTERS])
    doubtful = F.struct("seq", "model", counts("_total.").alias("total"), counts("_sum_").alias("sum"))
    rows = rows.withColumns({"_certain": certain, "_doubt": uncertain & F.col("model").isNotNull(), "_after": after})
    return rows.groupBy("session_id", "segment").agg(
        F.bool_or(F.col("_total").isNotNull()).alias("sets"), F.max_by("_after", "seq").alias("amount"),
        F.max(F.when(F.col("_certain").isNotNull(), F.struct("seq", F.col("_certain").alias("model")))).alias("certain"),
        F.max(F.when(F.col("_doubt"), doubtful)).alias("doubtful"),
        F.min_by("is_spawned", "seq").alias("spawned"), F.bool_or("is_boundary").alias("boundary"),
        F.min_by("fork_ts", F.when(F.col("fork_ts").isNotNull(), F.col("seq"))).alias("fork_ts"),
    )


def with_state(parts: DataFrame, state: DataFrame | None) -> DataFrame:
    """Summaries with stored states as the first of their sessions."""
    parts = parts.withColumn("stage", F.lit(1))
    if state is None:
        return parts
    kinds = {f.name: f.dataType for f in parts.schema}
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    named = F.when(F.col("s.model").isNotNull(), F.struct(F.lit(None).cast(kinds["certain"]["seq"].dataType).alias("seq"), F.col("s.model").alias("model")))
    first = state.alias("s").select(
        "s.session_id", none("segment"), F.lit(True).alias("sets"), F.col("s.carried").alias("amount"), named.alias("certain"), none("doubtful"),
        "s.spawned", F.col("s.past_boundary").alias("boundary"), "s.fork_ts", F.lit(0).alias("stage"),
    )
    return parts.unionByName(first.select(*parts.columns))


def combined(parts: DataFrame) -> DataFrame:
    """Summaries with what each is handed (_carry_, _carry_model, _spawned, _past, _fork) and what is carried after it
    (out, a struct)."""
    order = Window.partitionBy("session_id").orderBy("stage", "segment")
    so_far, before = (order.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    added = {c: F.when(~F.col("sets"), F.col(f"amount.{c}")) for c in COUNTERS}
    rows = parts.withColumns({f"_added_{c}": _zero(F.sum(added[c]).over(so_far)) for c in COUNTERS})
    set_to = {c: F.last(F.when(F.col("sets"), F.col(f"amount.{c}") - F.col(f"_added_{c}")), ignorenulls=True).over(before) for c in COUNTERS}
    rows = rows.withColumns({f"_carry_{c}": _zero(set_to[c]) + F.col(f"_added_{c}") - _zero(added[c]) for c in COUNTERS})
    grew = lambda c: minus(F.col(f"doubtful.total.{c}"), F.col(f"_carry_{c}") + F.col(f"doubtful.sum.{c}")) > 0
    counts = F.coalesce(grew("input") | grew("output") | grew("reasoning_output"), F.lit(False))
    later = counts & (F.col("certain").isNull() | F.col("certain.seq").isNull() | (F.col("doubtful.seq") > F.col("certain.seq")))
    rows = rows.withColumn("_named", F.when(later, F.col("doubtful.model")).otherwise(F.col("certain.model")))
    rows = rows.withColumns({
        "_carry_model": F.last("_named", ignorenulls=True).over(before), "_spawned": F.coalesce(F.first("spawned").over(so_far), F.lit(False)),
        "_past": F.coalesce(F.max("boundary").over(before), F.lit(False)), "_fork": F.first("fork_ts", ignorenulls=True).over(before),
    })
    carried = F.struct(*[F.when(F.col("sets"), F.col(f"amount.{c}")).otherwise(F.col(f"_carry_{c}") + F.col(f"amount.{c}")).alias(c) for c in COUNTERS])
    out = F.struct(
        carried.alias("carried"), F.coalesce("_named", "_carry_model").alias("model"), F.col("_spawned").alias("spawned"),
        (F.col("_past") | F.coalesce("boundary", F.lit(False))).alias("past_boundary"), F.coalesce("_fork", "fork_ts").alias("fork_ts"),
    )
    return rows.withColumn("out", out)


def last_states(parts: DataFrame) -> DataFrame:
    """STATE of each session after the last of its combined summaries."""
    return parts.groupBy("session_id").agg(F.max_by("out", F.struct("stage", "segment")).alias("out")).select("session_id", "out.*")
