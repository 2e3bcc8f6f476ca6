"""The driver's tables as usage-log tables: fixed projections, no invented rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.operators.events import usage_events
from meterloom.operators.pricing import BUILT_IN
from meterloom.schemas import COUNTERS, PRICING

#: A price of its own for a name with a provider prefix, so that exact names can be told from fallbacks.
PREFIXED = ("openai/gpt-5", 2.0, 0.2, 12.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*BUILT_IN, PREFIXED], PRICING)


def _usage(**counters: Column) -> Column:
    return F.struct(*[counters[c].cast("bigint").alias(c) for c in COUNTERS])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records from events: a session for each user, in order of time and id."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    k, kind = F.col("k"), F.col("event_type")
    zero = k % 17 == 0
    of = lambda c: F.when(zero, 0).otherwise(c).cast("bigint")
    i, o = of(F.floor(F.col("value") * 10)), of(F.floor("value"))
    usage = _usage(input=i, cached_input=of(k * 3), output=o, reasoning_output=of(k % 7), total=F.when(k % 5 == 0, 0).otherwise(i + o))
    name = F.element_at(F.array(*map(F.lit, ("gpt-5", "gpt-5.3-codex", "openai/gpt-5", "unpriced"))), (k % 4 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("team"), F.col("user_id") % 3, F.lit("/u"), F.col("user_id")).alias("session_id"),
        F.struct("ts", "event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "signup", "context").otherwise("usage").alias("kind"),
        F.when((kind == "signup") | ((kind == "error") & (k % 5 == 0)), name).alias("model"),
        F.when(kind.isin("click", "view", "error"), usage).alias("last"),
        F.when(kind.isin("purchase", "error"), usage).alias("cumulative"),
        F.lit(None).cast(usage_type()).alias("message"),
        (F.col("user_id") % 4 == 1).alias("is_spawned"),
        ((kind == "view") & (k % 6 == 0)).alias("is_boundary"),
        F.lit(None).cast("timestamp").alias("fork_ts"),
    )


def usage_type() -> str:
    return "struct<" + ",".join(f"{c}:bigint" for c in COUNTERS) + ">"


def events(spark: SparkSession, sf_dir: str, replay: bool = False) -> DataFrame:
    """Usage events of records; replay: with the suppression of inherited records."""
    r = records(spark, sf_dir)
    return usage_events(r if replay else r.withColumn("is_spawned", F.lit(False)))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session descriptors from customer: chains by halving, two-cycles, missing parents and roots."""
    c = F.col("c_custkey")
    parent = F.when(c % 10 == 3, c + 1).when(c % 10 == 4, c - 1).when(c % 7 == 0, None).when(c % 11 == 0, c + 100_000_000).otherwise(F.floor(c / 2))
    return table(spark, sf_dir, "customer").select(c.alias("session_id"), c.alias("thread_id"), parent.cast("bigint").alias("parent_thread_id"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session files from orders: a session for each customer, in two roots, some compressed."""
    root = F.col("o_orderkey") % 2
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("session_id"),
        root.cast("int").alias("root_ord"),
        F.concat(F.lit("root"), root, F.lit("/c"), F.col("o_custkey"), F.lit("-"), F.col("o_orderkey"), F.lit(".jsonl")).alias("path"),
        (F.col("o_orderstatus") == "F").alias("compressed"),
        F.floor("o_totalprice").cast("bigint").alias("bytes"),
        F.col("o_orderdate").cast("timestamp").alias("mtime"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the second dialect from conversations; every third conversation is a fork at its third turn."""
    n, turn, conv = F.length("text").cast("bigint"), F.col("turn"), F.col("conv_id")
    minutes = lambda t: F.timestamp_seconds(F.lit(1_704_067_200) + conv * 3600 + t * 60)
    cached, out = F.floor(n / 4), turn * 10 + 5
    shape = _usage(input=n + cached, cached_input=F.least(cached, n + cached), output=out, reasoning_output=F.lit(0), total=n + cached + out)
    used = (F.col("role") == "assistant") & (n > 0)
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv/"), conv).alias("session_id"), turn.alias("seq"), minutes(turn).alias("ts"),
        F.when(used, "message").otherwise("other").alias("kind"), F.when(used, "gpt-5").alias("model"),
        F.lit(None).cast(usage_type()).alias("last"), F.lit(None).cast(usage_type()).alias("cumulative"), F.when(used, shape).alias("message"),
        F.lit(False).alias("is_spawned"), F.lit(False).alias("is_boundary"), F.when((conv % 3 == 0) & (turn == 0), minutes(F.lit(2))).alias("fork_ts"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of events as lines of log files, one file for each session; ts is when a line was written."""
    r = records(spark, sf_dir)
    names = dict(zip(COUNTERS, ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"), strict=True))
    usage = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{k}").alias(v) for k, v in names.items()]))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    context = F.struct(at, F.lit("turn_context").alias("type"), F.struct("model").alias("payload"))
    info = F.struct("model", usage("last").alias("last_token_usage"), usage("cumulative").alias("total_token_usage"))
    event = F.struct(at, F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload"))
    value = F.when(F.col("kind") == "context", F.to_json(context)).otherwise(F.to_json(event))
    return r.select("session_id", F.lit(0).alias("root_ord"), F.concat("session_id", F.lit(".jsonl")).alias("path"), "seq", value.alias("value"), "ts")


def files_of(lines: DataFrame) -> DataFrame:
    """The files that lines come from, as large and as old as those lines make them."""
    sizes = lines.groupBy("session_id", "root_ord", "path").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("ts").alias("mtime"))
    return sizes.select("session_id", "root_ord", "path", F.lit(False).alias("compressed"), "bytes", "mtime")


class LineParts:
    """Parts of the files that lines stand for (operators.incremental.Parts): a line is as long as its text and a break."""

    def __init__(self, lines: DataFrame):
        self.lines = lines

    def examined(self, files: DataFrame) -> DataFrame:
        whole = F.lit("whole")
        return files.select("path", F.col("bytes").alias("end"), whole.alias("digest"), F.when(F.col("parsed_bytes").isNotNull(), whole).alias("known"))

    def range_lines(self, ranges: DataFrame) -> DataFrame:
        so_far = F.sum(F.octet_length("value") + 1).over(Window.partitionBy("path").orderBy("seq"))
        rows = self.lines.withColumn("at", so_far).join(ranges.select("path", "start", F.col("end").alias("stop")), "path")
        return rows.where("at > start AND at <= stop").withColumn("head", F.col("at") == F.octet_length("value") + 1).drop("at", "start", "stop", "root_ord", "ts")
