"""Log lines to records: a text prefilter, one lossy JSON projection, and the rules of both dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.schemas import COUNTERS

# Record types, markers and the provider of the second dialect.
CONTEXT, EVENT, TOKENS, BOUNDARY = "turn_context", "event_msg", "token_count", "inter_agent_communication_metadata"
META, SESSION, MESSAGE, PROVIDER = "session_meta", "session", "message", "openai-codex"

_COUNTS = "struct<input_tokens:bigint,cached_input_tokens:bigint,cache_read_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint,total_tokens:bigint>"
_MODEL = "model:variant,model_name:variant,metadata:struct<model:variant>"
_BOTH = f"last_token_usage:{_COUNTS},total_token_usage:{_COUNTS}"
#: String leaves are variants, so that numbers in their place can be told from text; counters are longs, so that text,
#: fractions and containers in their place become null.
LINE = (
    f"type variant, timestamp variant, cwd variant, parentSession variant, payload struct<type:variant,id:variant,cwd:variant,source:variant,{_MODEL},"
    f"info:struct<{_MODEL},{_BOTH}>,{_BOTH}>, message struct<role:variant,provider:variant,model:variant,"
    "usage:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,reasoning:bigint,totalTokens:bigint>>"
)
BLANK = " \t\r\n\f"


def trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(BLANK))


def marker(kind: str) -> str:
    return f'"type":"{kind}"'


def escaped_pattern(word: str) -> str:
    """A pattern for word in JSON where each letter may stand as a \\u escape."""
    return "".join(f"(?:{c}|\\\\u{ord(c):04x})" if f"{ord(c):04x}".isdigit() else f"(?:{c}|\\\\u(?i:{ord(c):04x}))" for c in word)


def might_matter(value: Column, strict_markers: bool = True) -> Column:
    """Whether a line can give or shape usage, by its text alone: compact type markers, or escaped forms of them."""
    def has(kind: str) -> Column:
        exact = value.contains(marker(kind))
        return exact if strict_markers else exact | value.rlike(rf'"type"\s*:\s*"{kind}"')

    escaped = lambda word: value.rlike(escaped_pattern(word)) & ~value.contains(word)
    plain = has(CONTEXT) | (has(TOKENS) & has(EVENT)) | (has(MESSAGE) & value.contains(f'"provider":"{PROVIDER}"' if strict_markers else PROVIDER))
    hidden = value.contains("\\u") & (escaped(CONTEXT) | ((has(TOKENS) | escaped(TOKENS)) & (has(EVENT) | escaped(EVENT))))
    return plain | hidden


def marks_history(value: Column) -> Column:
    """Whether a line can be a session header, a fork header or a boundary of inherited history."""
    return value.contains(META) | value.contains(SESSION) | value.contains(BOUNDARY)


def text(leaf: Column) -> Column:
    """A variant leaf as text, null unless it is a JSON string."""
    return F.when(F.schema_of_variant(leaf) == "STRING", F.try_variant_get(leaf, "$", "string"))


def count(leaf: Column) -> Column:
    return F.coalesce(F.greatest(leaf, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def _usage(u: Column) -> Column:
    present = lambda x: F.when(x >= 0, x)
    cached = F.coalesce(present(u["cached_input_tokens"]), present(u["cache_read_input_tokens"]), F.lit(0).cast("bigint"))
    values = (count(u["input_tokens"]), cached, count(u["output_tokens"]), count(u["reasoning_output_tokens"]), count(u["total_tokens"]))
    return F.when(u.isNotNull(), F.struct(*[v.alias(c) for v, c in zip(values, COUNTERS, strict=True)]))


def _model(p: Column) -> Column:
    """The first text that isn't blank: of info, of the payload, of the metadata of both."""
    info = p["info"]
    places = [info["model"], info["model_name"], p["model"], p["model_name"], info["metadata"]["model"], p["metadata"]["model"]]
    return F.coalesce(*[F.nullif(F.trim(text(x)), F.lit("")) for x in places])


RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def instant(value: Column) -> Column:
    """A timestamp with offset, null if malformed."""
    return F.when(value.rlike(RFC3339), F.try_to_timestamp(F.upper(F.regexp_replace(value, r"^(.{10}) ", "$1T"))))


def _message(u: Column) -> Column:
    input_ = count(u["input"]) + count(u["cacheRead"]) + count(u["cacheWrite"])
    output, total = count(u["output"]), count(u["totalTokens"])
    values = (input_, F.least(count(u["cacheRead"]), input_), output, F.least(count(u["reasoning"]), output), F.when(total > 0, total).otherwise(input_ + output))
    return F.when(u.isNotNull(), F.struct(*[v.alias(c) for v, c in zip(values, COUNTERS, strict=True)]))


def _kept(lines: DataFrame, strict: bool, strict_markers: bool, *more: str, always: Column | None = None) -> DataFrame:
    """The trimmed lines that can matter by their text, with useful (all but headers and boundaries) and parsed JSON."""
    line = F.col("value")
    matters = might_matter(line, strict_markers) | marks_history(line)
    kept = lines.where(matters if always is None else matters | always).withColumn("useful", might_matter(line, strict_markers))
    if strict:
        broken = F.col("useful") & ~F.is_valid_utf8("value")
        kept = kept.withColumn("value", F.when(broken, F.raise_error(F.lit("session log line is not valid UTF-8"))).otherwise(F.col("value")))
    return kept.select("session_id", "seq", "useful", F.from_json("value", LINE).alias("j"), *more)


def records(lines: DataFrame, strict: bool = False, strict_markers: bool = True, headers: bool = False) -> DataFrame:
    """Records (schemas.RECORDS) of lines (session_id, seq, value); seq may be of any type that orders a session's lines.

    Lines that cannot matter are dropped by their text before anything is parsed, and only narrow columns go on. A usage
    record without a text timestamp is no record; one with a malformed timestamp raises an error if strict, and else
    stays to carry counts on but gives no event. If strict, a line that could matter and isn't UTF-8 is an error too.
    headers adds thread_id and parent_thread_id, which the first line of a session may have.
    """
    lines = lines.select("session_id", "seq", trimmed(F.col("value")).alias("value")).where("value <> ''")
    # only a header is asked whether it is first, so other lines don't move; an escape can hide the type of one
    maybe_header = F.col("value").contains(META) | F.col("value").contains("\\")
    heads = lines.groupBy("session_id").agg(F.min("seq").alias("first"))
    asked = _kept(lines.where(maybe_header), strict, strict_markers).join(heads, "session_id").withColumn("head", F.col("seq") == F.col("first")).drop("first")
    others = _kept(lines.where(~maybe_header), strict, strict_markers).withColumn("head", F.lit(False))
    return _records(others.unionByName(asked), strict, headers)


def line_records(lines: DataFrame, strict: bool = False, strict_markers: bool = True, keep: tuple[str, ...] = (), always: Column | None = None, headers: bool = False) -> DataFrame:
    """The same, and the columns to keep, of lines that say themselves whether they are the first of their session that
    isn't blank (head): line by line, so that streams and parts of files can be parsed. Lines for which always holds give
    a record whatever their text."""
    lines = lines.withColumn("value", trimmed(F.col("value")))
    return _records(_kept(lines, strict, strict_markers, "head", *keep, always=always), strict, headers, *keep)


def _records(rows: DataFrame, strict: bool, headers: bool, *keep: str) -> DataFrame:
    kind, payload, message = text(F.col("j.type")), F.col("j.payload"), F.col("j.message")
    rows = rows.select("session_id", "seq", "head", "useful", *keep, kind.alias("type"), text(F.col("j.timestamp")).alias("at"), payload.alias("p"), message.alias("m"), text(F.col("j.parentSession")).alias("fork"))
    token = F.col("useful") & (F.col("type") == EVENT) & (text(F.col("p.type")) == TOKENS) & F.col("at").isNotNull()
    said = F.col("useful") & (F.col("type") == MESSAGE) & (text(F.col("m.role")) == "assistant") & (text(F.col("m.provider")) == PROVIDER) & F.col("at").isNotNull()
    named = F.nullif(F.trim(text(F.col("m.model"))), F.lit(""))
    said = said & named.isNotNull() & F.col("m.usage").isNotNull()
    inner = F.col("p.info").isNotNull()
    pick = lambda name: F.when(inner, F.col(f"p.info.{name}")).otherwise(F.col(f"p.{name}"))
    kind = F.when(token, "usage").when(F.col("useful") & (F.col("type") == CONTEXT), "context").when(said, "message").otherwise("other")
    parent = F.try_variant_get("p.source", "$.subagent.thread_spawn.parent_thread_id", "variant")
    rows = rows.withColumn("kind", F.coalesce(kind, F.lit("other")))
    timed = F.col("kind").isin("usage", "message")
    ts = instant(F.col("at"))
    if strict:
        ts = F.when(timed & ts.isNull(), F.raise_error(F.concat(F.lit("invalid timestamp "), F.col("at")))).otherwise(ts)
    return rows.select(
        "session_id", "seq", F.when(timed, ts).alias("ts"), "kind",
        F.when(F.col("kind") == "message", named).when(F.col("kind").isin("usage", "context"), _model(F.col("p"))).alias("model"),
        F.when(F.col("kind") == "usage", _usage(pick("last_token_usage"))).alias("last"),
        F.when(F.col("kind") == "usage", _usage(pick("total_token_usage"))).alias("cumulative"),
        F.when(F.col("kind") == "message", _message(F.col("m.usage"))).alias("message"),
        (F.col("head") & (F.col("type") == META) & text(parent).isNotNull()).alias("is_spawned"),
        F.coalesce(F.col("type") == BOUNDARY, F.lit(False)).alias("is_boundary"),
        F.when((F.col("type") == SESSION) & F.col("fork").isNotNull(), instant(F.col("at"))).alias("fork_ts"), *keep,
        *([F.when(F.col("head") & (F.col("type") == META), x).alias(c) for c, x in (("thread_id", text(F.col("p.id"))), ("parent_thread_id", text(parent)))] if headers else []),
    )


def descriptors(lines: DataFrame) -> DataFrame:
    """(session_id, thread_id, parent_thread_id, cwd) from the first line of each session that isn't blank; sessions whose
    first line is no header have nulls."""
    lines = lines.select("session_id", "seq", trimmed(F.col("value")).alias("value")).where("value <> ''")
    first = lines.groupBy("session_id").agg(F.min_by("value", "seq").alias("value"))
    rows = first.select("session_id", F.from_json("value", LINE).alias("j"))
    kind, parent = text(F.col("j.type")), F.try_variant_get("j.payload.source", "$.subagent.thread_spawn.parent_thread_id", "variant")
    meta = kind == META
    return rows.select(
        "session_id", F.when(meta, text(F.col("j.payload.id"))).alias("thread_id"), F.when(meta, text(parent)).alias("parent_thread_id"),
        F.when(meta, text(F.col("j.payload.cwd"))).when(kind == SESSION, text(F.col("j.cwd"))).alias("cwd"),
    )
