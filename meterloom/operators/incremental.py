"""A store of sums by session, local day and model, refreshed for changed files only, for each time zone by itself.

Every refresh adds sums and parser states of the sessions that it parsed, in folders named by a run of its own, then
manifest rows for them and for removed sessions, and at last the marker of the next generation. The marker is created
exclusively, so of two refreshes that read the same generation one fails, and an unfinished one is never seen. A reader
takes each session's latest row and looks only into the folders of runs that are named there. A file that grew is read
from the byte where its last parse ended, with the stored state; its sums are added to the stored ones. Nothing is
rewritten in place: vacuum() deletes runs that nobody can still read, compact() merges a store into a new one.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions import parse
from meterloom.functions.formats import month_of
from meterloom.operators import carry, inventory, lineage, reports
from meterloom.operators.events import events_and_states
from meterloom.schemas import COUNTERS, ReportOptions
from meterloom.session import checkpointed, kept_table

PARSER_VERSION = 2
MANIFEST = (
    "session_id string, path string, compressed boolean, bytes bigint, mtime timestamp, dev bigint, ino bigint, ctime_ns bigint, parsed_bytes bigint, digest string, "
    "parser_version int, is_valid boolean, removed boolean, events_total bigint, run string, generation int"
)
STATES = f"{carry.STATE}, thread_id string, parent_thread_id string, run string"
SUMS = "session_id string, local_day date, model string, " + ", ".join(f"{c} bigint" for c in (*COUNTERS, *reports.FALLBACK)) + ", is_fallback boolean, last_activity timestamp, run string"


class StoreChanged(RuntimeError):
    """Another refresh committed since this one read the manifest; run it again."""


class Parts(Protocol):
    """How grown files are looked at and read in part (see sources.ranges)."""

    def examined(self, files: DataFrame) -> DataFrame: ...

    def range_lines(self, ranges: DataFrame) -> DataFrame: ...


def _path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _zone(store: str, part: str, tz: str) -> str:
    return f"{store}/{part}/tz={tz.replace('/', '~')}"


def published(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text unless there is one, whoever else tries. On a local file system it is written aside
    and linked to its name, which fails if that exists; elsewhere creation without overwriting is the file system's."""
    fs, target = _path(spark, path)
    fs.mkdirs(target.getParent())
    jvm = spark.sparkContext._jvm
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    local = fs.getScheme() == "file"
    try:
        out = fs.create(aside if local else target, False)
    except Exception as e:
        if fs.exists(target):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    if not local:
        return True
    try:
        named = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        jvm.java.nio.file.Files.createLink(named(target), named(aside))
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise e
    finally:
        fs.delete(aside, False)
    return True


def generations(spark: SparkSession, store: str, tz: str = "UTC") -> list[tuple[int, str, int]]:
    """(generation, folder of its manifest rows, when it was committed in ms) of a zone's commits."""
    fs, folder = _path(spark, _zone(store, "commits", tz))
    found = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if name.isdigit() and status.getLen():
            stream = fs.open(status.getPath())
            rows = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append((int(name), rows, status.getModificationTime()))
    return sorted(found)


def commit(spark: SparkSession, rows: DataFrame, store: str, tz: str, generation: int) -> None:
    """Make manifest rows the given generation, unless there is one already."""
    name = uuid.uuid4().hex
    rows.write.parquet(f"{_zone(store, 'manifest', tz)}/rows={name}")
    if not published(spark, f"{_zone(store, 'commits', tz)}/{generation}", name):
        raise StoreChanged(f"generation {generation} of {store}")


def manifest_rows(spark: SparkSession, store: str, tz: str, known: list[tuple[int, str, int]]) -> DataFrame:
    """All manifest rows of the given generations."""
    folders = [f"{_zone(store, 'manifest', tz)}/rows={rows}" for _, rows, _ in known]
    return spark.read.schema(MANIFEST).parquet(*folders) if folders else spark.createDataFrame([], MANIFEST)


def _latest(rows: DataFrame) -> DataFrame:
    latest = rows.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "session_id"]), "generation").alias("m"))
    return latest.select("session_id", "m.*").where(~F.col("removed")).drop("removed")


def manifest(spark: SparkSession, store: str, tz: str = "UTC") -> DataFrame:
    """The latest row of each session that isn't removed."""
    return _latest(manifest_rows(spark, store, tz, generations(spark, store, tz)))


def day_sums(events: DataFrame, tz: str) -> DataFrame:
    options = ReportOptions(timezone=tz)
    return reports.model_sums(reports.with_local_day(events, options), "session_id", "local_day")


def _live(spark: SparkSession, store: str, part: str, schema: str, tz: str, listed: DataFrame | None = None) -> DataFrame:
    """Rows of the runs that the manifest names; the folders of others aren't read. A store has one run for each refresh
    since it was compacted, so the names of runs are few."""
    live = (manifest(spark, store, tz) if listed is None else listed).select("session_id", "run")
    runs = [r[0] for r in live.select("run").distinct().collect()]
    if not runs:
        return spark.createDataFrame([], schema).drop("run")
    rows = spark.read.schema(schema).parquet(_zone(store, part, tz)).where(F.col("run").isin(runs))
    return rows.join(live, ["session_id", "run"]).drop("run")


def stored_sums(spark: SparkSession, store: str, tz: str = "UTC", listed: DataFrame | None = None) -> DataFrame:
    """The sums of each session's latest run."""
    return _live(spark, store, "sums", SUMS, tz, listed)


def stored_states(spark: SparkSession, store: str, tz: str = "UTC", listed: DataFrame | None = None) -> DataFrame:
    """The parser state and header of each session's latest run."""
    return _live(spark, store, "states", STATES, tz, listed)


def stored_roots(spark: SparkSession, store: str, tz: str = "UTC") -> DataFrame:
    """(session_id, root_id) from the stored headers."""
    return lineage.root_sessions(stored_states(spark, store, tz).select("session_id", "thread_id", "parent_thread_id"))


def inconsistent(sums: DataFrame, listed: DataFrame) -> DataFrame:
    """Sessions whose stored sums don't add up to the total that the manifest has."""
    added = sums.groupBy("session_id").agg(F.sum("total").alias("added"))
    return listed.join(added, "session_id", "left").where(F.coalesce("added", F.lit(0)) != F.col("events_total")).select("session_id")


def _planned(files: DataFrame, known: DataFrame, parts: Parts | None) -> DataFrame:
    """The refresh plan with the byte where parsing will end and a digest of what lies before it. A grown file is only
    appended to if the bytes that were parsed are still there."""
    plan = inventory.refresh_plan(files, known, PARSER_VERSION)
    old = F.col("old.parsed_bytes").alias("start")
    plan = plan.select("session_id", "path", "compressed", "bytes", "mtime", *[_optional(plan, c) for c in inventory.IDENTITY], old, F.col("old.digest").alias("digest_before"), "action")
    if parts is None:
        return plan.withColumns({"action": F.when(F.col("action") == "append", "rebuild").otherwise(F.col("action")), "end": F.col("bytes"), "digest": F.lit(None).cast("string")}).drop("digest_before")
    looked = plan.where(F.col("action").isin("append", "rebuild") & ~F.col("compressed")).select("path", "bytes", F.when(F.col("action") == "append", F.col("start")).alias("parsed_bytes"))
    plan = plan.join(parts.examined(looked), "path", "left")
    intact = F.col("known").eqNullSafe(F.col("digest_before")) & (F.col("end") >= F.col("start"))
    action = F.when((F.col("action") == "append") & ~F.coalesce(intact, F.lit(False)), "rebuild").otherwise(F.col("action"))
    return plan.withColumns({"action": action, "end": F.coalesce("end", "bytes")}).drop("known", "digest_before")


def _optional(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("bigint").alias(name)


def refresh(spark: SparkSession, lines: DataFrame, files: DataFrame, store: str, tz: str = "UTC", parts: Parts | None = None) -> dict[str, int]:
    """Bring the zone's part of the store up to the selected files and their lines (sources.files); returns sessions by
    action. Raises StoreChanged if another refresh of the zone came first.

    Sessions that are cached and consistent are not read again: their lines are pruned by a join before parsing. With
    parts, grown files are read from where they were parsed to; without, they are parsed anew.
    """
    seen = generations(spark, store, tz)
    base = max((g for g, *_ in seen), default=0)
    listed = _latest(manifest_rows(spark, store, tz, seen))
    listed = checkpointed(listed) if seen else listed  # of a new store the optimiser knows that it is empty
    sums_before, states_before = stored_sums(spark, store, tz, listed), stored_states(spark, store, tz, listed)
    broken = inconsistent(sums_before, listed).withColumn("broken", F.lit(True))
    known = listed.join(broken, "session_id", "left").withColumn("is_valid", F.col("is_valid") & F.col("broken").isNull())
    plan = checkpointed(_planned(files, known, parts))
    counts = {r[0]: r[1] for r in plan.groupBy("action").count().collect()}
    if not set(counts) & {"append", "rebuild", "removed"}:
        return counts
    run = uuid.uuid4().hex
    grown = plan.where("action = 'append'").select("session_id")
    rows, state = parse.records(lines.join(plan.where("action = 'rebuild'").select("path"), "path", "left_semi"), headers=True), None
    if counts.get("append"):
        ranges = plan.where("action = 'append'").select("session_id", "path", "start", "end")
        rows = rows.unionByName(parse.line_records(parts.range_lines(ranges), headers=True))
        state = states_before.join(grown, "session_id", "left_semi")
    rows = kept_table(rows)  # parsed once
    events, states = events_and_states(rows, checkpointed, state=state)
    sums = day_sums(events.where("ts IS NOT NULL"), tz)
    heads = rows.where("thread_id IS NOT NULL OR parent_thread_id IS NOT NULL").select("session_id", "thread_id", "parent_thread_id")
    if state is not None:
        sums = reports.regroup(sums.unionByName(sums_before.join(grown, "session_id", "left_semi")), "session_id", "local_day")
        heads = heads.unionByName(state.select("session_id", "thread_id", "parent_thread_id"))
    # a grown session without new records keeps its state
    parsed = plan.where(F.col("action").isin("append", "rebuild")).select("session_id").join(states, "session_id", "left").join(heads.groupBy("session_id").agg(F.max("thread_id").alias("thread_id"), F.max("parent_thread_id").alias("parent_thread_id")), "session_id", "left")
    sums_path = f"{_zone(store, 'sums', tz)}/run={run}"
    sums.write.parquet(sums_path)
    parsed.write.parquet(f"{_zone(store, 'states', tz)}/run={run}")
    totals = spark.read.schema(SUMS).parquet(sums_path).groupBy("session_id").agg(F.sum("total").alias("events_total"))
    rows = plan.where("action <> 'cached'").join(totals, "session_id", "left")
    rows = rows.select(
        "session_id", "path", "compressed", "bytes", "mtime", *inventory.IDENTITY, F.col("end").alias("parsed_bytes"), "digest", F.lit(PARSER_VERSION).alias("parser_version"), F.lit(True).alias("is_valid"),
        (F.col("action") == "removed").alias("removed"), F.coalesce("events_total", F.lit(0)).cast("bigint").alias("events_total"), F.lit(run).alias("run"), F.lit(base + 1).alias("generation"),
    )
    commit(spark, rows, store, tz, base + 1)
    return counts


def compact(spark: SparkSession, store: str, target: str, tz: str = "UTC") -> None:
    """Write the live rows of a zone's part of a store as one generation of a new store."""
    run, listed = uuid.uuid4().hex, checkpointed(manifest(spark, store, tz))
    for part, schema in (("sums", SUMS), ("states", STATES)):
        _live(spark, store, part, schema, tz, listed).write.parquet(f"{_zone(target, part, tz)}/run={run}")
    commit(spark, listed.withColumns({"generation": F.lit(1), "removed": F.lit(False), "run": F.lit(run)}), target, tz, 1)


def vacuum(spark: SparkSession, store: str, tz: str = "UTC", keep: timedelta = timedelta(hours=1), now: datetime | None = None) -> list[str]:
    """Delete the runs of a zone that no reader of the last `keep` can have looked at, and those of refreshes that never
    committed and began before then; returns their names. A reader that began at some time reads the runs of the
    manifest as it was then: the latest rows at the start of that span, and all rows committed since."""
    start = int(((now or datetime.now(UTC)) - keep).timestamp() * 1000)
    known = generations(spark, store, tz)
    before, since = [g for g in known if g[2] < start], [g for g in known if g[2] >= start]
    used = _latest(manifest_rows(spark, store, tz, before)).select("run").unionByName(manifest_rows(spark, store, tz, since).select("run"))
    used_runs = {r[0] for r in used.distinct().collect()}
    gone = set()
    for part in ("sums", "states"):
        fs, folder = _path(spark, _zone(store, part, tz))
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            run = status.getPath().getName().removeprefix("run=")
            if run not in used_runs and status.getModificationTime() < start:
                fs.delete(status.getPath(), True)
                gone.add(run)
    return sorted(gone)


def stored_report(
    spark: SparkSession, kind: str, store: str, pricing: DataFrame, options: ReportOptions = ReportOptions(), today=None, roots: DataFrame | None = None
) -> DataFrame:
    """A daily, monthly or session report over stored sums; of sessions by the stored headers, or by given roots."""
    if options.last_days is not None and kind != "daily":
        raise ValueError("last_days is for the daily report")
    since, until = options.bounds(today)
    sums = stored_sums(spark, store, options.timezone)
    sums = sums.where(F.col("local_day") >= F.lit(since)) if since else sums
    sums = sums.where(F.col("local_day") <= F.lit(until)) if until else sums
    if kind == "session":
        roots = stored_roots(spark, store, options.timezone) if roots is None else roots
        return reports.session_rows(reports.regroup(sums, "session_id"), pricing, options, roots)
    keys = {"daily": ("date", F.col("local_day")), "monthly": ("month", month_of(F.col("local_day")))}
    if kind not in keys:
        raise ValueError(f"unknown report {kind!r}")
    name, key = keys[kind]
    rows = reports.priced(reports.regroup(sums.withColumn(name, key), name), pricing, options)
    return reports.by_key(rows, name).drop("last_activity").orderBy(name)
