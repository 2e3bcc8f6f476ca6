"""Reports over directories of log files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions import parse
from meterloom.operators import incremental, lineage, reports
from meterloom.operators.events import usage_events
from meterloom.operators.pricing import built_in_prices
from meterloom.schemas import ReportOptions
from meterloom.session import checkpointed
from meterloom.sources import files, ranges


def _split_bytes(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def chosen_files(spark: SparkSession, options: ReportOptions) -> DataFrame:
    """The file of each session that the options select, kept in the shared folder: a small table that much asks for."""
    return checkpointed(files.selected_files(spark, list(options.roots), options.project))


def events_of(spark: SparkSession, options: ReportOptions, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(usage events, lines) of the files that the options select. Where a file is large enough for Spark to read it in
    several splits, these are the segments of its session."""
    chosen = chosen_files(spark, options) if chosen is None else chosen
    lines = files.selected_lines(spark, list(options.roots), files=chosen)
    rows = parse.records(lines, strict=options.strict)
    large = (chosen.agg(F.max("bytes")).first()[0] or 0) > _split_bytes(spark)
    return usage_events(rows, segment=F.col("seq.block_start") if large else None).where("ts IS NOT NULL"), lines


def _report(spark: SparkSession, kind: str, rows: DataFrame, options: ReportOptions) -> dict:
    missing = files.missing_roots(spark, list(options.roots))
    return {"kind": kind, "rows": rows, "totals": reports.totals(rows), "json": reports.json_report(rows, kind, missing), "missing_directories": missing}


def build_report(spark: SparkSession, kind: str, options: ReportOptions, pricing: DataFrame | None = None, today: date | None = None) -> dict:
    """{"kind", "rows", "totals", "json", "missing_directories"} for a daily, monthly or session report; rows, totals and
    json (one text a row) are DataFrames, evaluated when they are used."""
    pricing = built_in_prices(spark) if pricing is None else pricing
    events, lines = events_of(spark, options)
    if kind == "daily":
        rows = reports.daily_report(events, pricing, options, today)
    elif kind == "monthly":
        rows = reports.monthly_report(events, pricing, options)
    elif kind == "session":
        rows = reports.session_report(events, pricing, options, lineage.root_sessions(parse.descriptors(lines)))
    else:
        raise ValueError(f"unknown report {kind!r}")
    return _report(spark, kind, rows, options)


def session_file(spark: SparkSession, options: ReportOptions, session_id: str) -> DataFrame:
    """The file of one session across the roots, with no row if there is none."""
    return files.find_session(files.inventory(spark, list(options.roots)), session_id)


def refreshed_report(spark: SparkSession, kind: str, store: str, options: ReportOptions, pricing: DataFrame | None = None, today: date | None = None) -> dict:
    """The same over a store of sums, which is first brought up to the files that the options select. A store is for one
    choice of roots and project."""
    pricing = built_in_prices(spark) if pricing is None else pricing
    roots = list(options.roots)
    chosen, parts = chosen_files(spark, options), ranges if all(ranges.mounted(spark, root) for root in roots) else None
    incremental.refresh(spark, files.selected_lines(spark, roots, files=chosen), chosen, store, options.timezone, parts)
    return _report(spark, kind, incremental.stored_report(spark, kind, store, pricing, options, today), options)
