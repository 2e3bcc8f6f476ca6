"""Queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

import uuid
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions import formats
from meterloom.operators import inventory, lineage, live, reports
from meterloom.operators.events import carried_states
from meterloom.operators.events import usage_events as usage_events_of
from meterloom.operators.pricing import candidates, merged_prices, resolved_prices
from meterloom.plans import bindings as b
from meterloom.schemas import COUNTERS, ReportOptions
from meterloom.sources.files import find_session as find

QUERIES: dict = {}
ORACLE_SQL: dict = {}
NOON, EARLY = datetime(2024, 1, 15, 12, 10, tzinfo=UTC), datetime(2024, 1, 15, 0, 20, tzinfo=UTC)
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS)

_RECORDS_SQL = """
k0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
u AS (
  SELECT 'team' || (user_id % 3) || '/u' || user_id AS session_id, event_id, ts, event_type = 'signup' AS ctx,
    event_type IN ('click', 'view', 'error') AS has_last, event_type IN ('purchase', 'error') AS has_total,
    CASE WHEN event_type = 'signup' OR (event_type = 'error' AND k % 5 = 0)
      THEN CASE k % 4 WHEN 0 THEN 'gpt-5' WHEN 1 THEN 'gpt-5.3-codex' WHEN 2 THEN 'openai/gpt-5' ELSE 'unpriced' END END AS named,
    CASE WHEN k % 17 = 0 THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS i, CASE WHEN k % 17 = 0 THEN 0 ELSE k * 3 END AS c,
    CASE WHEN k % 17 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS o, CASE WHEN k % 17 = 0 THEN 0 ELSE k % 7 END AS g,
    CASE WHEN k % 5 = 0 OR k % 17 = 0 THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) + CAST(floor(value) AS BIGINT) END AS t,
    user_id % 4 = 1 AS spawned, event_type = 'view' AND k % 6 = 0 AS boundary
  FROM k0),
seg AS (SELECT *, count(CASE WHEN has_total THEN 1 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM u),
car AS (
  SELECT *, sum(CASE WHEN has_total OR has_last THEN i END) OVER w AS ci, sum(CASE WHEN has_total OR has_last THEN c END) OVER w AS cc,
    sum(CASE WHEN has_total OR has_last THEN o END) OVER w AS co, sum(CASE WHEN has_total OR has_last THEN g END) OVER w AS cg,
    sum(CASE WHEN has_total THEN t WHEN has_last THEN CASE WHEN t > 0 THEN t ELSE i + o END END) OVER w AS ct
  FROM seg WINDOW w AS (PARTITION BY session_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
pre AS (
  SELECT *, coalesce(lag(ci) OVER w, 0) AS pi, coalesce(lag(cc) OVER w, 0) AS pc, coalesce(lag(co) OVER w, 0) AS po,
    coalesce(lag(cg) OVER w, 0) AS pg, coalesce(lag(ct) OVER w, 0) AS pt
  FROM car WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
raw AS (
  SELECT *, CASE WHEN has_last THEN i ELSE greatest(i - pi, 0) END AS ri, CASE WHEN has_last THEN c ELSE greatest(c - pc, 0) END AS rc,
    CASE WHEN has_last THEN o ELSE greatest(o - po, 0) END AS ro, CASE WHEN has_last THEN g ELSE greatest(g - pg, 0) END AS rg,
    CASE WHEN has_last THEN t ELSE greatest(t - pt, 0) END AS rt
  FROM pre),
norm AS (
  SELECT *, NOT ctx AND (ri > 0 OR ro > 0 OR rg > 0 OR least(rc, ri) > 0) AS ev FROM raw),
modelled AS (
  SELECT *, last_value(CASE WHEN ctx OR ev THEN named END IGNORE NULLS) OVER w AS m,
    first_value(spawned) OVER w AND NOT bool_or(boundary) OVER w AS inherited
  FROM norm WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
all_events AS (
  SELECT session_id, event_id, ts, coalesce(m, 'gpt-5') AS model, m IS NULL AS is_fallback, CAST(ri AS BIGINT) AS input,
    CAST(least(rc, ri) AS BIGINT) AS cached_input, CAST(ro AS BIGINT) AS output, CAST(rg AS BIGINT) AS reasoning_output,
    CAST(CASE WHEN rt > 0 THEN rt ELSE ri + ro END AS BIGINT) AS total, inherited
  FROM modelled WHERE ev),
prices(model, pi, pc, po) AS (
  VALUES ('gpt-5', 1.25, 0.125, 10.0), ('gpt-5.3-codex', 1.25, 0.125, 10.0), ('openai/gpt-5', 2.0, 0.2, 12.0), ('unpriced', 0.0, 0.0, 0.0))"""
_COST = "((input - least(cached_input, input)) * CAST(pi AS DOUBLE) + least(cached_input, input) * CAST(pc AS DOUBLE) + output * CAST(po AS DOUBLE)) / 1000000"
_FREE = "((input - least(cached_input, input)) * CAST(pi AS DOUBLE) + output * CAST(po AS DOUBLE)) / 1000000"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def with_events(sql: str) -> str:
    return f"WITH {_RECORDS_SQL},\n{sql}"


def money(*columns: str) -> dict:
    return {c: F.round(c, 9) for c in columns}


@query("usage_events", f"WITH {_RECORDS_SQL} SELECT session_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, model, is_fallback, {', '.join(COUNTERS)} FROM all_events")
def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.events(spark, sf_dir).select("session_id", F.col("seq.event_id").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "model", "is_fallback", *COUNTERS)


@query("segmented_events", f"WITH {_RECORDS_SQL} SELECT session_id, event_id, model, is_fallback, {', '.join(COUNTERS)} FROM all_events WHERE NOT inherited")
def segmented_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of replay_suppression, with each session cut into days that are summed up apart."""
    events = usage_events_of(b.records(spark, sf_dir), segment=F.to_date("seq.ts"))
    return events.select("session_id", F.col("seq.event_id").alias("event_id"), "model", "is_fallback", *COUNTERS)


@query("continued_events", f"WITH {_RECORDS_SQL} SELECT session_id, event_id, model, is_fallback, {', '.join(COUNTERS)} FROM all_events WHERE NOT inherited AND ts >= TIMESTAMP '2024-01-15'")
def continued_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events from a day on, found from the records since then and the states that sessions had before."""
    records, late = b.records(spark, sf_dir), F.col("seq.ts") >= F.lit("2024-01-15").cast("timestamp")
    events = usage_events_of(records.where(late), state=carried_states(records.where(~late)))
    return events.select("session_id", F.col("seq.event_id").alias("event_id"), "model", "is_fallback", *COUNTERS)


@query("replay_suppression", f"WITH {_RECORDS_SQL} SELECT session_id, event_id, model, is_fallback, {', '.join(COUNTERS)} FROM all_events WHERE NOT inherited")
def replay_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.events(spark, sf_dir, replay=True).select("session_id", F.col("seq.event_id").alias("event_id"), "model", "is_fallback", *COUNTERS)


def grouped_sql(key: str, cost: str = _COST, where: str = "true", counters: str = SUMS, source: str = "all_events") -> str:
    return with_events(f"""
d AS (SELECT *, {key} AS key FROM {source} WHERE {where}),
m AS (SELECT key, model, {SUMS} FROM d GROUP BY key, model),
p AS (SELECT m.*, {cost} AS cost FROM m JOIN prices USING (model))
SELECT key, {counters}, round(sum(cost), 9) AS cost_usd FROM p GROUP BY key""")


def flat(report: DataFrame, key: str) -> DataFrame:
    return report.select(F.col(key).alias("key"), *COUNTERS, F.round("cost_usd", 9).alias("cost_usd"))


DAY = "CAST(ts AS DATE)"
WARSAW = "CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Warsaw' AS DATE)"
KOLKATA = "CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Kolkata' AS DATE)"


@query("daily_report", grouped_sql(DAY))
def daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(reports.daily_report(b.events(spark, sf_dir), b.pricing(spark)), "date")


@query("monthly_report", grouped_sql("strftime(ts, '%Y-%m')"))
def monthly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(reports.monthly_report(b.events(spark, sf_dir), b.pricing(spark)), "month")


@query("json_report", with_events(f"""
m AS (SELECT {DAY} AS key, model, sum(total) AS total, bool_or(is_fallback) AS fallback FROM all_events GROUP BY ALL)
SELECT 'daily' AS kind, CAST(key AS VARCHAR) AS key, CAST(sum(total) AS BIGINT) AS total, CAST(max(total) FILTER (model = 'gpt-5') AS BIGINT) AS gpt_5, string_agg(model, ',' ORDER BY model) AS models,
  bool_or(fallback) FILTER (model = 'gpt-5') AS fallback, '/gone' AS missing FROM m GROUP BY key"""))
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the JSON texts of a daily report, models in the order that the texts have them."""
    texts = reports.json_report(reports.daily_report(b.events(spark, sf_dir), b.pricing(spark)), "daily", ["/gone"])
    at = lambda path: F.get_json_object("value", path)
    return texts.select(
        at("$.kind").alias("kind"), at("$.row.date").alias("key"), at("$.row.total").cast("bigint").alias("total"), at("$.row.models.gpt-5.total").cast("bigint").alias("gpt_5"),
        F.array_join(F.json_object_keys(at("$.row.models")), ",").alias("models"), F.coalesce(at("$.row.models.gpt-5.is_fallback"), F.lit("false")).cast("boolean").alias("fallback"),
        at("$.missing_directories[0]").alias("missing"),
    )


@query("session_report", with_events(f"""
m AS (SELECT session_id, model, {SUMS}, max(ts) AS last_ts FROM all_events GROUP BY session_id, model),
p AS (SELECT m.*, {_COST} AS cost FROM m JOIN prices USING (model))
SELECT session_id AS key, split_part(session_id, '/', 1) AS directory, split_part(session_id, '/', 2) AS session_file, {SUMS}, round(sum(cost), 9) AS cost_usd,
  strftime(max(last_ts), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(max(last_ts)) % 1000 AS VARCHAR), 3, '0') || 'Z' AS last_activity FROM p GROUP BY session_id"""))
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports.session_report(b.events(spark, sf_dir), b.pricing(spark))
    return r.select(F.col("session_id").alias("key"), "directory", "session_file", *COUNTERS, F.round("cost_usd", 9).alias("cost_usd"), "last_activity")


@query("tz_daily", grouped_sql(WARSAW))
def tz_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(reports.daily_report(b.events(spark, sf_dir), b.pricing(spark), ReportOptions(timezone="Europe/Warsaw")), "date")


@query("date_range", grouped_sql(KOLKATA, where=f"{KOLKATA} BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'"))
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ReportOptions(since="20240105", until="2024-01-12", timezone="Asia/Kolkata")
    return flat(reports.daily_report(b.events(spark, sf_dir), b.pricing(spark), options), "date")


@query("last_n_days", grouped_sql(DAY, where=f"{DAY} BETWEEN DATE '2024-01-14' AND DATE '2024-01-20'"))
def last_n_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(reports.daily_report(b.events(spark, sf_dir), b.pricing(spark), ReportOptions(last_days=7), date(2024, 1, 20)), "date")


@query("free_cache_cost", grouped_sql(DAY, cost=_FREE))
def free_cache_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(reports.daily_report(b.events(spark, sf_dir), b.pricing(spark), ReportOptions(free_cached=True)), "date")


@query("exclude_cache", grouped_sql(DAY, cost=_FREE, counters="""CAST(sum(input - least(cached_input, input)) AS BIGINT) AS input, CAST(0 AS BIGINT) AS cached_input,
  CAST(sum(output) AS BIGINT) AS output, CAST(sum(reasoning_output) AS BIGINT) AS reasoning_output, CAST(sum(greatest(total - least(cached_input, input), 0)) AS BIGINT) AS total"""))
def exclude_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(reports.daily_report(b.events(spark, sf_dir), b.pricing(spark), ReportOptions(exclude_cached=True)), "date")


@query("grand_totals", with_events(f"m AS (SELECT {DAY} AS d, model, {SUMS} FROM all_events GROUP BY ALL), p AS (SELECT m.*, {_COST} AS cost FROM m JOIN prices USING (model)) SELECT {SUMS}, round(sum(cost), 9) AS cost_usd FROM p"))
def grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(reports.daily_report(b.events(spark, sf_dir), b.pricing(spark))).withColumns(money("cost_usd"))


_FALLBACK_SUMS = ", ".join(f"CAST(coalesce(sum({c}) FILTER (WHERE is_fallback), 0) AS BIGINT) AS fallback_{c}" for c in COUNTERS)


def part_cost(prefix: str) -> str:
    """Cost of a part: of the fallback sums, or of what they leave."""
    v = (lambda c: f"fallback_{c}") if prefix == "fallback" else (lambda c: f"({c} - fallback_{c})")
    cached = f"least({v('cached_input')}, {v('input')})"
    return f"(({v('input')} - {cached}) * CAST(pi AS DOUBLE) + {cached} * CAST(pc AS DOUBLE) + {v('output')} * CAST(po AS DOUBLE)) / 1000000"


@query("daily_model_breakdown", with_events(f"""
m AS (SELECT {DAY} AS local_day, model, {SUMS}, {_FALLBACK_SUMS}, bool_or(is_fallback) AS is_fallback FROM all_events GROUP BY ALL)
SELECT m.*, round({part_cost('explicit')}, 9) AS explicit_cost_usd, round({part_cost('fallback')}, 9) AS fallback_cost_usd FROM m JOIN prices USING (model)"""))
def daily_model_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ReportOptions()
    sums = reports.model_sums(reports.with_local_day(b.events(spark, sf_dir), options), "local_day")
    rows = reports.priced(sums, b.pricing(spark), options)
    return rows.select("local_day", "model", *COUNTERS, *reports.FALLBACK, "is_fallback", F.round("explicit_cost_usd", 9).alias("explicit_cost_usd"), F.round("fallback_cost_usd", 9).alias("fallback_cost_usd"))


@query("fallback_split", with_events(f"""
m AS (SELECT model, {SUMS}, {_FALLBACK_SUMS} FROM all_events GROUP BY model)
SELECT model, {', '.join(f'{c} - fallback_{c} AS explicit_{c}' for c in COUNTERS)}, {', '.join(f'fallback_{c}' for c in COUNTERS)} FROM m"""))
def fallback_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = reports.model_sums(b.events(spark, sf_dir))
    return sums.select("model", *[formats.minus(F.col(c), F.col(f"fallback_{c}")).alias(f"explicit_{c}") for c in COUNTERS], *reports.FALLBACK)


_PARTS = with_events(f"""
m AS (SELECT {DAY} AS local_day, model, {SUMS}, {_FALLBACK_SUMS} FROM all_events GROUP BY ALL),
l AS (
  SELECT local_day, model AS label, {', '.join(f'{c} - fallback_{c} AS {c}' for c in COUNTERS)}, {part_cost('explicit')} AS cost FROM m JOIN prices USING (model)
  UNION ALL SELECT local_day, model || ' (fallback)', {', '.join(f'fallback_{c}' for c in COUNTERS)}, {part_cost('fallback')} FROM m JOIN prices USING (model)),
v AS (SELECT * FROM l WHERE input > 0 OR cached_input > 0 OR output > 0 OR reasoning_output > 0 OR total > 0)
SELECT local_day, CASE WHEN grouping(label) = 0 THEN label ELSE 'TOTAL' END AS label, CAST(grouping(local_day) * 2 + grouping(label) AS BIGINT) AS level, {SUMS}, round(sum(cost), 9) AS cost_usd
FROM v GROUP BY GROUPING SETS ((local_day, label), (local_day), ())""")


@query("display_rows", _PARTS)
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ReportOptions()
    sums = reports.model_sums(reports.with_local_day(b.events(spark, sf_dir), options), "local_day")
    return reports.display_rows(reports.priced(sums, b.pricing(spark), options), "local_day").withColumns(money("cost_usd"))


_CANDIDATES = """
n AS (SELECT DISTINCT model FROM (SELECT unnest([model, 'azure/' || model, 'openrouter/openai/' || model, ' ' || model, 'openrouter/' || model || ':free', 'gpt-5-codex', 'openai/gpt-5-codex']) AS model FROM all_events)),
q AS (SELECT model, trim(model) AS t, CASE WHEN starts_with(trim(model), 'openrouter/openai/') THEN 'openrouter/openai/' WHEN starts_with(trim(model), 'openai/') THEN 'openai/' WHEN starts_with(trim(model), 'azure/') THEN 'azure/' END AS prefix FROM n),
s AS (SELECT *, substr(t, length(prefix) + 1) AS base FROM q),
al AS (SELECT *, CASE t WHEN 'gpt-5-codex' THEN 'gpt-5' WHEN 'gpt-5.3-codex' THEN 'gpt-5.2-codex' END AS ta, CASE base WHEN 'gpt-5-codex' THEN 'gpt-5' WHEN 'gpt-5.3-codex' THEN 'gpt-5.2-codex' END AS ba FROM s),
l0 AS (SELECT model, [x FOR x IN [t, ta, base, prefix || ba, ba] IF x IS NOT NULL] AS direct FROM al),
l1 AS (SELECT model, direct, [x FOR x IN direct IF NOT (starts_with(x, 'openrouter/openai/') OR starts_with(x, 'openai/') OR starts_with(x, 'azure/'))] AS plain FROM l0),
l2 AS (SELECT model, list_concat(direct, flatten([['openai/' || x, 'azure/' || x, 'openrouter/openai/' || x] FOR x IN plain])) AS names FROM l1),
e AS (SELECT model, unnest(names) AS name, generate_subscripts(names, 1) AS place FROM l2),
known(name, i, c, o) AS (VALUES ('gpt-5', 1.25, 0.125, 10.0), ('gpt-5-codex', 1.25, 0.125, 10.0), ('gpt-5.2-codex', 1.25, 0.125, 10.0), ('openai/gpt-5', 2.0, 0.2, 12.0)),
f AS (SELECT model, arg_min(i, place) AS i, arg_min(c, place) AS c, arg_min(o, place) AS o FROM e JOIN known USING (name) GROUP BY model)
SELECT n.model, CAST(CASE WHEN lower(trim(n.model)) LIKE 'openrouter/%:free' THEN 0 ELSE coalesce(i, 0) END AS DOUBLE) AS input_cost_per_mtoken,
  CAST(CASE WHEN lower(trim(n.model)) LIKE 'openrouter/%:free' THEN 0 ELSE coalesce(c, 0) END AS DOUBLE) AS cached_input_cost_per_mtoken,
  CAST(CASE WHEN lower(trim(n.model)) LIKE 'openrouter/%:free' THEN 0 ELSE coalesce(o, 0) END AS DOUBLE) AS output_cost_per_mtoken FROM n LEFT JOIN f USING (model)"""


@query("price_lookup", with_events(_CANDIDATES))
def price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("model")
    names = F.array(m, F.concat(F.lit("azure/"), m), F.concat(F.lit("openrouter/openai/"), m), F.concat(F.lit(" "), m), F.concat(F.lit("openrouter/"), m, F.lit(":free")), F.lit("gpt-5-codex"), F.lit("openai/gpt-5-codex"))
    return resolved_prices(b.events(spark, sf_dir).select(F.explode(names).alias("model")).distinct(), b.pricing(spark))


@query("price_override", with_events("""
a AS (SELECT model, CAST(count(*) AS DOUBLE) AS i FROM all_events GROUP BY model),
k(model, i, c, o) AS (VALUES ('gpt-5', 1.25, 0.125, 10.0), ('gpt-5-codex', 1.25, 0.125, 10.0), ('gpt-5.2-codex', 1.25, 0.125, 10.0))
SELECT model, CAST(coalesce(a.i, k.i) AS DOUBLE) AS input_cost_per_mtoken, CAST(coalesce(a.i, k.c) AS DOUBLE) AS cached_input_cost_per_mtoken,
  CAST(coalesce(a.i, k.o) AS DOUBLE) AS output_cost_per_mtoken FROM a FULL JOIN k USING (model)"""))
def price_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot prices over built-in ones; the snapshot prices each model that occurs by how often it does."""
    n = F.count("*").cast("double")
    snapshot = b.events(spark, sf_dir).groupBy("model").agg(n.alias("input_cost_per_mtoken"), n.alias("cached_input_cost_per_mtoken"), n.alias("output_cost_per_mtoken"))
    return merged_prices(snapshot, b.pricing(spark).where("model <> 'openai/gpt-5'"))


_FILES = """WITH RECURSIVE f AS (
  SELECT 'c' || o_custkey AS session_id, CAST(o_orderkey % 2 AS INTEGER) AS root_ord, o_orderstatus = 'F' AS compressed,
    CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderdate AS mtime, 'root' || (o_orderkey % 2) || '/c' || o_custkey || '-' || o_orderkey || '.jsonl' AS path FROM orders)"""


_PREFERRED = _FILES + """,
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY root_ord, path) AS k FROM f),
s AS (
  SELECT session_id, k, root_ord, compressed, bytes, mtime, path FROM o WHERE k = 1
  UNION ALL
  SELECT o.session_id, o.k,
    CASE WHEN p THEN o.root_ord ELSE s.root_ord END, CASE WHEN p THEN o.compressed ELSE s.compressed END, CASE WHEN p THEN o.bytes ELSE s.bytes END,
    CASE WHEN p THEN o.mtime ELSE s.mtime END, CASE WHEN p THEN o.path ELSE s.path END
  FROM s JOIN o ON o.session_id = s.session_id AND o.k = s.k + 1,
  LATERAL (SELECT CASE WHEN (o.compressed OR s.compressed) AND o.mtime <> s.mtime THEN o.mtime > s.mtime
    ELSE o.bytes > s.bytes OR (o.bytes = s.bytes AND (o.mtime > s.mtime OR (o.mtime = s.mtime AND o.path > s.path))) END AS p) AS t)"""


@query("dedupe_files", _PREFERRED + " SELECT session_id, arg_max(path, k) AS path, arg_max(bytes, k) AS bytes FROM s GROUP BY session_id")
def dedupe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.preferred_files(b.files(spark, sf_dir)).select("session_id", "path", "bytes")


@query("find_session", _FILES + """,
kept AS (SELECT * FROM f WHERE session_id = 'c1' OR session_id = 'c10'),
plain AS (SELECT DISTINCT session_id, root_ord FROM kept WHERE NOT compressed),
k AS (SELECT kept.* FROM kept LEFT JOIN plain USING (session_id, root_ord) WHERE NOT compressed OR plain.root_ord IS NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY root_ord, path) AS k FROM k),
""" + _PREFERRED[_PREFERRED.index("s AS ("):] + " SELECT session_id, arg_max(path, k) AS path, arg_max(bytes, k) AS bytes FROM s GROUP BY session_id")
def find_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of two sessions, looked up by id across roots; plain files go first in a root."""
    found = [find(b.files(spark, sf_dir), name) for name in ("c1", "c10")]
    return found[0].unionByName(found[1]).select("session_id", "path", "bytes")


@query("number_texts", """
SELECT l_orderkey, l_linenumber, format('{:,}', CAST(floor(l_extendedprice * 100) AS BIGINT)) AS full_number, printf('$%.2f', CAST(l_extendedprice AS DOUBLE)) AS currency,
  CAST(CAST(round_even(greatest(0, least(100, 100 - CAST(l_quantity * 2.5 AS DOUBLE))), 0) AS BIGINT) AS VARCHAR) AS percent_left FROM lineitem""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as reports and the monitor show them."""
    price, used = F.col("l_extendedprice").cast("double"), (F.col("l_quantity") * 2.5).cast("double")
    return b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", formats.full_number(F.floor(F.col("l_extendedprice") * 100)).alias("full_number"), formats.currency(price).alias("currency"), formats.percent_left(used).alias("percent_left"),
    )


@query("plain_over_compressed", _FILES + """
SELECT session_id, path FROM f WHERE NOT compressed OR (root_ord, session_id) NOT IN (SELECT (root_ord, session_id) FROM f WHERE NOT compressed)""")
def plain_over_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.plain_over_compressed(b.files(spark, sf_dir)).select("session_id", "path")


_ROOTS = """WITH RECURSIVE t AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN c_custkey + 1 WHEN c_custkey % 10 = 4 THEN c_custkey - 1 WHEN c_custkey % 7 = 0 THEN NULL
    WHEN c_custkey % 11 = 0 THEN c_custkey + 100000000 ELSE c_custkey // 2 END AS parent FROM customer),
l AS (SELECT t.id, p.id AS parent FROM t LEFT JOIN t p ON t.parent = p.id),
w AS (SELECT id, id AS node, 0 AS depth FROM l UNION ALL SELECT w.id, l.parent, depth + 1 FROM w JOIN l ON l.id = w.node WHERE l.parent IS NOT NULL AND depth < 64),
r AS (SELECT id, max(depth) AS depth, arg_max(node, depth) AS node FROM w GROUP BY id)"""


@query("session_roots", _ROOTS + " SELECT id AS session_id, CASE WHEN depth >= 64 THEN id ELSE node END AS root_id FROM r")
def session_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.root_sessions(b.threads(spark, sf_dir))


@query("session_fold", _ROOTS + """,
x AS (SELECT id, CASE WHEN depth >= 64 THEN id ELSE node END AS root_id FROM r),
s AS (SELECT o_custkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)
SELECT coalesce(x.root_id, s.id) AS session_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS parts FROM s LEFT JOIN x USING (id) GROUP BY ALL""")
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = lineage.root_sessions(b.threads(spark, sf_dir))
    sums = b.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.sum(F.floor("o_totalprice").cast("bigint")).alias("n"), F.count("*").alias("k"))
    return sums.join(roots, "session_id", "left").groupBy(F.coalesce("root_id", "session_id").alias("session_id")).agg(F.sum("n").alias("total"), F.sum("k").alias("parts"))


_MESSAGES = """
WITH m AS (SELECT 'conv/' || conv_id AS session_id, turn, role, CAST(length(text) AS BIGINT) AS n, conv_id % 3 = 0 AS fork, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations),
e AS (SELECT session_id, turn, n + n // 4 AS input, n // 4 AS cached_input, turn * 10 + 5 AS output FROM m WHERE role = 'assistant' AND n > 0 AND NOT (fork AND first = 0 AND turn < 2))"""


@query("fork_cutoff", _MESSAGES + " SELECT session_id, turn, input, cached_input, output, input + output AS total FROM e")
def fork_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterloom.operators.events import usage_events as events_of

    return events_of(b.messages(spark, sf_dir)).select("session_id", F.col("seq").alias("turn"), "input", "cached_input", "output", "total")


@query("assistant_usage", _MESSAGES + " SELECT session_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cached_input) AS BIGINT) AS cached_input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(input + output) AS BIGINT) AS total FROM e GROUP BY session_id")
def assistant_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterloom.operators.events import usage_events as events_of

    sums = [F.sum(c).alias(c) for c in ("input", "cached_input", "output", "total")]
    return events_of(b.messages(spark, sf_dir)).groupBy("session_id").agg(*sums)


def window_sql(now: str, hours: str, body: str) -> str:
    return with_events(f"""
v AS (SELECT * FROM all_events WHERE ts <= TIMESTAMP '{now}' AND ts >= greatest({hours}, date_trunc('day', TIMESTAMP '{now}'))),
m AS (SELECT model, is_fallback, {SUMS} FROM v GROUP BY model, is_fallback),
mm AS (SELECT model, {SUMS} FROM v GROUP BY model),
p AS (SELECT mm.*, {_COST} AS cost FROM mm JOIN prices USING (model))
{body}""")


_ZEROS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COUNTERS)


@query("current_day", window_sql("2024-01-15 12:10:00", "TIMESTAMP '2024-01-15 00:00:00'", f"SELECT DATE '2024-01-15' AS date, {_ZEROS}, round(coalesce(sum(cost), 0), 9) AS cost_usd FROM p"))
def current_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.current_day_totals(b.events(spark, sf_dir), b.pricing(spark), NOON).withColumns(money("cost_usd"))


def rate_sql(now: str, minutes: int) -> str:
    rates = ", ".join(f"CAST((coalesce(sum({c}), 0) * 3600000000 + CAST({minutes} AS BIGINT) * 30000000) // (CAST({minutes} AS BIGINT) * 60000000) AS BIGINT) AS {c}_per_hour" for c in COUNTERS)
    return window_sql(now, f"TIMESTAMP '{now}' - INTERVAL 1 HOUR", f"SELECT CAST({minutes} AS BIGINT) AS window_minutes, {rates}, round(coalesce(sum(cost), 0) * 60 / {minutes}, 9) AS cost_usd_per_hour FROM p")


@query("burn_rate", rate_sql("2024-01-15 12:10:00", 60))
def burn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.burn_rate(b.events(spark, sf_dir), b.pricing(spark), NOON).withColumns(money("cost_usd_per_hour"))


@query("burn_rate_after_midnight", rate_sql("2024-01-15 00:20:00", 20))
def burn_rate_after_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.burn_rate(b.events(spark, sf_dir), b.pricing(spark), EARLY).withColumns(money("cost_usd_per_hour"))


def history_sql(now: str) -> str:
    return with_events(f"""
s AS (SELECT CAST(i AS INTEGER) AS sample, TIMESTAMP '{now}' - INTERVAL 8 HOUR + i * INTERVAL 15 MINUTE AS at FROM range(33) r(i)),
m AS (SELECT sample, model, {SUMS} FROM s JOIN all_events e ON e.ts BETWEEN s.at - INTERVAL 30 MINUTE AND s.at GROUP BY ALL),
p AS (SELECT sample, {_COST} AS cost FROM m JOIN prices USING (model))
SELECT s.sample, strftime(s.at, '%H:%M') AS end_time, round(coalesce(sum(cost), 0) * 2, 9) AS cost_usd_per_hour FROM s LEFT JOIN p USING (sample) GROUP BY ALL""")


@query("burn_history", history_sql("2024-01-15 12:10:00"))
def burn_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = live.burn_history(b.events(spark, sf_dir), b.pricing(spark), NOON)
    return h.select("sample", F.date_format("end_ts", "HH:mm").alias("end_time"), F.round("cost_usd_per_hour", 9).alias("cost_usd_per_hour"))


@query("burn_history_short", "SELECT * FROM (" + history_sql("2024-01-15 12:10:00") + ") WHERE sample >= 16")
def burn_history_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 17 points, four hours of it."""
    h = live.burn_history(b.events(spark, sf_dir), b.pricing(spark), NOON, points=17)
    return h.select("sample", F.date_format("end_ts", "HH:mm").alias("end_time"), F.round("cost_usd_per_hour", 9).alias("cost_usd_per_hour"))


@query("burn_history_after_midnight", history_sql("2024-01-15 00:20:00"))
def burn_history_after_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = live.burn_history(b.events(spark, sf_dir), b.pricing(spark), EARLY)
    return h.select("sample", F.date_format("end_ts", "HH:mm").alias("end_time"), F.round("cost_usd_per_hour", 9).alias("cost_usd_per_hour"))


@query("burn_by_model", window_sql("2024-01-15 12:10:00", "TIMESTAMP '2024-01-15 11:10:00'", f"""
, l AS (SELECT model || CASE WHEN is_fallback THEN ' (fallback)' ELSE '' END AS label, {', '.join(COUNTERS)}, round({_COST}, 9) AS cost_usd FROM m JOIN prices USING (model)
  WHERE input > 0 OR cached_input > 0 OR output > 0 OR reasoning_output > 0 OR total > 0)
{' UNION ALL '.join(f"SELECT label, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM l" for c in (*COUNTERS, "cost_usd"))}"""))
def burn_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.burn_by_model(b.events(spark, sf_dir), b.pricing(spark), NOON).withColumns(money("value"))


_U = "(1 + abs(value) * 1000 * (event_id % 7 + 1) * power(10, event_id % 9))"


@query("short_numbers", f"""
WITH v AS (SELECT event_id, CAST(floor({_U}) AS BIGINT) AS n FROM events),
u AS (SELECT *, CASE WHEN n >= 999500000000 THEN 4 WHEN n >= 999500000 THEN 3 WHEN n >= 999500 THEN 2 WHEN n >= 1000 THEN 1 ELSE 0 END AS unit FROM v),
w AS (SELECT *, CAST(power(1000, unit) AS HUGEINT) AS d FROM u),
x AS (SELECT *, CASE WHEN n // d >= 100 THEN 0 WHEN n // d >= 10 THEN 1 ELSE 2 END AS p FROM w),
y AS (SELECT *, CAST(power(10, p) AS HUGEINT) AS s FROM x),
z AS (SELECT *, (greatest(n, d) * s + d // 2) // d AS r FROM y)
SELECT event_id, n, CASE WHEN unit = 0 THEN CAST(n AS VARCHAR) ELSE
  CASE WHEN p = 0 THEN CAST(r AS VARCHAR) ELSE regexp_replace(CAST(r // s AS VARCHAR) || '.' || lpad(CAST(r % s AS VARCHAR), p, '0'), '[.]?0+$', '') END
  || substr('KMBT', unit, 1) END AS short FROM z""")
def short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "events").select("event_id", F.floor(F.expr(_U)).cast("bigint").alias("n"))
    return rows.withColumn("short", formats.short_number(F.col("n")))


@query("countdown", """
WITH v AS (SELECT event_id, CAST(floor(abs(value) * 1000 * (event_id % 11)) AS BIGINT) AS s FROM events),
p AS (SELECT *, [x FOR x IN [CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd' END, CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || 'h' END,
  CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm' END, CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END] IF x IS NOT NULL] AS parts FROM v)
SELECT event_id, CASE WHEN s = 0 THEN '0s' ELSE array_to_string(parts[1:2], ' ') END AS left_text FROM p""")
def countdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(F.abs(F.col("value")) * 1000 * (F.col("event_id") % 11)).cast("bigint")
    return b.table(spark, sf_dir, "events").select("event_id", formats.countdown(seconds).alias("left_text"))


_URL_PATH = "regexp_replace(url, '^[a-z]+:/', '')"


@query("project_filter", f"SELECT page_id, {_URL_PATH} AS path FROM pages WHERE {_URL_PATH} = (SELECT min({_URL_PATH}) FROM pages) OR starts_with({_URL_PATH}, regexp_extract((SELECT min({_URL_PATH}) FROM pages), '^(/[^/]*)', 1) || '/')")
def project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below the first component of the least path."""
    rows = b.table(spark, sf_dir, "pages").select("page_id", F.expr(_URL_PATH).alias("path"))
    least = rows.agg(F.min("path").alias("least")).first()[0] or "/"
    root = "/" + least.lstrip("/").split("/")[0]
    # the path is compared in normal form, dots and doubled slashes resolved
    return rows.where(formats.inside(formats.normal_path(F.concat(F.col("path"), F.lit("/./x/.."))), F.lit(root)))


@query("split_session_id", f"SELECT page_id, regexp_extract({_URL_PATH}, '^(.*)/[^/]*$', 1) AS directory, regexp_extract({_URL_PATH}, '([^/]*)$', 1) AS leaf FROM pages")
def split_session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(_URL_PATH)
    return b.table(spark, sf_dir, "pages").select("page_id", formats.directory_of(path).alias("directory"), formats.leaf_of(path).alias("leaf"))


_LINES_SQL = """
WITH k AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events),
c AS (SELECT *, CASE k % 6 WHEN 0 THEN k WHEN 5 THEN 0 ELSE 0 END AS input,
  CASE WHEN k % 4 = 0 THEN k WHEN k % 4 = 1 THEN k + 1 WHEN k % 4 = 2 THEN k + 1 ELSE 0 END AS cached FROM k)
SELECT event_id, CAST(input AS BIGINT) AS input, CAST(cached AS BIGINT) AS cached FROM c"""


@query("lossy_counters", _LINES_SQL)
def lossy_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of log lines built from events: text, fractions, negatives, booleans and containers count as nothing."""
    from meterloom.functions import parse

    k = F.get_json_object("props", "$.k").cast("bigint")
    as_text = k.cast("string")
    forms = F.array(as_text, F.concat(F.lit('"'), as_text, F.lit('"')), F.concat(as_text, F.lit(".5")), F.lit("true"), F.lit("[1]"), F.lit("-3"))
    cached = F.array(as_text, F.lit("null"), F.lit("-1"), F.lit('"9"'))
    other = F.array(F.lit("7"), (k + 1).cast("string"), (k + 1).cast("string"), F.lit("{}"))
    at = lambda a, n: F.element_at(a, (k % n + 1).cast("int"))
    line = F.concat(
        F.lit('{"timestamp":"2025-01-01T00:00:00Z","type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":'), at(forms, 6),
        F.lit(',"cached_input_tokens":'), at(cached, 4), F.lit(',"cache_read_input_tokens":'), at(other, 4), F.lit("}}}}"),
    )
    lines = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("session_id"), F.lit(0).alias("seq"), line.alias("value"))
    return parse.records(lines).select(F.col("session_id").alias("event_id"), "last.input", F.col("last.cached_input").alias("cached"))


@query("model_coalesce", """
WITH k AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k % 2 = 0 THEN event_type WHEN k % 3 = 0 THEN event_type || '-b' WHEN k % 5 = 0 THEN event_type || '-c' END AS model FROM k""")
def model_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first model name that is text and not blank, over the places it may stand in."""
    from meterloom.functions import parse

    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    quoted = lambda ok, x: F.when(ok, F.concat(F.lit('" '), x, F.lit(' "'))).otherwise(F.lit('"  "'))
    line = F.concat(
        F.lit('{"type":"turn_context","payload":{"info":{"model":7,"model_name":'), quoted(k % 2 == 0, kind), F.lit('},"model":'), quoted(k % 3 == 0, F.concat(kind, F.lit("-b"))),
        F.lit(',"model_name":null,"metadata":{"model":'), quoted(k % 5 == 0, F.concat(kind, F.lit("-c"))), F.lit("}}}"),
    )
    lines = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("session_id"), F.lit(0).alias("seq"), line.alias("value"))
    return parse.records(lines).select(F.col("session_id").alias("event_id"), "model")


def manifest(files: DataFrame) -> DataFrame:
    """A manifest bound to files: some sessions unknown, some moved, shorter, changed or of another parser."""
    n = F.substring("session_id", 2, 20).cast("bigint")
    rows = files.where(n % 7 != 0)
    return rows.select(
        "session_id", F.when(n % 11 == 0, F.concat(F.lit("old/"), F.col("path"))).otherwise(F.col("path")).alias("path"), "compressed",
        F.when(n % 3 == 0, F.greatest(F.col("bytes") - 10, F.lit(0))).when(n % 13 == 0, F.col("bytes") + 5).otherwise(F.col("bytes")).alias("bytes"), "mtime",
        F.lit(0).cast("bigint").alias("parsed_bytes"), F.when(n % 17 == 0, 0).otherwise(1).alias("parser_version"), (n % 19 != 0).alias("is_valid"),
    )


@query("incremental_plan", _PREFERRED + """,
n AS (SELECT session_id, arg_max(bytes, k) AS bytes, arg_max(compressed, k) AS compressed, CAST(substr(session_id, 2) AS BIGINT) AS n FROM s GROUP BY session_id)
SELECT session_id, CASE WHEN n % 7 = 0 OR n % 11 = 0 OR n % 17 = 0 OR n % 19 = 0 THEN 'rebuild'
  WHEN n % 3 = 0 THEN CASE WHEN bytes = 0 THEN 'cached' WHEN compressed THEN 'rebuild' ELSE 'append' END WHEN n % 13 = 0 THEN 'rebuild' ELSE 'cached' END AS action FROM n""")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = inventory.preferred_files(b.files(spark, sf_dir))
    return inventory.refresh_plan(best, manifest(best)).select("session_id", "action")


@query("stored_daily", grouped_sql(DAY))
def stored_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily report over a store of sums: log lines of all sessions up to a day are parsed into it, then it is refreshed
    with what the files gained since, which continues from the stored states."""
    from meterloom.operators import incremental
    from meterloom.session import kept_table, shared_dir

    # lines stand for files on disk, so they are made once
    store, lines = f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}", kept_table(b.lines(spark, sf_dir))
    for known in (lines.where("ts < '2024-01-15'"), lines):
        incremental.refresh(spark, known, b.files_of(known), store, parts=b.LineParts(known))
    return flat(incremental.stored_report(spark, "daily", store, b.pricing(spark)), "date")


@query("incremental_merge", grouped_sql(DAY))
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily report from sums by session and day: those of half the sessions stored, the rest new."""
    from meterloom.operators.incremental import day_sums

    events, options = b.events(spark, sf_dir), ReportOptions()
    old = F.pmod(F.xxhash64("session_id"), F.lit(2)) == 0
    both = day_sums(events.where(old), "UTC").unionByName(day_sums(events.where(~old), "UTC"))
    return flat(reports.by_key(reports.priced(reports.regroup(both, "local_day"), b.pricing(spark), options), "local_day"), "local_day")


@query("limit_windows", """
WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events),
w AS (SELECT event_id, k, greatest(0, least(100, CAST(k * 3 - 20 AS DOUBLE))) AS used FROM k)
SELECT event_id, CASE WHEN k % 5 = 3 THEN 'no_limit_data' WHEN k % 5 = 4 THEN 'malformed' ELSE 'available' END AS status,
  CASE WHEN k % 5 IN (0, 1, 2) THEN used END AS five_used, CASE WHEN k % 5 = 0 THEN 300 WHEN k % 5 = 1 THEN 300 END AS five_minutes,
  CASE WHEN k % 5 = 1 THEN CAST(12.5 AS DOUBLE) WHEN k % 5 = 2 THEN CAST(7 AS DOUBLE) END AS week_used FROM w""")
def limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-limit windows of payloads built from events, in both schemas and both spellings."""
    from meterloom.operators.limits import limit_windows as windows

    k = F.get_json_object("props", "$.k").cast("bigint")
    used = (k * 3 - 20).cast("string")
    shapes = F.array(
        F.concat(F.lit('{"rate_limits":{"limit_id":"codex","primary":{"used_percent":'), used, F.lit(',"window_duration_mins":300}}}')),
        F.concat(F.lit('{"rateLimitsByLimitId":{"x":{"limitId":"codex","primary":{"usedPercent":'), used, F.lit(',"windowDurationMins":300},"secondary":{"usedPercent":12.5,"windowDurationMins":10080}}}}')),
        F.concat(F.lit('{"rate_limit":{"primary_window":{"used_percent":'), used, F.lit('}},"additional_rate_limits":[{"limit_name":"other","rate_limit":{"primary_window":{"used_percent":1}}},{"limit_name":"codex","rate_limit":{"primary_window":{"used_percent":7,"limit_window_seconds":604741}}}]}')),
        F.lit('{"rate_limits":{"limit_id":"other","primary":{"used_percent":1}}}'), F.lit("{broken"),
    )
    rows = b.table(spark, sf_dir, "events").select("event_id", F.element_at(shapes, (k % 5 + 1).cast("int")).alias("payload"))
    return windows(rows).select("event_id", "status", F.col("five_hour.used_percent").alias("five_used"), F.col("five_hour.window_minutes").cast("int").alias("five_minutes"), F.col("weekly.used_percent").alias("week_used"))
