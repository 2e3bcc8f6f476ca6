"""Prices: ingest, snapshots, lookup by ordered candidates, and the cost formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.schemas import PRICING

# Built-in prices in USD per million tokens, aliases, provider prefixes.
BUILT_IN = [("gpt-5", 1.25, 0.125, 10.0), ("gpt-5-codex", 1.25, 0.125, 10.0), ("gpt-5.2-codex", 1.25, 0.125, 10.0)]
ALIASES = {"gpt-5-codex": "gpt-5", "gpt-5.3-codex": "gpt-5.2-codex"}
PROVIDER_PREFIXES = ("openrouter/openai/", "openai/", "azure/")
COSTS = ("input_cost_per_mtoken", "cached_input_cost_per_mtoken", "output_cost_per_mtoken")


def built_in_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILT_IN, PRICING)


def prices_from_list(documents: DataFrame, column: str = "value") -> DataFrame:
    """Price rows of JSON objects {model: {input_cost_per_token, ...}}: entries that are no objects or cost nothing go,
    the cached price falls back to the input price, and prices become those of a million tokens."""
    entries = documents.select(F.explode(F.from_json(column, "map<string,string>")).alias("model", "entry"))
    cost = F.from_json("entry", "struct<input_cost_per_token:double,output_cost_per_token:double,cache_read_input_token_cost:double>")
    rows = entries.where(F.trim("entry").startswith("{")).select("model", cost.alias("c"))
    zero = F.lit(0.0)
    rows = rows.select("model", F.coalesce("c.input_cost_per_token", zero).alias("i"), F.coalesce("c.cache_read_input_token_cost", "c.input_cost_per_token", zero).alias("k"), F.coalesce("c.output_cost_per_token", zero).alias("o"))
    return rows.where("i <> 0 OR k <> 0 OR o <> 0").select("model", *[(F.col(a) * 1_000_000).alias(b) for a, b in zip("iko", COSTS, strict=True)])


def merged_prices(snapshot: DataFrame, fallback: DataFrame) -> DataFrame:
    """Prices of snapshot, and those of fallback for models that it lacks."""
    a, b = snapshot.select("model", F.struct(*COSTS).alias("a")), fallback.select("model", F.struct(*COSTS).alias("b"))
    return a.join(b, "model", "full_outer").select("model", F.coalesce("a", "b").alias("p")).select("model", "p.*")


def save_snapshot(prices: DataFrame, path: str, refreshed_at: int) -> None:
    """Add a refresh to the snapshots at path. Earlier ones stay, so readers see the old prices or the new, never none."""
    prices.withColumn("refreshed_at", F.lit(refreshed_at).cast("bigint")).write.mode("append").parquet(path)


def stored_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All refreshes at path, none where there is no such folder."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"{PRICING}, refreshed_at bigint"
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def latest_snapshot(snapshots: DataFrame, now: int, ttl_seconds: int = 86_400) -> DataFrame:
    """The rows of the latest refresh, with is_stale where it is older than ttl_seconds; one from the future is fresh."""
    newest = snapshots.agg(F.max("refreshed_at").alias("refreshed_at"))
    stale = (F.lit(now) - F.col("refreshed_at") > ttl_seconds) | (F.col("refreshed_at") < 0)
    return snapshots.join(newest, "refreshed_at").withColumn("is_stale", stale)


def refresh_is_due(snapshots: DataFrame, now: int, ttl_seconds: int = 86_400, offline: bool = False, forced: bool = False) -> bool:
    """Whether prices should be fetched anew: never offline, else always if forced, without a snapshot or with a stale one."""
    if offline or forced:
        return not offline
    first = latest_snapshot(snapshots, now, ttl_seconds).select("is_stale").first()
    return first is None or first[0]


def _prefix(model: Column) -> Column:
    out = F.lit(None).cast("string")
    for p in reversed(PROVIDER_PREFIXES):
        out = F.when(model.startswith(p), F.lit(p)).otherwise(out)
    return out


def candidates(model: Column) -> Column:
    """Names to look a model up by, in order: itself, its alias, without provider prefix, and with each prefix."""
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    prefix = _prefix(model)
    base = F.when(prefix.isNotNull(), F.substring(model, F.length(prefix) + 1, F.length(model)))
    base_alias = F.try_element_at(alias, base)
    direct = F.array_compact(F.array(model, F.try_element_at(alias, model), base, F.concat(prefix, base_alias), base_alias))
    plain = F.filter(direct, lambda m: _prefix(m).isNull())
    more = F.flatten(F.transform(plain, lambda m: F.array(F.concat(F.lit("openai/"), m), F.concat(F.lit("azure/"), m), F.concat(F.lit("openrouter/openai/"), m))))
    return F.array_distinct(F.concat(direct, more))


def is_free_route(model: Column) -> Column:
    lower = F.lower(F.trim(model))
    return (lower == "openrouter/free") | (lower.startswith("openrouter/") & lower.endswith(":free"))


def _root(model: Column) -> Column:
    """A name without all its provider prefixes; the candidates of a model have its root or the alias of that."""
    return F.regexp_replace(model, "^(?:" + "|".join(PROVIDER_PREFIXES) + ")+", "")


def with_prices(rows: DataFrame, pricing: DataFrame) -> DataFrame:
    """rows with the three costs of their model: the price of the first candidate that has one, else 0.

    Rows are used once: the price list is grouped by root name, a few names each, and joins on the model's root and on
    the alias of it.
    """
    named = pricing.groupBy("model").agg(F.min(F.struct(*COSTS)).alias("p"))
    listed = named.groupBy(_root(F.col("model")).alias("_root")).agg(F.map_from_entries(F.collect_list(F.struct("model", "p"))).alias("_names"))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    model = F.trim("model")
    met = rows.withColumns({"_own": _root(model), "_alias": F.try_element_at(alias, _root(model))})
    met = met.join(listed.toDF("_own", "_own_names"), "_own", "left").join(listed.toDF("_alias", "_alias_names"), "_alias", "left")
    price_of = lambda name: F.coalesce(F.try_element_at("_own_names", name), F.try_element_at("_alias_names", name))
    found = F.get(F.filter(F.transform(candidates(model), price_of), lambda p: p.isNotNull()), 0)
    price = lambda c: F.when(is_free_route(F.col("model")), 0.0).otherwise(F.coalesce(F.col("_price")[c], F.lit(0.0)))
    return met.withColumn("_price", found).select(*rows.columns, *[price(c).alias(c) for c in COSTS])


def resolved_prices(models: DataFrame, pricing: DataFrame) -> DataFrame:
    """(model, three costs) for every distinct model of models."""
    return with_prices(models.select("model").distinct(), pricing)


def cost(input_: Column, cached: Column, output: Column, cached_is_free: bool = False) -> Column:
    """USD of counters under the price columns of the same row; cached input is at most the input."""
    cached = F.least(cached, input_)
    paid = (input_ - cached) * F.col(COSTS[0]) + output * F.col(COSTS[2])
    return (paid if cached_is_free else paid + cached * F.col(COSTS[1])) / 1_000_000
