"""Which log files stand for a session, and what has to be read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What tells one file object from another, where the file system says so.
IDENTITY = ("dev", "ino", "ctime_ns")


def plain_over_compressed(files: DataFrame) -> DataFrame:
    """Files without compressed ones that have a plain sibling in the same root."""
    plain = files.where(~F.col("compressed")).select("root_ord", "session_id").distinct()
    kept = files.where("compressed").join(plain, ["root_ord", "session_id"], "left_anti")
    return files.where(~F.col("compressed")).unionByName(kept.select(*files.columns))


def _preferred(a: Column, b: Column) -> Column:
    """Whether file b takes the place of a: a newer one where either is compressed; else more bytes, newer, greater path."""
    mixed = (a["compressed"] | b["compressed"]) & (a["mtime"] != b["mtime"])
    key = lambda x: F.struct(x["bytes"], x["mtime"], x["path"])
    return F.when(mixed, b["mtime"] > a["mtime"]).otherwise(key(b) > key(a))


def preferred_files(files: DataFrame) -> DataFrame:
    """One file of each session. The preference isn't transitive in mixed sets, so they are folded in root order.

    Sessions of plain files alone, nearly all of any store, take one max_by; only mixed sessions gather their few files.
    """
    key = F.struct("bytes", "mtime", "path")
    file = F.struct("root_ord", "path", "compressed", "bytes", "mtime", *[c for c in IDENTITY if c in files.columns])
    mixed = files.groupBy("session_id").agg(F.bool_or("compressed").alias("mixed"), F.max_by(file, key).alias("best"))
    simple = mixed.where(~F.col("mixed")).select("session_id", "best.*")
    sets = files.join(mixed.where("mixed").select("session_id"), "session_id").groupBy("session_id").agg(F.array_sort(F.collect_list(file)).alias("all"))
    fold = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), lambda a, b: F.when(_preferred(a, b), b).otherwise(a))
    return simple.unionByName(sets.select("session_id", fold.alias("best")).select("session_id", "best.*"))


def refresh_plan(files: DataFrame, manifest: DataFrame, parser_version: int = 1) -> DataFrame:
    """files with action: cached (nothing changed), append (a plain file of the same path grew), rebuild, or removed
    for sessions of the manifest that are gone.

    manifest: session_id, path, compressed, bytes, mtime, parsed_bytes, parser_version, is_valid; where both tables have
    IDENTITY, a file with another change time isn't cached, and only the same file object is appended to.
    """
    old = manifest.select("session_id", F.struct(*[c for c in manifest.columns if c != "session_id"]).alias("old"))
    rows = files.join(old, "session_id", "full_outer")
    told = set(IDENTITY) <= set(files.columns) & set(manifest.columns)
    kept = lambda *names: F.coalesce(reduce(Column.__and__, [F.col(f"old.{c}") == F.col(c) for c in names]), F.lit(True)) if told else F.lit(True)
    same = (F.col("old.bytes") == F.col("bytes")) & (F.col("old.mtime") == F.col("mtime")) & (F.col("old.compressed") == F.col("compressed")) & kept(*IDENTITY)
    compatible = (F.col("old.path") == F.col("path")) & (F.col("old.parser_version") == parser_version)
    grows = ~F.col("compressed") & ~F.col("old.compressed") & (F.col("bytes") > F.col("old.bytes")) & (F.col("old.parsed_bytes") <= F.col("old.bytes")) & kept("dev", "ino")
    action = (
        F.when(F.col("path").isNull(), "removed").when(F.col("old").isNull() | ~compatible | ~F.col("old.is_valid"), "rebuild").when(same, "cached").when(grows, "append").otherwise("rebuild")
    )
    return rows.withColumn("action", action)
