"""Log files under several roots as tables of files and of lines."""

from __future__ import annotations

import posixpath
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions.formats import inside, normal_path
from meterloom.functions.parse import descriptors
from meterloom.operators.inventory import IDENTITY, plain_over_compressed, preferred_files
from meterloom.sources import ranges

NAME = r"(?i)\.jsonl(\.zst)?$"
LINES = "session_id string, root_ord int, path string, seq struct<block_start:bigint,line:bigint>, value string"
FILES = "session_id string, root_ord int, path string, compressed boolean, bytes bigint, mtime timestamp, dev bigint, ino bigint, ctime_ns bigint"


def missing_roots(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots that are no directories; any other failure to look at one is raised."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(conf)
        if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
            out.append(root)
    return out


def _shown(root: str) -> str:
    return posixpath.normpath("/" + root.split("://")[-1].split(":", 1)[-1].strip("/"))


def _plain(path: Column) -> Column:
    """A path without its scheme."""
    return F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")


def _named(path: Column, root: str) -> tuple[Column, Column]:
    """(session id, whether the file is compressed) of paths below root."""
    relative, compressed = F.substring(path, len(_shown(root)) + 2, 1 << 30), F.lower(path).endswith(".zst")
    plain = F.when(compressed, F.regexp_replace(relative, r"(?i)\.zst$", "")).otherwise(relative)
    return F.regexp_replace(plain, r"\.jsonl$", ""), compressed


def _present(spark: SparkSession, roots: list[str]) -> list[tuple[int, str]]:
    gone = set(missing_roots(spark, roots))
    return [(order, root) for order, root in enumerate(roots) if root not in gone]


def _reader(spark: SparkSession, modified_after: str | None):
    reader = spark.read.option("recursiveFileLookup", True)
    return reader.option("modifiedAfter", modified_after) if modified_after else reader


def _empty(spark: SparkSession, found: DataFrame, sized: DataFrame) -> DataFrame:
    """(path, length, modificationTime) of the files that Spark lists but, as they are empty, doesn't read."""
    names = [(n,) for n in found.inputFiles() if re.search(NAME, n)]
    listed = spark.createDataFrame(names, "uri string").withColumn("path", _plain(F.url_decode(F.regexp_replace("uri", r"\+", "%2B"))))
    rows, conf = [], spark.sparkContext._jsc.hadoopConfiguration()
    for r in listed.join(sized, "path", "left_anti").collect():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(r["uri"]))
        rows.append((r["path"], 0, path.getFileSystem(conf).getFileStatus(path).getModificationTime()))
    return spark.createDataFrame(rows, "path string, length bigint, millis bigint").select("path", "length", F.timestamp_millis("millis").alias("modificationTime"))


def _local(root: str) -> str:
    """The path of a root on a mounted file system."""
    return _shown(root)


def inventory(spark: SparkSession, roots: list[str], modified_after: str | None = None) -> DataFrame:
    """(session_id, root_ord, path, compressed, bytes, mtime, dev, ino, ctime_ns) of all log files below the roots that
    exist, empty ones too. Only what the file system says about them is read; modified_after (a timestamp) leaves older
    files out. Tasks list the roots that can be opened by path; of others Spark lists the files, and identities are null."""
    parts, near = [], []
    for order, root in _present(spark, roots):
        if ranges.mounted(spark, root):
            near.append((order, root))
            continue
        found = _reader(spark, modified_after).format("binaryFile").load(root)
        sized = found.select(_plain(F.col("path")).alias("path"), "length", "modificationTime")
        session, compressed = _named(F.col("path"), root)
        none = [F.lit(None).cast("bigint").alias(c) for c in IDENTITY]
        parts.append(sized.unionByName(_empty(spark, found, sized)).where(F.col("path").rlike(NAME)).select(
            session.alias("session_id"), F.lit(order).alias("root_ord"), "path", compressed.alias("compressed"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), *none,
        ))
    if near:
        listed = ranges.listing(spark, [(order, _local(root)) for order, root in near]).where(F.col("path").rlike(NAME))
        listed = listed.where(F.col("mtime") > F.lit(modified_after).cast("timestamp")) if modified_after else listed
        named = {order: _named(F.col("path"), root) for order, root in near}
        pick = lambda i: F.coalesce(*[F.when(F.col("root_ord") == order, columns[i]) for order, columns in named.items()])
        parts.append(listed.select(pick(0).alias("session_id"), "root_ord", "path", pick(1).alias("compressed"), "bytes", "mtime", *IDENTITY))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FILES)


def lines(spark: SparkSession, roots: list[str], modified_after: str | None = None) -> DataFrame:
    """Lines of all log files below the roots that exist, with session_id, root_ord, path, seq (file order) and value.
    Names are matched in any case; .zst files are decoded by Spark."""
    parts = []
    for order, root in _present(spark, roots):
        m = F.col("_metadata")
        path = _plain(F.url_decode(F.regexp_replace(m["file_path"], r"\+", "%2B")))
        seq = F.struct(m["file_block_start"].alias("block_start"), F.monotonically_increasing_id().alias("line")).alias("seq")
        rows = _reader(spark, modified_after).text(root).select(path.alias("path"), seq, "value").where(F.col("path").rlike(NAME))
        parts.append(rows.select(_named(F.col("path"), root)[0].alias("session_id"), F.lit(order).alias("root_ord"), "path", "seq", "value"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LINES)


def within_project(files: DataFrame, heads: DataFrame, project: str) -> DataFrame:
    """Files whose first line (heads: path, seq, value) names a working directory inside project; others, and those
    without one, go."""
    named = descriptors(heads.select(F.col("path").alias("session_id"), "seq", "value")).where("cwd IS NOT NULL")
    root = normal_path(F.lit(project))
    near = named.where(inside(normal_path(F.col("cwd")), root)).select(F.col("session_id").alias("path"))
    return files.join(near, "path", "left_semi")


def selected_files(spark: SparkSession, roots: list[str], project: str | None = None, modified_after: str | None = None) -> DataFrame:
    """One file for each session: plain over compressed in a root, then inside the project, then the preferred copy across
    roots."""
    files = plain_over_compressed(inventory(spark, roots, modified_after))
    if project and all(ranges.mounted(spark, root) for root in roots):
        files = within_project(files, ranges.first_lines(files).withColumn("seq", F.lit(0)), project)  # bodies are not read
    elif project:
        files = within_project(files, lines(spark, roots, modified_after), project)
    return preferred_files(files)


def selected_lines(spark: SparkSession, roots: list[str], project: str | None = None, files: DataFrame | None = None, modified_after: str | None = None) -> DataFrame:
    """Lines of the selected files."""
    files = selected_files(spark, roots, project, modified_after) if files is None else files
    return lines(spark, roots, modified_after).join(files.select("path"), "path", "left_semi")


def find_session(files: DataFrame, session_id: str) -> DataFrame:
    """The preferred file of one session."""
    return preferred_files(plain_over_compressed(files.where(F.col("session_id") == session_id)))
