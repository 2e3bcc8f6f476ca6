"""Parts of log files: byte ranges as lines, first records, and what identifies a file that was read up to some byte.

The files stand in a table (path, ...) and tasks open them, so nothing is listed or read on the driver. They must be plain
and lie on a file system that all machines mount alike (see mounted); others are read whole by Spark's own readers.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE, PIECE, CHUNK = 4096, 64 << 20, 4 << 20
BLANKS = b" \t\r\n\f"
LINES = "session_id string, path string, seq struct<block_start:bigint,line:bigint>, value string, head boolean"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mounted(spark: SparkSession, root: str) -> bool:
    """Whether files below root can be opened by path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def prefix_digest(path: str, offset: int) -> str:
    """A hash of the length, the first and the last SAMPLE bytes of the first offset bytes."""
    with open(path, "rb") as f:
        head = f.read(min(offset, SAMPLE))
        f.seek(max(0, offset - SAMPLE))
        tail = f.read(min(offset, SAMPLE))
    return hashlib.sha256(b"%d:" % offset + head + b"|" + tail).hexdigest()


def whole_lines(path: str, size: int, floor: int = 0) -> int:
    """The end of the last whole line among the first size bytes, floor if none ends after it. Text after the last line
    break is a line too if it is JSON: then the end is size."""
    rest = b""
    with open(path, "rb") as f:
        end = size
        while end > floor:
            start = max(floor, end - (1 << 16))
            f.seek(start)
            part = f.read(end - start)
            at = part.rfind(b"\n")
            rest = part[at + 1 :] + rest
            if at >= 0:
                floor = start + at + 1
                break
            end = start
    if not rest.strip(BLANKS):
        return floor
    try:
        json.loads(rest)
    except ValueError:
        return floor
    return size


def first_text(path: str) -> int:
    """Where the first byte that isn't blank lies."""
    with open(path, "rb") as f:
        at = 0
        while part := f.read(SAMPLE):
            if text := part.lstrip(BLANKS):
                return at + len(part) - len(text)
            at += len(part)
    return at


def lines_between(path: str, start: int, end: int, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines of the range from start to end that begin in its part from low to high."""
    with open(path, "rb") as f:
        at = max(start, low - 1) if low > start else low
        f.seek(at)
        if low > start:
            at += len(f.readline(end - at))
        while at < high and at < end:
            line = f.readline(end - at)
            if not line:
                return
            yield at, line
            at += len(line)


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has; small rows may stand for large files, so they aren't coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def range_lines(ranges: DataFrame) -> DataFrame:
    """Lines (LINES) of byte ranges (session_id, path, start, end) of files; ranges begin and end where lines do. seq is
    the offset in the file, head marks the first line of a file that isn't blank. Large ranges are cut into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(row: dict, found: list[tuple[int, bytes]], first: int) -> pa.RecordBatch:
            seq = pa.StructArray.from_arrays([pa.array([at for at, _ in found], pa.int64()), pa.array([0] * len(found), pa.int64())], ["block_start", "line"])
            # text columns take any bytes, as those of Spark's own reader do
            value = pa.array([line.rstrip(b"\r\n") for _, line in found], pa.binary()).view(pa.string())
            head = pa.array([at <= first < at + len(line) for at, line in found])
            return pa.RecordBatch.from_arrays([pa.array([row["session_id"]] * len(found), pa.string()), pa.array([row["path"]] * len(found), pa.string()), seq, value, head], ["session_id", "path", "seq", "value", "head"])

        for rows in batches:
            for row in rows.to_pylist():
                first, found, size = first_text(row["path"]), [], 0
                for at, line in lines_between(row["path"], row["start"], row["end"], row["low"], row["high"]):
                    found.append((at, line))
                    size += len(line)
                    if size > CHUNK:
                        yield batch(row, found, first)
                        found, size = [], 0
                if found:
                    yield batch(row, found, first)

    filled = ranges.where("end > start").select("session_id", "path", "start", "end", F.explode(F.sequence("start", F.col("end") - 1, F.lit(PIECE).cast("bigint"))).alias("low"))
    pieces = filled.withColumn("high", F.least(F.col("low") + PIECE, F.col("end")))
    return _spread(pieces, "path", "low").mapInArrow(run, LINES)


STATUS = "root_ord int, path string, bytes bigint, mtime timestamp, dev bigint, ino bigint, ctime_ns bigint"


def shown(name: str) -> bool:
    """Whether Spark's readers would read a file or folder of this name."""
    return not name.startswith((".", "_"))


def files_below(top: str) -> Iterator[str]:
    """Paths of all files below a folder, or top itself if it is a file; links are followed once."""
    if not os.path.isdir(top):
        yield top
        return
    seen = {os.path.realpath(top)}
    for folder, inner, names in os.walk(top, followlinks=True):
        fresh = [n for n in inner if shown(n) and os.path.realpath(os.path.join(folder, n)) not in seen]
        seen.update(os.path.realpath(os.path.join(folder, n)) for n in fresh)
        inner[:] = fresh
        yield from (os.path.join(folder, n) for n in names if shown(n))


def listing(spark: SparkSession, roots: list[tuple[int, str]]) -> DataFrame:
    """STATUS of all files below roots (ordinal, path) that can be opened by path. Folders of two levels are dealt to
    tasks, which walk what is below them; nothing is listed on the driver."""

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [(o, os.path.join(top, n)) for o, top in zip(rows.column("root_ord").to_pylist(), rows.column("top").to_pylist(), strict=True) for n in (os.listdir(top) if os.path.isdir(top) else [""]) if not n or shown(n)]
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in found], pa.int32()), pa.array([p.rstrip("/") for _, p in found], pa.string())], ["root_ord", "top"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for order, top in zip(rows.column("root_ord").to_pylist(), rows.column("top").to_pylist(), strict=True):
                found = []
                for path in files_below(top):
                    try:
                        s = os.stat(path)
                    except FileNotFoundError:
                        continue
                    found.append((order, path, s.st_size, s.st_mtime_ns // 1000, s.st_dev, s.st_ino, s.st_ctime_ns))
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], ["root_ord", "path", "bytes", "mtime", "dev", "ino", "ctime_ns"])

    tops = spark.createDataFrame([(o, os.path.normpath(r)) for o, r in roots], "root_ord int, top string")
    for _ in range(2):
        tops = _spread(tops, "top").mapInArrow(children, "root_ord int, top string")
    return _spread(tops, "top").mapInArrow(walk, STATUS)


def examined(files: DataFrame) -> DataFrame:
    """(path, end, digest, known) of files (path, bytes, parsed_bytes): the end of their last whole line, the digest of all
    before it, and that of the first parsed_bytes (null if those are null or beyond the end of the file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for row in rows.to_pylist():
                parsed = row["parsed_bytes"]
                known = None if parsed is None or parsed > row["bytes"] else prefix_digest(row["path"], parsed)
                end = whole_lines(row["path"], row["bytes"])
                out.append({"path": row["path"], "end": end, "digest": prefix_digest(row["path"], end), "known": known})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("end", pa.int64()), ("digest", pa.string()), ("known", pa.string())]))

    return _spread(files.select("path", "bytes", "parsed_bytes"), "path").mapInArrow(run, "path string, end bigint, digest string, known string")


def first_lines(files: DataFrame) -> DataFrame:
    """(path, value) of the first line that isn't blank of files (path, compressed); files without one have no row. Bodies
    are not read, of compressed files only the frames up to that line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for row in rows.to_pylist():
                with open(row["path"], "rb") as f:
                    source = f
                    if row["compressed"]:
                        import zstandard

                        source = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True))
                    line = next((text for line in source if (text := line.strip(BLANKS))), None)
                if line is not None:
                    out.append((row["path"], line))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([v for _, v in out], pa.binary()).view(pa.string())], ["path", "value"])

    return _spread(files.select("path", "compressed"), "path").mapInArrow(run, "path string, value string")
