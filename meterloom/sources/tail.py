"""A stream of the lines that are appended to log files.

Spark's own file stream ignores text that is added to a file it has seen. This source keeps, for each file, how many bytes
were read and a digest of their first and last 4 KiB; each micro-batch reads the new byte ranges, one partition a file, up
to the last whole line. A file that shrank or whose start changed is read anew, its lines with reset set, after a row
without text that says so. Offsets count the ticks as well, so that time goes on in batches without lines. Files must lie
on a file system that the driver and the executors mount alike.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from meterloom.sources.ranges import first_text, lines_between, prefix_digest, whole_lines


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int
    reset: bool


def unchanged(path: str, size: int, done: int, digest: str) -> bool:
    """Whether the first done bytes, of which digest is kept, are still there."""
    return done == 0 or (size >= done and prefix_digest(path, done) == digest)


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root
        self.seen: dict[str, list] = {}
        self.tick = time.time_ns()

    def initialOffset(self) -> dict:
        return {"files": {}, "tick": 0}

    def latestOffset(self) -> dict:
        found: dict[str, list] = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                path = os.path.join(folder, name)
                if not name.lower().endswith(".jsonl") or os.path.islink(path):
                    continue
                size = os.path.getsize(path)
                done, digest = self.seen.get(path, [0, ""])
                end = whole_lines(path, size, done if unchanged(path, size, done, digest) else 0)
                found[path] = [end, prefix_digest(path, end)]
        self.seen = found
        self.tick += 1
        return {"files": found, "tick": self.tick}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, (stop, _) in end["files"].items():
            done, digest = start["files"].get(path, [0, ""])
            same = unchanged(path, stop, done, digest)
            if stop > done or not same:
                out.append(FileRange(path, done if same else 0, stop, not same))
        return out

    def read(self, partition: FileRange) -> Iterator[tuple]:
        session = os.path.splitext(os.path.relpath(partition.path, self.root))[0]
        first = first_text(partition.path)
        if partition.reset:
            yield session, -1, "", False, True
        for at, line in lines_between(partition.path, partition.start, partition.end, partition.start, partition.end):
            yield session, at, line.decode("utf-8", "replace").rstrip("\r\n"), at <= first < at + len(line), partition.reset


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "session_id string, seq bigint, value string, head boolean, reset boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["path"])
