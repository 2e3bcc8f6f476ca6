"""Spawned sessions and their root ancestors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.session import checkpointed


def session_by_thread(descriptors: DataFrame) -> DataFrame:
    """(thread_id, session_id): of sessions with the same thread the last in id order."""
    return descriptors.where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.max("session_id").alias("session_id"))


def parents(descriptors: DataFrame) -> DataFrame:
    """(session_id, parent) for every session whose parent thread is among the sessions; parent is null for the rest."""
    threads = session_by_thread(descriptors).select(F.col("thread_id").alias("parent_thread_id"), F.col("session_id").alias("parent"))
    return descriptors.select("session_id", "parent_thread_id").join(threads, "parent_thread_id", "left").select("session_id", "parent")


def root_sessions(descriptors: DataFrame) -> DataFrame:
    """(session_id, root_id): the highest ancestor among the sessions, or the session itself on a path with a cycle.

    Pointers double in each round, so paths of n sessions need log2 n rounds. What still points somewhere after them runs
    into a cycle. Each round is checkpointed in the shared folder.
    """
    links = checkpointed(parents(descriptors))
    n = links.count()
    # state: at, an ancestor that was reached; ahead, the parent of it (null at the top)
    state = links.select("session_id", F.col("session_id").alias("at"), F.col("parent").alias("ahead"))
    for _ in range(math.ceil(math.log2(max(n, 2))) + 1):
        if state.where("ahead IS NOT NULL").isEmpty():
            break
        hop = state.select(F.col("session_id").alias("ahead"), F.col("at").alias("far"), F.col("ahead").alias("further"))
        moved = F.when(F.col("ahead").isNull(), F.col("at")).otherwise(F.col("far")).alias("at")
        state = checkpointed(state.join(hop, "ahead", "left").select("session_id", moved, F.when(F.col("ahead").isNotNull(), F.col("further")).alias("ahead")))
    return state.select("session_id", F.when(F.col("ahead").isNull(), F.col("at")).otherwise(F.col("session_id")).alias("root_id"))
