"""How far an action is: finished tasks of its jobs against those that are known."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

Say = Callable[[float, str], None]
Result = TypeVar("Result")


def followed(spark: SparkSession, work: Callable[[], Result], say: Say, message: str, start: float = 0.0, end: float = 100.0, every: float = 0.2) -> Result:
    """Do ``work`` in a job group of its own and tell ``say`` from time to time which part of its tasks has finished, as a percentage between ``start`` and ``end``.

    Percentages never fall: stages that only become known on the way make it stand still. ``end`` is told when the work is done, and not if it fails.
    """
    context, group, over = spark.sparkContext, f"rowdelta-{uuid.uuid4().hex}", threading.Event()
    tracker, reached = context.statusTracker(), 0.0

    def look() -> None:
        nonlocal reached
        while not over.wait(every):
            jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if j]
            stages = [s for s in map(tracker.getStageInfo, {s for j in jobs for s in j.stageIds}) if s]
            tasks = sum(s.numTasks for s in stages)
            share = sum(s.numCompletedTasks for s in stages) / tasks if tasks else 0.0
            if share > reached and not over.is_set():
                reached = share
                say(start + (end - start) * min(reached, 0.99), message)

    watch = threading.Thread(target=look, daemon=True)
    before = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")
    context.setJobGroup(group, message)
    watch.start()
    try:
        out = work()
    finally:
        over.set()
        watch.join()
        context.setLocalProperty("spark.jobGroup.id", before[0])
        context.setLocalProperty("spark.job.description", before[1])
    say(end, message)
    return out
