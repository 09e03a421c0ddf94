"""Comparison of two datasets, and the result."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowdelta.operators.compare import flat_differences
from rowdelta.operators.content import align_headers, content_diff
from rowdelta.operators.keyed import keyed_diff
from rowdelta.options import KEY, DiffOptions
from rowdelta.plans.progress import followed
from rowdelta.plans.view import View
from rowdelta.sources.dataset import Dataset, from_table

#: Percent when the comparison is planned; the rest follows the tasks.
PLANNED = 30.0
STATUSES = ("added", "removed", "modified", "unchanged")


@dataclass
class Metrics:
    """Wall-clock seconds of stages on the driver."""

    seconds: dict[str, float] = field(default_factory=dict)

    def time(self, stage: str, work: Callable):
        began = time.perf_counter()
        try:
            return work()
        finally:
            self.seconds[stage] = self.seconds.get(stage, 0.0) + time.perf_counter() - began

    @property
    def total(self) -> float:
        return sum(self.seconds.values())


@dataclass(frozen=True)
class DiffResult:
    """One lazy DataFrame with all classified rows, and what is known about both sides without reading them."""

    rows: DataFrame
    source_headers: tuple[str, ...]
    target_headers: tuple[str, ...]
    options: DiffOptions
    metrics: Metrics = field(default_factory=Metrics)
    warnings: tuple[str, ...] = ()

    def of(self, status: str) -> DataFrame:
        return self.rows.where(F.col("status") == status)

    @property
    def added(self) -> DataFrame:
        return self.of("added").select("key", "target_row")

    @property
    def removed(self) -> DataFrame:
        return self.of("removed").select("key", "source_row")

    @property
    def modified(self) -> DataFrame:
        return self.of("modified").select("key", "source_row", "target_row", "differences")

    @property
    def unchanged(self) -> DataFrame:
        """An unchanged row is shown as the source has it."""
        return self.of("unchanged").select("key", F.col("source_row").alias("row"))

    def differences(self) -> DataFrame:
        return flat_differences(self.rows)

    def counts(self) -> dict[str, int]:
        """Rows of each status, 0 where there are none."""
        found = self.metrics.time("compare", lambda: {r["status"]: r["count"] for r in self.rows.groupBy("status").count().collect()})
        return {s: found.get(s, 0) for s in STATUSES}

    def write(self, path: str, progress: Callable[[float, str], None] | None = None) -> dict[str, int]:
        """Write the classified rows as Parquet and return the rows of each status, counted in the same pass. ``progress`` follows the finished tasks."""
        seen = Observation()
        kept = self.rows.observe(seen, *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES])
        work = lambda: self.metrics.time("compare", lambda: kept.write.mode("overwrite").parquet(path))
        followed(self.rows.sparkSession, work, progress or (lambda _percent, _message: None), "Comparing", PLANNED)
        return {s: seen.get[s] for s in STATUSES}

    def count_rows(self) -> DataFrame:
        """The counts as a table of one row."""
        return status_counts(self.rows)

    def view(self) -> View:
        return View(self.rows, self.source_headers, self.target_headers)


def status_counts(rows: DataFrame) -> DataFrame:
    of = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return rows.agg(*[of(s) for s in STATUSES], F.count(F.lit(1)).alias("total"))


def diff(source: Dataset | DataFrame, target: Dataset | DataFrame, options: DiffOptions | None = None, progress: Callable[[float, str], None] | None = None, **changes: object) -> DiffResult:
    """Compare two datasets (or tables) and classify every row as added, removed, modified or unchanged.

    Errors in keys are raised here, which takes a pass over the keys; everything else waits until the result is used. ``progress`` hears of the planning; the comparison
    itself tells how far it is in ``DiffResult.write``.
    """
    options = (options or DiffOptions()).but(**changes) if changes or options is None else options
    say = progress or (lambda _percent, _message: None)
    metrics = Metrics()
    say(0, "Reading source")
    source = metrics.time("source", lambda: source if isinstance(source, Dataset) else from_table(source))
    say(10, "Reading target")
    target = metrics.time("target", lambda: target if isinstance(target, Dataset) else from_table(target))
    say(20, "Planning")
    if options.mode == KEY:
        rows = metrics.time("plan", lambda: keyed_diff(source, target, options))
    else:
        target = align_headers(source, target)
        rows = metrics.time("plan", lambda: content_diff(source, target, options))
    say(PLANNED, "Planned")
    return DiffResult(rows, source.headers, target.headers, options, metrics, source.warnings + target.warnings)
