"""Comparison in chunks, and of a static source with a streaming target."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowdelta.operators.compare import S, T, alone, side, unified
from rowdelta.operators.content import align_headers, greedy_matches
from rowdelta.operators.keyed import check_all_unique, check_keys, check_unique, duplicate_error, key_of, keyed_pairs, one_sided
from rowdelta.options import KEY, DiffOptions, StreamingConfig
from rowdelta.plans.scratch import scratch, settled
from rowdelta.sources.csv_files import CsvStream
from rowdelta.sources.dataset import INDEX, KEY_COLUMN, Dataset, numbered
from rowdelta.sources.prepared import SeenKeys, discard, exists, prepare


@dataclass
class PartialResult:
    """Classified rows of the chunks so far; merging is associative."""

    rows: DataFrame | None = None
    processed: int = 0
    total: int = 0

    def merge(self, other: PartialResult) -> PartialResult:
        rows = other.rows if self.rows is None else self.rows if other.rows is None else self.rows.unionByName(other.rows)
        return PartialResult(rows, self.processed + other.processed, max(self.total, other.total))

    @property
    def progress(self) -> float:
        """Percent of rows processed; 100 if there are none."""
        return 100.0 * self.processed / self.total if self.total else 100.0


@dataclass
class Differ:
    """Both sides, prepared once, for comparison by ``chunk``.

    By key a chunk is a range of target rows and the last chunk also gives the removed rows; the source is written once, bucketed by key, and no chunk
    shuffles it. By content a chunk is a range of source
    rows, matched row by row with the target rows that earlier chunks left, and the last chunk gives the added rows. ``close``, or the end of a ``with`` block, gives up what was
    prepared; results have to be used before.
    """

    source: Dataset
    target: Dataset
    options: DiffOptions
    config: StreamingConfig = field(default_factory=StreamingConfig)
    progress: Callable[[float, str], None] | None = None

    def __post_init__(self) -> None:
        self._path: str | None = None
        if self.options.mode == KEY:
            check_keys(self.source, self.target, self.options)
            check_all_unique([(self.source, "source"), (self.target, "target")], self.options)
            self._path = scratch(self.source.df.sparkSession, "prepared")
            self.source = prepare(self.source, self.options, self._path)
        else:
            self.target = align_headers(self.source, self.target)
            self.source = replace(self.source, df=self.source.df.persist())
        self.target = replace(self.target, df=self.target.df.persist())
        self._free: Dataset = self.target
        self.total = (self.target if self.options.mode == KEY else self.source).df.count()

    def close(self) -> None:
        self.target.df.unpersist()
        if self._path:
            discard(self.source, self._path)
        else:
            self.source.df.unpersist()

    def __enter__(self) -> Differ:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def chunk(self, start: int, size: int) -> DataFrame:
        return self._key_chunk(start, size) if self.options.mode == KEY else self._content_chunk(start, size)

    def chunks(self) -> PartialResult:
        """All chunks, one after another, merged."""
        done = PartialResult(total=self.total)
        n = max(1, math.ceil(self.total / self.config.chunk_size))
        for k in range(n):
            start = k * self.config.chunk_size
            done = done.merge(PartialResult(self.chunk(start, self.config.chunk_size), min(self.config.chunk_size, self.total - start), self.total))
            if self.progress and self.config.enable_progress and (k % self.config.progress_interval == 0 or k == n - 1):
                self.progress(done.progress, f"Chunk {k + 1} of {n}")
        return done

    def _key_chunk(self, start: int, size: int) -> DataFrame:
        part = self.target.select_rows(start, start + size)
        pairs = keyed_pairs(self.source, part, self.options, "right")
        rows = unified(pairs, self.source, part, self.options, F.col("_key"), F.col("_status"))
        if start + size < self.total:
            return rows
        seen = self.target.df.select(key_of(self.target, self.options).alias("_k"))
        gone = replace(self.source, df=self.source.df.join(seen, key_of(self.source, self.options) == F.col("_k"), "left_anti"))
        return rows.unionByName(unified(one_sided(gone, S, self.target, self.options), gone, self.target, self.options, F.col("_key"), F.col("_status")))

    def _content_chunk(self, start: int, size: int) -> DataFrame:
        part = self.source.select_rows(start, start + size)
        rule = self.options.but(similarity="row")
        matched = settled(greedy_matches(part, self._free, rule, all_pairs=True))
        left = side(part, S).join(matched, F.col(S + INDEX) == F.col("source_idx"), "left")
        pairs = left.join(side(self._free, T), F.col("target_idx") == F.col(T + INDEX), "left")
        status = F.when(F.col("target_idx").isNull(), "removed").when(F.col("score").isNull(), "unchanged").otherwise("modified")
        hit = pairs.where("target_idx is not null")
        key = F.concat(F.lit("Row "), (F.col(S + INDEX) + 1).cast("string"))
        rows = unified(hit, part, self._free, self.options, key, status, F.col("score"))
        lost = numbered(pairs.where("target_idx is null"), "_n", [F.col(S + INDEX)])
        rows = rows.unionByName(unified(lost, part, self._free, self.options, F.concat(F.lit("Removed "), (F.col("_n") + 1).cast("string")), F.lit("removed")))
        rest = self._free.df.join(matched.select(F.col("target_idx").alias("_m")), F.col(INDEX) == F.col("_m"), "left_anti")
        rest = settled(rest)
        self._free = Dataset(rest, self.target.headers)
        if start + size < self.total:
            return rows
        added = numbered(alone(self._free, T, self.source), "_n", [F.col(T + INDEX)])
        return rows.unionByName(unified(added, self.source, self._free, self.options, F.concat(F.lit("Added "), (F.col("_n") + 1).cast("string")), F.lit("added")))


def stream_csv(spark: SparkSession, path: str, headers: tuple[str, ...], has_headers: bool = True, files_per_batch: int = 1, on_ragged: str = "error") -> CsvStream:
    """A folder that CSV files arrive in, as a stream under the rules of ``read_csv``."""
    return CsvStream(spark, path, tuple(headers), has_headers, files_per_batch, on_ragged)


class StreamingKeyDiff:
    """A static source against a target that arrives as a stream.

    The source is written once below ``path``, bucketed by key, so that a micro-batch is shuffled and the source isn't. A batch's added, modified and
    unchanged rows go to ``path/rows``, its keys to ``path/seen``, bucketed as well; ``finish`` adds the removed rows: those whose key never came. A batch that is run again after a failure
    overwrites its own folder, so results are written once. A key that comes twice, in a batch or over batches, is an error when it arrives, also after a restart. Records that a ``CsvStream``
    rejects go to ``path/rejected``.
    """

    def __init__(self, source: Dataset, headers: tuple[str, ...], options: DiffOptions, path: str) -> None:
        check_unique(source, options, "source")
        self.headers, self.options, self.path = tuple(headers), options, path
        self.source = prepare(source, options, f"{path}/source")
        self.seen = SeenKeys(source.df.sparkSession, f"{path}/seen")
        self._read: Callable[[DataFrame, int], Dataset] = self._named

    def _named(self, batch: DataFrame, epoch: int) -> Dataset:
        if INDEX not in batch.columns:
            batch = batch.withColumn(INDEX, F.monotonically_increasing_id())
        return Dataset(batch.select(F.col(INDEX), *[F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")).alias(f"c{i}") for i, h in enumerate(self.headers)]), self.headers)

    def _batch(self, batch: DataFrame, epoch: int) -> None:
        target = self._read(batch, epoch)
        target = replace(target, df=target.df.withColumn(KEY_COLUMN, key_of(target, self.options)).persist(), key=KEY_COLUMN)
        try:
            check_keys(self.source, target, self.options)
            check_unique(target, self.options, "target")
            keys = target.df.select(KEY_COLUMN)
            self.seen.merge(epoch)
            if (twice := self.seen.repeated(keys, epoch)) is not None:
                raise duplicate_error("target", twice)
            self.classified(target).write.mode("overwrite").parquet(f"{self.path}/rows/epoch={epoch}")
            self.seen.add(keys, epoch)
        finally:
            target.df.unpersist()

    def classified(self, target: Dataset) -> DataFrame:
        """The added, modified and unchanged rows of a part of the target."""
        return unified(keyed_pairs(self.source, target, self.options, "right"), self.source, target, self.options, F.col("_key"), F.col("_status"))

    def _reject(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rejected/epoch={epoch}")

    def start(self, stream: DataFrame | CsvStream, **trigger: object) -> StreamingQuery:
        """``stream`` is a ``CsvStream``, or has the target's named columns and maybe ``_row_idx``; without it rows are numbered within their batch."""
        lines = stream
        if isinstance(stream, CsvStream):
            reader = stream if stream.rejected else replace(stream, rejected=self._reject)
            self._read, lines = reader.read, stream.lines
        writer = lines.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def rejected(self) -> DataFrame:
        """The records that were left out: file, line, text, epoch."""
        spark = self.source.df.sparkSession
        if exists(spark, f"{self.path}/rejected"):
            return spark.read.parquet(f"{self.path}/rejected")
        return spark.createDataFrame([], "file string, line long, text string, epoch int")

    def finish(self) -> DataFrame:
        """The whole result, with the removed rows."""
        rows = self.source.df.sparkSession.read.parquet(f"{self.path}/rows").drop("epoch")
        gone = replace(self.source, df=self.source.df.join(self.seen.before(), KEY_COLUMN, "left_anti"))
        return rows.unionByName(unified(one_sided(gone, S, self._like_source(), self.options), gone, self._like_source(), self.options, F.col("_key"), F.col("_status")))

    def _like_source(self) -> Dataset:
        """A target's columns, for rows that have none."""
        names = ", ".join([f"{INDEX} long", *[f"c{i} string" for i in range(len(self.headers))]])
        return Dataset(self.source.df.sparkSession.createDataFrame([], names), self.headers)
