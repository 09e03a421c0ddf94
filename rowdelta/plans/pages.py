"""Pages of a sorted view that lie ready: the view is sorted and written once, and a page is read where it lies."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from rowdelta.plans.view import View

#: Bits of ``monotonically_increasing_id`` that count a partition's rows.
_ROW_BITS = 33


@dataclass(frozen=True)
class StoredPages:
    """A written view. ``bounds`` has one row for each range in order: its folder's number ``part``, ``rows``, and ``last``, the place of its last row by the leading sort key."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    kind: str | None  # None where the view is in its display order
    descending: bool
    bounds: tuple[Row, ...]

    @property
    def starts(self) -> list[int]:
        """The position at which each range begins, and the number of all rows behind."""
        return reduce(lambda at, b: [*at, at[-1] + b["rows"]], self.bounds, [0])

    def __len__(self) -> int:
        return self.starts[-1]

    def _read(self, parts: list[int]) -> DataFrame:
        """The rows of some ranges; the folders of others aren't even listed."""
        folder = f"{self.path}/rows"
        rows = self.spark.read.option("basePath", folder)
        return rows.parquet(*[f"{folder}/part={p}" for p in parts])

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows.select("status", "key", *[F.get("cells", n).alias(c) for n, c in enumerate(self.columns)])

    def page(self, offset: int, limit: int) -> DataFrame:
        """``limit`` rows from position ``offset`` on, as ``View.page`` gives them. Only ranges that have some of them are read, and of the first and last only their rows."""
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit must not be negative.")
        starts = self.starts
        end = min(offset + limit, starts[-1])
        if offset >= end:
            return self._shown(self.spark.read.parquet(f"{self.path}/rows").where("false")) if self.bounds else self._nothing()
        first, last = bisect_right(starts, offset) - 1, bisect_right(starts, end - 1) - 1
        part = lambda n: self.bounds[n]["part"]
        if first == last:
            found = self._read([part(first)]).where(F.col("at").between(offset - starts[first], end - 1 - starts[first]))
        else:
            found = self._read([part(first)]).where(F.col("at") >= offset - starts[first])
            if last - first > 1:
                found = found.unionByName(self._read([part(n) for n in range(first + 1, last)]))
            found = found.unionByName(self._read([part(last)]).where(F.col("at") < end - starts[last]))
        return self._shown(found.orderBy("part", "at"))

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in ("status", "key", *self.columns)))

    def _not_before(self, place: Column, value: str) -> Column:
        """Whether a leading sort key stands at or behind ``value``; what has no key stands last."""
        from rowdelta.plans.view import sort_value

        key = sort_value(F.lit(value), self.kind)
        return (place <= key if self.descending else place >= key) | place.isNull()

    def position(self, value: str) -> int:
        """Where the first row stands whose leading sort key is at or behind ``value``; the number of rows, if there is none. One range is looked through."""
        if self.kind is None:
            raise ValueError("A view that is sorted by no column has no place for a value.")
        places = self.spark.read.parquet(f"{self.path}/bounds")
        found = places.where(self._not_before(F.col("last"), value)).agg(F.min("part")).first()[0]
        if found is None:
            return len(self)
        at = self._read([found]).where(self._not_before(F.col("place"), value)).agg(F.min("at")).first()[0]
        return self.starts[[b["part"] for b in self.bounds].index(found)] + at

    def page_from(self, value: str, limit: int) -> DataFrame:
        """The page that begins with the first row whose leading sort key is at or behind ``value``."""
        return self.page(self.position(value), limit)


def store_pages(view: View, path: str) -> StoredPages:
    """Sort what the view shows and write it below ``path``, replacing what is there: ranges of the sort order, and a table of their bounds, written last.

    Sorting is one shuffle by ranges; each range is numbered as it is written. The driver gets one row for each range.
    """
    spark, names = view.rows.sparkSession, tuple(n for n in view.columns if n not in view.hidden)
    keys = view.sort_keys()
    by = [F.col(f"by.k{n}").desc_nulls_last() if down else F.col(f"by.k{n}").asc_nulls_last() for n, (_, down) in enumerate(keys)]
    cells = F.array(*[view.display(n) for n in names]).cast("array<string>")
    rows = view.shown().select("status", "key", cells.alias("cells"), F.struct(*[v.alias(f"k{n}") for n, (v, _) in enumerate(keys)]).alias("by"))
    ranged = rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    ranged.select("part", at.alias("at"), F.col("by.k0").alias("place"), "status", "key", "cells").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    kind, down = (view.sort[0][2], view.sort[0][1]) if view.sort else (None, False)
    about = spark.range(1).select(F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("columns"), F.lit(kind).cast("string").alias("kind"), F.lit(down).alias("descending"))
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    schema = ranged.select(F.col("part"), F.col("by.k0").alias("place")).schema
    written = spark.read.schema(f"part int, at long, place {schema['place'].dataType.simpleString()}").parquet(f"{path}/rows")
    bounds = written.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.max_by("place", "at").alias("last"))
    bounds.write.mode("overwrite").parquet(f"{path}/bounds")
    return open_pages(spark, path)


def open_pages(spark: SparkSession, path: str) -> StoredPages:
    """Pages that an earlier run has stored."""
    about = spark.read.parquet(f"{path}/about").first()
    bounds = spark.read.parquet(f"{path}/bounds").orderBy("part").collect()
    return StoredPages(spark, path, tuple(about["columns"]), about["kind"], about["descending"], tuple(bounds))
