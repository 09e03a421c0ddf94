"""A side of a comparison: a DataFrame of strings with a row index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = "_row_idx"
#: The row key of a side that has it as a column.
KEY_COLUMN = "_key"


@dataclass(frozen=True)
class Dataset:
    """``df`` has ``_row_idx`` and the physical columns ``c0 .. cN``; ``headers`` are the logical names in file order.

    A logical name that occurs more than once means its last column. Cells are never null: a missing one is the empty string.
    """

    df: DataFrame
    headers: tuple[str, ...]
    warnings: tuple[str, ...] = field(default=())
    #: The column that holds the row key, where a table is kept by it.
    key: str | None = None

    def ordinal(self, name: str) -> int | None:
        return next((i for i in range(len(self.headers) - 1, -1, -1) if self.headers[i] == name), None)

    def cell(self, name: str, prefix: str = "") -> Column:
        """The named cell; the empty string where there is no such column."""
        at = self.ordinal(name)
        return F.lit("") if at is None else F.col(f"{prefix}c{at}")

    @property
    def names(self) -> list[str]:
        """Logical names, each once."""
        return list(dict.fromkeys(self.headers))

    def renamed(self, headers: Iterable[str]) -> Dataset:
        return replace(self, headers=tuple(headers))

    def as_map(self, prefix: str = "") -> Column:
        """The row as a map from name to value."""
        if not self.headers:
            return F.create_map().cast("map<string,string>")
        return F.create_map(*[x for name in self.names for x in (F.lit(name), self.cell(name, prefix))])

    def select_rows(self, start: int, end: int) -> Dataset:
        return replace(self, df=self.df.where(F.col(INDEX).between(start, end - 1)))

    def chunks(self, size: int) -> Iterator[Dataset]:
        """The rows in slices of ``size`` row numbers, each a lazy filter."""
        top = self.df.agg(F.max(INDEX)).first()[0]
        for start in range(0, 0 if top is None else top + 1, size):
            yield self.select_rows(start, start + size)

    def named(self) -> DataFrame:
        """The rows under their logical names, with the index."""
        return self.df.select(INDEX, *[self.cell(n).alias(n) for n in self.names])


def as_text(column: Column, kind: T.DataType) -> Column:
    """A typed cell as text, by Spark's cast, which gives different doubles different texts; null is empty. Minus zero counts as zero.

    Queries that want rounded numbers cast them to a decimal first.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        column = F.when(column == 0, F.lit(0.0).cast(kind)).otherwise(column)
    return F.coalesce(column.cast("string"), F.lit(""))


def from_table(df: DataFrame, index: str | Column | None = None, columns: list[str] | None = None) -> Dataset:
    """A typed table as a dataset.

    ``index`` is a column or expression of unique whole numbers that orders the rows. Without one, rows are numbered from 0 in their order of
    reading, partition by partition, which takes one pass to count them.
    """
    names = columns or df.columns
    kinds = dict(zip(df.columns, [f.dataType for f in df.schema.fields], strict=True))
    cells = [as_text(F.col(f"`{n}`"), kinds[n]).alias(f"c{i}") for i, n in enumerate(names)]
    if index is None:
        return Dataset(numbered(df.select(*cells)), tuple(names))
    key = F.col(index) if isinstance(index, str) else index
    return Dataset(df.select(key.cast("long").alias(INDEX), *cells), tuple(names))


def numbered(df: DataFrame, column: str = INDEX, order: list[Column] | None = None) -> DataFrame:
    """Add dense row numbers from 0, in reading order or sorted by ``order``.

    Partitions number their own rows; only their sizes (one small row each) are gathered to know where each begins. Reading order needs a
    source whose partitions are the same when read again, such as files that don't change. A sort is kept for the second pass.
    """
    if order is not None:
        df = df.orderBy(*order).persist()
    marked = df.withColumn("_mark", F.monotonically_increasing_id())
    part, place = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0]
    for p in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(p, 0))
    offsets = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")  # folded to one literal, however many partitions
    return marked.withColumn(column, (F.coalesce(F.get(offsets, part.cast("int")), F.lit(0)) + place).cast("long")).drop("_mark")
