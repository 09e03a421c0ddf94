"""The next row in descending order of a key, without one window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width


def bounds_of(df: DataFrame, key: str, most: int = 20_000) -> list[int]:
    """Up to ``most`` keys that part the table into about equal ranges; each is a key that occurs, exactly. Reads the key column only.

    Quantiles go through doubles, which cannot tell large keys apart. So they are only where to look: each bound is the least key
    of the rows from there on, by whole numbers, and the last one is the greatest key.
    """
    n = min(most, 8 * shuffle_width(df.sparkSession))  # several ranges for each task even out its share
    keys = df.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull())
    found = keys.select(F.col(key).cast("double").alias(key)).approxQuantile(key, [k / n for k in range(n + 1)], 1 / (4 * n))
    places = sorted({min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in found})
    if not places:
        return []
    least = keys.groupBy(_range_of(F.col(key), literal_longs(places), len(places)).alias("at")).agg(F.min(key).alias("least"), F.max(key).alias("greatest")).collect()
    return sorted({*(r["least"] for r in least), max(r["greatest"] for r in least)})


def literal_longs(values: list[int]) -> Column:
    """One literal array, folded from text so that plans stay small with many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of the ``n`` sorted ``bounds`` are at most ``key``: a binary search by falling powers of two over one array."""
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def with_next(df: DataFrame, key: str, ties: list[str], value: str, out: str, bounds: list[int], keep_range: bool = False, rank: str | None = None) -> DataFrame:
    """Add ``out``: ``value`` of the next row by descending ``key``, then ``ties``; null keys come last; the last row gets the first's.

    The keys are cut into ranges at ``bounds``. A row whose key is a bound stands in its own range, where it serves the row before
    it, and once more on top of the range below, where its own successor is. Rows with the greatest key also stand at the end of the
    lowest range. Only rows at bounds are doubled, so each range is one task's sort. ``keep_range`` keeps the column ``_range`` by which
    rows are partitioned then: what groups by it and more needs no shuffle. ``rank`` adds a column that orders rows of one key as they stood here: all of
    them get their result in one range, and it is their place there.
    """
    place = {} if rank is None else {rank: F.row_number()}
    k = F.col(key)
    if not bounds:
        ranged = df.withColumns({"_range": F.lit(0), "_role": F.lit(1)})
        w = Window.partitionBy("_range").orderBy(k.desc_nulls_last(), *ties)
        first = F.first(F.struct(F.col(value).alias("v"))).over(w)["v"]
        following = F.when(F.lead(F.lit(1)).over(w).isNull(), first).otherwise(F.lead(value).over(w))
        return ranged.withColumns({out: following} | {c: x.over(w) for c, x in place.items()}).drop("_role", *([] if keep_range else ["_range"]))
    listed = literal_longs(bounds)
    df = df.withColumn("_own", F.when(k.isNull(), 0).otherwise(_range_of(k, listed, len(bounds))))
    own = F.col("_own")
    at_bound = F.coalesce((F.get(listed, own - 1) == k) & (own > 1), F.lit(False))
    # Roles: 0 top copy that gives the row's result, 1 the row itself, 2 a row that only serves the one before, 3 the wrap-around copy.
    base = F.struct(F.when(own <= 1, 1).otherwise(own).alias("r"), F.when(at_bound, 2).otherwise(1).alias("o"))
    down = F.struct((own - 1).alias("r"), F.lit(0).alias("o"))
    wrap = F.struct(F.lit(1).alias("r"), F.lit(3).alias("o"))
    places = F.concat(
        F.array(base),
        F.when(at_bound, F.array(down)).otherwise(F.array().cast("array<struct<r:int,o:int>>")),
        F.when(F.coalesce(k == bounds[-1], F.lit(False)), F.array(wrap)).otherwise(F.array().cast("array<struct<r:int,o:int>>")),
    )
    ranged = df.withColumn("_place", F.explode(places)).withColumns({"_range": F.col("_place.r"), "_role": F.col("_place.o")}).drop("_place", "_own")
    w = Window.partitionBy("_range").orderBy((F.col("_role") == 3).asc(), k.desc_nulls_last(), *ties)
    return ranged.withColumns({out: F.lead(value).over(w)} | {c: x.over(w) for c, x in place.items()}).where(F.col("_role") < 2).drop("_role", *([] if keep_range else ["_range"]))
