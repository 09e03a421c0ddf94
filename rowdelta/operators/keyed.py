"""Comparison by primary key: one full outer join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.functions.keys import row_key
from rowdelta.operators.compare import S, T, alone, any_difference, side, unified
from rowdelta.options import DiffOptions
from rowdelta.sources.dataset import INDEX, Dataset


def check_keys(source: Dataset, target: Dataset, options: DiffOptions) -> None:
    if not options.key_columns:
        raise ValueError("Primary key mode needs at least one key column.")
    for name in options.key_columns:
        for data, label in ((source, "source"), (target, "target")):
            if data.ordinal(name) is None:
                raise ValueError(f'Primary key column "{name}" not found in {label} dataset.')


def key_of(data: Dataset, options: DiffOptions, prefix: str = "") -> Column:
    return F.col(prefix + data.key) if data.key else row_key([data.cell(n, prefix) for n in options.key_columns])


def duplicate_keys(data: Dataset, options: DiffOptions) -> DataFrame:
    """Keys that occur more than once: key, n, first_idx. Counts combine before the shuffle, so a hot key is no burden."""
    keys = data.df.select(key_of(data, options).alias("key"), INDEX)
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(INDEX).alias("first_idx")).where("n > 1")


def duplicate_error(label: str, key: str) -> ValueError:
    return ValueError(f"Duplicate Primary Key found in {label}: \"{key}\". Primary Keys must be unique.")


def check_unique(data: Dataset, options: DiffOptions, label: str) -> None:
    """Raise for the first row in file order whose key an earlier row has."""
    check_all_unique([(data, label)], options)


def check_all_unique(sides: list[tuple[Dataset, str]], options: DiffOptions) -> None:
    """The same for several datasets, the first of them first, with one pass over the keys of all."""
    keys = [data.df.select(F.lit(n).alias("side"), key_of(data, options).alias("key")) for n, (data, _) in enumerate(sides)]
    counted = reduce(DataFrame.unionByName, keys).groupBy("side", "key").agg(F.count(F.lit(1)).alias("n"))
    bad = counted.where("n > 1").agg(F.min("side")).first()[0]
    if bad is None:
        return
    data, label = sides[bad]
    rows = data.df.select(key_of(data, options).alias("key"), INDEX).join(duplicate_keys(data, options), "key").where(F.col(INDEX) > F.col("first_idx"))
    raise duplicate_error(label, rows.agg(F.min_by("key", INDEX)).first()[0])


def last_of_each_key(data: Dataset, options: DiffOptions) -> Dataset:
    """Of rows with the same key the last one."""
    row = F.struct(*data.df.columns)
    kept = data.df.groupBy(key_of(data, options).alias("_key")).agg(F.max_by(row, INDEX).alias("_row")).select("_row.*")
    return Dataset(kept, data.headers, data.warnings)


def keyed_pairs(source: Dataset, target: Dataset, options: DiffOptions, how: str = "full") -> DataFrame:
    """Rows of both sides by key, with ``_key`` and ``_status``."""
    left = side(source, S).withColumn("_s_key", key_of(source, options, S))
    right = side(target, T).withColumn("_t_key", key_of(target, options, T))
    pairs = left.join(right, F.col("_s_key") == F.col("_t_key"), how)
    status = F.when(F.col("_s_key").isNull(), "added").when(F.col("_t_key").isNull(), "removed").when(any_difference(source, target, options), "modified").otherwise("unchanged")
    return pairs.withColumns({"_key": F.coalesce("_s_key", "_t_key"), "_status": status})


def one_sided(data: Dataset, prefix: str, other: Dataset, options: DiffOptions) -> DataFrame:
    """Rows that have no partner, with ``_key`` and ``_status``, as ``keyed_pairs`` gives them."""
    status = "removed" if prefix == S else "added"
    return alone(data, prefix, other).withColumns({"_key": key_of(data, options, prefix), "_status": F.lit(status)})


def keyed_diff(source: Dataset, target: Dataset, options: DiffOptions, check: bool = True) -> DataFrame:
    """The unified result of a comparison by key; ``check=False`` trusts the keys to be unique and saves the pass that looks."""
    check_keys(source, target, options)
    if options.on_duplicate == "last":
        source, target = last_of_each_key(source, options), last_of_each_key(target, options)
    elif check:
        check_all_unique([(source, "source"), (target, "target")], options)
    return unified(keyed_pairs(source, target, options), source, target, options, F.col("_key"), F.col("_status"))
