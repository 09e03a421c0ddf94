"""What differs between two matched rows; shared by both modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.functions.normalize import normalized
from rowdelta.functions.textdiff import CHANGES, word_diff
from rowdelta.options import DiffOptions
from rowdelta.sources.dataset import Dataset

S, T = "s_", "t_"
DIFFERENCES = f"array<struct<column:string,old_value:string,new_value:string,diff:{CHANGES}>>"
RESULT = ["status", "key", "source_idx", "target_idx", "score", "source_row", "target_row", "differences"]


def compared_columns(source: Dataset, target: Dataset, options: DiffOptions) -> list[str]:
    """The source's columns that the target has too and that aren't excluded."""
    return [n for n in source.names if n not in options.excluded_columns and target.ordinal(n) is not None]


def side(data: Dataset, prefix: str) -> DataFrame:
    """The dataset with prefixed columns, so that two sides can stand in one row."""
    return data.df.select(*[F.col(c).alias(prefix + c) for c in data.df.columns])


def alone(data: Dataset, prefix: str, other: Dataset) -> DataFrame:
    """One side's rows with nulls for the other's columns."""
    away = T if prefix == S else S
    return side(data, prefix).select("*", *[F.lit(None).cast(f.dataType).alias(away + f.name) for f in other.df.schema.fields])


def any_difference(source: Dataset, target: Dataset, options: DiffOptions) -> Column:
    out = F.lit(False)
    for n in compared_columns(source, target, options):
        out = out | (normalized(source.cell(n, S), options) != normalized(target.cell(n, T), options))
    return out


def differences(source: Dataset, target: Dataset, options: DiffOptions) -> Column:
    """Raw values of the columns whose normalised values differ, in the source's column order."""
    found = []
    for n in compared_columns(source, target, options):
        old, new = source.cell(n, S), target.cell(n, T)
        changes = word_diff(old, new, options.case_sensitive) if options.text_diff else F.lit(None).cast(CHANGES)
        found.append(F.when(normalized(old, options) != normalized(new, options), F.struct(F.lit(n).alias("column"), old.alias("old_value"), new.alias("new_value"), changes.alias("diff"))))
    return F.array_compact(F.array(*found)).cast(DIFFERENCES) if found else F.array().cast(DIFFERENCES)


def unified(pairs: DataFrame, source: Dataset, target: Dataset, options: DiffOptions, key: Column, status: Column, score: Column | None = None) -> DataFrame:
    """The result's columns from rows of both sides. What a query doesn't ask for, such as row maps, Catalyst prunes."""
    has_s, has_t = F.col(S + "_row_idx").isNotNull(), F.col(T + "_row_idx").isNotNull()
    none = F.lit(None).cast("map<string,string>")
    return pairs.select(
        status.alias("status"),
        key.alias("key"),
        F.col(S + "_row_idx").alias("source_idx"),
        F.col(T + "_row_idx").alias("target_idx"),
        (score if score is not None else F.lit(None).cast("double")).alias("score"),
        F.when(has_s, source.as_map(S)).otherwise(none).alias("source_row"),
        F.when(has_t, target.as_map(T)).otherwise(none).alias("target_row"),
        F.when(status == "modified", differences(source, target, options)).otherwise(F.array().cast(DIFFERENCES)).alias("differences"),
    )


def flat_differences(result: DataFrame) -> DataFrame:
    """One row for each changed cell: status, key, column, old_value, new_value."""
    return result.select("status", "key", F.explode("differences").alias("d")).select("status", "key", F.col("d.column").alias("column"), F.col("d.old_value").alias("old_value"), F.col("d.new_value").alias("new_value"))
