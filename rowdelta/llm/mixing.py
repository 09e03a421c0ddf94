"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, in_batches, shuffle_width, text_or_empty

#: Weights of the sources by code point, again and again, and the tilt of each one's schedule.
WEIGHTS = (5, 2, 1)
TILTS = (-0.5, 0.0, 0.5)
#: Each source's documents are dealt over two to this many ranges of their order hash, or more, so that no source is one task's work.
LEAST_RANGE_BITS = 12


def targets(sizes: DataFrame, total: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, tilts: tuple = TILTS) -> DataFrame:
    """Each source's target from (source, source_size): weights share ``total`` of all sizes; what lies above ``cap`` times a source's
    size is shared out again by weight until no source is above.

    That is the water level L with sum(min(L * weight, cap * size)) = total: with sources by cap * size / weight, L is the first level
    that doesn't lift the next source above its cap. All sources together demand ``demand`` * t + ``bend`` * t * t words before time t.
    One row for each source; the windows without a key are over those rows only.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (F.col("_rank") % n + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name) - 1).withColumns({"weight": pick(weights), "tilt": pick(tilts), "_cap": F.col("source_size") * cap})
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    rest = F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1))
    levels = ranked.withColumn("_level", (F.sum("source_size").over(Window.partitionBy()) * total - F.coalesce(rest, F.lit(0.0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.col("_level"))
    level = F.first(fits, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = levels.select("source", "source_size", "weight", "tilt", F.coalesce(F.least(level * F.col("weight"), F.col("_cap")), F.col("_cap")).alias("target"))
    whole = Window.partitionBy()
    return known.withColumns({"demand": F.sum(F.col("target") * (1 - F.col("tilt"))).over(whole), "bend": F.sum(F.col("target") * F.col("tilt")).over(whole)})


def when_served(share: Column, tilt: Column) -> Column:
    """The time in 0..1 at which a source has served this share of its target.

    A source's weight at time t is its mean weight times 1 + tilt * (2t - 1). The integral, (1 - tilt) * t + tilt * t * t, is the
    share served by then; this is its inverse. The position in training is what all sources' integrals, times their targets, have
    demanded by that time.
    """
    a = 1 - tilt
    return F.when(F.abs(tilt) < 1e-9, share).otherwise(F.abs((-a + F.sqrt(a * a + 4 * tilt * share)) / (2 * tilt)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Deal every document its part of its source's target and its places along the curriculum.

    Returns doc_id, source, size (words), source_size, target, taken (words, repeats counted), first_words and second_words of its two readings, first_at and
    second_at (the times in 0..1 at which they begin), first_position and second_position (the words that all sources demand before those
    times), each null if there is no such reading, and the columns in ``keep``.

    A source's documents stand in the order of a hash of id and text; its target is read off along that order, from the start again where
    it exceeds the source's size. The document in which the target ends is taken in part, so a source's words meet its target to less than
    one word. Nothing is random, so reruns agree. Null ids and sources are values like others; null and empty texts have size 0 and are never taken; rows
    that repeat are documents of their own; an empty table gives no rows.

    Running sums go in two steps, within a hash range and over the ranges of a source, so a source with most rows is many tasks' work. The number of
    ranges follows the shuffle's width and doesn't change the result. Rows move once, by source and range.
    """
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_or_empty(text_col)).cast("binary"))
    bits = max(LEAST_RANGE_BITS, min(24, (16 * shuffle_width(docs.sparkSession)).bit_length()))
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        key.alias("_key"), *keep,
    ).withColumns({"_range": F.shiftright(F.conv(F.substring("_key", 1, 6), 16, 10).cast("int"), 24 - bits), "_of": _name_of("source")})
    slim = cut(base.groupBy("_of", "source", "_range").agg(F.sum("size").alias("_in_range")))
    over = Window.partitionBy("_of").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    goals = targets(slim.groupBy("source").agg(F.sum("_in_range").alias("source_size")), total, cap).withColumn("_of", _name_of("source")).drop("source")
    before = F.coalesce(F.sum("_in_range").over(over), F.lit(0))
    ranges = slim.select("_of", "_range", before.alias("_before")).join(goals, "_of")
    here = Window.partitionBy("_of", "_range").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("_within", F.coalesce(F.sum("size").over(here), F.lit(0)))
    known = placed.join(ranges, ["_of", "_range"])
    start, goal, size, all_ = F.col("_before") + F.col("_within"), F.round("target").cast("long"), F.col("size"), F.col("source_size")
    part = lambda k: F.greatest(F.lit(0), F.least(size, goal - (start + all_ * k)))
    at = lambda k: F.when(part(k) > 0, when_served((start + all_ * k) / goal, F.col("tilt")))
    read = known.select("doc_id", "source", "size", "source_size", "target", (part(0) + part(1)).alias("taken"), part(0).alias("first_words"), part(1).alias("second_words"), at(0).alias("first_at"), at(1).alias("second_at"), "demand", "bend", *keep)
    position = lambda t: F.col("demand") * F.col(t) + F.col("bend") * F.col(t) * F.col(t)
    return read.select("doc_id", "source", "size", "source_size", "target", "taken", "first_words", "second_words", "first_at", "second_at", position("first_at").alias("first_position"), position("second_at").alias("second_position"), *keep)


def _name_of(source: str) -> Column:
    """A source as text that isn't null, so that grouping and joins stand on the same partitions."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut each text after its first ``_short`` words, where that is set."""
    word = re.compile(WORD)
    for batch in batches:
        n, at = batch.column("_short").to_pylist(), batch.schema.get_field_index("_text")
        texts = [t if k is None else t[: next(islice(word.finditer(t), k - 1, None)).end()] for t, k in zip(batch.column(at).to_pylist(), n, strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, columns[at].type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The documents as the mix takes them, range-sorted by training position: a row for each reading, with the columns of ``docs``.

    A reading that the target cuts short has the document's first words only. Documents that aren't taken go; those without words do
    too, as they add nothing.
    """
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.struct(*others).alias("_rest"))
    mixed = mix(packed, keep=("text", "_rest"))
    one = lambda k, words, at: F.struct(F.lit(k).alias("k"), F.col(words).alias("words"), F.col(at).alias("at"))
    read = mixed.select("*", F.explode(F.array(one(0, "first_words", "first_position"), one(1, "second_words", "second_position"))).alias("_read")).where(F.col("_read.words") > 0)
    short = F.when(F.col("_read.words") < F.col("size"), F.col("_read.words"))
    rows = read.select(F.col("_read.at").alias("_at"), F.col("_read.k").alias("_k"), "_rest", F.col("text").cast("string").alias("_text"), short.alias("_short"))
    rows = in_batches(rows).mapInArrow(_shorten, rows.schema).drop("_short")
    ordered = rows.repartitionByRange(2 * shuffle_width(docs.sparkSession), "_at", "_k", F.xxhash64("_text")).sortWithinPartitions("_at", "_k")
    length = lambda c: F.char_length("_text").cast(docs.schema[c].dataType) if c == length_col else F.col(f"_rest.`{c}`")
    return ordered.select(*[(F.col("_text") if c == text_col else length(c)).alias(c) for c in docs.columns])


def in_order(mixed: DataFrame) -> DataFrame:
    """Range-sort documents by the position of their first reading; those not taken come last."""
    return mixed.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
