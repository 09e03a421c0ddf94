"""Ranked lexical search: postings bucketed by term, integer scores, the best k documents of each item.

Postings are lists: a row has one term and the documents of one batch that hold it, so a term that is everywhere is many bounded rows and copies of
the term are few. They are dealt out by term and kept; items meet them there, each match is scored in 64-bit integers, scores are
summed by item and document, and ``row_number`` takes the best.

Common terms would make a match of nearly every item with nearly every document. They are spared without losing any result: each item's rare terms give a
few documents, whose full scores give a score that the k-th best reaches at least; a document that has only terms whose
greatest possible sum stays below that score can't be among the best, so common terms are looked up only for documents that other terms have
found and that can still get there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, in_batches, shuffle_width, text_or_empty

_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What isn't part of a term in ASCII becomes a space; other bytes stay, capital letters of ASCII become small.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split into terms at once.
_PIECE = 1 << 20
#: Bits of the filter of terms.
FILTER_BITS = 1 << 23
#: Rows of a side that may be sent to every task: 16 bytes each.
SENT_ROWS = 500_000
#: Postings of an item's rarest terms that are scored first.
SEED_POSTINGS = 1000
#: Documents of each item, found by these, that are scored in full first, as a multiple of k.
SEED_DOCS = 5
#: Terms whose bounds sum up to this part (in tenths) of what the k-th best reaches are left until the others have found their documents. With all
#: ten tenths nearly every document that is found could still get there.
COMMON_TENTHS = 6
#: Matches are worth this at most, times their weight in thousandths.
_SCALE = 1_000_000_000
_KNOWN_TERMS = 500_000


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text; long texts go in pieces that end between terms."""
    folded = text.translate(_FOLD)
    if len(folded) <= _PIECE:
        return Counter(folded.split())
    found: Counter = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + _PIECE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


@dataclass(frozen=True)
class Index:
    """``postings``: term, rows (numbers of documents), ids, tfs, sizes (terms of these documents), dealt out by term; and the table's totals."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def term_filter(items: DataFrame, text: str = "text") -> bytes:
    """One bit for each checksum of a term in ``items``: 1 MB at most, however many items there are. Other terms may share a bit."""
    bit = F.pmod(F.crc32("term"), F.lit(FILTER_BITS))
    bits = _exploded(items.select(text_or_empty(text).alias("text"))).select((bit / 8).cast("int").alias("byte"), F.pow(F.lit(2), bit % 8).cast("int").alias("one"))
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bits.groupBy("byte").agg(F.bit_or("one").alias("one")).collect():
        held[row["byte"]] = row["one"]
    return held.tobytes()


def _exploded(texts: DataFrame) -> DataFrame:
    """The rows once for each term of ``text``, as ``term``."""
    small = F.translate("text", _LOWER.upper(), _LOWER)
    terms = F.regexp_extract_all(small, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    return texts.withColumn("term", F.explode(terms)).drop("text")


def _lists(held: bytes | None, id_type: pa.DataType):
    """The postings of each batch, a row for each term, and at the task's end a row without a term that has its counts of documents and terms."""
    schema = pa.schema([("term", pa.string()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(id_type)), ("tfs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}
        n_docs = n_terms = 0

        def wanted(term: bytes) -> bool:
            found = known.get(term)
            if found is None:
                if len(known) >= _KNOWN_TERMS:
                    known.clear()
                bit = zlib.crc32(term) % FILTER_BITS
                found = known[term] = bool(held[bit >> 3] >> (bit & 7) & 1)
            return found

        for batch in batches:
            codes: dict[bytes, int] = {}
            code: list[int] = []
            tf: list[int] = []
            lengths = np.zeros(batch.num_rows, np.int64)
            hits = np.zeros(batch.num_rows, np.int64)
            for at, text in enumerate(batch.column("text").cast(pa.large_binary())):
                counts = term_counts(text.as_py())
                lengths[at] = counts.total()
                of = counts if held is None else [t for t in counts if wanted(t)]
                code.extend([codes.setdefault(t, len(codes)) for t in of])
                tf.extend([counts[t] for t in of])
                hits[at] = len(of)
            codes_of = np.array(code, np.int64)
            order = np.argsort(codes_of, kind="stable")
            doc = np.repeat(np.arange(batch.num_rows), hits)[order]
            offsets = pa.array(np.searchsorted(codes_of[order], np.arange(len(codes) + 1)), pa.int32())
            listed = lambda values: pa.ListArray.from_arrays(offsets, values)
            terms = pa.array([t.decode() for t in codes], pa.string())
            taken = pa.array(doc)
            lists = [listed(batch.column("row").take(taken)), listed(batch.column("id").take(taken)), listed(pa.array(np.array(tf, np.int64)[order])), listed(pa.array(lengths[doc]))]
            yield pa.RecordBatch.from_arrays([terms, *lists], schema=schema)
            n_docs, n_terms = n_docs + int((lengths > 0).sum()), n_terms + int(lengths.sum())
        yield pa.RecordBatch.from_pylist([{"term": None, "rows": [], "ids": [], "tfs": [n_docs], "sizes": [n_terms]}], schema=schema)

    return run


def build_index(docs: DataFrame, text: str = "text", id_column: str = "doc_id", only: bytes | None = None) -> Index:
    """Postings of ``docs``, of all terms or of those in the filter ``only``; totals count every term in any case.

    Rows that repeat and rows with the same id or none are documents of their own. A null or empty text has no terms. Other columns aren't read. An empty table gives an
    index without postings.
    """
    id_type = docs.schema[id_column].dataType
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), text_or_empty(text).alias("text"))
    listed = T.StructType([T.StructField("term", T.StringType())] + [T.StructField(n, T.ArrayType(k)) for n, k in (("rows", T.LongType()), ("ids", id_type), ("tfs", T.LongType()), ("sizes", T.LongType()))])
    lists = in_batches(rows).mapInArrow(_lists(only, to_arrow_type(id_type)), listed)
    kept = cut(lists.repartition(shuffle_width(docs.sparkSession), "term"))
    totals = kept.where("term is null").agg(F.sum(F.col("tfs")[0]).alias("n"), F.sum(F.col("sizes")[0]).alias("l")).first()
    return Index(kept.where("term is not null"), totals["n"] or 0, totals["l"] or 0)


def impact(tf: Column, size: Column, n_docs: int, n_terms: int) -> Column:
    """What a term's occurrences in a document of ``size`` terms are worth. Where 64 bits don't hold the product of sizes, decimals do."""
    factor = 75 * max(1, n_docs)
    div = lambda a, b: F.call_function("div", a, b)
    short = div(size * F.lit(factor).cast("long"), F.lit(n_terms).cast("long"))
    long = div(size.cast("decimal(19,0)") * F.lit(factor).cast("decimal(19,0)"), F.lit(n_terms).cast("decimal(19,0)"))
    m = F.when(size <= F.lit(((1 << 63) - 1) // factor), short).otherwise(long) + 25
    return div(tf * F.lit(_SCALE).cast("long"), tf * 1000 + m * 8)


def _weights(index: Index, items: DataFrame, text: str, item_id: str) -> DataFrame:
    """A row for each item's different terms: item, item_id, term, w (repeats included), df, bound (the most that it adds to a document)."""
    n = index.n_docs
    rows = cut(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), text_or_empty(text).alias("text")))
    asked = _exploded(rows).groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("q"))
    best = F.array_max(F.zip_with("tfs", "sizes", lambda tf, size: impact(tf, size, n, index.n_terms)))
    known = index.postings.groupBy("term").agg(F.sum(F.size("rows")).cast("long").alias("df"), F.max(best).alias("most"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("q")
    return asked.join(known, "term").select("item", "item_id", "term", weight.alias("w"), "df", (weight * F.col("most")).alias("bound")).where("w > 0")


def _matches(index: Index, terms: DataFrame) -> DataFrame:
    """Each match of a term of an item with a document: item, row, id, part."""
    hit = F.explode(F.arrays_zip("rows", "ids", "tfs", "sizes")).alias("d")
    found = index.postings.join(terms.select("item", "term", "w"), "term").select("item", "w", hit)
    return found.select("item", F.col("d.rows").alias("row"), F.col("d.ids").alias("id"), (F.col("w") * impact(F.col("d.tfs"), F.col("d.sizes"), index.n_docs, index.n_terms)).alias("part"))


def _summed(index: Index, terms: DataFrame) -> DataFrame:
    return _matches(index, terms).groupBy("item", "row").agg(F.any_value("id").alias("id"), F.sum("part").alias("score"))


def _looked_up(index: Index, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """The sum of ``terms`` for given pairs of item and document: item, row, more. Pairs without any of the terms are missing.

    The postings are cut down to the documents asked for first, which are sent to every task as long as they are few.
    """
    asked = pairs.select("row").distinct()
    asked = F.broadcast(asked) if pairs.count() <= SENT_ROWS else asked
    hit = F.explode(F.arrays_zip("rows", "tfs", "sizes")).alias("d")
    of_docs = index.postings.select("term", hit).select("term", F.col("d.rows").alias("row"), F.col("d.tfs").alias("tf"), F.col("d.sizes").alias("size")).join(asked, "row", "left_semi")
    wanted = pairs.select("item", "row").join(terms.select("item", "term", "w"), "item")
    part = F.col("w") * impact(F.col("tf"), F.col("size"), index.n_docs, index.n_terms)
    return wanted.join(of_docs, ["row", "term"]).groupBy("item", "row").agg(F.sum(part).alias("more"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(index: Index, items: DataFrame, k: int = 10, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank (from 1), doc_id, score.

    Equal scores stand by ascending id, nulls last. Items that repeat are ranked each; an item without terms, or whose terms nothing holds, has no rows, and
    neither has any item where there are no documents.
    """
    weights = cut(_weights(index, items, text, item_id))
    by_item = Window.partitionBy("item")
    before = F.coalesce(F.sum("df").over(by_item.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = weights.withColumn("before", before).where(F.col("before") < SEED_POSTINGS)
    first = cut(_best(_summed(index, seeds), SEED_DOCS * k).select("item", "row", "id"))
    full = first.join(_looked_up(index, first, weights), ["item", "row"]).withColumnRenamed("more", "score")
    reached = _best(full, k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("reached")).where(F.col("n") == k).select("item", "reached")
    # Terms from the least bound upwards, as long as all of them together stay well below what the k-th best reaches.
    up_to = F.sum("bound").over(by_item.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    parted = cut(weights.join(reached, "item", "left").withColumns({"reached": F.coalesce("reached", F.lit(0)), "up_to": up_to}))
    is_common = F.col("up_to") * 10 < F.col("reached") * COMMON_TENTHS
    common, telling = parted.where(is_common), parted.where(~is_common)
    rest = parted.groupBy("item").agg(F.any_value("item_id").alias("item_id"), F.any_value("reached").alias("reached"), F.max(F.when(is_common, F.col("up_to"))).alias("rest"))
    found = _summed(index, telling).join(rest, "item").where(F.col("score") + F.coalesce("rest", F.lit(0)) >= F.col("reached"))
    found = cut(found.select("item", "item_id", "row", "id", "score"))
    scored = found.join(_looked_up(index, found, common), ["item", "row"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0)))
    return _best(scored.where("score > 0"), k).select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
