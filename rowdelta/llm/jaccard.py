"""N-gram Jaccard join by MinHash banding.

Texts are sets of word 5-grams. A signature of ``bands * rows`` minima is cut into bands; texts that agree in a band are candidates.
Band and row counts are chosen for a target recall at the threshold. Band hashes are shuffled once, texts that meet are tied to the smallest
of them, and the connected candidates make groups in which all pairs are verified on the full n-gram sets.

Equal texts are told by 128 bits of two hashes and are one node from there on. Only keys, ids and band hashes move until the groups are known; texts
move once to be verified, and once more where whole documents are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Words, cut, in_batches, mix64, pieces, shingle_hashes, text_key, text_or_empty
from .groups import components, dealt_again, forest, group_links

NGRAM, THRESHOLD, RECALL, CHUNK = 5, 0.8, 0.999, 384


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` minima that find a pair at the threshold with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def _band_hashes(bands: int, rows: int, ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        at_row = mix64(np.arange(100, 100 + rows, dtype=np.uint64)) | np.uint64(1)
        at_band = mix64(np.arange(1000, 1000 + bands, dtype=np.uint64))
        for batch in batches:
            out = []
            for _, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets)
                for k in range(len(offsets) - 1):
                    grams = shingle_hashes(words.hashes[words.bounds[k] : words.bounds[k + 1]], ngram)
                    if not len(grams):
                        out.append(None)
                        continue
                    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
                    for lo in range(0, len(grams), 2048):  # a long text is one row at a time
                        np.minimum(least, np.multiply.outer(factors, grams[lo : lo + 2048]).min(axis=1), out=least)
                    out.append(mix64((mix64(least).reshape(bands, rows) * at_row).sum(axis=1, dtype=np.uint64) + at_band).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "k1", "k2")], pa.array(out, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "bands"])

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (h, id) for each band hash and the smallest id that has it in the batch; other ids that have it come as edges (id, other).

    So a hash that very many texts share is sent once by each batch. Edges are dealt out by their id and pass the shuffle as they are.
    """
    for batch in batches:
        ids, bands = batch.column("id").to_numpy(), batch.column("bands")
        h = bands.flatten().to_numpy()
        per = np.repeat(ids, np.diff(bands.offsets.to_numpy()))
        order = np.lexsort((per, h))
        h, per = h[order], per[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        lead = per[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(h) else per
        u, v = forest(per[per != lead], lead[per != lead])
        n = int(first.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([h[first], mix64(u.astype(np.uint64)).view(np.int64)])), pa.array(np.concatenate([per[first], u]), pa.int64()), pa.array(np.concatenate([np.zeros(n, np.int64), v]), pa.int64(), mask=np.arange(n + len(u)) < n)],
            ["h", "id", "other"],
        )


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (id, other) from rows sorted by h and id: each id to the first that has the same hash, and the edges among the rows."""
    last, lead = None, None
    for batch in batches:
        edge = batch.column("other").is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column("id").to_numpy()
        u, v = [ids[edge]], [batch.column("other").filter(pa.array(edge)).to_numpy()]
        h, ids = batch.column("h").to_numpy()[~edge], ids[~edge]
        if len(h):
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            of = ids[np.flatnonzero(first)[np.cumsum(first) - 1]]
            if last is not None and h[0] == last:
                of[: len(h) if first.sum() == 1 else np.flatnonzero(first)[1]] = lead
            last, lead = h[-1], of[-1]
            u.append(ids[ids != of])
            v.append(of[ids != of])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u), pa.int64()), pa.array(np.concatenate(v), pa.int64())], ["id", "other"])


def _gram_sets(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for _, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets)
                sets += [shingle_hashes(words.hashes[words.bounds[k] : words.bounds[k + 1]], ngram).tobytes() for k in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "grp", "size", "weight")], pa.array(sets, pa.binary())], ["id", "grp", "size", "weight", "load"])

    return run


def _linked(threshold: float):
    def run(left: list[bytes], right: list[bytes]) -> np.ndarray:
        """Which pairs of sets have a Jaccard similarity of the threshold or more; grams of one set only are left out of the product."""
        a, b = [np.frombuffer(x, np.uint64) for x in left], [np.frombuffer(x, np.uint64) for x in right]
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        grams, at, n = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
        shared = n[at] > 1
        rows, at = rows[shared], np.searchsorted(np.flatnonzero(n > 1), at[shared])
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        both = np.zeros((len(a), len(b)))
        width = 4096
        for lo in range(0, int((n > 1).sum()), width):
            s, e = np.searchsorted(at, [lo, lo + width])
            x = np.zeros((len(a) + len(b), width), np.float32)
            x[rows[s:e], at[s:e] - lo] = 1
            both += x[: len(a)] @ x[len(a) :].T
        # Compare whole numbers: both / union >= threshold.
        return both >= threshold * (na[:, None] + nb[None, :] - both) - 1e-9

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float, recall: float) -> DataFrame:
    """One row for each different text: k1, k2 (its key), class_id, first_id (its smallest doc_id), empty, n_links, kept (its first_id stays)."""
    bands, rows = plan_bands(threshold, recall)
    text = text_or_empty(text_col)
    keyed = in_batches(docs).select(F.col(id_col).alias("doc_id"), text.alias("text"), *text_key(text))
    signed = keyed.mapInArrow(_band_hashes(bands, rows, ngram), f"doc_id {docs.schema[id_col].dataType.simpleString()}, k1 long, k2 long, bands array<long>")
    # Copies of a text are one node from here on; sums of counts and minima combine before the shuffle.
    texts = signed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))
    met = texts.where("bands is not null").select("id", "bands").mapInArrow(_meetings, "h long, id long, other long")
    tied = met.repartition("h").sortWithinPartitions("h", "id").mapInArrow(_tied, "id long, other long")
    coarse = components(tied, "id", "other")
    sizes = coarse.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    grouped = coarse.join(dealt_again(sizes), "root").select("node", "root", "size").unionByName(sizes.select(F.col("root").alias("node"), "root", "size"))
    slim = texts.select("id", "k1", "k2", "copies", "first_id")
    wanted = cut(grouped.join(slim, F.col("node") == F.col("id")).select("id", "k1", "k2", F.col("root").alias("grp"), "size", "copies", "first_id"))
    # One document stands for each text: the one with the smallest id.
    of = wanted.select("id", F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "grp", "size", F.col("copies").alias("weight"), F.col("first_id").alias("_first"))
    chosen = keyed.join(of, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    members = chosen.select("id", "grp", "size", "weight", "text").mapInArrow(_gram_sets(ngram), "id long, grp long, size long, weight long, load binary")
    found = cut(group_links(members, _linked(threshold), CHUNK))
    linked = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select("id", "other"), "id", "other")
    in_class = wanted.join(linked, "id", "left").join(roots, F.col("id") == F.col("node"), "left").select("id", "k1", "k2", "first_id", "links", F.coalesce("root", "id").alias("root"))
    least = in_class.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min_by("id", F.struct(F.col("first_id").isNull(), "first_id", "k1", "k2")).alias("kept_id"))
    known = in_class.join(dealt_again(least), "root").select("k1", "k2", "class_id", (F.col("kept_id") == F.col("id")).alias("kept"), "links")
    empty = F.col("bands").isNull()
    return cut(
        texts.join(known, ["k1", "k2"], "left").select(
            "k1", "k2", "first_id", empty.alias("empty"), F.when(F.col("kept").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.when(empty, F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("kept", F.lit(True)).alias("kept"),
        )
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, kept.

    ``n_links`` counts the other documents whose n-gram sets have a Jaccard similarity of ``threshold`` or more with this one's,
    copies included. ``class_id`` is the smallest doc_id reachable by links, itself included; ``kept`` marks the row that stays of a class.
    Texts of fewer than ``ngram`` words are one gram; null and empty texts and those without words have no grams and link with nothing. Documents with a null
    id count like others; a class without any id has a null class_id. Of rows with the same id, text and so class all are marked.
    """
    classes = _classes(docs, id_col, text_col, ngram, threshold, recall)
    slim = docs.select(F.col(id_col).alias("doc_id"), *text_key(text_or_empty(text_col)))
    out = slim.join(classes, ["k1", "k2"])
    kept = F.col("empty") | (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return out.select("doc_id", F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each class: all its columns, no others. Documents without words all stay.

    Of rows that repeat (same id, same text) the one with the smallest hash of the other columns stays. What stays is known by the key of the
    text and the id, so documents move once, and the copies of one text are dealt out by their ids.
    """
    classes = _classes(docs, id_col, text_col, ngram, threshold, recall)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    stays = classes.where("kept and not empty").select("k1", "k2", name("first_id").alias("name"), F.lit(True).alias("stays"))
    text = text_or_empty(text_col)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rest = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    bare = ~text.rlike(WORD)
    packed = docs.select(*text_key(text), F.when(bare, F.concat(name(id_col), F.lit(" "), rest.cast("string"))).otherwise(name(id_col)).alias("name"), rest.alias("rest"), bare.alias("bare"), F.struct("*").alias("doc"))
    marked = packed.join(stays, ["k1", "k2", "name"], "left").where("bare or stays")
    one = marked.withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2", "name").orderBy("rest"))).where("bare or place = 1")
    return one.select("doc.*")
