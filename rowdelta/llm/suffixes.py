"""Substring dedup over bytes by prefix doubling.

The rank of a position at offset h stands for the h bytes from there; the pair of ranks at p and p + h ranks the position at 2h. Ranks are
64-bit fingerprints of such pairs rather than places in a sorted list: two positions have the same rank when their bytes agree, which is all
that removal asks for, and a task can double its own positions without the others. Spark's part is the reranking, that is to
group equal ranks of all documents and to let unique positions drop out:

1. Positions are doubled to 256 bytes. Of every 145 neighbouring positions the one with the smallest rank is an anchor, so any 400 bytes hold
   an anchor and copies of them hold the same one. Anchors' ranks are grouped over all blocks; those that are unique drop out. An
   anchor whose whole surroundings (all 400-byte strings over it) occur again is settled.
2. What remains are anchors that share their 256 bytes but not all surroundings, at the ends of repeated passages. For these the ranks at 400, the
   pairs of 256-ranks at p and p + 144, are grouped over all blocks for every position around the anchor.

Then every byte under a settled anchor's strings or a repeated 400-byte string is removed. What is compared in the end are 128 bits or more: ranks,
and beside them hashes of the same bytes by another rule.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import _BYTE, _OTHER_BYTE, mix64, pieces, span_hashes

LENGTH, HALF = 400, 256
STEP = LENGTH - HALF
_K = [np.uint64(k) for k in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
#: Low bits of a rank that give way to the position, so that a minimum also says where it is and ties go to the left. They
#: hold any place in an Arrow column of text, which has at most 2 GB.
_AT = np.uint64((1 << 31) - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of two neighbouring strings from their ranks."""
    out = a * _K[0]
    out ^= out >> np.uint64(31)
    out += b
    out *= _K[1]
    out ^= out >> np.uint64(29)
    return out


def doubled(data: np.ndarray, size: int = HALF) -> np.ndarray:
    """Ranks at ``size`` (a power of two) of every position that has so many bytes."""
    rank, h = _BYTE[data], 1
    while h < size:
        if len(rank) <= h:
            return np.zeros(0, np.uint64)
        rank = _pair(rank[:-h], rank[h:])
        h *= 2
    return rank


class _Part:
    """Texts that lie one after another, with their ranks and anchors."""

    def __init__(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        self.ids, self.data, self.offsets = ids, data, offsets
        self.rank = doubled(data)
        sizes = np.diff(offsets)
        starts = offsets[:-1][sizes >= LENGTH]
        ends = offsets[1:][sizes >= LENGTH]
        edge = np.zeros(len(data) + 1, np.int32)
        edge[starts] += 1
        np.add.at(edge, ends - LENGTH + 1, -1)
        whole = np.flatnonzero(np.cumsum(edge)[:-1] > 0)  # where a 400-byte string begins
        at = np.zeros(0, np.int64)
        if len(whole):
            least = (self.rank & ~_AT) | np.arange(len(self.rank), dtype=np.uint64)
            h = 1
            while 2 * h <= STEP + 1:
                least = np.minimum(least[:-h], least[h:])
                h *= 2
            rest = STEP + 1 - h
            least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
            hit = np.zeros(len(data), bool)
            hit[(least[whole] & _AT).astype(np.int64)] = True
            at = np.flatnonzero(hit)
        doc = np.searchsorted(offsets, at, "right") - 1
        self.anchors, begin, end = at, offsets[doc], offsets[doc + 1]
        left, right = np.minimum(STEP, at - begin), np.minimum(STEP, end - at - HALF)
        #: First and last string over each anchor.
        self.low, self.high = at - left, np.minimum(at, end - LENGTH)
        #: Ranks of the anchors, and two independent hashes of their surroundings.
        self.marks = [np.zeros(0, np.uint64)] * 3
        if len(at):
            around = _pair(_pair(self.rank[at - left], self.rank[at]), self.rank[at + right]) + (left * (STEP + 1) + right).astype(np.uint64) * _K[2]
            self.marks = [mix64(self.rank[at]), around, self._other(at - left, at + HALF + right) + left.astype(np.uint64) * _K[1]]

    def _other(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches that don't come from the ranks."""
        return span_hashes(_OTHER_BYTE[self.data], starts, ends)

    def at_length(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks at 400, and another hash of the same bytes."""
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return mix64(_pair(self.rank[starts], self.rank[starts + STEP])), self._other(starts, starts + LENGTH)

    def strings_over(self, some: np.ndarray) -> np.ndarray:
        """Where the 400-byte strings over these anchors begin."""
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, self.low[some], 1)
        np.add.at(step, self.high[some] + 1, -1)
        return np.flatnonzero(np.cumsum(step)[:-1] > 0)


def _parts(group: pa.Table) -> list[_Part]:
    with np.errstate(over="ignore"):
        return [_Part(ids.slice(at, len(offsets) - 1), data, offsets) for ids, texts in blocks.opened(group) for at, data, offsets in pieces(texts)]


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *arrays])


def _anchor_table(parts: list[_Part]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct (rank, surroundings) rows of a block in order, the place of each anchor among them, and how often each occurs."""
    return blocks.distinct(*[_joined([p.marks[k] for p in parts]) for k in range(3)])


def _send_anchors(n: int):
    def run(group: pa.Table) -> pa.Table:
        marks, _, times = _anchor_table(_parts(group))
        records = np.concatenate([blocks.packed_prints(*marks), (times > 1).astype(np.uint8)[:, None]], axis=1)
        return blocks.sent(group.column("block")[0].as_py(), records, marks[0], n)

    return run


def _rank_anchors(records: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Bit 0: the surroundings occur again, so the anchor is settled. Bit 1: the block has to send the strings over the anchor."""
    marks = np.ascontiguousarray(records[:, :24]).view("<u8")
    times = 1 + records[:, 24].astype(np.int64)
    order = np.lexsort((block, marks[:, 2], marks[:, 1], marks[:, 0]))
    p, b = marks[order], times[order]
    first = np.ones(len(p), bool)
    first[1:] = (p[1:] != p[:-1]).any(axis=1)
    of_mark = np.cumsum(first) - 1
    count = np.bincount(of_mark, weights=b)[of_mark]
    of_rank = np.cumsum(np.concatenate([[True], p[1:, 0] != p[:-1, 0]])) - 1
    kinds = np.bincount(of_rank, weights=first)[of_rank]
    out = np.empty(len(p), np.uint8)
    out[order] = (count > 1) | (((kinds > 1) & ((count == 1) | first)).astype(np.uint8) << 1)
    return out


def _open_strings(parts: list[_Part], status: np.ndarray) -> tuple[list[np.ndarray], tuple]:
    """Where the strings begin that have to be compared, for each part, and the distinct pairs of their hashes (as ``blocks.distinct``)."""
    starts, hashes, at = [], [], 0
    for p in parts:
        mine = status[at : at + len(p.anchors)]
        at += len(p.anchors)
        starts.append(p.strings_over(mine & 2 > 0))
        hashes.append(p.at_length(starts[-1]))
    return starts, blocks.distinct(*[_joined([h[k] for h in hashes]) for k in range(2)])


def _status(parts: list[_Part], replies: pa.Table) -> np.ndarray:
    place = _anchor_table(parts)[1]
    return blocks.reply_of(replies)[place] if len(place) else np.zeros(0, np.uint8)


def _send_strings(n: int):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        parts = _parts(group)
        _, (pairs, _, _) = _open_strings(parts, _status(parts, replies))
        return blocks.sent(group.column("block")[0].as_py(), blocks.packed_prints(*pairs), pairs[0], n)

    return run


def _remove(group: pa.Table, replies: pa.Table) -> pa.Table:
    round_ = replies.column("round").to_numpy()
    parts = _parts(group)
    status = _status(parts, replies.filter(pa.array(round_ == 1)))
    starts, (_, place, n) = _open_strings(parts, status)
    again = ((n > 1) | (blocks.reply_of(replies.filter(pa.array(round_ == 2))) > 0))[place] if len(place) else np.zeros(0, bool)
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    at = tested = 0
    for p, begin in zip(parts, starts, strict=True):
        settled = status[at : at + len(p.anchors)] & 1 > 0
        at += len(p.anchors)
        hit = begin[again[tested : tested + len(begin)]]
        tested += len(begin)
        step = np.zeros(len(p.data) + 1, np.int64)
        np.add.at(step, p.low[settled], 1)
        np.add.at(step, p.high[settled] + LENGTH, -1)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + LENGTH, -1)
        gone = np.cumsum(step)[:-1] > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        bounds = p.offsets
        inner = bounds[:-1][bounds[:-1] < len(gone)]
        first[inner] |= gone[inner]
        removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(first)])
        kept, kept_at = p.data[~gone], bounds - removed[bounds]
        out["doc_id"] += p.ids.to_pylist()
        out["n_bytes"] += np.diff(bounds).tolist()
        out["n_removed"] += np.diff(removed[bounds]).tolist()
        out["n_spans"] += np.diff(spans[bounds]).tolist()
        out["kept_sha256"] += [hashlib.sha256(kept[a:b].tobytes()).hexdigest() for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)]
    return pa.table({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that are left).

    A byte of the UTF-8 text goes when a 400-byte string over it starts anywhere else as well, in the same document or another;
    overlaps count, and the input counts, not what is left. Null texts are empty; null ids and rows that repeat are documents like
    others; texts under 400 bytes stay whole; an empty table gives no rows.
    """
    n_blocks, n = blocks.counts(docs, text_col)
    packed = blocks.dealt(docs, n_blocks, id_col, text_col)
    anchors = packed.groupBy("block").applyInArrow(_send_anchors(n), blocks.SENT)
    first = blocks.answered(anchors, _rank_anchors, 25)
    strings = packed.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_send_strings(n), blocks.SENT)
    second = blocks.answered(strings, blocks.repeated, 16)
    replies = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
