"""Substring dedup over words: every window of a fixed number of words has a Rabin-Karp hash; hashes are counted over all documents and windows
that repeat are merged to maximal intervals, whose words are removed.

Counting goes in two rounds. In the first every window's hash is sent, cut to a few bytes, which finds all windows that repeat and hardly any other.
In the second those windows alone are sent with 128 bits of two independent hashes, which decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import Words, pieces, span_hashes

WINDOW = 35
#: Bytes of a hash in the first round; its bucket tells some bits more. What they confuse is told apart in the second.
FIRST_WIDTH = 4


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window that lies in one document."""
    first = np.arange(max(0, len(words.starts) - window + 1))
    if len(first):
        doc = np.searchsorted(words.bounds, np.arange(len(words.starts)), "right")
        first = first[doc[first] == doc[first + window - 1]]
    return first, span_hashes(words.hashes, first, first + window) if len(first) else np.zeros(0, np.uint64)


class _Block:
    """The texts of a block with all their windows."""

    def __init__(self, group: pa.Table, window: int) -> None:
        self.parts, self.window = [], window
        found = [np.zeros(0, np.uint64)]
        for ids, texts in blocks.opened(group):
            for at, data, offsets in pieces(texts):
                words = Words(data, offsets)
                first, h = _windows(words, window)
                self.parts.append((ids.slice(at, len(offsets) - 1), data, words, first))
                found.append(h)
        self.hashes = np.concatenate(found)
        self.distinct, self.place, self.times = np.unique(self.hashes, return_inverse=True, return_counts=True)

    def again(self, reply: np.ndarray) -> None:
        """What may repeat: windows whose hash the block has more than once, or another block seems to have too. Those get a second hash."""
        elsewhere = reply > 0
        self.maybe = np.flatnonzero(((self.times > 1) | elsewhere)[self.place])
        second, at = [np.zeros(0, np.uint64)], 0
        for _, data, words, first in self.parts:
            mine = self.maybe[slice(*np.searchsorted(self.maybe, [at, at + len(first)]))] - at
            at += len(first)
            if len(mine):
                second.append(span_hashes(words.other_hashes(data), first[mine], first[mine] + self.window))
        self.pairs, self.pair_of, self.pair_times = blocks.distinct(self.hashes[self.maybe], np.concatenate(second))
        self.sent = elsewhere[np.searchsorted(self.distinct, self.pairs[0])] if len(self.distinct) else np.zeros(0, bool)

    def repeated(self, reply: np.ndarray) -> np.ndarray:
        """Whether each window occurs anywhere else."""
        twice = self.pair_times > 1
        twice[self.sent] |= reply > 0
        out = np.zeros(len(self.hashes), bool)
        out[self.maybe] = twice[self.pair_of]
        return out


def _send(n: int, window: int):
    def run(group: pa.Table) -> pa.Table:
        block = _Block(group, window)
        return blocks.sent(group.column("block")[0].as_py(), blocks.packed_prints(block.distinct, width=FIRST_WIDTH), block.distinct, n)

    return run


def _send_again(n: int, window: int):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(group, window)
        block.again(blocks.reply_of(replies))
        a, b = (x[block.sent] for x in block.pairs)
        return blocks.sent(group.column("block")[0].as_py(), blocks.packed_prints(a, b), a, n)

    return run


def _remove(window: int):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        round_ = replies.column("round").to_numpy()
        block = _Block(group, window)
        block.again(blocks.reply_of(replies.filter(pa.array(round_ == 1))))
        repeated = block.repeated(blocks.reply_of(replies.filter(pa.array(round_ == 2))))
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []}
        start = 0
        for ids, raw, words, first in block.parts:
            data = raw.tobytes()
            hit = first[repeated[start : start + len(first)]]
            start += len(first)
            step = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + window, -1)
            kept = np.cumsum(step)[:-1] == 0
            for k, doc in enumerate(ids.to_pylist()):
                a, b = words.bounds[k], words.bounds[k + 1]
                at = a + np.flatnonzero(kept[a:b])
                out["doc_id"].append(doc)
                out["n_words"].append(int(b - a))
                out["n_removed"].append(int(b - a - len(at)))
                out["kept_sha256"].append(hashlib.sha256(b" ".join([data[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)])).hexdigest())
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})

    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes when a window over it has the same words as a window that starts anywhere else, in the same document or another; what counts is
    the input, not what is left. Null and empty texts have no words; null ids and rows that repeat are documents like others (so a row
    repeated loses all windows); texts shorter than a window keep all words; an empty table gives no rows.
    """
    n_blocks, n = blocks.counts(docs, text_col)
    packed = blocks.dealt(docs, n_blocks, id_col, text_col)
    sent = packed.groupBy("block").applyInArrow(_send(n, window), blocks.SENT)
    first = blocks.answered(sent, blocks.repeated, FIRST_WIDTH)
    sent = packed.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_send_again(n, window), blocks.SENT)
    second = blocks.answered(sent, blocks.repeated, 16)
    replies = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
