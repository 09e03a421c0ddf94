"""Packing documents into sequences by first-fit decreasing in randomised groups.

Each document's token ids are cut into full sequences and a rest. Every piece goes to a group by a hash; within a group the pieces stand
by falling length and each goes to the first open sequence with room for it, found by walking down a tournament tree whose inner nodes
hold the largest capacity below them. Groups are independent tasks of bounded size.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

CAPACITY = 1024
#: Pieces of a group, about: enough for little padding, few enough for a small task.
GROUP = 4096
_USUAL = re.compile(r"[^\x00-\x7f¡-ɏ‐-‧€]")
_ENDING = 0


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, tokenizer: str, ranks: str | None) -> list[int]:
    """Ids of ``text`` by the tokenizer's file, without special tokens added.

    Where ``ranks`` names the same vocabulary as merge ranks, texts of usual letters without ``<|`` are encoded from it: the ids are
    the same and it takes a quarter of the time. Other texts go to the tokenizer itself.
    """
    if ranks and "<|" not in text and not _USUAL.search(text):
        return _ranks(ranks).encode_ordinary(text)
    return _tokenizer(tokenizer).encode(text, add_special_tokens=False).ids


def _cutter(tokenizer: str, ranks: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*token_ids(text, tokenizer, ranks), _ENDING], dtype="<u4")
                rows += [(doc, at, min(capacity, len(ids) - at), zlib.crc32(ids[at : at + capacity].tobytes()), len(ids)) for at in range(0, len(ids), capacity)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Sequences:
    """Open sequences as the leaves of a tournament tree of free capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.n, self.leaves = capacity, 0, 1
        self.tree = [0, 0]

    def _grow(self) -> None:
        old, k = self.tree[self.leaves :], self.leaves * 2
        self.tree = [0] * k + old + [0] * (k - len(old))
        self.leaves = k
        for i in range(k - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def _set(self, leaf: int, free: int) -> None:
        i = self.leaves + leaf
        self.tree[i] = free
        while i > 1:
            i //= 2
            top = max(self.tree[2 * i], self.tree[2 * i + 1])
            if self.tree[i] == top:
                break
            self.tree[i] = top

    def put(self, size: int) -> tuple[int, int]:
        """The first sequence with room for ``size`` and the offset in it; a new one if there is none."""
        if self.tree[1] < size:
            if self.n == self.leaves:
                self._grow()
            self.n += 1
            self._set(self.n - 1, self.capacity - size)
            return self.n - 1, 0
        i = 1
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] >= size else 2 * i + 1
        free = self.tree[i]
        self._set(i - self.leaves, free - size)
        return i - self.leaves, self.capacity - free


def _first_fit(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        names = ["length", "doc_id", "start", "ids_crc32", "doc_tokens"]
        order = group.append_column("_i", pa.array(np.arange(len(lengths)))).sort_by([(n, "descending" if n == "length" else "ascending") for n in names]).column("_i").to_numpy()
        open_, seq, off = Sequences(capacity), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i in order:
            seq[i], off[i] = open_.put(int(lengths[i]))
        base = group.column("_group").to_numpy() << np.int64(32)
        return group.drop_columns(["_group"]).append_column("sequence_id", pa.array(base + seq)).append_column("offset", pa.array(off))

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Place every token of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, a row for each piece.

    A document is its text's ids and id 0; null and empty texts are that one id. Null ids and rows that repeat are documents like
    others. Longer documents are cut at multiples of ``capacity``. The number of groups follows the number of documents and their bytes, that is the pieces; a group is
    chosen by a hash of id and content, so a hot source is spread, and reruns give the same sequences. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).collect()[0]
    groups = max(1, -(-(rows + size // (4 * capacity)) // group))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = in_batches(texts).mapInArrow(_cutter(tokenizer, ranks, capacity), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(17)), F.lit(groups)).cast("long"))
    return dealt.groupBy("_group").applyInArrow(_first_fit(capacity), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
