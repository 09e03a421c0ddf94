"""Blocks of whole texts, and the exchange that tells each block which of its fingerprints occur elsewhere too.

Texts are dealt into blocks by hash, each of a few MB, and travel compressed. A block sends the sorted distinct fingerprints of what it
holds to buckets by their leading bits, packed to bytes; a bucket sees all fingerprints of its range and answers each block with one byte for each one
sent. So the shuffle moves a few bytes for each fingerprint and never a row for each, a fingerprint that is everywhere is sent
once by each block, and a block's or bucket's size does not grow with the table, whose size sets their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, shuffle_width, text_or_empty

BLOCK_BYTES = 6 << 20
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])


def counts(docs: DataFrame, text_col: str = "text", size: int = BLOCK_BYTES) -> tuple[int, int]:
    """Numbers of blocks and of buckets. Their product bounds the rows of an exchange, so there are half as many buckets as blocks."""
    total = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)))).collect()[0][0] or 0
    width, n = shuffle_width(docs.sparkSession), -(-total // size)
    return max(width, n), max(width, n // 2)


def gathered(batches: Iterator[pa.RecordBatch], most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``most`` bytes, so that what a task sends to a block is a few large parts."""
    held: list[pa.RecordBatch] = []
    size = 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from whole()
            held, size = [], 0
    if held:
        yield from whole()


def dealt(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (block, data): texts as compressed Arrow streams. Copies of a text fall into different blocks, as the id decides too."""
    block = F.pmod(F.xxhash64(F.col(id_col), text_or_empty(text_col), F.lit(3)), F.lit(n)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"), block.alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in gathered(batches):
            blocks = batch.column("block").to_numpy()
            order = np.argsort(blocks, kind="stable")
            cuts = np.flatnonzero(np.diff(blocks[order])) + 1
            names, out = [], []
            for rows_of in np.split(order, cuts) if len(order) else []:
                sink = pa.BufferOutputStream()
                part = pa.record_batch([batch.column("doc_id").take(pa.array(rows_of)), batch.column("text").cast(pa.binary()).take(pa.array(rows_of))], schema=_SCHEMA)
                with pa.ipc.new_stream(sink, _SCHEMA, options=options) as writer:
                    writer.write_batch(part)
                names.append(int(blocks[rows_of[0]]))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], ["block", "data"])

    return in_batches(rows).mapInArrow(run, "block int, data binary")


def opened(group: pa.Table) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_id, text) of a block, a packed part at a time."""
    for data in group.column("data"):
        for batch in pa.ipc.open_stream(data.as_buffer()):
            yield batch.column("doc_id"), batch.column("text")


def bucket_of(prints: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each fingerprint by its leading 32 bits; rises with the fingerprint."""
    return ((prints >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def sent(block: int, records: np.ndarray, prints: np.ndarray, n: int) -> pa.Table:
    """Rows (bucket, block, data) of a block's ``records`` (bytes of shape (rows, width)), which are sorted by ``prints``."""
    buckets = bucket_of(prints, n)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    at = np.concatenate([[0], cuts, [len(buckets)]]).astype(np.int64) if len(buckets) else np.zeros(1, np.int64)
    parts = [records[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"bucket": pa.array(buckets[at[:-1]], pa.int32()), "block": pa.array(np.full(len(parts), block), pa.int32()), "data": pa.array(parts, pa.binary())})


SENT = "bucket int, block int, data binary"


def answered(sent_rows: DataFrame, judge: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> DataFrame:
    """Let ``judge(records, block)`` give one byte for each record of a bucket: rows (block, bucket, reply)."""

    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in group.column("data").to_pylist()]
        blocks = group.column("block").to_numpy()
        sizes = [len(p) for p in parts]
        verdict = judge(np.concatenate(parts), np.repeat(blocks, sizes)).astype(np.uint8)
        replies = [x.tobytes() for x in np.split(verdict, np.cumsum(sizes)[:-1])]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "reply": pa.array(replies, pa.binary())})

    return sent_rows.groupBy("bucket").applyInArrow(run, "block int, bucket int, reply binary")


def packed_prints(*prints: np.ndarray, width: int = 8) -> np.ndarray:
    """Records of the first ``width`` bytes of each fingerprint."""
    return np.concatenate([p.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width] for p in prints], axis=1)


def repeated(records: np.ndarray, _block: np.ndarray) -> np.ndarray:
    """1 for each record that is there more than once, that is, which another block has sent too if a block sends each once."""
    columns = []
    for at in range(0, records.shape[1], 8):
        part = records[:, at : at + 8]
        value = np.zeros((len(part), 8), np.uint8)
        value[:, : part.shape[1]] = part
        columns.append(value.view("<u8").ravel())
    _, place, n = distinct(*columns)
    return n[place] > 1


def distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The different rows of several columns in the order of the first column, then the next; each row's place among them; how often each occurs."""
    order = np.lexsort(columns[::-1])
    ordered = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in ordered])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return [c[new] for c in ordered], place, np.bincount(place, minlength=int(new.sum()))


def reply_of(replies: pa.Table) -> np.ndarray:
    """A block's replies in the order of what it sent: buckets rise with the fingerprints."""
    order = np.argsort(replies.column("bucket").to_numpy(), kind="stable")
    parts = replies.column("reply").to_pylist()
    return np.concatenate([np.frombuffer(parts[i], np.uint8) for i in order]) if len(order) else np.zeros(0, np.uint8)


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the intervals: maximal runs, sorted; touching intervals join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > reach[:-1]])
    return s[new], np.concatenate([reach[:-1][new[1:]], reach[-1:]])
