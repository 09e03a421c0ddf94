"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only on a single machine (``local[...]``) where that is unset a
    temporary one is made.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "rowdelta-checkpoints"))
    return df.checkpoint(eager=True)


#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, after seeing to it that its session hands rows to Python in batches of a few MB.

    Spark counts 10,000 rows to a batch by default, which with whole texts is as much memory as they happen to take. What the user has set stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, BATCH_BYTES)
    return df


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text, as two longs ``k1`` and ``k2``."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OTHER_BYTE = mix64(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_R = 0x5851F42D4C957F2D | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept for the worker's next batches."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _R, dtype=np.uint64), np.full(size, _R_INVERSE, dtype=np.uint64)
            up[0] = down[0] = 1
            have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size <= 1 << 22:
            _POWERS[0] = have
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of ``values[starts:ends]`` (uint64, modulo 2**64, then finalised)."""
    up, down = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=prefix[1:])
        raw = (prefix[ends] - prefix[starts]) * down[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Words of several texts that lie one after another in ``data``; ``offsets`` has the n + 1 bounds of the texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(_BYTE[data], self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def other_hashes(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words from another table of bytes, independent of ``hashes``."""
        return span_hashes(_OTHER_BYTE[data], self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` words, sorted; fewer words than that make one shingle, none make none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = max(1, len(words) - size + 1)
        out = np.full(n, len(words[:size]), dtype=np.uint64)
        for k in range(min(size, len(words))):
            out = mix64(out * np.uint64(_R) + words[k : k + n])
    return np.unique(out)


def pieces(column, most: int = 1 << 20):
    """Slices of an Arrow string or binary column as (first row, bytes, offsets), each of about ``most`` bytes."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to
