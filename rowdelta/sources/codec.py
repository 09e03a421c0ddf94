"""Results as JSON and as binary frames.

A frame is little-endian: five u32 (total, added, removed, modified, unchanged), then the rows. A row is a u8 (1 added, 2 removed,
3 modified, 4 unchanged), its key and its row map or maps; a modified row ends with the number of differences and their
column, old and new values. A string is its length in bytes (u32) and UTF-8; a map is its size (u32) and its names and values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"added": 1, "removed": 2, "modified": 3, "unchanged": 4}
_NAMES = {n: s for s, n in TYPES.items()}
_ORDER = ("added", "removed", "modified", "unchanged")


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON object for each row, with the names and shapes of each status."""
    diffs = F.transform("differences", lambda d: F.struct(d["column"].alias("column"), d["old_value"].alias("oldValue"), d["new_value"].alias("newValue"), F.coalesce(d["diff"], F.array().cast("array<struct<added:boolean,removed:boolean,value:string>>")).alias("diff")))
    added = F.struct(F.col("status").alias("type"), "key", F.col("target_row").alias("targetRow"))
    removed = F.struct(F.col("status").alias("type"), "key", F.col("source_row").alias("sourceRow"))
    modified = F.struct(F.col("status").alias("type"), "key", F.col("source_row").alias("sourceRow"), F.col("target_row").alias("targetRow"), diffs.alias("differences"))
    unchanged = F.struct(F.col("status").alias("type"), "key", F.col("source_row").alias("row"))
    s = F.col("status")
    return rows.select(F.when(s == "added", F.to_json(added)).when(s == "removed", F.to_json(removed)).when(s == "modified", F.to_json(modified)).otherwise(F.to_json(unchanged)).alias("json"))


def _text(value: str) -> bytes:
    data = value.encode()
    return struct.pack("<I", len(data)) + data


def _row_map(row: dict[str, str]) -> bytes:
    return struct.pack("<I", len(row)) + b"".join(_text(k) + _text(v or "") for k, v in row.items())


def encode_row(status: str, key: str, source: dict[str, str] | None, target: dict[str, str] | None, differences: list) -> bytes:
    out = struct.pack("<B", TYPES[status]) + _text(key)
    if status != "added":
        out += _row_map(source or {})
    if status in ("added", "modified"):
        out += _row_map(target or {})
    if status == "modified":
        out += struct.pack("<I", len(differences)) + b"".join(_text(d["column"]) + _text(d["old_value"]) + _text(d["new_value"]) for d in differences)
    return out


def encode_rows(rows: DataFrame) -> DataFrame:
    """(status, data): each row's bytes, encoded in the tasks."""

    @F.udf("binary", useArrow=True)
    def encode(status, key, source, target, differences):
        return encode_row(status, key, source and dict(source), target and dict(target), [d if isinstance(d, dict) else d.asDict() for d in differences])

    return rows.select("status", encode("status", "key", "source_row", "target_row", "differences").alias("data"))


def frame_head(counts: dict[str, int]) -> bytes:
    return struct.pack("<5I", sum(counts.values()), *[counts.get(s, 0) for s in _ORDER])


def to_binary_frame(rows: DataFrame) -> bytes:
    """A whole frame, for export of a result that fits the driver; ``write_frames`` is the form for large ones."""
    encoded = encode_rows(rows).persist()
    counts = {r["status"]: r["count"] for r in encoded.groupBy("status").count().collect()}
    head = frame_head(counts)
    rank = F.array_position(F.array(*[F.lit(s) for s in _ORDER]), F.col("status"))
    body = b"".join(bytes(r["data"]) for r in encoded.orderBy(rank).toLocalIterator())
    encoded.unpersist()
    return head + body


#: Bytes of rows after which a task closes a frame.
FRAME_BYTES = 8 << 20
#: Bytes of rows that are encoded or decoded at once.
_SLICE = 8 << 20
_FRAME = ", ".join([*[f"{s} long" for s in _ORDER], "data binary", "row_bytes binary"])
_ROW = "status string, key string, source_row map<string,string>, target_row map<string,string>, differences array<struct<column:string,old_value:string,new_value:string>>"


def _u32(numbers: np.ndarray) -> pa.Array:
    """Numbers as four bytes each."""
    places = np.arange(0, 4 * len(numbers) + 4, 4, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(numbers, "<u4"))])


def _sized(values: pa.Array) -> pa.Array:
    """Strings with their length before them; a null is an empty one."""
    data = values.cast(pa.binary()).fill_null(b"")
    return pc.binary_join_element_wise(_u32(pc.binary_length(data).to_numpy()), data, b"")


def _listed(lists: pa.Array, wanted: pa.Array, fields: list[pa.Array]) -> pa.Array:
    """Of each wanted list its size and its entries' fields; nothing of the others."""
    entries = pc.binary_join_element_wise(*[_sized(f) for f in fields], b"")
    sizes = np.diff(lists.offsets.to_numpy())
    joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, entries), b"")
    return pc.if_else(wanted, pc.binary_join_element_wise(_u32(sizes), joined, b""), pa.scalar(b"", pa.binary()))


def _encoded(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """Places of the rows' statuses in ``_ORDER`` and the rows' bytes, column by column."""
    kinds = pc.index_in(batch.column("status"), pa.array(_ORDER))
    if kinds.null_count:
        raise ValueError("Unknown row type")
    kinds = kinds.to_numpy()
    old, new, changed = (batch.column(c) for c in ("source_row", "target_row", "differences"))
    has_old, has_new, has_changes = (pa.array(np.isin(kinds, [_ORDER.index(s) for s in of])) for of in (("removed", "modified", "unchanged"), ("added", "modified"), ("modified",)))
    parts = [
        pa.Array.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer(np.arange(len(kinds) + 1, dtype=np.int32)), pa.py_buffer((kinds + 1).astype(np.uint8))]),
        _sized(batch.column("key")),
        _listed(old, has_old, [old.keys, old.items]),
        _listed(new, has_new, [new.keys, new.items]),
        _listed(changed, has_changes, [changed.values.field(c) for c in ("column", "old_value", "new_value")]),
    ]
    return kinds, pc.binary_join_element_wise(*parts, b"")


def encode_frames(rows: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """A result as frames of about ``frame_bytes``, each complete in itself, with their counts: tasks make their own rows' frames, nothing goes through the driver.

    ``row_bytes`` has the bytes of each row of the frame (u32), so that its rows can be decoded beside each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        sizes: list[np.ndarray] = []
        counts, size = np.zeros(4, np.int64), 0

        def frame() -> pa.RecordBatch:
            found = dict(zip(_ORDER, counts.tolist(), strict=True))
            columns = {s: pa.array([n], pa.int64()) for s, n in found.items()}
            return pa.RecordBatch.from_pydict(columns | {"data": pa.array([frame_head(found) + b"".join(held)], pa.binary()), "row_bytes": pa.array([np.concatenate(sizes).astype("<u4").tobytes()], pa.binary())})

        for whole in batches:
            step = max(1, whole.num_rows * _SLICE // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                # Taken, not sliced, so that lists and their values begin at nought.
                batch = whole if step >= whole.num_rows else pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(at, min(at + step, whole.num_rows)))) for c in whole.columns], whole.schema.names)
                kinds, encoded = _encoded(batch)
                ends = np.frombuffer(encoded.buffers()[1], np.int32)[encoded.offset : encoded.offset + len(encoded) + 1].astype(np.int64)
                data, lo = memoryview(encoded.buffers()[2] or b""), 0
                while lo < len(kinds):
                    full = np.searchsorted(ends[lo + 1 :], ends[lo] + frame_bytes - size)
                    hi = min(len(kinds), lo + int(full) + 1)
                    held.append(bytes(data[ends[lo] : ends[hi]]))
                    sizes.append(np.diff(ends[lo : hi + 1]))
                    counts += np.bincount(kinds[lo:hi], minlength=4)
                    size += len(held[-1])
                    if size >= frame_bytes:
                        yield frame()
                        held, sizes, counts, size = [], [], np.zeros(4, np.int64), 0
                    lo = hi
        if held:
            yield frame()

    slim = F.transform("differences", lambda d: F.struct(d["column"].alias("column"), d["old_value"].alias("old_value"), d["new_value"].alias("new_value"))).alias("differences")
    return rows.select("status", "key", "source_row", "target_row", slim).mapInArrow(run, _FRAME)


class _Side:
    """Rows of a frame that are decoded beside each other: ``at`` is the place that each has come to."""

    def __init__(self, raw: np.ndarray, at: np.ndarray) -> None:
        self.raw, self.at = raw, at.copy()

    def _move(self, which: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        began = self.at[which]
        if len(began) and (began + n).max() > len(self.raw):
            raise ValueError(f"Buffer overflow: a row goes on beyond {len(self.raw)}")
        self.at[which] = began + n
        return began

    def u32(self, which: np.ndarray) -> np.ndarray:
        at = self._move(which, 4)
        return sum(self.raw[at + k].astype(np.int64) << (8 * k) for k in range(4))

    def text(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.u32(which)
        return self._move(which, n), n

    def strings(self, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.raw[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
        out = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        out.validate(full=True)
        return out

    def lists(self, which: np.ndarray, fields: int) -> tuple[np.ndarray, list[pa.Array]]:
        """Offsets of the lists of these rows, of none for the others, and their entries' fields."""
        sizes = np.zeros(len(self.at), np.int64)
        sizes[which] = self.u32(which)
        if sizes.sum() * 4 * fields > len(self.raw):
            raise ValueError("Buffer overflow: more entries than bytes")
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = np.zeros((fields, 2, offsets[-1]), np.int64)
        k = 0
        while len(which := which[sizes[which] > k]):
            for f in range(fields):
                places[f][:, offsets[which] + k] = self.text(which)
            k += 1
        return offsets.astype(np.int32), [self.strings(*p) for p in places]


def _row_bytes(data: bytes, total: int) -> np.ndarray:
    """The size of each row of a frame, row after row."""
    r = _Reader(data)
    r.take(20)
    out = np.zeros(min(total, len(data)), np.int64)
    for k in range(total):
        began = r.at
        _read_row(r)
        out[k] = r.at - began
    return out


def _decoded(data: bytes, row_bytes: bytes | None) -> Iterator[pa.RecordBatch]:
    total, *counts = struct.unpack("<5I", _Reader(data).take(20))
    sizes = _row_bytes(data, total) if row_bytes is None else np.frombuffer(row_bytes, "<u4").astype(np.int64)
    ends = 20 + np.concatenate([[0], np.cumsum(sizes)])
    if len(sizes) != total or ends[-1] > len(data):
        raise ValueError("The sizes of the rows don't agree with the frame")
    raw, seen, lo = np.frombuffer(data, np.uint8), np.zeros(4, np.int64), 0
    while lo < total:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _SLICE, side="right")) - 1)
        side = _Side(raw, ends[lo:hi])
        every = np.arange(hi - lo)
        kinds = raw[side._move(every, 1)].astype(np.int64) - 1
        if kinds.min() < 0 or kinds.max() > 3:
            raise ValueError("Unknown row type")
        seen += np.bincount(kinds, minlength=4)
        added, modified, unchanged = (kinds == _ORDER.index(s) for s in ("added", "modified", "unchanged"))
        removed = kinds == _ORDER.index("removed")
        key = side.strings(*side.text(every))
        old, old_fields = side.lists(np.flatnonzero(~added), 2)
        new, new_fields = side.lists(np.flatnonzero(added | modified), 2)
        changed, fields = side.lists(np.flatnonzero(modified), 3)
        if (side.at != ends[lo + 1 : hi + 1]).any():
            raise ValueError("The sizes of the rows don't agree with the frame")
        rows = lambda offsets, none, of: pa.MapArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(none, False)), *of)
        differences = pa.ListArray.from_arrays(pa.array(changed, pa.int32()), pa.StructArray.from_arrays(fields, ["column", "old_value", "new_value"]))
        columns = [pa.array(_ORDER).take(pa.array(kinds)), key, rows(old, added, old_fields), rows(new, removed | unchanged, new_fields), differences]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW_ROW, strict=True)], schema=_ARROW_ROW)
        lo = hi
    if seen.tolist() != counts:
        raise ValueError("The header's counts don't agree with the rows")


def decode_frames(frames: DataFrame) -> DataFrame:
    """The rows of frames: status, key, source_row, target_row, differences. An unchanged row is its source's.

    The rows of a frame are decoded beside each other where the frame comes with ``row_bytes``; else it is read through for them first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, row_bytes in zip(batch.column("data"), batch.column("row_bytes"), strict=True):
                yield from _decoded(data.as_py(), row_bytes.as_py())

    known = "row_bytes" if "row_bytes" in frames.columns else F.lit(None).cast("binary").alias("row_bytes")
    return frames.select("data", known).mapInArrow(run, _ROW)


_TEXTS = pa.map_(pa.string(), pa.string())
_ARROW_ROW = pa.schema([("status", pa.string()), ("key", pa.string()), ("source_row", _TEXTS), ("target_row", _TEXTS), ("differences", pa.list_(pa.struct([("column", pa.string()), ("old_value", pa.string()), ("new_value", pa.string())])))])


def write_frames(rows: DataFrame, path: str, frame_bytes: int = FRAME_BYTES) -> None:
    """Write a result as frames. The files are committed by Spark as a whole, with each frame's counts beside it."""
    encode_frames(rows, frame_bytes).write.mode("overwrite").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_frames`` has written, decoded in the tasks that read them."""
    return decode_frames(spark.read.parquet(path))


def frame_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows of each status in written frames, from their counts alone."""
    found = spark.read.parquet(path).agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in _ORDER]).first()
    return {s: found[s] for s in _ORDER}


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if self.at + n > len(self.data):
            raise ValueError(f"Buffer overflow: {n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def text(self) -> str:
        return bytes(self.take(self.u32())).decode()

    def row(self) -> dict[str, str]:
        return {self.text(): self.text() for _ in range(self.u32())}


def _read_row(r: _Reader) -> tuple[str, dict]:
    status = _NAMES.get(r.take(1)[0])
    if status is None:
        raise ValueError("Unknown row type")
    row: dict = {"key": r.text()}
    if status == "unchanged":
        row["row"] = r.row()
    if status in ("removed", "modified"):
        row["sourceRow"] = r.row()
    if status in ("added", "modified"):
        row["targetRow"] = r.row()
    if status == "modified":
        row["differences"] = [{"column": r.text(), "oldValue": r.text(), "newValue": r.text()} for _ in range(r.u32())]
    return status, row


def decode_frame(data: bytes) -> dict[str, list[dict]]:
    """The rows of a frame by status; the header's counts must agree with them."""
    r = _Reader(data)
    total, *counts = struct.unpack("<5I", r.take(20))
    out: dict[str, list[dict]] = {s: [] for s in _ORDER}
    for _ in range(total):
        status, row = _read_row(r)
        out[status].append(row)
    if [len(out[s]) for s in _ORDER] != counts:
        raise ValueError("The header's counts don't agree with the rows")
    return out
