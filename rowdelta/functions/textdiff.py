"""Word diffs of two texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CHANGES = "array<struct<added:boolean,removed:boolean,value:string>>"
_CHANGES = pa.list_(pa.struct([("added", pa.bool_()), ("removed", pa.bool_()), ("value", pa.string())]))
_TOKENS = re.compile(r"\s+|\S+")
_WHITE = np.array([chr(c).isspace() for c in range(128)] + [False] * 128)
#: White space beyond ASCII, in UTF-8, by first byte.
_WIDE_WHITE = {c.encode()[0]: [x.encode() for x in map(chr, range(128, 0x10000)) if x.isspace() and x.encode()[0] == c.encode()[0]] for c in "\xa0\u1680\u2000\u3000"}
_SAME, _REMOVED, _ADDED = range(3)


#: Edits up to which a script is that of Myers' greedy search; texts further apart are compared in rows of bits.
FEW = 256
#: Products of lengths up to which rows of bits tell how far texts are apart before the greedy search is tried.
TOLD = 1 << 22
#: Bytes of rows of bits that are kept for the way back; larger problems are parted in the middle first.
KEPT_BYTES = 1 << 26
#: Bytes of texts whose words are numbered together.
HELD_BYTES = 1 << 19
#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _kinds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A shortest edit script of two lists of numbers, as what becomes of the next number: kept, removed from ``a`` or added from ``b``.

    Numbers that only one side has are in no common subsequence and take no part in the search for the longest. How far the others
    are apart at least is known before the greedy search, which walks in vain where it is too far.
    """
    has = np.zeros((2, max(a.max(initial=0), b.max(initial=0)) + 1), bool)
    has[0, a] = has[1, b] = True
    at, to = np.flatnonzero(has[1, a]), np.flatnonzero(has[0, b])
    x, y = a[at], b[to]
    least = len(a) + len(b) - 2 * min(len(x), len(y))
    if least <= FEW and len(x):
        n_x, n_y = (np.bincount(side, minlength=has.shape[1]) for side in (x, y))
        least = len(a) + len(b) - 2 * int(np.minimum(n_x, n_y).sum())
    if least <= FEW:
        apart = len(a) + len(b) - 2 * int(_lengths(x, y)[-1]) if len(x) * len(y) <= TOLD else 0
        found = _greedy(a.tolist(), b.tolist()) if apart <= FEW else None
        if found is not None:
            return found
    parts, i, j = [], 0, 0
    for u, v, i_end, j_end in _common(x, y):
        i_end, j_end = (int(at[i_end]) if i_end < len(at) else len(a)), (int(to[j_end]) if j_end < len(to) else len(b))
        parts.append(_placed(at[u] - i, to[v] - j, i_end - i, j_end - j))
        i, j = i_end, j_end
    return np.concatenate(parts)


def _placed(at: np.ndarray, to: np.ndarray, n: int, m: int) -> np.ndarray:
    """The script that keeps these places of ``n`` and ``m``: what is added between them comes before what is removed."""
    kinds = np.full(n + m - len(at), _REMOVED, np.int8)
    added = np.delete(np.arange(m), to)
    kept = np.searchsorted(to, added)
    kinds[added + np.concatenate([[0], at + 1])[kept] - kept] = _ADDED
    kinds[at + to - np.arange(len(at))] = _SAME
    return kinds


def _greedy(a: list[int], b: list[int]) -> np.ndarray | None:
    """The script of Myers' greedy search, walked back over its frontiers, if it has few edits."""
    n, m = len(a), len(b)
    most = min(n + m, FEW)
    zero = most + 1
    front = [-1] * (2 * zero + 1)
    front[zero + 1] = 0
    frontiers = []
    for d in range(most + 1):
        frontiers.append(front.copy())
        for k in range(-d, d + 1, 2):
            left, right = front[zero + k - 1], front[zero + k + 1]
            x = right if left < right else left + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            front[zero + k] = x
            if x >= n and y >= m:
                return _walk_back(n, m, frontiers, zero)
    return None


def _walk_back(x: int, y: int, frontiers: list[list[int]], zero: int) -> np.ndarray:
    out: list[int] = []
    for d in range(len(frontiers) - 1, 0, -1):
        front, k = frontiers[d], x - y
        left, right = front[zero + k - 1], front[zero + k + 1]
        down = left < right
        px = right if down else left
        py = px - k - 1 if down else px - k + 1
        out += [_SAME] * (x - px if down else y - py)
        out.append(_ADDED if down else _REMOVED)
        x, y = px, py
    return np.array((out + [_SAME] * x)[::-1], np.int8)


def _rises(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """For each beginning of ``b`` a number whose bit i is 0 where the longest common subsequence with the first i + 1 of ``a`` is longer than with the first i.

    One addition and one subtraction of numbers with as many bits as ``a`` has tokens make the next from the last. Bits beyond those mean nothing.
    """
    places: dict[int, int] = dict.fromkeys(b.tolist(), 0)
    often = int(np.bincount(a).argmax()) if len(a) else -1  # a space most likely; its places are packed at once
    rest = np.flatnonzero(a != often)
    for i, token in zip(rest.tolist(), a[rest].tolist(), strict=True):
        if token in places:
            places[token] |= 1 << i
    if often in places:
        places[often] = int.from_bytes(np.packbits(a == often, bitorder="little").tobytes(), "little")
    full = (1 << len(a)) - 1
    row = full
    masks = list(map(places.__getitem__, b.tolist()))
    for begin in range(0, len(masks), 64):
        row &= full  # carries make a row at most 64 bits longer meanwhile
        for mask in masks[begin : begin + 64]:
            hit = row & mask
            row = (row + hit) | (row - hit)
            yield row


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of ``b`` with each beginning of ``a``."""
    row = full = (1 << len(a)) - 1
    for row in _rises(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer((row & full).to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: np.ndarray, b: np.ndarray, i: int = 0, j: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """The places of a longest common subsequence in both, in parts, each with where it ends."""
    if len(b) > 1 and len(a) // 8 * len(b) > KEPT_BYTES:
        half = len(b) // 2
        at = int(np.argmax(_lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]))
        yield from _common(a[:at], b[:half], i, j)
        yield from _common(a[at:], b[half:], i + at, j + half)
        return
    rows = list(_rises(a, b))
    u: list[int] = []
    v: list[int] = []
    y, x = len(rows) - 1, len(a)
    while y >= 0:
        below = (1 << x) - 1
        x = ((rows[y] & below) ^ below).bit_length() - 1
        if x < 0:
            break
        bit = 1 << x
        while y and not rows[y - 1] & bit:
            y -= 1
        u.append(x)
        v.append(y)
        y -= 1
    yield np.array(u[::-1], np.int64) + i, np.array(v[::-1], np.int64) + j, i + len(a), j + len(b)


def _trimmed_kinds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same where what both begin and end with is kept."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    head = int(other[0]) if len(other) else n
    n -= head
    other = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    tail = n - 1 - int(other[-1]) if len(other) else n
    inner = _kinds(a[head : len(a) - tail], b[head : len(b) - tail])
    return np.concatenate([np.zeros(head, np.int8), inner, np.zeros(tail, np.int8)])


def _numbered(*sides: list[str]) -> list[np.ndarray]:
    number: dict[str, int] = {}
    return [np.array([number.setdefault(t, len(number)) for t in side], np.int64) for side in sides]


def _told(a: list[str], b: list[str], kinds: np.ndarray) -> list[tuple[bool, bool, str]]:
    old, new, out = iter(a), iter(b), []
    for kind in kinds.tolist():
        if kind == _ADDED:
            out.append((True, False, next(new)))
        else:
            out.append((False, kind == _REMOVED, next(old)))
            if kind == _SAME:
                next(new)
    return out


def _script(a: list[str], b: list[str]) -> list[tuple[bool, bool, str]]:
    """A shortest edit script: that of Myers' greedy search if it has few edits, else by the longest common subsequence."""
    return _told(a, b, _kinds(*_numbered(a, b)))


def word_changes(old: str | None, new: str | None, case_sensitive: bool = True) -> list[tuple[bool, bool, str]]:
    """(added, removed, value) for each word and each run of white space.

    Without case sensitivity the lower-cased texts are compared and returned. Nulls count as empty. Values that aren't added make the
    old text, those that aren't removed the new one. The script is a shortest one, however far the texts are apart.
    Two texts of 20,000 words take a second or so; beyond a few edits the time grows with the product of the lengths over some thousand.
    """
    a, b = (_TOKENS.findall(t if case_sensitive else t.lower()) for t in (old or "", new or ""))
    return _told(a, b, _trimmed_kinds(*_numbered(a, b)))


def _small_batches() -> None:
    """Rows go to Python in batches of a few MB where the session says nothing: by count alone a batch of whole texts takes as much memory as they happen to have."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def _starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words and runs of white space begin in texts in UTF-8 that stand behind each other and end there."""
    white = _WHITE[data]
    for first, wide in _WIDE_WHITE.items():
        at = np.flatnonzero(data == first)
        for code in wide if len(at) else ():
            here = at
            for k, byte in enumerate(code[1:], 1):
                here = here[data[np.minimum(here + k, len(data) - 1)] == byte]
            for k in range(len(code)):
                white[here + k] = True
    begins = np.empty(len(data), bool)
    np.not_equal(white[1:], white[:-1], out=begins[1:])
    begins[:1] = True
    begins[ends[ends < len(data)]] = True
    return np.flatnonzero(begins)


def _changes_of_some(texts: pa.Array) -> pa.Array:
    """The word diffs of the first half of some texts with the other half. Words are numbered together and never become Python objects."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends[1:] - ends[0]
    starts = _starts(data, ends)
    offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
    words = pa.StringArray.from_buffers(len(starts), offsets, pa.py_buffer(data))
    numbers = words.dictionary_encode().indices.to_numpy()
    parts, half = np.split(numbers, np.searchsorted(starts, ends))[:-1], len(texts) // 2
    kinds = [_trimmed_kinds(a, b) for a, b in zip(parts[:half], parts[half:], strict=True)]
    lists = np.concatenate([[0], np.cumsum([len(k) for k in kinds])]).astype(np.int32)
    kind = np.concatenate(kinds)
    added = kind == _ADDED
    # What isn't added goes through the old texts' words, what isn't removed through the new ones'.
    places = np.where(added, sum(map(len, parts[:half])) - 1 + np.cumsum(kind != _REMOVED), np.cumsum(~added) - 1)
    columns = [pa.array(added), pa.array(kind == _REMOVED), words.take(pa.array(places))]
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(columns, ["added", "removed", "value"]))


def changes_of(old: pa.Array, new: pa.Array, case_sensitive: bool = True) -> pa.Array:
    """The word diffs of pairs of texts, some at a time."""
    sides = [pc.fill_null(x.cast(pa.large_string()), "") for x in (old, new)]
    if not case_sensitive:
        sides = [pa.array([t.lower() for t in x.to_pylist()], pa.large_string()) for x in sides]
    sizes = np.cumsum(sum(pc.binary_length(x).to_numpy() for x in sides)) // HELD_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(old)]
    some = [pa.concat_arrays([x.slice(lo, hi - lo) for x in sides]) for lo, hi in zip(cuts, cuts[1:], strict=False) if lo < hi]
    return pa.concat_arrays([_changes_of_some(texts) for texts in some]) if some else pa.array([], _CHANGES)


def word_diff(old: Column, new: Column, case_sensitive: bool = True) -> Column:
    """The word diff of two columns, as an array of (added, removed, value)."""
    _small_batches()

    @F.arrow_udf(CHANGES)
    def changes(a: pa.Array, b: pa.Array) -> pa.Array:
        return changes_of(a, b, case_sensitive)

    return changes(old, new)
