"""Embedding near-duplicates by sorted projection passes.

In a pass each vector gets a key of concatenated random-hyperplane bits; vectors of a label are sorted by the key (Spark
range-sorts them) and each is compared with those within a window in that order. Verified pairs of all passes are united to components. A component's members are then
compared with each other in full, in bounded tasks, so a dense group loses no link to the window's bound.

How many passes a label gets, and how wide its window is, follows what all of its vectors show in some trial passes, which sort keys without vectors: how many bits keep those within the
window beside a vector apart from the others, and how likely a partner at the threshold shares them. That holds for labels with dense parts as well. A label that isn't larger than the window needs one pass, in which all its pairs meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, shuffle_width
from .groups import components, dealt_again, forest, group_links

THRESHOLD, WINDOW, BITS, CHUNK = 0.93, 256, 62, 128
#: Share of the pairs at the threshold that all passes together may miss.
MISS = 1e-4
#: Passes on trial, in which all vectors of a label are looked at to plan its passes, and rows of a task of these.
TRIALS, TRIAL_ROWS = 8, 1 << 20
#: Passes that are preferred to a window four times as wide.
PASSES = 40


def passes_for(sample: np.ndarray, size: int, threshold: float, window: int, miss: float) -> int:
    """Passes after which all but a share ``miss`` of the pairs at the threshold have met within the window, in a label of ``size`` vectors of which ``sample`` (as seen from their mean) are some.

    A bit parts two vectors with the chance angle / pi. For each vector of the sample the bits are counted after which only a window of the label stays beside
    it; a partner at the threshold meets it if none of these bits parts them.
    """
    if size <= window + 1 or len(sample) < 2:
        return 1
    radius = np.maximum(np.linalg.norm(sample, axis=1), 1e-12)
    cosine = np.clip(sample @ sample.T / radius[:, None] / radius[None, :], -1, 1)
    stays = 1 - np.arccos(cosine) / np.pi
    np.fill_diagonal(stays, 0)
    bits = np.full(len(sample), BITS)
    for b in range(BITS - 1, -1, -1):
        beside = stays**b if b else np.ones_like(stays) - np.eye(len(stays))
        bits[beside.sum(axis=1) / (len(sample) - 1) * size <= window] = b
    return _fewest(_stays(radius, threshold) ** bits, np.ones(len(bits)), miss)


def _stays(radius: np.ndarray, threshold: float) -> np.ndarray:
    """The chance that a bit doesn't part a vector, so far from the mean, from a partner at the threshold."""
    return 1 - 2 / np.pi * np.arcsin(np.minimum(np.sqrt(max(0.0, 2 - 2 * threshold)) / 2 / radius, 1))


def _fewest(meets: np.ndarray, weights: np.ndarray, miss: float) -> int:
    """Passes that leave no more than a share ``miss`` of the partners unmet, if one pass meets them with the chances ``meets``."""
    passes = 1
    while passes < 1 << 20 and np.average((1 - meets) ** passes, weights=weights) > miss:
        passes += max(1, passes // 8)
    return passes


#: Steps of a chance's logarithm to the base 2, rounded down, in which vectors are counted.
_STEPS = 8


def plan_passes(window: int, miss: float):
    """A label's passes and window, from the counts of its vectors by their chances: the window is widened, fourfold each time, until few passes do or all of the label stands in it."""

    def run(group: pa.Table) -> pa.Table:
        size, places = group.column("size")[0].as_py(), group.column("place").to_numpy()
        meets, counts = 2.0 ** (group.column("step").to_numpy() / _STEPS), group.column("n").to_numpy()
        wide, passes, place = window, 1, 0
        while size > wide + 1:
            passes = _fewest(meets[places == place], counts[places == place], miss)
            if passes <= PASSES or wide >= size:
                break
            wide, passes, place = wide * 4, 1, place + 1
        return pa.table({"grp": group.column("grp")[:1], "passes": pa.array([passes], pa.int32()), "window": pa.array([wide], pa.int32())})

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each group in a batch."""
    for batch in batches:
        grps, loads = batch.column("grp").to_numpy(), batch.column("load").to_pylist()
        found = [(g, np.sum([np.frombuffer(loads[i], np.float64) for i in np.flatnonzero(grps == g)], axis=0).tobytes()) for g in np.unique(grps)]
        yield pa.RecordBatch.from_arrays([pa.array([int(g) for g, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["grp", "total"])


def _centre(group: pa.Table) -> pa.Table:
    size = group.column("size")[0].as_py()
    mean = np.sum([np.frombuffer(x, np.float64) for x in group.column("total").to_pylist()], axis=0) / size
    return pa.table({"grp": group.column("grp")[:1], "centre": pa.array([mean.tobytes()], pa.binary())})


def _projected(batch: pa.RecordBatch, bits: int, seed: int, planes: dict[tuple[int, int], np.ndarray]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Rows of a batch, a pass that they have, their keys in it, and the vectors as seen from their mean."""
    weights = (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    loads, centres, passes = batch.column("load").to_pylist(), batch.column("centre").to_pylist(), batch.column("passes").to_numpy()
    sizes = np.array([len(x) // 8 for x in loads])
    for d in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == d)
        x = np.stack([np.frombuffer(loads[i], np.float64) - np.frombuffer(centres[i], np.float64) for i in of])
        for k in range(int(passes[of].max())):
            if (d, k) not in planes:
                planes[d, k] = np.random.default_rng([seed, d, k]).standard_normal((d, bits))
            here = passes[of] > k
            yield of[here], k, ((x[here] @ planes[d, k] > 0) * weights).sum(axis=1, dtype=np.uint64).astype(np.int64), x[here]


def _keys(bits: int, seed: int):
    """One row for each vector and pass, with the pass's key; the vector goes along as unit doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at, k, keys, _ in _projected(batch, bits, seed, planes):
                own = {c: batch.column(c).take(pa.array(at)) for c in ("id", "grp", "window", "load")}
                yield pa.RecordBatch.from_arrays([own["id"], own["grp"], own["window"], pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), own["load"]], ["id", "grp", "window", "pass", "key", "load"])

    return run


def _trial_keys(bits: int, seed: int, threshold: float):
    """One row for each vector and trial, with its key and the chance that a bit doesn't part it from a partner at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at, k, keys, x in _projected(batch, bits, seed, planes):
                stays = _stays(np.maximum(np.linalg.norm(x, axis=1), 1e-12), threshold)
                own = {c: batch.column(c).take(pa.array(at)) for c in ("id", "grp")}
                yield pa.RecordBatch.from_arrays([own["id"], own["grp"], pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), pa.array(stays)], ["id", "grp", "pass", "key", "stays"])

    return run


def _chances(windows: list[int], alone: bool):
    """For each row of a sorted partition the chance that a trial brings it within each window of a partner.

    They meet for certain if they share one bit more than the row does with those a window before and after it. Where these are in another partition the
    partition's first or last row stands for them: no bit too few is counted. ``alone``: there is no other partition.
    """

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return BITS - np.frexp((a ^ b).astype(np.float64))[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        grp, of, key, stays = (rows.column(c).to_numpy() for c in ("grp", "pass", "key", "stays"))
        n = len(key)
        at = np.arange(n)
        starts = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (of[1:] != of[:-1])]))
        run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        first, last = starts[run_of], np.append(starts[1:], n)[run_of] - 1
        columns = [rows.column("id").combine_chunks(), rows.column("grp").combine_chunks()]
        for w in windows:
            after = shared(key, key[np.minimum(at + w, last)])
            before = shared(key, key[np.maximum(at - w, first)])
            after[(at + w > last) & (alone | (last < n - 1))] = -1
            before[(at - w < first) & (alone | (first > 0))] = -1
            columns.append(pa.array(stays ** np.minimum(1 + np.maximum(after, before), BITS)))
        out = pa.Table.from_arrays(columns, ["id", "grp", *[f"m{k}" for k in range(len(windows))]])
        yield from out.to_batches(max_chunksize=1 << 16)

    return run


def planned(own: DataFrame, groups: DataFrame, centres: DataFrame, threshold: float, window: int, miss: float, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """(grp, passes, window) of every group, and the counts these are planned from: (grp, size, place, step, n), n vectors of a group with a chance of two to the power of step / ``_STEPS`` within the window number ``place``.

    ``own`` has grp, id and load of the vectors. All vectors of groups beyond the window are looked at, in ``TRIALS`` passes.
    """
    most, rows = groups.where(F.col("size") > window + 1).agg(F.max("size"), F.sum("size")).first()
    narrow = lambda d: d.select("grp", F.lit(1).alias("passes"), F.lit(window).alias("window"))
    if not most:
        return narrow(groups), None
    windows = [window]
    while windows[-1] < most:
        windows.append(4 * windows[-1])
    tasks = -(-rows * TRIALS // TRIAL_ROWS)
    large = groups.where(F.col("size") > window + 1).select("grp", "size")
    dealt = own.select("id", "grp", "load").join(dealt_again(large.join(centres, "grp")), "grp").select("id", "grp", "load", "centre", F.lit(TRIALS).alias("passes"))
    keys = dealt.mapInArrow(_trial_keys(BITS, seed, threshold), "id long, grp long, pass int, key long, stays double")
    dealt = keys.repartition(1) if tasks == 1 else keys.repartitionByRange(tasks, "pass", "grp", "key", "id")
    placed = dealt.sortWithinPartitions("pass", "grp", "key", "id")
    names = [f"m{k}" for k in range(len(windows))]
    chances = placed.mapInArrow(_chances(windows, tasks == 1), ", ".join(["id long", "grp long", *[f"{m} double" for m in names]]))
    means = chances.groupBy("grp", "id").agg(*[F.avg(m).alias(m) for m in names])
    step = lambda m: F.floor(F.log2(F.greatest(F.col(m), F.lit(2.0**-BITS))) * _STEPS).cast("int")
    steps = means.select("grp", F.posexplode(F.array(*[step(m) for m in names])).alias("place", "step"))
    counts = cut(steps.groupBy("grp", "place", "step").agg(F.count(F.lit(1)).alias("n")).join(large, "grp").select("grp", "size", "place", "step", "n"))
    plans = counts.groupBy("grp").applyInArrow(plan_passes(window, miss), "grp long, passes int, window int")
    return plans.unionByName(narrow(groups.where(F.col("size") <= window + 1))), counts


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as float64 of length one; None where a vector is null, empty, zero or has a component that is null or not finite."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        x = None if not v or any(c is None for c in v) else np.array(v, dtype=np.float64)
        if x is None or not np.isfinite(x).all() or not x.any():
            out.append(None)
            continue
        x = x / np.abs(x).max()
        out.append(x / np.sqrt((x * x).sum()))
    return out


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = _units(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())], ["vec_id", "label", "load"])


def _close(threshold: float):
    def linked(left: list[bytes], right: list[bytes]) -> np.ndarray:
        size = max(map(len, left + right))
        pad = lambda xs: np.stack([np.frombuffer(x.ljust(size, b"\0"), np.float64) for x in xs])
        same = np.array([len(x) for x in left])[:, None] == np.array([len(x) for x in right])[None, :]
        return (pad(left) @ pad(right).T >= threshold) & same

    return linked


#: Rows that are multiplied with those after them at once.
_ROWS = 256


def _met(rows: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Compare each row of a sorted run with the rows of its group and pass that follow within its window; what is verified, as a forest."""
    n = rows.num_rows
    ids, windows, loads = rows.column("id").to_numpy(), rows.column("window").to_numpy(), rows.column("load").to_pylist()
    _, place = np.unique(np.stack([rows.column(c).to_numpy() for c in ("pass", "grp")], axis=1), axis=0, return_inverse=True)
    place = place.ravel()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sizes = np.array([len(x) for x in loads])
    x = np.zeros((n, sizes.max() // 8 if n else 0))
    for i, load in enumerate(loads):
        x[i, : len(load) // 8] = np.frombuffer(load, np.float64)
    for lo in range(0, n, _ROWS):
        hi = min(n, lo + _ROWS)
        end = min(n, hi + int(windows[lo:hi].max()))
        i, j = np.nonzero(x[lo:hi] @ x[lo:end].T >= threshold)
        ok = (i < j) & (j - i <= windows[lo + i]) & (place[lo + i] == place[lo + j])
        u, v = forest(ids[lo + i[ok]], ids[lo + j[ok]])
        a.append(u), b.append(v)
    return forest(np.concatenate(a), np.concatenate(b))


def neighbours(placed: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs (a, b) among rows that stand within their group's window of each other in a group and pass.

    ``placed`` is range-sorted by pass, grp, key and id. Each task also returns the first and the last rows of its partition; those of a
    group and pass, put in order, have the pairs that the partitions' edges part.
    """
    ends = ("id", "grp", "window", "pass", "key", "load")
    kinds = {"a": pa.int64(), "b": pa.int64(), "id": pa.int64(), "grp": pa.int64(), "window": pa.int32(), "pass": pa.int32(), "key": pa.int64(), "load": pa.binary()}

    def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: pa.Table | None = None
        tail: pa.Table | None = None
        seen = window = reach = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            seen += now.num_rows
            windows = now.column("window").to_numpy()
            if head is None:
                reach = int(windows[0])  # only the first row's group can have begun in an earlier partition
                head = now[:reach]
            elif head.num_rows < reach:
                head = pa.concat_tables([head, now])[:reach]
            window = max(window, int(windows.max()))
            joined = now if tail is None else pa.concat_tables([tail, now])
            u, v = _met(joined, threshold)
            if len(u):
                yield batch_of(len(u), a=pa.array(u), b=pa.array(v))
            tail = joined.slice(max(0, joined.num_rows - window))
        if head is not None:
            rest = min(tail.num_rows, max(0, seen - head.num_rows))
            both = pa.concat_tables([head, tail.slice(tail.num_rows - rest)]).combine_chunks()
            for part in both.to_batches():
                yield batch_of(part.num_rows, **{c: part.column(c) for c in ends})

    def over_edges(group: pa.Table) -> pa.Table:
        u, v = _met(group.sort_by([("key", "ascending"), ("id", "ascending")]), threshold)
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    found = cut(placed.select(*ends).mapInArrow(run, "a long, b long, id long, grp long, window int, pass int, key long, load binary"))
    edges = found.where("id is not null").select(*ends).groupBy("grp", "pass").applyInArrow(over_edges, "a long, b long")
    return found.where("a is not null").select("a", "b").unionByName(edges)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, seed: int = 7) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Vectors of one label link when their cosine, in double precision, is ``threshold`` or more; a null label and a vector that is null, empty,
    zero or holds a null or non-finite component link with nothing. Vectors of different lengths don't link. ``component_id`` is the
    smallest vec_id reachable by links, itself included; ``kept`` marks it. Other columns aren't read; an empty table gives no rows.

    Equal unit vectors of a label, told by 128 bits, are one node whose copies count as links, so many copies cost no pairs. Vectors of one label and length are
    a group. Its passes are planned from all of its vectors, so that about a share ``miss`` of its pairs at the threshold is lost, if no other vector connects them; a group of no more than ``window`` loses none.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = in_batches(base).mapInArrow(_normal, "vec_id long, label long, load binary")
    usable = F.col("label").isNotNull() & F.col("load").isNotNull()
    keyed = cut(units.withColumns({"usable": usable, "k1": F.xxhash64("label", "load"), "k2": F.xxhash64(F.lit(1), "label", "load")}))
    nodes = keyed.where("usable").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("load").alias("load"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()))
    width = F.octet_length("load").alias("width")
    groups = cut(nodes.groupBy("label", width).agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("grp")).where("size > 1"))
    own = nodes.select("id", "label", width, "load").join(dealt_again(groups), ["label", "width"])
    sums = own.select("grp", "load").mapInArrow(_sums, "grp long, total binary")
    centres = cut(sums.join(groups.select("grp", "size"), "grp").groupBy("grp").applyInArrow(_centre, "grp long, centre binary"))
    plans, _ = planned(own, groups, centres, threshold, window, miss, seed)
    groups = cut(groups.join(centres, "grp").join(plans, "grp"))
    dealt = nodes.select("id", "label", width, "load").join(dealt_again(groups), ["label", "width"]).select("id", "grp", "load", "centre", "passes", "window")
    keys = dealt.mapInArrow(_keys(BITS, seed), "id long, grp long, window int, pass int, key long, load binary")
    placed = keys.repartitionByRange(4 * shuffle_width(vectors.sparkSession), "pass", "grp", "key", "id").sortWithinPartitions("pass", "grp", "key", "id")
    met = components(neighbours(placed, threshold))
    met = met.unionByName(met.select(F.col("root").alias("node"), "root").distinct())
    sizes = met.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = met.join(dealt_again(sizes), "root").join(nodes, F.col("node") == F.col("id")).select("id", F.col("root").alias("grp"), "size", F.col("copies").alias("weight"), "load")
    found = cut(group_links(members, _close(threshold), CHUNK))
    linked = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.where("other is not null").select("id", "other"), "id", "other")
    known = nodes.join(linked, "id", "left").join(classes, F.col("id") == F.col("node"), "left").select("k1", "k2", "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    result = known.join(dealt_again(least), "root").select("k1", "k2", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    alone = keyed.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = keyed.where("usable").select("vec_id", "k1", "k2").join(result, ["k1", "k2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
