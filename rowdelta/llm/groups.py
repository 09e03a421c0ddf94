"""Connected components, and exact links inside large candidate groups by bounded tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_width


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (node, root) with the components of the edges; the root of each is its smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:  # pointer jumping
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


#: Edges that a task of the component search reduces to stars at once.
EDGES = 1 << 20


def local_forests(most: int = EDGES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reduce a partition's edges (the first two columns) to stars, about ``most`` at a time, so memory is bounded whatever the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        stars = lambda: forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        rows = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n > most:
                u, v = stars()
                held, n = [(u, v)], len(u)
                if n > most // 2:
                    yield rows(u, v)
                    held, n = [], 0
        if n:
            yield rows(*stars())

    return run


def dealt_again(sums: DataFrame) -> DataFrame:
    """Aggregated rows, dealt out anew before they are joined with the rows they sum up.

    Otherwise the join would stand on the aggregation's own partitions; with a shuffle of its own on either side adaptive execution can split
    the rows of a key that has very many, such as a hub's edges or a large group's members. The aggregated side is small.
    """
    return sums.repartition(shuffle_width(sums.sparkSession))


def components(edges: DataFrame, a: str = "a", b: str = "b", per_task: int = EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns) but the roots; a component's root is its smallest node.

    Edges are first reduced to stars, by each task and then once more in tasks of about ``per_task`` edges, as many as there are edges for.
    Then rounds of two steps: every node sends its larger neighbours to its smallest one, then its smaller neighbours too, until
    nothing changes. Each round is checkpointed; rounds grow with the logarithm of the longest path; a single task's stars need none.
    Self-loops and repeated edges don't matter; rows with a null are left out.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(F.col("u") != F.col("v"))
    e = cut(e.mapInArrow(local_forests(per_task), "u long, v long"))
    tasks = max(1, -(-e.count() // per_task))
    e = cut(e.coalesce(tasks).mapInArrow(local_forests(per_task), "u long, v long"))
    mark = None
    while tasks > 1:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(dealt_again(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(dealt_again(least), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        if now == mark or now[0] == 0:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def group_links(members: DataFrame, linked: Callable[[list, list], np.ndarray], chunk: int) -> DataFrame:
    """Exact links between all members of each group, in tasks of two chunks at most.

    ``members`` has ``id`` long (one row each), ``grp`` long, ``size`` long (members of the group), ``weight`` long and ``load``
    binary. ``linked(a, b)`` gives the matrix of links between two lists of loads. A group of many members is dealt into chunks by
    hash, and each pair of chunks is a task's work, so no task holds a whole group and no pair is a row.

    Returns ``id``, ``other``, ``links``: rows with a null ``other`` carry part of the weight of an id's links, the others are
    edges of a spanning forest of the links seen in a task.
    """
    n = F.ceil(F.col("size") / chunk).cast("int")
    own = members.withColumns({"_n": n, "_c": F.pmod(F.xxhash64("id", F.lit(5)), n).cast("int")})
    spread = own.withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = spread.select("grp", F.least("_c", "_d").alias("i"), F.greatest("_c", "_d").alias("j"), (F.col("_c") > F.col("_d")).alias("second"), "id", "weight", "load")

    def run(group: pa.Table) -> pa.Table:
        ids, weights = group.column("id").to_numpy(), group.column("weight").to_numpy()
        loads, second = group.column("load").to_pylist(), group.column("second").to_numpy()
        same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        _, first_of = np.unique(ids, return_index=True)
        keep = np.zeros(len(ids), bool)
        keep[first_of] = True
        left = np.flatnonzero(keep & ~second)
        right = left if same else np.flatnonzero(keep & second)
        out_id, out_other, out_links = [], [], []
        if len(left) and len(right):
            hit = linked([loads[k] for k in left], [loads[k] for k in right])
            if same:
                np.fill_diagonal(hit, False)
            sums = [(left, hit @ weights[right])] if same else [(left, hit @ weights[right]), (right, hit.T @ weights[left])]
            for at, total in sums:
                some = total > 0
                out_id.append(ids[at][some])
                out_other.append(np.zeros(int(some.sum()), np.int64))
                out_links.append(total[some])
            x, y = np.nonzero(hit)
            if len(x):
                u, v = forest(ids[left[x]], ids[right[y]])
                out_id.append(u), out_other.append(v), out_links.append(np.zeros(len(u), np.int64) - 1)
        flat = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64)
        links = flat(out_links)
        return pa.table({"id": pa.array(flat(out_id)), "other": pa.array(flat(out_other), mask=links >= 0), "links": pa.array(links, mask=links < 0)})

    return dealt.groupBy("grp", "i", "j").applyInArrow(run, "id long, other long, links long")
