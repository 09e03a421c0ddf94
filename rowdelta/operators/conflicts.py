"""Rows that want the same partners: groups of them that are connected are settled in one task each.

Taking rows in order, each with its best free partner, is a loop; but rows without a common partner, directly or over others, don't meet in it. So
the loop runs once for each connected group, many groups at once, and only a group that is too large for a task takes rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdelta.plans.scratch import settled

#: Edges that a task joins up, and entries (rows, copies and wishes) of the groups that it settles: some 100 bytes each.
LIMIT = 2_000_000
_MATCH = "source_idx long, target_idx long, score double"


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as stars: each node with the least node it is connected to here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 100_000):
        part = nodes[k : k + 100_000]
        yield pd.DataFrame({"u": part, "v": [find(x) for x in part]}, dtype=np.int64)


def connected(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): the root is the least node that it is connected to.

    Tasks of at most about ``limit`` edges turn theirs into stars, again and again while that makes them fewer; what is left then is joined up
    in one task, or, where it is still too much, by passing on the least label along edges and over labels until nothing changes.
    """
    kept, n = edges.select("u", "v"), edges.count()
    before = None
    while n > limit and (before is None or n < 0.7 * before):
        kept = settled(kept.repartition(-(-n // limit), F.least("u", "v")).mapInPandas(_forest, "u long, v long"))
        before, n = n, kept.where("u != v").count()
    if n <= limit:
        stars = (kept if before is None else kept.where("u != v")).coalesce(1).mapInPandas(_forest, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("root"))
        if before is None:
            return stars
        return kept.select(F.col("u").alias("node")).distinct().join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    both = settled(kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settled(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("near")), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        nearer = labels.join(heard, "node").select("node", F.least("root", "near").alias("root"))
        over = nearer.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = settled(nearer.join(over, "root").select("node", F.least("root", "far").alias("root")))
        if new.exceptAll(labels).isEmpty():
            return new
        labels = new


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """The loop over the source rows of some groups: the last free copy, or else the best free partner."""
    kind = rows["kind"].to_numpy()
    wishes = rows[kind == 2].sort_values(["a", "score", "b"], ascending=[True, False, True], kind="stable")
    source, target, score = (wishes[c].to_numpy() for c in ("a", "b", "score"))
    copies: dict[int, list[int]] = {}
    for t, group in sorted(zip(rows["a"][kind == 1].tolist(), rows["b"][kind == 1].tolist(), strict=True)):
        copies.setdefault(group, []).append(t)
    taken: set[int] = set()
    out: list[tuple[int, int, float | None]] = []
    own = rows[kind == 0].sort_values("a")
    begins, ends = (np.searchsorted(source, own["a"].to_numpy(), side) for side in ("left", "right"))
    for s, group, lo, hi in zip(own["a"].tolist(), own["b"].tolist(), begins, ends, strict=True):
        stack = copies.get(group, [])
        while stack and stack[-1] in taken:
            stack.pop()
        if stack:
            taken.add(stack[-1])
            out.append((s, stack.pop(), None))
            continue
        at = next((k for k in range(lo, hi) if target[k] not in taken), None)
        if at is not None:
            taken.add(int(target[at]))
            out.append((s, int(target[at]), float(score[at])))
    return pd.DataFrame(out, columns=["source_idx", "target_idx", "score"]).astype({"source_idx": "int64", "target_idx": "int64", "score": "float64"})


def settle(sources: DataFrame, copies: DataFrame, wishes: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """The matches (source_idx, target_idx, score, null if exact) of all groups that fit into a task, and the source rows (source_idx) of those that don't, if any.

    ``sources`` (source_idx, fp), ``copies`` (target_idx, fp) and ``wishes`` (source_idx, target_idx, score) are all there is to want.
    """
    group = copies.groupBy("fp").agg(F.min("target_idx").alias("group"))
    own = sources.join(group, "fp", "left").select(F.lit(0).alias("kind"), F.col("source_idx").alias("a"), F.coalesce("group", F.lit(-1)).alias("b"), F.lit(0.0).alias("score"))
    same = copies.join(group, "fp").select(F.lit(1).alias("kind"), F.col("target_idx").alias("a"), F.col("group").alias("b"), F.lit(0.0).alias("score"))
    want = wishes.select(F.lit(2).alias("kind"), F.col("source_idx").alias("a"), F.col("target_idx").alias("b"), "score")
    entries = settled(own.unionByName(same).unionByName(want))
    s, t = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    node = F.when(F.col("kind") == 1, t("a")).otherwise(s("a"))
    other = F.when(F.col("b") < 0, s("a")).otherwise(t("b"))
    roots = settled(connected(entries.select(node.alias("u"), other.alias("v")), limit))
    placed = entries.withColumn("node", node).join(roots, "node").drop("node")
    sizes = settled(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.where(F.col("n") <= limit).agg(F.sum("n")).first()[0] or 0
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // limit))
    fits = placed.join(sizes.where(F.col("n") <= limit), "root").withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(tasks)))
    done = fits.select("bucket", "kind", "a", "b", "score").groupBy("bucket").applyInPandas(_settle, _MATCH)
    large = sizes.where(F.col("n") > limit)
    left = None if large.isEmpty() else placed.where("kind = 0").join(large, "root", "left_semi").select(F.col("a").alias("source_idx"))
    # Where nothing is exact the score of a loop's match stands as it is; pandas has no null double but NaN.
    return done.select("source_idx", "target_idx", F.when(~F.isnan("score"), F.col("score")).alias("score")), left
