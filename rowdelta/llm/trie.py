"""The prefix trie of conversations: which beginnings they share, and what sharing them saves.

A turn is told by a digest of its role and text, a conversation by the digests of its turns in a row, so that texts are read once and never moved.
Equal conversations become one row with a count. These rows are hash-partitioned by their first turn; each part is built as a pointer-dictionary trie in one
task and summed up in iterative postorder. A first turn with too many turns below it is parted by the next turn, and so on; the few nodes above such cuts
are summed up by joins, level by level from below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_width, text_or_empty

#: Letters of a turn's digest.
_WIDE = 32
#: Turns of different conversations that a task's trie is built from; about 200 bytes each.
LIMIT = 200_000
#: Ids of a range of this width are joined in one task before the digest over them is made.
_ID_RANGE = 1 << 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuild(turns: DataFrame, width: int = 100, most: int = 6) -> DataFrame:
    """Every conversation behind the first turns of its group's first one: conv_id, path (its turns' digests), chars (code points of their texts).

    Conversation c begins with the first h turns of conversation c - c % ``width``, h being crc32(c) % ``most``, and goes on with its own turns after its
    first h. Turns stand by turn number, nulls first, and where numbers are equal by their digests; null roles and texts count as empty; rows that repeat are turns that
    repeat. Rows without a conv_id belong to no conversation. Other columns aren't read.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    conv = F.col("conv_id").cast("long")
    rows = turns.where(conv.isNotNull()).select((conv - conv % width).alias("base"), conv.alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    opening = own.where("conv_id = base").select("base", F.slice("own", 1, most - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    first = F.coalesce(F.slice("first", F.lit(1), h), F.slice("own", 1, 0))
    whole = own.join(opening, "base", "left").select("conv_id", F.concat(first, F.slice("own", h + 1, F.size("own"))).alias("turns"))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each key's lists of ids, which come one after another."""
    key, state = None, None
    for batch in batches:
        keys, digests = [], []
        for k, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                keys.append(key)
                digests.append(state.hexdigest())
            key, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pydict({"end": pa.array(keys, pa.string()), "ends_sha256": pa.array(digests, pa.string())})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"end": [key], "ends_sha256": [state.hexdigest()]})


def _id_digests(convs: DataFrame) -> DataFrame:
    """For each end of a conversation the digest over the ids of all that end there. Ids are joined in ranges, so that a task only reads on through finished pieces."""
    ranged = convs.groupBy("end", F.floor(F.col("conv_id") / _ID_RANGE).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return ranged.repartition("end").sortWithinPartitions("end", "range").select("end", "ids").mapInArrow(_joined_digests, "end string, ends_sha256 string")


def _prefix(d: Column | int) -> Column:
    return F.substring("path", F.lit(1), F.lit(_WIDE) * d)


def _crowded(seqs: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """``seqs`` with ``at``, the depth from which a conversation's part of the trie is built in a task (0 if it ends above), and the nodes above the cuts.

    A node is cut where more than ``limit`` turns of several conversations lie below it. Depths are looked at in ranges that double.
    """
    parted, nodes, rest, lo, hi = [], [], seqs, 1, 1
    while True:
        spread = rest.withColumn("d", F.explode(F.sequence(F.lit(lo), F.least(F.lit(hi), F.col("n_turns"))))).withColumn("key", F.md5(_prefix(F.col("d")).cast("binary")))
        below = F.sum(F.col("n_turns") - F.col("d") + 1).alias("below")
        sized = spread.groupBy("d", "key").agg(below, F.count(F.lit(1)).alias("n"), F.any_value(F.md5(_prefix(F.col("d") - 1).cast("binary"))).alias("up"), F.any_value(F.element_at("chars", F.col("d"))).alias("chars"))
        crowded = cut(sized.where((F.col("below") > limit) & (F.col("n") > 1)).select("d", "key", "up", "chars"))
        if crowded.isEmpty():
            return _union([*parted, rest.withColumn("at", F.lit(lo))]), nodes
        nodes.append(crowded)
        above = spread.join(crowded.select("d", "key"), ["d", "key"], "left_semi").groupBy("end").agg(F.count(F.lit(1)).cast("int").alias("above"))
        at = F.lit(lo) + F.coalesce("above", F.lit(0))
        rest = cut(rest.join(above, "end", "left").withColumn("at", F.when(at <= F.least(F.lit(hi), F.col("n_turns")), at).when(F.col("n_turns") <= hi, F.lit(0))).drop("above"))
        parted.append(rest.where("at is not null"))
        rest = rest.where("at is null").drop("at")
        lo, hi = hi + 1, 2 * hi + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """Tries of the conversations given, from depth ``at`` on, as rows of nodes; ``up`` is the key of what a trie hangs on."""
    tops: dict[str, int] = {}
    children: list[dict[str, int]] = []
    parent, depth, chars, count, first, end, up = [], [], [], [], [], [], []

    def add(above: int, at: int, n: int, key: str | None) -> int:
        for column, value in ((children, {}), (parent, above), (depth, at), (chars, n), (count, 0), (first, None), (end, _NO_ENDS), (up, key)):
            column.append(value)
        return len(parent) - 1

    for path, lengths, at, n, conv, sha, key in zip(rows["path"], rows["chars"], rows["at"], rows["n"], rows["first_id"], rows["ends_sha256"], rows["up"], strict=True):
        top = path[: _WIDE * at]
        node = tops[top] if top in tops else tops.setdefault(top, add(-1, at, int(lengths[at - 1]), key))
        for d in range(at, len(lengths) + 1):
            if d > at:
                digest = path[_WIDE * (d - 1) : _WIDE * d]
                found = children[node].get(digest)
                node = children[node].setdefault(digest, add(node, d, int(lengths[d - 1]), None)) if found is None else found
            count[node] += n
            first[node] = conv if first[node] is None else min(first[node], conv)
        end[node] = sha
    leaves, saved = [0] * len(parent), [0] * len(parent)
    for node in range(len(parent) - 1, -1, -1):  # a node is made before those below it, so backwards is a postorder
        leaves[node] = leaves[node] or 1
        saved[node] += (count[node] - 1) * chars[node]
        if parent[node] >= 0:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    out = {"conv_id": first, "depth": depth, "parent_conv_id": pd.array([first[p] if p >= 0 else None for p in parent], "Int64"), "n_convs": count, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": end, "up": up}
    return pd.DataFrame(out)


def prefix_trie(turns: DataFrame, width: int = 100, most: int = 6, limit: int = LIMIT) -> DataFrame:
    """One row for each different beginning of the rebuilt conversations (see ``rebuild``), the empty one included.

    conv_id (the smallest that begins so), depth (its turns), parent_conv_id (null for the empty one), n_convs, n_children, n_leaves, saved_tokens (over all nodes
    below and itself, conversations but one times code points of the last text) and ends_sha256 (over the ids of those that end there). An empty table gives no rows. A conversation
    and a trie of ``limit`` turns must fit into a task's memory.
    """
    convs = cut(rebuild(turns, width, most).withColumn("end", F.md5(F.col("path").cast("binary"))))
    seqs = convs.groupBy("end").agg(F.any_value("path").alias("path"), F.any_value("chars").alias("chars"), F.min("conv_id").alias("first_id"), F.count(F.lit(1)).alias("n")).withColumn("n_turns", F.size("chars"))
    seqs = cut(seqs.join(_id_digests(convs), "end"))
    parted, crowded = _crowded(seqs.where("n_turns > 0"), limit)
    parted = cut(parted.withColumns({"key": F.md5(_prefix(F.col("at")).cast("binary")), "up": F.md5(_prefix(F.col("at") - 1).cast("binary"))}))
    inside = parted.where("at > 0")
    size = inside.agg(F.sum(F.col("n_turns") - F.col("at") + 1)).first()[0] or 0
    buckets = max(shuffle_width(turns.sparkSession), -(-size // limit))
    bucketed = inside.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "path", "chars", "at", "n", "first_id", "ends_sha256", "up")
    built = cut(bucketed.groupBy("bucket").applyInPandas(_build, _NODE + ", up string"))
    ended = seqs.where("n_turns = 0").select(F.col("end").alias("key"), "n", "first_id", "ends_sha256").unionByName(parted.where("at = 0").select(F.col("end").alias("key"), "n", "first_id", "ends_sha256"))
    tops = _tops(built.where("up is not null"), crowded, ended)
    parents = tops.select(F.col("key").alias("up"), F.col("conv_id").alias("_parent"))
    hung = _union([built.where("up is not null"), tops.where("depth > 0").drop("key")]).drop("parent_conv_id").join(parents, "up").withColumnRenamed("_parent", "parent_conv_id")
    names = [f.split()[0] for f in _NODE.split(", ")]
    return _union([d.select(*names) for d in (tops.where("depth = 0"), hung, built.where("up is null"))])


def _tops(built: DataFrame, crowded: list[DataFrame], ended: DataFrame) -> DataFrame:
    """The nodes above the built tries, from the lowest level to the root: columns of a node, key and up."""
    spark = built.sparkSession
    root = spark.range(1).select(F.lit(0).alias("d"), F.md5(F.lit("").cast("binary")).alias("key"), F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("chars"))
    nodes = _union([*[c.select(F.col("d").cast("int").alias("d"), "key", "up", "chars") for c in crowded], root])
    depth = nodes.agg(F.max("d")).first()[0]
    done: list[DataFrame] = []
    for d in range(depth, -1, -1):
        below = [built.where(F.col("depth") == d + 1), *[x.drop("key").where(F.col("depth") == d + 1) for x in done[-1:]]]
        kids = _union(below).groupBy("up").agg(F.min("conv_id").alias("c"), F.sum("n_convs").alias("n_below"), F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        here = nodes.where(F.col("d") == d).join(kids.withColumnRenamed("up", "key"), "key", "left").join(ended, "key", "left")
        total = F.coalesce("n_below", F.lit(0)) + F.coalesce("n", F.lit(0))
        node = here.select(
            F.least("c", "first_id").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), total.alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (total - 1) * F.col("chars")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"), "up", "key",
        )
        done.append(cut(node.where("n_convs > 0")))
    return _union(done)
