"""The best partners of each row among many, by bounds: most pairs are ruled out before any similarity is computed.

In a block of rows with a common value all pairs get a bound, column by column: the characters that have an equal within reach, and the prefix. The pairs
with the highest bounds are scored, then the others that can still be better.

Where any rows may meet, or blocks have very many pairs, rows get a signature: their values where a column has few different ones, else how many letters of
some classes a value has. Two signatures bound the score of all pairs of their rows from above. Each source row looks at the target rows of one signature
after another, those with the highest bound first, in ranges that grow, and is done when the next bound is below the (last of the) best it has found. In a
task pairs are then bounded as in a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowdelta.functions.similarity import edit_distance, jaro_winkler_distinct
from rowdelta.plans.scratch import settled

#: Rows of a side in a task.
CHUNK = 512
#: Target rows in a task where whole blocks are bounded.
WIDE = 4096
#: Different signatures at most; their pairs are ranked, so their number is squared.
SIGNATURES = 1000
#: Different values of a signature's part at most.
PARTS = 256
#: Pairs of different values of a column that are scored at once instead of bounded.
SCORED = 4096
#: Scores are compared to 12 decimals; bounds give way by more than sums of doubles can differ.
SLACK = 1e-9
#: The same in single precision.
ROUGH = 1e-5
#: Numbers that a value has in a bound by places; long values have stretches of several places.
FEATURES = 256
_CHARS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .-#"
_CLASSES = {"letters": 8, "rough": 3, "length": 0}
_NEAR = "s_group int, rank int, t_group int, bound double"
_FOUND = "source_idx long, score double, target_idx long"


def similarities(left: list[str], right: list[str], rule: str) -> np.ndarray:
    """Similarity of values, pair by pair: equal ones 1 and others by Jaro-Winkler; by the rule ``row`` edit distance beyond 20 bytes."""
    far = [rule == "row" and (len(x.encode()) > 20 or len(y.encode()) > 20) for x, y in zip(left, right, strict=True)]
    out = np.ones(len(left))
    near = [k for k, (x, y) in enumerate(zip(left, right, strict=True)) if not far[k] and not (rule != "row" and x == y)]
    out[near] = jaro_winkler_distinct([left[k] for k in near], [right[k] for k in near])
    for k in (k for k, f in enumerate(far) if f):
        out[k] = 1 - edit_distance(left[k], right[k]) / max(len(left[k]), len(right[k]))
    return out


def ceiling(common: np.ndarray, left: np.ndarray, right: np.ndarray, prefix: np.ndarray | int = 4) -> np.ndarray:
    """The most that two values of these lengths can be alike, by either measure, with so many letters in common and so long a prefix."""
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(common > 0, (common / left + common / right + 1) / 3, 0.0)
    jaro = np.where((left == 0) & (right == 0), 1.0, jaro)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def _counted(values: list[str], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of each class (by code point), lengths, and the first four code points."""
    sizes = np.array([len(v) for v in values], np.int64)
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(values)), sizes)
    counts = np.bincount(row * classes + codes % classes, minlength=len(values) * classes).reshape(len(values), classes)
    first = np.frombuffer("".join(v[:4].ljust(4, "\0") for v in values).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(values), 4)
    return counts.astype(np.int32), sizes, first


def ceilings(left: list[str], right: list[str]) -> np.ndarray:
    """Bounds for every left with every right value."""
    a, na, fa = _counted(left, 24)
    b, nb, fb = _counted(right, 24)
    common = np.zeros((len(left), len(right)), np.int32)
    for c in range(24):
        common += np.minimum(a[:, c][:, None], b[:, c][None, :])
    prefix, alike = np.zeros(common.shape), np.ones(common.shape, bool)
    for k in range(4):
        alike &= (fa[:, k][:, None] == fb[:, k][None, :]) & (k < np.minimum(na[:, None], nb[None, :]))
        prefix += alike
    return ceiling(common, na[:, None], nb[None, :], prefix)


def _coded(left: list[str], right: list[str]) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    x, y = ({v: k for k, v in enumerate(dict.fromkeys(side))} for side in (left, right))
    return list(x), np.array([x[v] for v in left], np.int64), list(y), np.array([y[v] for v in right], np.int64)


def _features(values: list[str], alphabet: np.ndarray, classes: int, reach: int, step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many characters of each class a value has in each of ``n`` stretches of ``step`` places, and which ones it has within ``reach`` of the stretch."""
    sizes = np.array([len(v) for v in values], np.int64)
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(values)), sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = np.isin(codes, alphabet)
    row, at, kind = row[known], at[known], np.searchsorted(alphabet, codes[known]) % classes
    has = np.bincount((row * n + at // step) * classes + kind, minlength=len(values) * n * classes)
    near = np.zeros((len(values), n, classes), np.float32)
    first, last = np.maximum(at - reach, 0) // step, np.minimum((at + reach) // step, n - 1)
    for more in range(int((last - first).max()) + 1 if len(at) else 0):
        there = first + more <= last
        near[row[there], first[there] + more, kind[there]] = 1
    return has.astype(np.float32).reshape(len(values), n * classes), near.reshape(len(values), n * classes)


def near_ceilings(left: list[str], right: list[str]) -> np.ndarray:
    """Bounds for the Jaro-Winkler similarity of every left with every right value: as if all matched that have an equal within reach, in order."""
    codes = [np.frombuffer("".join(v).encode("utf-32-le", "surrogatepass"), np.uint32) for v in (left, right)]
    alphabet = np.intersect1d(*codes)
    na, nb = (np.array([len(v) for v in side], np.float32) for side in (left, right))
    longest = int(max(na.max(), nb.max(), 1))
    classes = max(1, min(len(alphabet), 32))
    step = -(-longest * classes // FEATURES)
    a, b = (_features(v, alphabet, classes, max(longest // 2 - 1, 0), step, -(-longest // step)) for v in (left, right))
    most = np.minimum(a[0] @ b[1].T, a[1] @ b[0].T)
    none = most == 0
    part = lambda n: np.divide(1, n, where=n > 0, out=np.zeros_like(n))
    most *= part(na)[:, None] + part(nb)[None, :]
    most += 1
    most /= 3
    most[none] = 0
    prefix = np.zeros(most.shape, np.float32)
    for n in range(1, 5):
        code: dict[str, int] = {}
        x, y = (np.array([code.setdefault(v[:n], len(code)) if len(v) >= n else short for v in side], np.int32) for side, short in ((left, -1), (right, -2)))
        prefix += x[:, None] == y[None, :]
    prefix[most <= 0.7 - ROUGH] = 0
    most += np.float32(0.1) * prefix * (1 - most)
    most[np.ix_(na == 0, nb == 0)] = 1
    return most


def _bounds(left: list[str], right: list[str], rule: str) -> np.ndarray:
    """Bounds for the similarity of every left with every right value; where few are different they are scored."""
    x, at_x, y, at_y = _coded(left, right)
    if len(x) * len(y) <= SCORED:
        part = similarities([v for v in x for _ in y], y * len(x), rule).reshape(len(x), len(y))
    elif rule == "row" and any(len(v.encode()) > 20 for v in (*x, *y)):
        part = ceilings(x, y)  # letters that an edit distance keeps may be further apart
    else:
        part = near_ceilings(x, y)
    return part if part.shape == (len(left), len(right)) else part[np.ix_(at_x, at_y)]


def top_pairs(left: list[list[str]], right: list[list[str]], allowed: np.ndarray | None, floor: np.ndarray, rule: str, k: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each left row its ``k`` best right rows (the first of equal ones) among ``allowed`` pairs (or all) of at least its ``floor``: places and scores, best first."""
    columns = list(zip(zip(*left, strict=True), zip(*right, strict=True), strict=True))
    bound = np.zeros((len(left), len(right)), np.float32)
    for a, b in columns:
        bound += _bounds(a, b, rule)
    bound /= len(columns)
    if allowed is not None:
        bound[~allowed] = -1
    least, best = np.maximum(floor.astype(float), 0), np.full((len(left), k), -1.0)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def look(i: np.ndarray, j: np.ndarray) -> None:
        """Score those pairs that can still be among the best; ``i`` rises."""
        nonlocal least, best
        keep = bound[i, j] >= least[i] - ROUGH
        i, j = i[keep], j[keep]
        score = np.round(sum((similarities([a[r] for r in i], [b[c] for c in j], rule) for a, b in columns), np.zeros(len(i))) / len(columns), 12)
        found.append((i, j, score))
        order = np.lexsort((-score, i))
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        more = np.full((len(left), k), -1.0)
        more[i[rank < k], rank[rank < k]] = score[order][rank < k]
        best = -np.sort(-np.concatenate([best, more], axis=1), axis=1)[:, :k]
        least = np.maximum(least, best[:, -1])

    # The pairs with the highest bounds, a few for each row at once; then those of the others that their scores leave, by falling bound.
    few = np.argpartition(-bound, min(k + 2, bound.shape[1] - 1), axis=1)[:, : k + 3]
    look(np.repeat(np.arange(len(left)), few.shape[1]), few.ravel())
    np.put_along_axis(bound, few, -1, axis=1)
    i, j = np.nonzero(bound >= (least - ROUGH)[:, None])
    order = np.lexsort((-bound[i, j], i))
    i, j = i[order], j[order]
    rank, lo, step = np.arange(len(i)) - np.searchsorted(i, i), 0, k + 3
    while len(i) and lo <= rank.max():
        now = (rank >= lo) & (rank < lo + step)
        look(i[now], j[now])
        lo, step = lo + step, 2 * step
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (score >= np.maximum(floor[i], 0))
    return i[keep], j[keep], score[keep]


def _shared(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Whether a left and a right row have a probe in common, column by column; a null is none."""
    out = np.zeros((len(left), len(right)), bool)
    for a, b in zip(zip(*left, strict=True), zip(*right, strict=True), strict=True):
        code = {v: k for k, v in enumerate(dict.fromkeys(a))}
        x = np.array([-1 if v is None else code[v] for v in a])
        y = np.array([-2 if v is None else code.get(v, -2) for v in b])
        out |= x[:, None] == y[None, :]
    return out


def _in_chunks(rule: str, k: int, any_pair: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"source_idx": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "target_idx": pa.array([], pa.int64())})
        right = right.sort_by("idx")
        lists = lambda t, name: t.column(name).to_pylist()
        allowed = None if any_pair else _shared(lists(left, "probe"), lists(right, "probe"))
        if left.column("print").null_count < left.num_rows:
            others = ~_shared([[v] for v in lists(left, "print")], [[v] for v in lists(right, "print")])
            allowed = others if allowed is None else allowed & others
        if "holder" in right.column_names and right.column("holder").null_count < right.num_rows:
            holder = right.column("holder").fill_null(np.iinfo(np.int64).max).to_numpy()
            free = left.column("idx").to_numpy()[:, None] < holder[None, :]
            allowed = free if allowed is None else allowed & free
        i, j, score = top_pairs(lists(left, "row"), lists(right, "row"), allowed, left.column("floor").to_numpy(), rule, k)
        return pa.table({"source_idx": left.column("idx").to_numpy()[i], "score": score, "target_idx": right.column("idx").to_numpy()[j]})

    return run


def _signature(value: Column, kind: str) -> Column:
    """A value's part of a signature: itself, or its letters by class and its length."""
    if kind == "value":
        return value
    classes = _CLASSES[kind]
    names = "".join(chr(0xE000 + k % classes) for k in range(len(_CHARS))) if classes else ""
    coded = F.translate(value, _CHARS[: len(names)], names) if classes else value
    of = lambda k: F.char_length(coded) - F.char_length(F.replace(coded, F.lit(chr(0xE000 + k))))
    return F.concat_ws(",", *[of(k).cast("string") for k in range(classes)], F.char_length(value).cast("string"))


def _parts_alike(kind: str, left: list[str], right: list[str], rule: str) -> np.ndarray:
    """Bounds for the similarity of values with these parts of signatures."""
    if kind == "value":
        return similarities([v for v in left for _ in right], right * len(left), rule).reshape(len(left), len(right))
    a, b = (np.array([[int(n) for n in v.split(",")] for v in side]) for side in (left, right))
    rest = lambda m: m[:, -1] - m[:, :-1].sum(axis=1)
    common = sum((np.minimum(a[:, k][:, None], b[:, k][None, :]) for k in range(a.shape[1] - 1)), np.minimum(rest(a)[:, None], rest(b)[None, :]))
    return ceiling(common, a[:, -1][:, None], b[:, -1][None, :])


def choose_signature(rows: DataFrame, width: int) -> list[tuple[int, str]]:
    """Columns of the array ``row`` and kinds of their parts: those with the fewest different parts first, as many as stay below ``SIGNATURES`` together."""
    value = lambda c: F.col("row")[c]
    counts = rows.agg(*[F.approx_count_distinct(_signature(value(c), kind)).alias(f"{kind}_{c}") for c in range(width) for kind in ("value", *_CLASSES)]).first()
    parts = []
    for c in range(width):
        fit = [(counts[f"{kind}_{c}"], c, kind) for kind in ("value", *_CLASSES) if counts[f"{kind}_{c}"] <= PARTS]
        parts += [p for p in fit[:1] if p[0] > 1]
    parts.sort()
    if not parts:
        return []
    signed = [F.array(*[_signature(value(c), kind) for _, c, kind in parts[: n + 1]]) for n in range(len(parts))]
    together = rows.agg(*[F.approx_count_distinct(s).alias(f"n{n}") for n, s in enumerate(signed)]).first()
    return [(c, kind) for n, (_, c, kind) in enumerate(parts) if together[f"n{n}"] <= SIGNATURES]


def _ranked(targets: list[list[str]], kinds: list[str], width: int, rule: str):
    """For signatures of source rows the target signatures by falling bound."""

    def run(batches):
        for batch in batches:
            bound = np.full((len(batch), len(targets)), float(width - len(kinds)))
            for k, kind in enumerate(kinds):
                x, at_x, y, at_y = _coded([s[k] for s in batch["signature"]], [t[k] for t in targets])
                bound += _parts_alike(kind, x, y, rule)[np.ix_(at_x, at_y)]
            order = np.argsort(-bound, axis=1, kind="stable")
            n = len(targets)
            yield pd.DataFrame({"s_group": np.repeat(batch["s_group"].to_numpy(), n), "rank": np.tile(np.arange(n), len(batch)), "t_group": order.ravel(), "bound": np.take_along_axis(bound, order, axis=1).ravel() / width})

    return run


def top(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("source_idx").orderBy(F.col("score").desc(), F.col("target_idx"))
    return lists.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def best_partners(source: DataFrame, target: DataFrame, known: DataFrame, width: int, rule: str, threshold: float, k: int = 1, any_pair: bool = False) -> DataFrame:
    """Each source row's ``k`` best target rows above the threshold: source_idx, score, target_idx.

    ``source`` and ``target`` have idx, row (the ``width`` values that are scored), probe (the values by which rows are candidates, null for none) and print: pairs
    without a common probe are none, unless ``any_pair``, and neither are pairs with the same print, nor those of a target with a holder, if it has one, and a row that isn't before the holder. ``known`` has what is known already, of other rows too (source_idx, score,
    target_idx). Of equal scores the lowest targets count.
    """
    spark = source.sparkSession
    chosen = choose_signature(source.select("row").unionByName(target.select("row")), width)
    signature = F.array(*[_signature(F.col("row")[c], kind) for c, kind in chosen]).cast("array<string>")
    source, target = settled(source.withColumn("signature", signature)), settled(target.withColumn("signature", signature))
    groups = [sorted(list(r[0]) for r in d.select("signature").distinct().collect()) for d in (source, target)]
    lists = settled(top(known, k))
    if not groups[0] or not groups[1]:
        return lists
    numbered = lambda signatures, name: F.broadcast(spark.createDataFrame([(s, n) for n, s in enumerate(signatures)], f"signature array<string>, {name} int"))
    near = settled(numbered(groups[0], "s_group").repartition(max(1, len(groups[0]) // 64)).mapInPandas(_ranked(groups[1], [kind for _, kind in chosen], width, rule), _NEAR))
    target = target.join(numbered(groups[1], "t_group"), "signature").drop("signature")
    source = source.join(numbered(groups[0], "s_group"), "signature").drop("signature")
    sizes = target.groupBy("t_group").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n_t"))
    part = lambda n: F.pmod(F.xxhash64("idx", F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tasks, holder = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), [c for c in target.columns if c == "holder"]
    lo, step = 0, 1
    while lo < len(groups[1]):
        floors = lists.groupBy(F.col("source_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("idx", "least")
        state = source.select("idx", "s_group").join(floors, "idx", "left").select("idx", "s_group", F.coalesce("least", F.lit(threshold)).alias("floor"))
        asked = state.withColumn("rank", F.explode(F.sequence(F.lit(lo), F.lit(min(lo + step, len(groups[1])) - 1)))).join(near, ["s_group", "rank"]).where(F.col("bound") >= F.col("floor") - SLACK).select("idx", "t_group", "floor")
        asked = settled(asked)
        if asked.isEmpty():
            break
        chunks = asked.groupBy("t_group").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n_s")).join(sizes, "t_group")
        left = asked.join(chunks, "t_group").join(source.drop("s_group"), "idx").withColumns({"i": part("n_s"), "j": every("n_t")}).select("t_group", "i", "j", "idx", "row", "probe", "print", "floor")
        right = target.join(chunks, "t_group").withColumns({"j": part("n_t"), "i": every("n_s")}).select("t_group", "i", "j", "idx", "row", "probe", "print", *holder)
        keys = ["t_group", "i", "j"]
        dealt = lambda d: d.repartition(tasks, *keys).groupBy(*keys)  # noqa: B023, E731  by number: what is little to read may be much to do
        found = dealt(left).cogroup(dealt(right)).applyInArrow(_in_chunks(rule, k, any_pair), _FOUND)
        lists = settled(top(lists.unionByName(found.where(F.col("score") > threshold)).dropDuplicates(["source_idx", "target_idx"]), k))
        lo, step = lo + step, 4 * step
    return lists


def best_in_blocks(source: DataFrame, target: DataFrame, blocks: DataFrame, known: DataFrame, rule: str, threshold: float, k: int = 1) -> DataFrame:
    """The same for rows that meet in ``blocks`` (col, val, n_s, n_t): block by block, in pairs of chunks.

    All pairs of a block are bounded, which is one product of matrices for a column, and few of them are scored. A task holds a pair of chunks, however common
    the value.
    """
    tasks = max(1, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    floors = known.groupBy(F.col("source_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("idx", "least")
    many = blocks.select("col", "val", F.ceil(F.col("n_s") / CHUNK).cast("int").alias("n_s"), F.ceil(F.col("n_t") / WIDE).cast("int").alias("n_t"))
    part = lambda n: F.pmod(F.xxhash64("idx", F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    holder = [c for c in target.columns if c == "holder"]
    met = lambda d, *more: d.select("idx", "row", "print", *more, F.posexplode("probe").alias("col", "val")).where("val is not null").join(many, ["col", "val"])
    left = met(source).join(floors, "idx", "left").withColumns({"i": part("n_s"), "j": every("n_t"), "floor": F.coalesce("least", F.lit(threshold))})
    right = met(target, *holder).withColumns({"j": part("n_t"), "i": every("n_s")})
    keys = ["col", "val", "i", "j"]
    dealt = lambda d, *more: d.select(*keys, "idx", "row", "print", *more).repartition(tasks, *keys).groupBy(*keys)
    found = dealt(left, "floor").cogroup(dealt(right, *holder)).applyInArrow(_in_chunks(rule, k, True), _FOUND).where(F.col("score") > threshold)
    return settled(top(known.unionByName(found).dropDuplicates(["source_idx", "target_idx"]), k))
