"""Comparison by content: exact rows first, then the best partners among rows that share a cell.

The exact phase is a bag join. What is left on both sides is matched in two aggregations: each source row proposes the target row with the best
score (of equal ones the lowest), and each target row takes the best proposal (again the lowest). Ranks and ties are by row index, so results
don't depend on the order of work.

Rows that share a cell meet in that cell's block. Small blocks are joined and scored in whole batches. A block may be large, a common value is in
most rows; in such blocks the best partner is searched by bounds (``bounded.py``). Where all pairs above the threshold are wanted, large blocks
are cut into chunks and each pair of chunks is one bounded task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowdelta.functions.keys import fingerprint
from rowdelta.functions.normalize import normalized, unicode_trim
from rowdelta.functions.similarity import jaro_winkler, normalized_levenshtein
from rowdelta.operators.bounded import best_in_blocks, best_partners, similarities, top
from rowdelta.operators.compare import S, T, side, unified
from rowdelta.operators.conflicts import settle
from rowdelta.options import DiffOptions
from rowdelta.plans.scratch import settled
from rowdelta.sources.dataset import INDEX, Dataset

#: Rows of a side in a chunk of a block.
CHUNK = 512
#: Blocks of so many pairs at most are compared as joined rows; only larger ones are worth tasks of their own.
SMALL = 256
#: Pairs of rows that may want each other up to which greedy matching lists all that are above the threshold; beyond that each row lists its best partners first.
DIRECT_PAIRS = 1_000_000
#: Partners that a row lists at least, if there are as many.
WISHES = 8
#: Partners that all rows of a turn list together, if that leaves the first number for each.
LISTED = 900_000
#: Rows of the source that are matched one by one, as it were, before the next ones have their turn: with their copies and lists they fit a task.
TURN_ROWS = 30_000
#: Pairs in large blocks that are scored without a search.
FEW_PAIRS = 100_000
#: Pairs in large blocks up to which each gets a bound; beyond that signatures rule most of them out together.
BOUNDED_PAIRS = 2_000_000_000
#: Pairs that a task of a report on all candidates makes.
TASK_PAIRS = 4_000_000
#: A fingerprint with more rows than this is numbered in slices of the row index, so that no task has to sort them all.
HOT_ROWS = 1_000_000


def align_headers(source: Dataset, target: Dataset) -> Dataset:
    """The target under the source's names, if it has as many columns; names are left alone otherwise."""
    if len(source.headers) == len(target.headers) and source.headers != target.headers:
        return target.renamed(source.headers)
    return target


def fingerprint_of(data: Dataset, source: Dataset, options: DiffOptions, prefix: str = "") -> Column:
    """Fingerprint over the source's columns; one that this side lacks counts as empty."""
    return fingerprint([data.cell(n, prefix) for n in source.names if n not in options.excluded_columns], options)


def ranked_in_bag(df: DataFrame, fp: str, idx: str, rank: str, descending: bool) -> DataFrame:
    """Number the rows of each fingerprint by index. Only where a fingerprint is very common the numbers are summed up from slices."""
    order = F.col(idx).desc() if descending else F.col(idx).asc()
    most = df.groupBy(fp).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= HOT_ROWS:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(fp).orderBy(order)))
    sliced = df.withColumn("_slice", F.floor(F.col(idx) / HOT_ROWS))
    slice_order = F.col("_slice").desc() if descending else F.col("_slice").asc()
    before = F.sum("_n").over(Window.partitionBy(fp).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sliced.groupBy(fp, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(fp, "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(fp, "_slice").orderBy(order))
    return sliced.withColumn("_local", local).join(sizes, [fp, "_slice"]).withColumn(rank, F.col("_before") + F.col("_local")).drop("_slice", "_local", "_before")


def exact_phase(source: Dataset, target: Dataset, options: DiffOptions) -> DataFrame:
    """Index pairs (s_idx, t_idx) of the bag join; a null stands where a row has no exact partner.

    Of n source and m target rows with one fingerprint, the first min(n, m) source rows pair with the last target rows, in turn.
    """
    s = ranked_in_bag(source.df.select(F.col(INDEX).alias("s_idx"), fingerprint_of(source, source, options).alias("s_fp")), "s_fp", "s_idx", "s_rank", False)
    t = ranked_in_bag(target.df.select(F.col(INDEX).alias("t_idx"), fingerprint_of(target, source, options).alias("t_fp")), "t_fp", "t_idx", "t_rank", True)
    return s.join(t, (F.col("s_fp") == F.col("t_fp")) & (F.col("s_rank") == F.col("t_rank")), "full").select("s_idx", "t_idx")


def shared_columns(source: Dataset, target: Dataset, options: DiffOptions) -> list[str]:
    return [n for n in source.names if n not in options.excluded_columns and target.ordinal(n) is not None]


def _probe(value: Column, options: DiffOptions, of_target: bool) -> Column:
    """A cell as it is looked up: a target's cell in lower case unless case counts, a source's cell raw (or both normalised)."""
    if options.normalize_candidates:
        return normalized(value, options)
    return F.lower(value) if of_target and not options.case_sensitive else value


def cells(data: Dataset, columns: list[str], options: DiffOptions, of_target: bool) -> DataFrame:
    """(idx, col, val) of the cells that aren't blank."""
    entries = F.array(*[F.struct(F.lit(i).alias("col"), _probe(data.cell(n), options, of_target).alias("val")) for i, n in enumerate(columns)])
    long = data.df.select(F.col(INDEX).alias("idx"), F.explode(entries).alias("e")).select("idx", "e.col", "e.val")
    return long.where(unicode_trim(F.col("val")) != "")


def _probes(data: Dataset, columns: list[str], options: DiffOptions, of_target: bool) -> Column:
    """What a row is looked up by, column by column; a blank cell is null."""
    return F.array(*[F.when(unicode_trim(p) != "", p) for n in columns for p in [_probe(data.cell(n), options, of_target)]])


def _meetings(source: Dataset, target: Dataset, options: DiffOptions) -> DataFrame:
    """All pairs of rows that share a cell, once each: source_idx, target_idx and the cells of both (prefixed).

    A pair is made in the block of the first column that it shares and in no other, so none has to be told from another. Blocks are dealt in
    pairs of chunks, which bounds what a task holds of a common value; its pairs pass through.
    """
    columns = shared_columns(source, target, options)

    def long(data: Dataset, of_target: bool, prefix: str) -> DataFrame:
        rows = data.df.withColumn("probe", _probes(data, columns, options, of_target))
        return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns], F.posexplode("probe").alias("col", "val")).where("val is not null")

    s, t = long(source, False, S), long(target, True, T)
    count = lambda df, name: df.groupBy("col", "val").agg(F.count(F.lit(1)).alias(name))
    sizes = count(s, "n_s").join(count(t, "n_t"), ["col", "val"])
    sizes = settled(sizes.repartition(int(source.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    total = sizes.agg(F.sum(F.col("n_s") * F.col("n_t"))).first()[0] or 0
    tasks = max(int(source.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, total // TASK_PAIRS))
    many = sizes.select("col", "val", *[F.ceil(F.col(n) / CHUNK).cast("int").alias(n) for n in ("n_s", "n_t")])
    part = lambda idx, n: F.pmod(F.xxhash64(idx, F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["col", "val", "i", "j"]
    left = s.join(many, ["col", "val"]).withColumns({"i": part(S + INDEX, "n_s"), "j": every("n_t")}).drop("n_s", "n_t")
    right = t.join(many, ["col", "val"]).withColumns({"j": part(T + INDEX, "n_t"), "i": every("n_s")}).drop("n_s", "n_t")
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys)
    for c in range(len(columns) - 1):
        met = met.where((F.col("col") <= c) | F.coalesce(F.col(S + "probe")[c] != F.col(T + "probe")[c], F.lit(True)))
    return met.drop(*keys, S + "probe", T + "probe").withColumns({"source_idx": F.col(S + INDEX), "target_idx": F.col(T + INDEX)})


def candidate_pairs(source: Dataset, target: Dataset, options: DiffOptions) -> DataFrame:
    """All distinct pairs of rows that share a cell, as rows (source_idx, target_idx). For reports: the main path doesn't make them."""
    if not shared_columns(source, target, options):
        return _no_pairs(source).select("source_idx", "target_idx")
    return _meetings(source, target, options).select("source_idx", "target_idx")


def scored_candidates(source: Dataset, target: Dataset, options: DiffOptions) -> DataFrame:
    """All distinct pairs of rows that share a cell with their score; rows are scored where they meet."""
    if not shared_columns(source, target, options):
        return _no_pairs(source).select("source_idx", "target_idx", "score")
    return _scored(_meetings(source, target, options), source, target, options)


def score_pairs(pairs: DataFrame, source: Dataset, target: Dataset, options: DiffOptions) -> DataFrame:
    """Add ``score`` to (source_idx, target_idx) rows: the mean similarity of the shared columns, 0 without any."""
    both = pairs.join(side(source, S), F.col("source_idx") == F.col(S + INDEX)).join(side(target, T), F.col("target_idx") == F.col(T + INDEX))
    return _scored(both, source, target, options)


def _scored(both: DataFrame, source: Dataset, target: Dataset, options: DiffOptions) -> DataFrame:
    columns = shared_columns(source, target, options)
    total = F.lit(0.0)
    for n in columns:
        a, b = source.cell(n, S), target.cell(n, T)
        if options.similarity == "row":
            short = (F.octet_length(a) <= 20) & (F.octet_length(b) <= 20)
            total = total + F.when(short, jaro_winkler(a, b)).otherwise(normalized_levenshtein(a, b))
        else:
            x, y = normalized(a, options), normalized(b, options)
            total = total + F.when(x == y, F.lit(1.0)).otherwise(jaro_winkler(x, y))
    return both.select("source_idx", "target_idx", F.round(total / max(1, len(columns)), 12).alias("score"))


def _matrix(left: list[list[str]], right: list[list[str]], rule: str) -> np.ndarray:
    """Mean similarity of every left row with every right row, to 12 decimals so that ties are ties. Each pair of distinct values of a column is scored once."""
    total = np.zeros((len(left), len(right)))
    for a, b in zip(zip(*left, strict=True), zip(*right, strict=True), strict=True):
        (x, at_x), (y, at_y) = (_distinct(v) for v in (a, b))
        scores = similarities([v for v in x for _ in y], y * len(x), rule).reshape(len(x), len(y))
        total += scores[np.ix_(at_x, at_y)]
    return np.round(total / max(1, len(left[0]) if left else 1), 12)


def _distinct(values: tuple[str, ...]) -> tuple[list[str], np.ndarray]:
    index = {v: k for k, v in enumerate(dict.fromkeys(values))}
    return list(index), np.array([index[v] for v in values])


_FOUND = "source_idx long, score double, target_idx long"


def _found(ids: np.ndarray, scores: np.ndarray, partners: np.ndarray) -> pa.Table:
    return pa.table({"source_idx": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64()), "target_idx": pa.array(partners, pa.int64())})


def _in_chunks(rule: str, pick: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """Score a chunk of source rows with one of target rows and return what ``pick`` chooses, as row and column numbers of the matrix."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found(*[np.zeros(0)] * 3)
        order = np.argsort(right.column("idx").to_numpy(), kind="stable")
        score = _matrix(left.column("row").to_pylist(), [right.column("row").to_pylist()[i] for i in order], rule)
        at, to = pick(score)
        return _found(left.column("idx").to_numpy()[at], score[at, to], right.column("idx").to_numpy()[order][to])

    return run


def _no_pairs(source: Dataset) -> DataFrame:
    return source.df.select(F.col(INDEX).alias("source_idx"), F.lit(0.0).alias("score"), F.col(INDEX).alias("target_idx")).where(F.lit(False))


def _scored_values(data: Dataset, columns: list[str], options: DiffOptions) -> Column:
    return F.array(*[data.cell(n) if options.similarity == "row" else normalized(data.cell(n), options) for n in columns])


def _blocks(source: Dataset, target: Dataset, options: DiffOptions, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The scored pairs above the threshold of all small blocks, and the large blocks (col, val, n_s, n_t), if there are any."""
    s_cells, t_cells = cells(source, columns, options, False), cells(target, columns, options, True)
    count = lambda df, name: df.groupBy("col", "val").agg(F.count(F.lit(1)).alias(name))
    sizes = count(s_cells, "n_s").join(count(t_cells, "n_t"), ["col", "val"]).withColumn("small", F.col("n_s") * F.col("n_t") <= SMALL)
    sizes = settled(sizes.repartition(int(source.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    few = sizes.where("small").select("col", "val")
    pairs = s_cells.withColumnRenamed("idx", "source_idx").join(few, ["col", "val"]).join(t_cells.withColumnRenamed("idx", "target_idx"), ["col", "val"]).select("source_idx", "target_idx").distinct()
    scored = score_pairs(pairs, source, target, options).where(F.col("score") > options.threshold).select("source_idx", "score", "target_idx")
    large = sizes.where("not small").select("col", "val", "n_s", "n_t")
    return scored, None if large.isEmpty() else large


def _compared(source: Dataset, target: Dataset, options: DiffOptions, pick: Callable, all_pairs: bool = False, blocks: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
    """Score rows that share a cell (or all rows) block by block, in pairs of chunks: source_idx, score, target_idx of what ``pick`` chooses.

    Blocks that only one side has vanish in the join of their sizes. Each side's chunk is sent once for each chunk of the other. The sizes
    are dealt anew before that join, so that adaptive execution can split the rows of a common value.
    """
    columns = shared_columns(source, target, options)
    if not columns:
        return _no_pairs(source)
    rows = lambda d: d.df.select(F.col(INDEX).alias("idx"), _scored_values(d, columns, options).alias("row"))
    part = lambda n: F.pmod(F.xxhash64("idx", F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    if all_pairs:
        n_s, n_t = (max(1, -(-d.df.count() // CHUNK)) for d in (source, target))
        whole = lambda d: rows(d).withColumns({"col": F.lit(-1), "val": F.lit(""), "n_s": F.lit(n_s), "n_t": F.lit(n_t)})
        s, t = whole(source), whole(target)
    else:
        scored, large = blocks or _blocks(source, target, options, columns)
        if large is None:
            return scored
        many = large.select("col", "val", chunks(F.col("n_s")).alias("n_s"), chunks(F.col("n_t")).alias("n_t"))
        s, t = cells(source, columns, options, False).join(many, ["col", "val"]).join(rows(source), "idx"), cells(target, columns, options, True).join(many, ["col", "val"]).join(rows(target), "idx")
    keys = ["col", "val", "i", "j"]
    left = s.withColumns({"i": part("n_s"), "j": every("n_t")}).select(*keys, "idx", "row")
    right = t.withColumns({"j": part("n_t"), "i": every("n_s")}).select(*keys, "idx", "row")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_in_chunks(options.similarity, pick), _FOUND)
    return found if all_pairs else found.unionByName(scored)


def _best_above(threshold: float) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of a matrix of scores each row's first best one above the threshold."""

    def pick(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = score.argmax(axis=1)
        at = np.flatnonzero(score[np.arange(len(to)), to] > threshold)
        return at, to[at]

    return pick


def best_targets(source: Dataset, target: Dataset, options: DiffOptions, k: int = 1, all_pairs: bool = False, no_copies: bool = False, held: DataFrame | None = None) -> DataFrame:
    """Each source row's ``k`` best partners above the threshold (of equal scores the lowest targets): source_idx, score, target_idx.

    Small blocks are scored as joined rows; their scores are where the search by bounds in large blocks begins, unless these have few pairs, which are all scored. ``all_pairs`` drops the demand for a
    shared cell; ``no_copies`` leaves out pairs with equal fingerprints, ``held`` (target_idx, holder) targets for all but earlier rows than their holder.
    """
    columns = shared_columns(source, target, options)
    if not columns:
        return _no_pairs(source)
    source, target = (replace(d, df=settled(d.df)) for d in (source, target))  # read several times
    copy = lambda d: fingerprint_of(d, source, options) if no_copies else F.lit(None).cast("string")
    rows = lambda d, of_target: d.df.select(F.col(INDEX).alias("idx"), _scored_values(d, columns, options).alias("row"), _probes(d, columns, options, of_target).alias("probe"), copy(d).alias("print"))
    s, t = rows(source, False), rows(target, True)
    if held is not None:
        t = t.join(held.withColumnRenamed("target_idx", "idx"), "idx", "left")
    if all_pairs:
        return best_partners(s, t, _no_pairs(source).select("source_idx", "score", "target_idx"), len(columns), options.similarity, options.threshold, k, True)
    small, large = _blocks(source, target, options, columns)
    if no_copies:
        prints = lambda d, name: d.select(F.col("idx").alias(name), F.col("print").alias(f"{name}_print"))
        small = small.join(prints(s, "source_idx"), "source_idx").join(prints(t, "target_idx"), "target_idx").where("source_idx_print != target_idx_print").select("source_idx", "score", "target_idx")
    if held is not None:
        small = small.join(held, "target_idx", "left").where("holder is null or source_idx < holder").select("source_idx", "score", "target_idx")
    if large is None:
        return top(small, k)
    n_pairs = large.agg(F.sum(F.col("n_s").cast("decimal(38,0)") * F.col("n_t"))).first()[0]
    if k == 1 and not no_copies and n_pairs <= FEW_PAIRS:
        return top(_compared(source, target, options, _best_above(options.threshold), blocks=(small, large)), 1)
    if n_pairs <= BOUNDED_PAIRS:
        return best_in_blocks(s, t, large, settled(top(small, k)), options.similarity, options.threshold, k)
    hot = lambda c: c.join(large.select("col", "val"), ["col", "val"]).select("idx").distinct()
    s = s.join(hot(cells(source, columns, options, False)), "idx", "left_semi")
    t = t.join(hot(cells(target, columns, options, True)), "idx", "left_semi")
    return best_partners(s, t, small, len(columns), options.similarity, options.threshold, k)


def good_pairs(source: Dataset, target: Dataset, options: DiffOptions, all_pairs: bool = False) -> DataFrame:
    """Pairs that share a cell (or any pairs) and score above the threshold; the others never become rows."""
    found = _compared(source, target, options, lambda score: np.nonzero(score > options.threshold), all_pairs)
    return found.groupBy("source_idx", "target_idx").agg(F.max("score").alias("score"))


def accepted(proposals: DataFrame) -> DataFrame:
    """Each target row's best proposal: source_idx, score, target_idx. The other proposers get no second choice."""
    best = F.max(F.struct("score", (-F.col("source_idx")).alias("low"))).alias("b")
    return proposals.groupBy("target_idx").agg(best).select((-F.col("b.low")).alias("source_idx"), F.col("b.score").alias("score"), "target_idx")


def _without(data: Dataset, matched: DataFrame, column: str) -> Dataset:
    rest = data.df.join(matched.where(F.col(column).isNotNull()).select(F.col(column).alias("_m")), F.col(INDEX) == F.col("_m"), "left_anti")
    return Dataset(rest, data.headers, data.warnings)


def _n_pairs(source: Dataset, target: Dataset, options: DiffOptions, all_pairs: bool) -> int:
    """Pairs of rows that share a cell, those that share several more than once; or of any rows."""
    if all_pairs:
        return source.df.count() * target.df.count()
    columns = shared_columns(source, target, options)
    if not columns:
        return 0
    count = lambda d, of_target, name: cells(d, columns, options, of_target).groupBy("col", "val").agg(F.count(F.lit(1)).alias(name))
    return int(count(source, False, "n_s").join(count(target, True, "n_t"), ["col", "val"]).agg(F.sum(F.col("n_s").cast("decimal(38,0)") * F.col("n_t"))).first()[0] or 0)


def greedy_matches(source: Dataset, target: Dataset, options: DiffOptions, all_pairs: bool = False) -> DataFrame:
    """Row by row in the source's order, each row takes the last exact copy that is free, or else its best free partner.

    Only pairs above the threshold are rows; ``all_pairs`` drops the demand for a shared cell. Rows that want the same partners are settled group by group (``conflicts.py``). Returns
    source_idx, target_idx, score (null if exact).
    """
    source, target = (replace(d, df=settled(d.df)) for d in (source, target))  # read several times
    bounds = source.df.approxQuantile(INDEX, [k / n for k in range(1, n)], 0.1 / n) if (n := -(-source.df.count() // TURN_ROWS)) > 1 else []
    found = None
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        # What a row gets depends on no later row, so some rows are settled for good before the next ones have their turn.
        some = source.df if lo is None else source.df.where(F.col(INDEX) > int(lo))
        some = replace(source, df=some if hi is None else some.where(F.col(INDEX) <= int(hi)))
        free = target if found is None else _without(target, found, "target_idx")
        matched = _greedy_turn(some, free, options, all_pairs)
        found = matched if found is None else settled(found.unionByName(matched), loop=True)
    return found


def _greedy_turn(source: Dataset, target: Dataset, options: DiffOptions, all_pairs: bool) -> DataFrame:
    """The matches of some rows, all of them at once.

    Where few pairs meet all that are good are listed. Else each row lists its best partners, and those all of whose partners are taken look further. They look at targets only
    that no earlier row holds: with longer lists a target goes to earlier rows if to others at all, so an earlier holder keeps it from a later row for good.
    """
    s_fp = source.df.select(F.col(INDEX).alias("source_idx"), fingerprint_of(source, source, options).alias("fp"))
    t_fp = target.df.select(F.col(INDEX).alias("target_idx"), fingerprint_of(target, source, options).alias("fp"))
    sources, targets = settled(s_fp), settled(t_fp)
    copies = targets.join(sources.select("fp").distinct(), "fp", "left_semi")
    if _n_pairs(source, target, options, all_pairs) <= DIRECT_PAIRS:
        other = good_pairs(source, target, options, all_pairs).join(sources.withColumnRenamed("fp", "s_fp"), "source_idx").join(targets.withColumnRenamed("fp", "t_fp"), "target_idx").where("s_fp != t_fp")
        return _settled_matches(sources, copies, settled(other.select("source_idx", "target_idx", "score")))
    copies = settled(copies)
    # First as if rows took copies only; then all list partners, for a copy may be gone when it is their turn.
    s, t = ranked_in_bag(sources, "fp", "source_idx", "rank", False), ranked_in_bag(copies, "fp", "target_idx", "rank", True)
    done = settled(s.join(t, ["fp", "rank"]).select("source_idx", "target_idx", F.lit(None).cast("double").alias("score")))
    short, spent, wishes = sources.select("source_idx"), sources.select("source_idx").where(F.lit(False)), _no_pairs(source).select("source_idx", "target_idx", "score")
    while True:
        n, first = short.agg(F.count(F.lit(1)), F.min("source_idx")).first()
        if not n:
            return done
        k, holder = max(WISHES, LISTED // n), done.select("target_idx", F.col("source_idx").alias("holder"))
        asking = replace(source, df=source.df.join(short.withColumnRenamed("source_idx", INDEX), INDEX, "left_semi"))
        asked = replace(target, df=target.df.join(done.where(F.col("source_idx") < first).select(F.col("target_idx").alias(INDEX)), INDEX, "left_anti"))
        more = settled(best_targets(asking, asked, options, k, all_pairs, True, holder).select("source_idx", "target_idx", "score"), loop=True)
        full = more.groupBy("source_idx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        spent = settled(spent.unionByName(short.join(full, "source_idx", "left_anti")), loop=True)  # they list all that is left for them
        open_wishes = wishes.join(short, "source_idx", "left_anti").join(holder, "target_idx", "left").where("holder is null or source_idx <= holder").drop("holder")
        wishes = settled(open_wishes.unionByName(more), loop=True)
        done = settled(_settled_matches(sources, copies, wishes), loop=True)
        short = settled(sources.select("source_idx").join(done, "source_idx", "left_anti").join(spent, "source_idx", "left_anti"), loop=True)


def _settled_matches(sources: DataFrame, copies: DataFrame, wishes: DataFrame) -> DataFrame:
    done, left = settle(sources, copies, wishes)
    if left is None:
        return done
    left = settled(left)
    return done.unionByName(_in_rounds(sources.join(left, "source_idx"), copies, wishes.join(left, "source_idx")))


def _in_rounds(sources: DataFrame, copies: DataFrame, wishes: DataFrame) -> DataFrame:
    """The same for rows of groups that are too large for a task.

    The outcome is what deferred acceptance gives when every target prefers the lowest source row: in each round the unmatched source
    rows propose to their best target that hasn't turned them down, and a target keeps the lowest proposer.
    Copies wish for the same targets in the same order, so the k-th of them is turned down by the first k - 1 for certain and begins with
    the k-th. Their wishes are looked up by number, never listed: n copies on both sides cost n rows and no round of their own.
    """
    copies = settled(ranked_in_bag(copies, "fp", "target_idx", "number", True))
    counts = copies.groupBy("fp").agg(F.count(F.lit(1)).alias("n_copies"))
    sources = ranked_in_bag(sources, "fp", "source_idx", "place", False).join(counts, "fp", "left").select("source_idx", "fp", "place", F.coalesce("n_copies", F.lit(0)).alias("n_copies"))
    sources = settled(sources)
    choice = Window.partitionBy("source_idx").orderBy(F.col("score").desc(), F.col("target_idx"))
    fuzzy = settled(wishes.select("source_idx", "target_idx", "score", F.row_number().over(choice).alias("wish")))
    down = sources.select("source_idx", "fp", "n_copies", F.least(F.col("place") - 1, F.col("n_copies")).cast("long").alias("down"))
    while True:
        # The next wish of each row is the one after those that turned it down: first the copies, then the others.
        exact = down.where("down < n_copies").join(copies.select("fp", "number", "target_idx"), (down.fp == copies.fp) & (F.col("number") == F.col("down") + 1)).select("source_idx", "target_idx", F.lit(None).cast("double").alias("score"))
        rest = down.where("down >= n_copies").select("source_idx", (F.col("down") - F.col("n_copies") + 1).alias("wish")).join(fuzzy, ["source_idx", "wish"]).select("source_idx", "target_idx", "score")
        now = settled(exact.unionByName(rest))
        held = now.groupBy("target_idx").agg(F.min("source_idx").alias("keeper"))
        losers = now.join(held, "target_idx").where("source_idx != keeper").select("source_idx", F.lit(1).alias("one"))
        if losers.isEmpty():
            return now
        down = settled(down.join(losers, "source_idx", "left").select("source_idx", "fp", "n_copies", (F.col("down") + F.coalesce("one", F.lit(0))).alias("down")))


def content_diff(source: Dataset, target: Dataset, options: DiffOptions) -> DataFrame:
    """The unified result of a comparison by content."""
    target = align_headers(source, target)
    if options.strategy == "greedy":
        matched = greedy_matches(source, target, options)
        matches = matched.select(F.col("source_idx").alias("s_idx"), F.col("target_idx").alias("t_idx"), "score", F.when(F.col("score").isNull(), "unchanged").otherwise("modified").alias("_status"))
    else:
        exact = exact_phase(source, target, options).persist()
        same = exact.where("s_idx is not null and t_idx is not null")
        fuzzy = accepted(best_targets(_without(source, same, "s_idx"), _without(target, same, "t_idx"), options))
        matches = same.select("s_idx", "t_idx", F.lit(None).cast("double").alias("score"), F.lit("unchanged").alias("_status")).unionByName(
            fuzzy.select(F.col("source_idx").alias("s_idx"), F.col("target_idx").alias("t_idx"), "score", F.lit("modified").alias("_status"))
        )
    left = side(source, S).join(matches, F.col(S + INDEX) == F.col("s_idx"), "left")
    pairs = left.join(side(target, T), F.col("t_idx") == F.col(T + INDEX), "full")
    status = F.coalesce("_status", F.when(F.col(S + INDEX).isNull(), "added").otherwise("removed"))
    key = F.concat(F.lit("Row "), (F.coalesce(S + INDEX, T + INDEX) + 1).cast("string"))
    return unified(pairs, source, target, options, key, status, F.col("score"))
