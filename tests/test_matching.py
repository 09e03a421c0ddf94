"""Matching by content where many rows have a value in common or want the same partners."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_functions import plain_jaro_winkler

from rowdelta import DiffOptions, diff, from_table
from rowdelta.functions.similarity import normalized_levenshtein
from rowdelta.operators import bounded, conflicts, content
from rowdelta.plans.scratch import settled

STRICT = DiffOptions(case_sensitive=True, ignore_whitespace=False, ignore_empty_vs_null=False)
NAMES = ["name", "status", "code"]


def table(spark, rows):
    return from_table(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, name string, status string, code string").repartition(3), "k", NAMES)


def hot_rows(n, seed):
    """Rows of which nearly all have a status in common; some are alike in nothing else."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdef01239") for _ in range(k))
    return [(word(rng.randint(0, 9)), rng.choice(["open"] * 9 + ["", "OPEN", "shut"]), str(rng.randint(0, 400)) + rng.choice(["", "é", " "])) for _ in range(n)]


def changed(rows, seed):
    rng = random.Random(seed)
    out = [(a + rng.choice(["", "", "x", "yy"]), s if rng.random() < 0.9 else "shut", c if rng.random() < 0.6 else c + "7") for a, s, c in rows if rng.random() < 0.9]
    rng.shuffle(out)
    return out


def similarity(x, y):
    return 1.0 if x == y else plain_jaro_winkler(x, y)


def plain_best(source, target, threshold=0.5, probe=str):
    """Each source row's best partner with a cell in common, of equal scores the first."""
    out = {}
    for i, x in enumerate(source):
        good = []
        for j, y in enumerate(target):
            if any(u.strip() and u == probe(v) for u, v in zip(x, y, strict=True)):
                s = round(sum(similarity(u, v) for u, v in zip(x, y, strict=True)) / 3, 12)
                if s > threshold:
                    good.append((-s, j))
        if good:
            out[i] = (min(good)[1], -min(good)[0])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_best_partners_among_many_with_a_common_value(spark, seed, monkeypatch):
    monkeypatch.setattr(bounded, "CHUNK", 40)
    monkeypatch.setattr(content, "FEW_PAIRS", 0)
    monkeypatch.setattr(bounded, "SCORED", 100 if seed == 1 else 4096)
    monkeypatch.setattr(bounded, "SIGNATURES", 60 if seed == 1 else 1000)
    a = hot_rows(150, seed)
    b = changed(a, seed + 10)
    found = content.best_targets(table(spark, a), table(spark, b), STRICT).collect()
    assert {r.source_idx: (r.target_idx, round(r.score, 9)) for r in found} == {i: (j, round(s, 9)) for i, (j, s) in plain_best(a, b).items()}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_common_values_are_searched_block_by_block(spark, limit, monkeypatch):
    if limit:
        monkeypatch.setattr(content, "best_partners", None)  # signatures only beyond the limit
    for module, name, value in ((bounded, "CHUNK", 40), (bounded, "WIDE", 64), (bounded, "SCORED", 9), (content, "FEW_PAIRS", 0), (content, "BOUNDED_PAIRS", limit)):
        monkeypatch.setattr(module, name, value, raising=False)
    a = hot_rows(150, 11)
    b = changed(a, 12)
    found = content.best_targets(table(spark, a), table(spark, b), STRICT).collect()
    assert {r.source_idx: (r.target_idx, round(r.score, 9)) for r in found} == {i: (j, round(s, 9)) for i, (j, s) in plain_best(a, b).items()}


def test_default_flags_among_many_with_a_common_value(spark, monkeypatch):
    monkeypatch.setattr(bounded, "CHUNK", 64)
    few = content.best_targets(*(table(spark, r) for r in (hot_rows(120, 5), changed(hot_rows(120, 5), 6))), DiffOptions()).collect()
    monkeypatch.setattr(content, "FEW_PAIRS", 0)
    a = hot_rows(120, 5)
    b = changed(a, 6)
    o = DiffOptions()
    hot = content.best_targets(table(spark, a), table(spark, b), o).collect()
    monkeypatch.setattr(content, "SMALL", 10**9)  # every block is joined and scored
    whole = content.best_targets(table(spark, a), table(spark, b), o).collect()
    assert sorted(tuple(r) for r in hot) == sorted(tuple(r) for r in whole) == sorted(tuple(r) for r in few) and len(hot) > 50


def test_columns_that_are_all_alike_or_all_different(spark, monkeypatch):
    monkeypatch.setattr(content, "FEW_PAIRS", 0)
    same = [("n", "open", "1")] * 40
    found = content.best_targets(table(spark, same), table(spark, [("m", "open", "1")] * 40), STRICT.but(threshold=0.6)).collect()
    assert {(r.source_idx, r.target_idx) for r in found} == {(k, 0) for k in range(40)}


def test_bounds_are_never_below_similarities(spark):
    rng = random.Random(4)
    values = ["", "a", "é", "🙂🙂", *["".join(rng.choice("abAB01 .é") for _ in range(rng.randint(1, 30))) for _ in range(80)]]
    exact = {rule: bounded.similarities([v for v in values for _ in values], values * len(values), rule).reshape(len(values), len(values)) for rule in ("normalized", "row")}
    top = bounded.ceilings(values, values)
    coded = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", *[bounded._signature(F.col("v"), kind).alias(kind) for kind in bounded._CLASSES]).orderBy("k").collect()
    for rule, scores in exact.items():
        assert (scores <= top + 1e-12).all()
        for kind in bounded._CLASSES:
            parts = [r[kind] for r in coded]
            assert (scores <= bounded._parts_alike(kind, parts, parts, rule) + 1e-12).all()
    far = spark.createDataFrame([(values[-1] + "z" * 21, values[-2])], "a string, b string").select(normalized_levenshtein(F.col("a"), F.col("b"))).first()[0]
    assert abs(far - bounded.similarities([values[-1] + "z" * 21], [values[-2]], "row")[0]) < 1e-12


def test_bounds_by_places_are_never_below_and_close():
    rng = random.Random(5)
    for letters, longest in (("01", 4), ("0123456789.-", 9), ("abc XYZé漢", 12), ("ab", 200)):
        left, right = ([rng.choice(["", "Ab"]) + "".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(40)] for _ in range(2))
        exact = bounded.similarities([v for v in left for _ in right], right * len(left), "normalized").reshape(40, 40)
        assert (bounded.near_ceilings(left, right) >= exact - 1e-6).all()


def test_few_pairs_of_a_block_are_scored(monkeypatch):
    rng = random.Random(6)
    row = lambda: (lambda k: [str(k), f"Supplier#{k:09d}", "7", f"{rng.uniform(-999, 9999):.2f}"])(rng.randint(0, 360_000))
    left, right = [row() for _ in range(60)], [row() for _ in range(1500)]
    scored, similarities = [0], bounded.similarities

    def counted(x, y, rule):
        scored[0] += len(x)
        return similarities(x, y, rule)

    monkeypatch.setattr(bounded, "similarities", counted)
    i, j, score = bounded.top_pairs(left, right, np.ones((60, 1500), bool), np.full(60, 0.5), "normalized")
    assert scored[0] < 30 * 60 * 4
    exact = sum(similarities([a[c] for a in left for _ in right], [b[c] for b in right] * 60, "normalized") for c in range(4)).reshape(60, 1500) / 4
    assert i.tolist() == list(range(60)) and j.tolist() == np.round(exact, 12).argmax(axis=1).tolist() and np.allclose(score, exact.max(axis=1))


def test_top_pairs_keep_to_the_floor_and_to_what_is_allowed():
    rows = [["abc", "x"], ["abd", "x"], ["zzz", "y"]]
    everything = np.ones((3, 3), bool)
    found = bounded.top_pairs(rows, rows[::-1], everything, np.array([0.5, 1.0, 0.5]), "normalized")
    assert [x.tolist() for x in found] == [[0, 1, 2], [2, 1, 0], [1.0, 1.0, 1.0]]
    i, j, score = bounded.top_pairs(rows, rows, ~np.eye(3, dtype=bool), np.array([0.5, 0.99, 0.5]), "normalized")
    assert (i.tolist(), j.tolist()) == ([0], [1]) and 0.9 < score[0] < 1
    i, j, score = bounded.top_pairs(rows, rows, everything, np.zeros(3), "normalized", 2)
    assert j.tolist() == [0, 1, 1, 0, 2, 0] and score.tolist()[:1] == [1.0]


def loop(source, target, threshold):
    free, out = set(range(len(target))), set()
    for i, x in enumerate(source):
        copies = [j for j in free if target[j] == x]
        good = sorted((-round(sum(similarity(u, v) for u, v in zip(x, target[j], strict=True)) / 3, 12), j) for j in free if any(u and u == v for u, v in zip(x, target[j], strict=True)))
        good = [g for g in good if -g[0] > threshold]
        to = max(copies) if copies else good[0][1] if good else None
        free.discard(to)
        out.add((i, to))
    return out


@pytest.mark.parametrize("limit", [60, 2_000_000])
def test_groups_of_conflicts_in_tasks_and_in_rounds(spark, limit, monkeypatch):
    monkeypatch.setattr(conflicts.settle, "__defaults__", (limit,))
    monkeypatch.setattr(conflicts.connected, "__defaults__", (limit,))
    rng = random.Random(limit)
    a = [(f"n{k % 9}", f"g{k % 8}", str(k % 5)) for k in range(24)] + [("same", "g1", "1")] * 4
    b = [(f"n{k % 9}" + rng.choice(["", "x"]), f"g{k % 8}", str(k % 4)) for k in range(22)] + [("same", "g1", "1")] * 3
    rng.shuffle(a), rng.shuffle(b)
    rows = diff(table(spark, a), table(spark, b), STRICT.but(strategy="greedy", threshold=0.6)).rows.where("source_idx is not null").collect()
    assert {(r.source_idx, r.target_idx) for r in rows} == loop(a, b, 0.6)


@pytest.mark.parametrize("all_pairs", [False, True])
def test_greedy_by_lists_that_grow(spark, all_pairs, monkeypatch):
    """Rows list their best partners first and look further when these are taken."""
    monkeypatch.setattr(content, "WISHES", 2)
    rng = random.Random(11)
    a = [(f"name{k % 7}", "open", str(k % 9)) for k in range(45)]
    b = [(f"name{k % 6}" + rng.choice(["", "x"]), "open", str(k % 8)) for k in range(40)]
    o = STRICT.but(threshold=0.6, similarity="row" if all_pairs else "normalized")
    sides = table(spark, a), table(spark, b)
    whole = content.greedy_matches(*sides, o, all_pairs).collect()
    monkeypatch.setattr(content, "DIRECT_PAIRS", 0)
    lists = content.greedy_matches(*sides, o, all_pairs).collect()
    key = lambda rows: sorted((r.source_idx, r.target_idx, -1 if r.score is None else round(r.score, 9)) for r in rows)
    assert key(lists) == key(whole) and len(whole) > 30


def test_greedy_lists_stay_within_tasks(spark, monkeypatch):
    """Rows that look further listed targets too that earlier rows had for good, until groups of them took rounds of jobs."""
    rng = random.Random(3)
    a = [(f"name{k % 7}", "open", str(rng.randint(0, 40))) for k in range(120)]
    b = [(f"name{k % 6}" + rng.choice(["", "x"]), "open", str(rng.randint(0, 40))) for k in range(100)]
    sides = table(spark, a), table(spark, b)
    key = lambda rows: sorted((r.source_idx, r.target_idx, -1 if r.score is None else round(r.score, 9)) for r in rows)
    whole = key(content.greedy_matches(*sides, STRICT).collect())
    for name, value in (("DIRECT_PAIRS", 0), ("WISHES", 2), ("LISTED", 300), ("TURN_ROWS", 50)):
        monkeypatch.setattr(content, name, value, raising=False)
    monkeypatch.setattr(conflicts.settle, "__defaults__", (1000,))
    monkeypatch.setattr(content, "_in_rounds", lambda *a: pytest.fail("rounds"))
    assert key(content.greedy_matches(*sides, STRICT).collect()) == whole and len(whole) == 100


def test_sizes_of_frames_in_loops_are_those_of_files(spark):
    df = spark.range(10).withColumn("x", F.lit(1))
    for _ in range(6):
        df = settled(df.join(df.select("id"), "id").join(df.select("id"), "id"), loop=True)
    assert df.count() == 10 and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20


def test_a_thousand_rows_that_all_want_each_other(spark):
    ids = [(k,) for k in range(1000)]
    sources = spark.createDataFrame([(k, f"s{k}") for (k,) in ids], "source_idx long, fp string")
    wishes = spark.createDataFrame(ids, "source_idx long").crossJoin(spark.createDataFrame(ids, "target_idx long")).withColumn("score", F.lit(0.9))  # a made-up worst case
    found, left = conflicts.settle(sources, spark.createDataFrame([], "target_idx long, fp string"), wishes)
    assert left is None and sorted(tuple(r) for r in found.collect()) == [(k, k, 0.9) for (k,) in ids]


@pytest.mark.parametrize("limit", [40, 10_000])
def test_connected_groups(spark, limit):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(1000, 1030)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(40)] + [(5000, 5000)] + [(7000, k) for k in range(7001, 7040)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    found = conflicts.connected(spark.createDataFrame(edges, "u long, v long").repartition(3), limit).collect()
    assert {r.node: r.root for r in found} == {x: find(x) for x in parent} and len(found) == len(parent)


def test_greedy_matching_counts_only_pairs_that_can_want_each_other(spark, monkeypatch):
    """400 rows of which 20 share a value are few wishes, however many pairs of rows there are."""
    rows = [(f"n{k}", f"group {k // 20}", str(1000 + k)) for k in range(400)]
    new = [(a, s, c + "x") for a, s, c in rows]
    monkeypatch.setattr(content, "DIRECT_PAIRS", 10_000)
    expected = {k: k for k in range(400)}
    monkeypatch.setattr(content, "best_targets", lambda *a, **k: pytest.fail("a search for few pairs"))
    found = content.greedy_matches(table(spark, rows), table(spark, new), STRICT).collect()
    assert {r.source_idx: r.target_idx for r in found} == expected


def test_candidates_come_once_and_are_dealt_in_chunks(spark, monkeypatch):
    a, b = hot_rows(60, 31), changed(hot_rows(60, 31), 32)
    expected = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if any(u.strip() and u == v for u, v in zip(x, y, strict=True)))
    monkeypatch.setattr(content, "CHUNK", 7)
    monkeypatch.setattr(content, "TASK_PAIRS", 100)
    pairs = content.candidate_pairs(table(spark, a), table(spark, b), STRICT)
    assert sorted(tuple(r) for r in pairs.collect()) == expected
    assert pairs.rdd.getNumPartitions() >= sum(1 for _ in expected) // 100  # one task had all pairs of a common value
    scores = content.scored_candidates(table(spark, a), table(spark, b), STRICT).collect()
    assert {(r.source_idx, r.target_idx): round(r.score, 9) for r in scores} == {(i, j): round(sum(similarity(u, v) for u, v in zip(a[i], b[j], strict=True)) / 3, 9) for i, j in expected}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortAggregate" not in plan  # none is told from another


def test_a_row_of_columns_is_scored_by_one_python_worker(spark):
    pairs = spark.createDataFrame([(0, 0)], "source_idx long, target_idx long")
    scored = content.score_pairs(pairs, table(spark, [("a", "b", "c")]), table(spark, [("d", "e", "f")]), STRICT)
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
