"""Joins of near copies, against all pairs."""

import math
import random
import re

import numpy as np
from corpus_helpers import same, tricky_texts
from pyspark.sql import functions as F

from rowdelta.llm import embeddings, groups, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes(n: int, links: list[tuple[int, int]]) -> list[int]:
    at = list(range(n))
    for _ in range(n):
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    return at


def grams(text: str | None) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard(tricky):
    rows = tricky_texts()
    sets = [grams(t) for _, t, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = [(b, a) for a, b in links]
    at = classes(len(rows), links)
    expected = []
    for k, (doc, text, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if at[j] == at[k] and rows[j][0] is not None]
        expected.append((doc, (min(ids) if ids else None) if sets[k] else doc, sum(k in x for x in links)))
    found = jaccard.near_duplicates(tricky).collect()
    same([(r.doc_id, r.class_id, r.n_links) for r in found], expected)
    kept = jaccard.drop_near_duplicates(tricky)
    assert kept.columns == tricky.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted((i is None, i or 0) for i in [1, 2, None, 3, 4, 5, 6, 8, 10, 11, 12, 13, 15, 16, 17, -5, 2**40])


def test_jaccard_empty(nothing):
    assert jaccard.near_duplicates(nothing).collect() == []
    assert jaccard.drop_near_duplicates(nothing).collect() == []


def test_bands_reach_the_recall():
    for threshold in (0.6, 0.8, 0.9):
        bands, rows = jaccard.plan_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 > 1 - (1 - threshold**rows) ** (bands - 1)


def test_large_group_is_cut_into_chunks(spark):
    """A group of 300 near copies of one text, each pair linked, in chunks of 16."""
    words = [f"w{k}" for k in range(400)]
    texts = [(k, " ".join([*words[:k], "changed", *words[k + 1 :]])) for k in range(300)]
    old, jaccard.CHUNK = jaccard.CHUNK, 16
    try:
        rows = jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    finally:
        jaccard.CHUNK = old
    assert {(r.class_id, r.n_links) for r in rows} == {(0, 299)} and [r.doc_id for r in rows if r.kept] == [0]


def vectors() -> list[tuple]:
    rng = np.random.default_rng(0)
    rows: list[tuple] = [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [float("nan")] * 16, 0), (5, [float("inf")] + [1.0] * 15, 0), (6, [None] + [1.0] * 15, 0), (7, [1.0] * 16, None), (8, [1.0] * 16, None), (9, [1e-30] * 16, 0), (10, [1e30] * 16, 0), (11, [1.0] * 8, 0)]
    k = 100
    for label in (0, 1):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(rng.integers(1, 9)):
                rows.append((k, (centre + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                k += 1
        rows += [(k, rows[-1][1], label), (k + 1, rows[-1][1], 1 - label), (k + 2, [-x for x in rows[-1][1]], label)]
        k += 3
    return rows


def test_vectors(spark):
    rows = vectors()
    good = [(n, np.array(v, float)) for n, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {n: x / np.abs(x).max() / math.sqrt(((x / np.abs(x).max()) ** 2).sum()) for n, x in good}
    links = [(a, b) for a in unit for b in unit if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.93]
    at = classes(len(rows), links)
    expected = [(rows[k][0], sum(k in x for x in links), rows[at[k]][0], at[k] == k) for k in range(len(rows))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    same(map(tuple, embeddings.near_vectors(df).collect()), expected)
    same(map(tuple, embeddings.near_vectors(df.withColumns({c: F.lit("clash") for c in ("id", "grp", "window", "pass", "key", "load", "size", "n_links")})).collect()), expected)
    assert embeddings.near_vectors(df.where("false")).collect() == []


def planted(n: int, pairs: int) -> np.ndarray:
    """Unit vectors about a common mean (mutual cosine 0.5); the last ``pairs`` stand at 0.931 to the first as many."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(rng.standard_normal(64)) + unit(rng.standard_normal((n, 64))))
    y = rng.standard_normal((pairs, 64))
    y = unit(y - (y * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    return np.concatenate([x, 0.931 * x[:pairs] + math.sqrt(1 - 0.931**2) * y])


def linked_pairs(spark, x: np.ndarray, **options) -> float:
    """Share of the links that are found, against all pairs."""
    links = (x @ x.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, **options).collect()}
    assert all(got[k] <= n for k, n in enumerate(links))
    return sum(got.values()) / links.sum()


def test_a_label_within_the_window_loses_nothing(spark):
    assert linked_pairs(spark, planted(1200, 300), window=1500) == 1


def test_passes_follow_size_and_spread(spark):
    assert linked_pairs(spark, planted(3000, 500), window=16) >= 0.995


def clusters(n: int, pairs: int, parts: int = 4, mutual: float = 0.85) -> np.ndarray:
    """Unit vectors in dense parts whose members have a mutual cosine below the threshold; the last ``pairs`` stand at 0.935 to the first as many."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    away = rng.standard_normal((n, 64))
    middle = unit(rng.standard_normal((parts, 64)))[np.arange(n) % parts]
    x = math.sqrt(mutual) * middle + math.sqrt(1 - mutual) * unit(away - (away * middle).sum(axis=1, keepdims=True) * middle)
    y = rng.standard_normal((pairs, 64))
    y = unit(y - (y * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    return np.concatenate([x, 0.935 * x[:pairs] + math.sqrt(1 - 0.935**2) * y])


def test_passes_follow_dense_parts(spark):
    assert linked_pairs(spark, clusters(3000, 400), window=16) >= 0.99


def test_passes_are_planned_from_all_vectors(spark):
    """A label is counted in full, also a dense part that a sample of 256 would hardly see; over partitions no chance is overrated."""
    rng = np.random.default_rng(8)
    wide, dense = rng.standard_normal((4000, 64)), rng.standard_normal(64) + 0.4 * rng.standard_normal((40, 64))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = {3: unit(np.concatenate([wide, dense])), 5: unit(wide[:900]), 7: unit(wide[:10])}
    rows = [(label * 10_000 + k, label, v.tobytes()) for label, x in labels.items() for k, v in enumerate(x)]
    own = spark.createDataFrame(rows, "id long, grp long, load binary").repartition(3)
    groups = spark.createDataFrame([(g, len(x)) for g, x in labels.items()], "grp long, size long")
    centres = spark.createDataFrame([(g, x.mean(axis=0).tobytes()) for g, x in labels.items()], "grp long, centre binary")

    def plan() -> tuple[dict, dict]:
        plans, counts = embeddings.planned(own, groups, centres, 0.93, 16, 1e-3, 7)
        found: dict = {}
        for r in counts.collect():
            found.setdefault((r.grp, r.place), []).append((r.step, r.n))
        return {r.grp: (r.passes, r.window) for r in plans.collect()}, found

    plans, counts = plan()
    assert set(plans) == {3, 5, 7} and plans[7] == (1, 16) and plans[5][0] >= 1
    assert all(sum(n for _, n in found) == len(labels[g]) for (g, _), found in counts.items()) and {g for g, _ in counts} == {3, 5}
    mean = lambda found: sum(2 ** (s / 8) * n for s, n in found) / sum(n for _, n in found)
    old, embeddings.TRIAL_ROWS = embeddings.TRIAL_ROWS, 5000
    try:
        _, parted = plan()
    finally:
        embeddings.TRIAL_ROWS = old
    assert all(sum(n for _, n in found) == len(labels[g]) and mean(found) <= mean(counts[g, place]) + 1e-9 for (g, place), found in parted.items())


def test_plans_keep_their_promise():
    """Planned passes against a plain model of keys, sorting and windows."""
    x = clusters(4000, 300, mutual=0.7)
    centred = x - x.mean(axis=0)
    sample = centred[np.random.default_rng(1).permutation(len(x))[:256]]
    passes = embeddings.passes_for(sample, len(x), 0.935, 32, 1e-2)
    assert passes < embeddings.passes_for(sample, 10 * len(x), 0.935, 32, 1e-2) and embeddings.passes_for(sample, 33, 0.935, 32, 1e-2) == 1
    met = np.zeros(300, bool)
    for k in range(passes):
        bits = centred @ np.random.default_rng([9, k]).standard_normal((64, 62)) > 0
        place = np.empty(len(x), int)
        place[np.lexsort(bits.T[::-1])] = np.arange(len(x))
        met |= np.abs(place[:300] - place[-300:]) <= 32
    assert met.mean() >= 0.97


def test_neighbours_over_the_edges_of_partitions(spark):
    rows = [(k, 0, 2, 0, k, np.array([math.cos(k / 10), math.sin(k / 10)]).tobytes()) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, grp long, window int, pass int, key long, load binary")
    for parts in (3, 16, 60):
        placed = df.repartitionByRange(parts, "pass", "grp", "key", "id").sortWithinPartitions("pass", "grp", "key", "id")
        found = groups.components(embeddings.neighbours(placed, math.cos(0.15))).collect()
        assert sorted((r.node, r.root) for r in found) == [(k, 0) for k in range(1, 40)]


def test_meetings_are_the_shared_band_hashes(spark):
    """Ids tied by a band hash, over batches and partitions, against plain sharing; one hash is in every row."""
    rng = random.Random(8)
    rows = [(k, [1, *(rng.randrange(2, 400) for _ in range(3))] if k % 3 else [rng.randrange(1000, 9000) for _ in range(4)]) for k in range(300)]
    links = [(a, b) for a, (_, x) in enumerate(rows) for b, (_, y) in enumerate(rows) if a < b and set(x) & set(y)]
    at = classes(len(rows), links)
    for parts, per_task in ((1, 1000), (7, 1000), (7, 20)):
        df = spark.createDataFrame(rows, "id long, bands array<long>").repartition(parts)
        tied = df.mapInArrow(jaccard._meetings, "h long, id long, other long").repartition(parts, "h").sortWithinPartitions("h", "id").mapInArrow(jaccard._tied, "id long, other long")
        found = {r.node: r.root for r in groups.components(tied, "id", "other", per_task).collect()}
        assert [found.get(k, k) for k in range(len(rows))] == at


def test_documents_that_repeat_or_hold_no_word(spark):
    """Rows with one id and text leave one row, by the other columns; texts without words all stay; a class without ids leaves one."""
    rows = [(1, "a b c", "z"), (1, "a b c", "y"), (1, "a b c", "y"), (None, "p q", "x"), (None, "p q", "w"), (2, " \n", "x"), (2, " \n", "x"), (None, None, "x"), (None, None, None), (3, "", "x")]
    kept = jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, rest string").repartition(3))
    got = sorted((r.doc_id or 0, r.text or "", r.rest or "") for r in kept.collect())
    assert [g[0] for g in got] == [0, 0, 0, 1, 2, 2, 3] and [g[1] for g in got] == ["", "", "p q", "a b c", " \n", " \n", ""]


def test_recall_of_the_bands(spark):
    """Pairs just above the threshold: 400 pairs of texts with a similarity of 0.8 to 0.82, measured rather than computed."""
    rng = random.Random(6)
    rows = []
    for k in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(94)]  # 90 grams; each changed word far from others takes 5 from each side
        other = list(words)
        for at in (20, 60):
            other[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(grams(rows[0][1]) & grams(rows[1][1])) / len(grams(rows[0][1]) | grams(rows[1][1])) == 0.8
    assert sum(r.n_links for r in found) >= 0.99 * len(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    nodes = sorted({x for e in edges for x in e})
    place = {x: k for k, x in enumerate(nodes)}
    at = classes(len(nodes), [(place[a], place[b]) for a, b in edges])
    for per_task in (groups.EDGES, 40):  # one task's stars, and rounds
        found = {r.node: r.root for r in groups.components(spark.createDataFrame(edges, "a long, b long").repartition(5), per_task=per_task).collect()}
        assert {x: found.get(x, x) for x in nodes} == {x: nodes[at[place[x]]] for x in nodes}
