"""Whole comparisons: against a plain model on random tables, invariants, views, chunks and streams."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowdelta import DiffOptions, diff, from_table, read_csv_text
from rowdelta.operators import content
from rowdelta.sources.dataset import numbered
from rowdelta.streaming.incremental import Differ, PartialResult, StreamingKeyDiff, stream_csv
from test_functions import plain_jaro_winkler  # tests/

STRICT = DiffOptions(case_sensitive=True, ignore_whitespace=False, ignore_empty_vs_null=False)


def table(rng: random.Random, n: int, width: int = 3) -> list[tuple[str, ...]]:
    return [tuple(rng.choice(["", "null", "Ab", "ab", "abc", "abd", "xyz", " ab", "q"]) for _ in range(width)) for _ in range(n)]


def csv(rows, names=("a", "b", "c")) -> str:
    return "\n".join([",".join(names), *[",".join(f'"{c}"' for c in r) for r in rows]]) + "\n"


def norm(v: str, o: DiffOptions) -> str:
    if o.ignore_empty_vs_null and (not v.strip() or v.strip().lower() == "null"):
        return "EMPTY_OR_NULL" if o.case_sensitive else "empty_or_null"
    v = v.strip() if o.ignore_whitespace else v
    return v if o.case_sensitive else v.lower()


def model(source, target, o: DiffOptions) -> set:
    """(status, source row, target row) of the set strategy, row by row."""
    prints = lambda rows: [tuple(norm(c, o) for c in r) for r in rows]
    ps, pt = prints(source), prints(target)
    free, out, rest = set(range(len(target))), set(), []
    for i, p in enumerate(ps):
        j = max((j for j in free if pt[j] == p), default=None)
        if j is None:
            rest.append(i)
        else:
            free.discard(j)
            out.add(("unchanged", i, j))
    wishes = {}
    for i in rest:
        best = None
        for j in sorted(free):
            if not any(c.strip() and c == (d if o.case_sensitive else d.lower()) for c, d in zip(source[i], target[j], strict=True)):
                continue
            score = round(sum(1.0 if x == y else plain_jaro_winkler(x, y) for x, y in zip(ps[i], pt[j], strict=True)) / len(ps[i]), 12)
            if score > 0.5 and (best is None or score > best[0]):
                best = (score, j)
        if best:
            wishes[i] = best
    for i, (score, j) in sorted(wishes.items(), key=lambda x: (-x[1][0], x[0])):
        if j in free:
            free.discard(j)
            rest.remove(i)
            out.add(("modified", i, j))
    return out | {("removed", i, None) for i in rest} | {("added", None, j) for j in free}


@pytest.mark.parametrize("seed", range(6))
def test_content_is_the_model(spark, seed):
    rng = random.Random(seed)
    source, target = table(rng, 25), table(rng, 22)
    o = STRICT if seed % 2 else DiffOptions()
    # The reader trims; the model gets trimmed cells too.
    trim = lambda rows: [tuple(c.strip() for c in r) for r in rows]
    result = diff(read_csv_text(spark, csv(source)), read_csv_text(spark, csv(target)), o)
    assert {(r.status, r.source_idx, r.target_idx) for r in result.rows.collect()} == model(trim(source), trim(target), o)


def test_small_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    sides = [read_csv_text(spark, csv(table(rng, 60))) for _ in range(2)]
    get = lambda: {(r.status, r.source_idx, r.target_idx, r.score) for r in diff(*sides, STRICT).rows.collect()}
    whole = get()
    monkeypatch.setattr(content, "CHUNK", 7)
    monkeypatch.setattr(content, "HOT_ROWS", 3)
    assert get() == whole


def greedy_model(source, target) -> set:
    def score(a, b):
        return sum(plain_jaro_winkler(x, y) for x, y in zip(a, b, strict=True)) / len(a)

    free, out = set(range(len(target))), set()
    for i, row in enumerate(source):
        exact = max((j for j in free if target[j] == row), default=None)
        best = max(((round(score(row, target[j]), 12), -j) for j in free if any(c and c == d for c, d in zip(row, target[j], strict=True))), default=(0, 0))
        j = exact if exact is not None else -best[1] if best[0] > 0.5 else None
        if j is None:
            out.add(("removed", i, None))
        else:
            free.discard(j)
            out.add(("unchanged" if exact is not None else "modified", i, j))
    return out | {("added", None, j) for j in free}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_is_the_row_by_row_loop(spark, seed):
    rng = random.Random(seed)
    source, target = ([tuple(c.strip() for c in r) for r in table(rng, 14)] for _ in range(2))
    o = STRICT.but(strategy="greedy", similarity="row")
    rows = diff(read_csv_text(spark, csv(source)), read_csv_text(spark, csv(target)), o).rows.collect()
    assert {(r.status, r.source_idx, r.target_idx) for r in rows} == greedy_model(source, target)


def keyed_sides(spark, seed, n=40):
    rng = random.Random(seed)
    make = lambda: [(str(k), *r) for k, r in zip(rng.sample(range(60), n), table(rng, n, 2), strict=True)]
    a, b = make(), make()
    return a, b, read_csv_text(spark, csv(a, ("id", "b", "c"))), read_csv_text(spark, csv(b, ("id", "b", "c")))


def test_keyed_invariants(spark):
    a, b, source, target = keyed_sides(spark, 1)
    o = STRICT.but(mode="primary-key", key_columns=("id",))
    counts, back = diff(source, target, o).counts(), diff(target, source, o).counts()
    assert counts["added"] == back["removed"] and counts["removed"] == back["added"] and counts["modified"] == back["modified"]
    assert counts["removed"] + counts["modified"] + counts["unchanged"] == len(a)
    assert counts["added"] + counts["modified"] + counts["unchanged"] == len(b)
    left = dict((r[0], tuple(c.strip() for c in r[1:])) for r in a)
    right = dict((r[0], tuple(c.strip() for c in r[1:])) for r in b)
    assert counts["modified"] == sum(left[k] != right[k] for k in left.keys() & right.keys())
    assert diff(source, target, o.but(excluded_columns=("b", "c"))).counts()["modified"] == 0
    flat = {(r.key, r.column, r.old_value, r.new_value) for r in diff(source, target, o).differences().collect()}
    assert flat == {(k, c, left[k][i], right[k][i]) for k in left.keys() & right.keys() for i, c in enumerate("bc") if left[k][i] != right[k][i]}


def test_first_repeated_key_is_named(spark):
    good = read_csv_text(spark, "id,v\n1,a")
    with pytest.raises(ValueError, match=re.escape('found in source: "3"')):
        diff(read_csv_text(spark, "id,v\n9,a\n3,a\n3,b\n9,c"), good, mode="primary-key", key_columns="id")
    with pytest.raises(ValueError, match="at least one key"):
        diff(good, good, mode="primary-key")
    last = diff(read_csv_text(spark, "id,v\n1,a\n1,b"), good, mode="primary-key", key_columns="id", on_duplicate="last")
    assert [(r.old_value, r.new_value) for r in last.differences().collect()] == [("b", "a")]


def test_text_diff_and_result_parts(spark):
    result = diff(read_csv_text(spark, "id,v,gone\n1,a b,x\n2,q,y"), read_csv_text(spark, "id,v,new\n1,a c,z\n3,r,w"), STRICT.but(mode="primary-key", key_columns=("id",), text_diff=True))
    assert [(d.column, [tuple(c) for c in d.diff][2:]) for d in result.modified.first().differences] == [("v", [(False, True, "b"), (True, False, "c")])]
    assert result.added.first().target_row == {"id": "3", "v": "r", "new": "w"} and result.removed.first().source_row == {"id": "2", "v": "q", "gone": "y"}
    assert result.unchanged.count() == 0 and result.view().columns == ["id", "v", "new", "gone"]
    assert result.count_rows().first().asDict() == {"added": 1, "removed": 1, "modified": 1, "unchanged": 0, "total": 3}
    assert result.metrics.total >= 0 and "plan" in result.metrics.seconds


def test_view(spark):
    result = diff(read_csv_text(spark, "id,v\n1,old\n2,same\n3,gone\n10,Old"), read_csv_text(spark, "id,v\n1,new\n2,same\n4,fresh\n10,Next"), STRICT.but(mode="primary-key", key_columns=("id",)))
    view = result.view()
    rows = lambda v: [(r.status, r.key) for r in v.table().collect()]
    assert rows(view) == [("modified", "1"), ("modified", "10"), ("added", "4"), ("removed", "3"), ("unchanged", "2")]
    assert rows(view.search("old")) == []  # old values of changed rows aren't searched
    assert rows(view.search("gone OR fresh")) == [("added", "4"), ("removed", "3")]
    assert rows(view.only_differences().with_status("added")) == [("added", "4")] and rows(view.with_status("all")) == rows(view)
    assert view.search("new").with_status("added").counts().first().total == 2 - 1 and view.with_status("added").visible_count() == 1
    assert rows(view.filter_column("v", "E").filter_type("Modified")) == [("modified", "1"), ("modified", "10")]
    assert [k for _, k in rows(view.sort_by("id"))] == ["1", "10", "2", "3", "4"]
    assert [k for _, k in rows(view.sort_by("id", descending=True, numeric=True))] == ["10", "4", "3", "2", "1"]
    assert [r.key for r in view.page(1, 2).collect()] == ["10", "4"]
    assert view.hide("v").table().columns == ["status", "key", "id"] and view.hide("v").show("v").table().columns == ["status", "key", "id", "v"]
    assert view.rows.select(view.change_text("v").alias("x")).where("key = '1'").first().x == "old → new"


def test_chunks(spark):
    source, target = read_csv_text(spark, "id,name,age\n1,Alice,30\n2,Bob,25\n3,Charlie,35"), read_csv_text(spark, "id,name,age\n1,Alice,30\n2,Bobby,25\n4,David,28")
    by_key = STRICT.but(mode="primary-key", key_columns=("id",))
    count = lambda df: Counter(r.status for r in df.collect())
    assert count(Differ(source, target, by_key).chunk(0, 10)) == Counter(added=1, removed=1, modified=1, unchanged=1)
    parts = Differ(source, target, by_key)
    first, second = count(parts.chunk(0, 2)), count(parts.chunk(2, 2))
    assert first == Counter(modified=1, unchanged=1) and second == Counter(added=1, removed=1)
    source, target = read_csv_text(spark, "name,age,city\nAlice,30,NYC\nBob,25,LA\nCharlie,35,Chicago"), read_csv_text(spark, "name,age,city\nAlice,30,NYC\nBob,25,San Francisco\nDavid,28,Seattle")
    rows = Differ(source, target, STRICT).chunk(0, 10).collect()
    assert sorted((r.status, r.key) for r in rows) == [("added", "Added 1"), ("modified", "Row 2"), ("removed", "Removed 1"), ("unchanged", "Row 1")]
    said = []
    from rowdelta import StreamingConfig

    done = Differ(source, target, STRICT, StreamingConfig(chunk_size=1, progress_interval=1), lambda p, m: said.append(round(p))).chunks()
    assert count(done.rows) == Counter(added=1, removed=1, modified=1, unchanged=1) and said == [33, 67, 100]
    assert PartialResult().progress == 100.0 and PartialResult(None, 5, 10).progress == 50.0


def test_stream(spark, tmp_path):
    a, b, source, target = keyed_sides(spark, 3)
    o = STRICT.but(mode="primary-key", key_columns=("id",))
    for part in range(3):
        target.named().where(F.col("_row_idx") % 3 == part).coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    stream = spark.readStream.schema("_row_idx long, id string, b string, c string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    live = StreamingKeyDiff(source, ("id", "b", "c"), o, f"{tmp_path}/out")
    live.start(stream).awaitTermination(120)
    key = lambda rows: sorted((r.status, r.key) for r in rows)
    assert key(live.finish().collect()) == key(diff(source, target, o).rows.collect())


def test_stream_of_csv_files(spark, tmp_path):
    a, b, source, target = keyed_sides(spark, 4)
    o = STRICT.but(mode="primary-key", key_columns=("id",))
    (tmp_path / "in").mkdir()
    for part in range(2):
        (tmp_path / "in" / f"{part}.csv").write_text(csv(b[part::2], ("id", "b", "c")))
    live = StreamingKeyDiff(source, ("id", "b", "c"), o, f"{tmp_path}/out")
    live.start(stream_csv(spark, f"{tmp_path}/in", ("id", "b", "c"))).awaitTermination(120)
    key = lambda rows: sorted((r.status, r.key) for r in rows)
    assert key(live.finish().collect()) == key(diff(source, target, o).rows.collect())
    assert [c.df.count() for c in source.chunks(15)] == [15, 15, 10]


def test_a_key_that_comes_twice_is_an_error(spark, tmp_path):
    """Within a batch and over batches, when it arrives."""
    source, _ = (read_csv_text(spark, text) for text in ("id,b\n1,x\n2,y\n", "id,b\n"))
    o = STRICT.but(mode="primary-key", key_columns=("id",))
    batch = lambda *rows: spark.createDataFrame(list(rows), "id string, b string")
    live = StreamingKeyDiff(source, ("id", "b"), o, f"{tmp_path}/out")
    live._batch(batch(("1", "x"), ("3", "z")), 0)
    live._batch(batch(("1", "x"), ("3", "z")), 0)  # the same batch once more, after a failure
    with pytest.raises(ValueError, match='Duplicate Primary Key found in target: "1"'):
        live._batch(batch(("1", "q"), ("4", "q")), 1)
    with pytest.raises(ValueError, match="Duplicate Primary Key found in target"):
        live._batch(batch(("5", "x"), ("5", "z")), 2)
    again = StreamingKeyDiff(source, ("id", "b"), o, f"{tmp_path}/out")  # another session
    with pytest.raises(ValueError, match='Duplicate Primary Key found in target: "3"'):
        again._batch(batch(("3", "q")), 1)
    again._batch(batch(("4", "q")), 1)
    assert sorted((r.status, r.key) for r in again.finish().collect()) == [("added", "3"), ("added", "4"), ("removed", "2"), ("unchanged", "1")]


def test_greedy_with_many_copies(spark):
    """Copies on both sides, beside rows that take one of them first, against the loop itself."""
    rng = random.Random(9)
    a = [("same", "k", "1")] * 12 + [("same", "k", str(n)) for n in range(3)] + [(rng.choice("xyz"), "k", rng.choice("12")) for _ in range(10)]
    b = [("same", "k", "1")] * 9 + [("samey", "k", "1"), ("same", "k", "2")] + [(rng.choice("xyz"), "k", rng.choice("12")) for _ in range(8)]
    rng.shuffle(a), rng.shuffle(b)
    o = STRICT.but(strategy="greedy", threshold=0.5)
    score = lambda x, y: round(sum(1.0 if u == v else plain_jaro_winkler(u, v) for u, v in zip(x, y, strict=True)) / 3, 12)
    free, expected = set(range(len(b))), set()
    for i, x in enumerate(a):
        copies = [j for j in free if b[j] == x]
        good = sorted((-score(x, b[j]), j) for j in free if score(x, b[j]) > 0.5)
        to = max(copies) if copies else good[0][1] if good else None
        expected.add((i, to))
        free.discard(to)
    found = diff(read_csv_text(spark, csv(a)), read_csv_text(spark, csv(b)), o).rows.where("source_idx is not null").collect()
    assert {(r.source_idx, r.target_idx) for r in found} == expected


def test_row_numbers(spark):
    df = spark.range(1000).repartition(7).select(F.col("id").alias("x"))
    rows = numbered(df, "n", [F.col("x").desc()]).collect()
    assert {(r.x, r.n) for r in rows} == {(999 - k, k) for k in range(1000)}
    typed = from_table(spark.sql("select 1.005D as d, -0.0D as z, 1e20D as big, double('nan') as nan, cast(null as double) as none, cast(null as string) as s, timestamp_ntz'2020-01-02 03:04:05' as t, 7 as k"), "k")
    assert typed.named().first().asDict() == {"_row_idx": 7, "d": "1.005", "z": "0.0", "big": "1.0E20", "nan": "NaN", "none": "", "s": "", "t": "2020-01-02 03:04:05", "k": "7"}
