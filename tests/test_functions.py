"""Scalar functions, the search language and codecs."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowdelta import DiffOptions, diff, read_csv, read_csv_bytes, read_csv_text, sample
from rowdelta.functions.keys import fingerprint, fingerprint_hash, row_key
from rowdelta.functions.normalize import is_empty_or_null, normalized, unicode_trim
from rowdelta.functions.similarity import edit_distance, jaro_winkler, jaro_winkler_distinct, jaro_winkler_pairs, normalized_levenshtein
from rowdelta.functions import textdiff
from rowdelta.functions.textdiff import changes_of, word_changes, word_diff
from rowdelta.options import PROFILES, StreamingConfig
from rowdelta.plans import catalog
from rowdelta.plans.search import SearchToken, parse_search, remove_token, search_predicate, tokens_to_query
from rowdelta.sources.codec import decode_frame, encode_row, to_binary_frame, to_json


def plain_jaro_winkler(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, left = list(range(len(b))), []
    for i, c in enumerate(a):
        j = next((j for j in free if abs(i - j) <= reach and b[j] == c), None)
        if j is not None:
            free.remove(j)
            left.append((i, j))
    if not left:
        return 0.0
    m = len(left)
    matched_b = sorted(j for _, j in left)
    swaps = sum(a[i] != b[j] for (i, _), j in zip(left, matched_b, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcé漢", max_size=9), st.text("abcé漢", max_size=9)), min_size=1, max_size=12))
def test_jaro_winkler_is_the_formula(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    expected = [plain_jaro_winkler(x, y) for x, y in pairs]
    assert jaro_winkler_pairs(a, b) == pytest.approx(expected)
    assert jaro_winkler_distinct(a, b) == pytest.approx(expected)


def test_similarity_bounds(spark):
    df = spark.createDataFrame([("Alice", "Alice"), ("Alice", "Alicia"), ("Alice", "Bob"), ("", ""), ("", "x"), ("Los Angeles", "LA")], "a string, b string")
    jw = [r[0] for r in df.select(jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert jw[0] == 1 and jw[1] > 0.8 and jw[2] < 0.5 and jw[3] == 1 and jw[4] == 0 and jw[5] == pytest.approx(0.754545, abs=1e-5)
    df = spark.createDataFrame([("New York", "New York"), ("New York", "New York City"), ("New York", "Los Angeles"), ("", "")], "a string, b string")
    lev = [r[0] for r in df.select(normalized_levenshtein(F.col("a"), F.col("b"))).collect()]
    assert lev[0] == 1 and lev[1] > 0.6 and lev[2] < 0.5 and lev[3] == 1


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (c != d)))
    assert edit_distance(a, b) == row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n", max_size=30), st.text("ab \n", max_size=30), st.sampled_from([(0, 4), (3, 1 << 26), (256, 1 << 26)]))
def test_word_changes_rebuild_both_texts(old, new, kept):
    was = textdiff.FEW, textdiff.KEPT_BYTES
    textdiff.FEW, textdiff.KEPT_BYTES = kept
    try:
        changes = word_changes(old, new)
    finally:
        textdiff.FEW, textdiff.KEPT_BYTES = was
    assert "".join(v for added, _, v in changes if not added) == old
    assert "".join(v for _, removed, v in changes if not removed) == new
    assert not any(added and removed for added, removed, _ in changes)
    assert (old == new) == (not any(added or removed for added, removed, _ in changes))


def test_scripts_are_shortest_by_rows_of_bits_too(monkeypatch):
    rng = random.Random(1)
    for _ in range(600):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        row = [0] * (len(b) + 1)  # longest common subsequence
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        for few, kept in ((0, 0), (0, 2), (2, 1000), (256, 0)):
            monkeypatch.setattr(textdiff, "FEW", few)
            monkeypatch.setattr(textdiff, "KEPT_BYTES", kept)
            script = textdiff._script(a, b)
            assert [v for added, _, v in script if not added] == a and [v for _, removed, v in script if not removed] == b
            assert sum(added or removed for added, removed, _ in script) == len(a) + len(b) - 2 * row[-1]
    far = [" ".join(f"{side}{k}" if k % 2 else f"c{k}" for k in range(2400)) for side in "ab"]
    monkeypatch.undo()
    assert sum(added or removed for added, removed, _ in word_changes(*far)) == 2400


def test_word_changes_of_long_texts_take_seconds():
    rng = random.Random(3)
    old = [f"w{rng.randint(0, 3000)}" for _ in range(20_000)]
    new = [w if rng.random() < 0.5 else f"w{rng.randint(0, 3000)}" for w in old]
    began = time.perf_counter()
    changes = word_changes(" ".join(old), " ".join(new))
    assert time.perf_counter() - began < 30
    assert "".join(v for added, _, v in changes if not added) == " ".join(old) and "".join(v for _, removed, v in changes if not removed) == " ".join(new)
    assert sum(added or removed for added, removed, _ in changes) <= 2 * sum(a != b for a, b in zip(old, new, strict=True))


def test_word_diffs_of_far_texts_compare_few_words():
    """The greedy search walked through 256 edits before it was given up, some 33,000 comparisons for every pair of unrelated texts."""
    compared = []

    class Word(str):
        __hash__ = str.__hash__

        def __eq__(self, other):
            compared.append(other)
            return str.__eq__(self, other)

    a, b = ([Word(" ") if k % 2 else Word(f"{side}{k}") for k in range(400)] for side in "ab")
    script = textdiff._script(a, b)
    assert len(compared) <= len(a) + len(b)
    assert [v for added, _, v in script if not added] == a and [v for _, removed, v in script if not removed] == b
    assert sum(added or removed for added, removed, _ in script) == 400


@pytest.mark.parametrize("held", [1, 200, 1 << 19])
def test_word_diffs_of_a_batch_are_those_of_its_pairs(monkeypatch, held):
    monkeypatch.setattr(textdiff, "HELD_BYTES", held)
    rng = random.Random(5)
    spaces = [" ", "  ", "\n", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", ""]
    text = lambda: rng.choice([None, "", " "] + [t for _ in range(5) for t in ["".join(rng.choice(["a", "B", "ß", "İ", "你好", "😀", "Σ"]) + rng.choice(spaces) for _ in range(rng.randint(1, 60)))]])
    old = [text() for _ in range(200)]
    new = [rng.choice([a, text(), (a or "")[:9] + "x " + (a or "")[9:]]) for a in old]
    sides = [pa.array(["skipped", *x], kind).slice(1) for x in (old, new) for kind in (pa.string(), pa.large_string())]
    for few, case in ((256, True), (256, False), (0, True)):
        monkeypatch.setattr(textdiff, "FEW", few)
        expected = [word_changes(a, b, case) for a, b in zip(old, new, strict=True)]
        for a, b in (sides[::2], sides[1::2]):
            assert [[tuple(c.values()) for c in changes] for changes in changes_of(a, b, case).to_pylist()] == expected
    none = pa.array([], pa.string())
    assert changes_of(none, none).to_pylist() == [] and changes_of(pa.array([None], pa.string()), pa.array([None], pa.string())).to_pylist() == [[]]


def test_word_changes_are_few():
    assert [c for c in word_changes("Hello World", "Hello Universe") if c[0] or c[1]] == [(False, True, "World"), (True, False, "Universe")]
    assert not any(a or r for a, r, _ in word_changes("Hello World", "hello world", case_sensitive=False))
    assert any(a or r for a, r, _ in word_changes("Hello World", "hello world"))
    assert sum(a or r for a, r, _ in word_changes("a b c d e f", "a c d x e f")) == 4


def test_word_diff_column(spark):
    row = spark.createDataFrame([("a b", "a c"), (None, "x")], "o string, n string").select(word_diff(F.col("o"), F.col("n")).alias("d")).collect()
    assert [tuple(x) for x in row[0].d] == [(False, False, "a"), (False, False, " "), (False, True, "b"), (True, False, "c")]
    assert [tuple(x) for x in row[1].d] == [(True, False, "x")]


def test_normalize(spark):
    values = ["  Ab c　\t", "", " NULL ", "null", "x", "EMPTY_OR_NULL", "İ"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    get = lambda c: [r[0] for r in df.select(c).collect()]
    assert get(unicode_trim(F.col("v"))) == [v.strip() for v in values]
    assert get(is_empty_or_null(F.col("v"))) == [False, True, True, True, False, False, False]
    assert get(normalized(F.col("v"), DiffOptions()))[:6] == ["ab c", "empty_or_null", "empty_or_null", "empty_or_null", "x", "empty_or_null"]
    strict = DiffOptions(case_sensitive=True, ignore_whitespace=False, ignore_empty_vs_null=False)
    assert get(normalized(F.col("v"), strict)) == values
    assert get(normalized(F.col("v"), strict.but(ignore_empty_vs_null=True)))[1:4] == ["EMPTY_OR_NULL"] * 3


def test_keys(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    keys = df.select(row_key([F.col("x"), F.col("y")]), fingerprint([F.col("x"), F.col("y")], DiffOptions()), fingerprint_hash([F.col("x"), F.col("y")], DiffOptions())).collect()
    assert keys[0][0] == keys[1][0] == "a|b|c" and keys[0][1] == "a|b||c" and keys[0][2] != keys[1][2]


def kinds(query, **how):
    return [(t.type, t.value, t.column, t.operator) for t in parse_search(query, **how)]


def test_search_tokens():
    assert kinds("john doe") == [("term", "john", None, "AND"), ("term", "doe", None, "AND")]
    assert kinds("-unwanted john") == [("exclude", "unwanted", None, "AND"), ("term", "john", None, "AND")]
    assert kinds('"hello world"') == [("phrase", "hello world", None, "AND")]
    assert kinds("name:john age:30") == [("column", "john", "name", "AND"), ("column", "30", "age", "AND")]
    assert kinds("john OR jane") == [("term", "john", None, "AND"), ("term", "jane", None, "OR")]
    assert kinds("orange") == [("term", "ange", None, "OR")] and kinds("orange", strict_or=True) == [("term", "orange", None, "AND")]
    assert kinds("-name:john") == [("column", "john", "name", "AND")]
    assert kinds(":x y:") == [("term", ":x", None, "AND"), ("term", "y:", None, "AND")]
    assert kinds('-"a b" "open') == [("exclude", "a b", None, "AND"), ("phrase", "open", None, "AND")]
    assert kinds("-") == [] and kinds("  ") == []
    assert kinds('name:"john doe"') == [("term", "name:", None, "AND"), ("phrase", "john doe", None, "AND")]


def test_query_from_tokens():
    query = 'a OR -b "c d" name:x'
    assert tokens_to_query(parse_search(query)) == query
    assert remove_token(parse_search(query), 0) == '-b "c d" name:x'
    assert [t.label for t in parse_search(query)] == ["a", "-b", '"c d"', "name:x"]


def matches(spark, query, rows):
    df = spark.createDataFrame([(r.get("name", ""), r.get("role", "")) for r in rows], "name string, role string")
    cell = {"name": F.col("name"), "role": F.col("role")}
    return [r[0] for r in df.select(search_predicate(parse_search(query), F.concat_ws(" ", "name", "role"), cell)).collect()]


def test_search_predicates(spark):
    people = [{"name": "John", "role": "manager"}, {"name": "Jane", "role": "developer"}, {"name": "Other", "role": "johnny"}]
    assert matches(spark, "john", people) == [True, False, True]
    assert matches(spark, "-manager", people) == [False, True, True]
    assert matches(spark, "john OR jane", people) == [True, True, True]
    assert matches(spark, "name:john", people) == [True, False, False]
    assert matches(spark, "Name:john", people) == [False, False, False]
    assert matches(spark, "john manager OR jane developer", people) == [True, True, False]
    assert matches(spark, "", people) == [True] * 3
    assert search_predicate([SearchToken("term", "x")], F.lit("X"), {}) is not None


def test_csv_parsing(spark, tmp_path):
    data = read_csv_text(spark, "id,name,age\n1,Alice,30\n2,Bob,25")
    assert data.headers == ("id", "name", "age") and sample(data) == [{"id": "1", "name": "Alice", "age": "30"}, {"id": "2", "name": "Bob", "age": "25"}]
    assert read_csv_text(spark, "1,Alice\n2,Bob", has_headers=False).headers == ("Column1", "Column2")
    sniffed = read_csv_text(spark, "1,2,3\nAlice,30,NYC\nBob,25,LA")
    assert sniffed.headers == ("Column1", "Column2", "Column3") and sniffed.df.count() == 3 and sniffed.warnings
    assert read_csv_text(spark, ",name\n0,Alice").headers == ("Column1", "Column2")
    assert read_csv_text(spark, "").headers == () and read_csv_text(spark, "").df.count() == 0
    assert sample(read_csv_text(spark, "a,a\n1,2"))[0] == {"a": "2"}
    with pytest.raises(ValueError, match="fields"):
        read_csv_text(spark, "a,b\n1,2,3")
    with pytest.raises(ValueError, match="Invalid UTF-8"):
        read_csv_bytes(spark, b"a\n\xff")
    seen = []
    read_csv_bytes(spark, "a,b\n1,é".encode(), progress=lambda p, m: seen.append(p))
    assert seen == [5, 95]
    path = tmp_path / "x.csv"
    path.write_bytes('id,note\r\n1,"a ""b""\nc"\n2, padded \n\n3,\n7,"x",\n'.replace(',"x",\n', ',"x"\n').encode())
    named = read_csv(spark, str(path)).named().orderBy("_row_idx").collect()
    assert [tuple(r) for r in named] == [(0, "1", 'a "b"\nc'), (1, "2", "padded"), (2, "3", ""), (3, "7", "x")]
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(ValueError, match="number of fields"):
        read_csv(spark, str(path))
    path.write_text("")
    assert read_csv(spark, str(path)).headers == ()


def test_codec_round_trip(spark):
    result = diff(read_csv_text(spark, "id,name\n1,Zoë\n2,Bob\n3,Cy"), read_csv_text(spark, "id,name\n1,Zoe\n2,Bob\n4,漢"), mode="primary-key", key_columns="id")
    frame = to_binary_frame(result.rows)
    decoded = decode_frame(frame)
    assert {s: len(v) for s, v in decoded.items()} == {"added": 1, "removed": 1, "modified": 1, "unchanged": 1}
    assert decoded["added"][0] == {"key": "4", "targetRow": {"id": "4", "name": "漢"}}
    assert decoded["modified"][0]["differences"] == [{"column": "name", "oldValue": "Zoë", "newValue": "Zoe"}]
    for broken in (frame[:-1], frame[:10], frame[:20] + b"\x09" + frame[21:]):
        with pytest.raises(ValueError):
            decode_frame(broken)
    assert encode_row("unchanged", "k", {}, None, [])[0] == 4
    lines = [r[0] for r in to_json(result.rows).collect()]
    assert any('"oldValue":"Zoë"' in x for x in lines) and any('"row":{"id":"2","name":"Bob"}' in x for x in lines)


def test_options():
    o = DiffOptions(mode="primary_key", key_columns=" a , ,b", excluded_columns=["c"])
    assert (o.mode, o.key_columns, o.excluded_columns) == ("primary-key", ("a", "b"), ("c",))
    for wrong in ({"mode": "x"}, {"similarity": "x"}, {"strategy": "x"}, {"on_duplicate": "x"}):
        with pytest.raises(ValueError, match=re.escape(next(iter(wrong)))):
            DiffOptions(**wrong)
    assert StreamingConfig() == StreamingConfig(5000, True, 10) and StreamingConfig().with_progress_interval(3).progress_interval == 3
    assert {p.chunk_size for p in PROFILES.values()} == {50_000, 10_000, 5_000}
    assert np.isclose(DiffOptions().threshold, 0.5)


def test_word_diffs_of_many_texts_hold_few_python_objects():
    """A diff's words were dictionaries all at once, a whole batch of texts long."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(2000)) for _ in range(200)]
    held = pa.array(texts)
    tracemalloc.start()
    try:
        found = changes_of(held, held)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20  # 800,000 words as dictionaries take above 150 MB
    assert ["".join(d["value"] for d in found[k].as_py()) for k in (0, 199)] == [texts[0], texts[199]]


def test_word_diff_has_rows_sent_in_batches_of_bytes(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    word_diff(F.col("a"), F.col("b"))
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", before or -1)) <= 4 << 20


def test_sum_of_squares_beyond_a_long(spark, tmp_path):
    write = lambda keys: spark.createDataFrame([(k,) for k in keys], "l_partkey long").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda: catalog.QUERIES["benchmark_parallel"](spark, str(tmp_path))
    for keys, kind in (([3_000_000_000, 2_999_999_999], "decimal(38,0)"), ([3, 4], "bigint")):
        write(keys)
        assert run().dtypes == [("sum_of_squares", kind)] and int(run().first()[0]) == sum(k * k for k in keys)
    write([4_000_000_000])
    assert int(run().first()[0]) == 4_000_000_000**2
