"""Results written and read by tasks, counts and progress, natural order."""

import time

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from rowdelta import diff, read_csv_text
from rowdelta.plans.progress import followed
from rowdelta.plans.view import natural_key
from rowdelta.sources.codec import decode_frame, decode_frames, encode_frames, encode_row, frame_counts, read_frames, write_frames


@pytest.fixture(scope="module")
def result(spark):
    old = "id,name\n" + "\n".join(f"{k},n{k % 7}" for k in range(60)) + "\n100,Zoë"
    new = "id,name\n" + "\n".join(f"{k},n{k % 5}" for k in range(5, 70)) + "\n100,漢"
    return diff(read_csv_text(spark, old), read_csv_text(spark, new), mode="primary-key", key_columns="id")


def test_frames_are_written_and_read_in_parts(spark, result, tmp_path):
    write_frames(result.rows.repartition(3), f"{tmp_path}/f", 200)
    frames = spark.read.parquet(f"{tmp_path}/f").collect()
    assert len(frames) > 6 and all({s: len(v) for s, v in decode_frame(bytes(f["data"])).items()} == {s: f[s] for s in ("added", "removed", "modified", "unchanged")} for f in frames)
    assert frame_counts(spark, f"{tmp_path}/f") == result.counts()
    shown = lambda d: sorted((r.status, r.key, str(r.source_row), str(r.target_row), str([(x.column, x.old_value, x.new_value) for x in r.differences])) for r in d.collect())
    read = read_frames(spark, f"{tmp_path}/f")
    expected = result.rows.withColumns({"target_row": F.when(F.col("status") != "unchanged", F.col("target_row")), "differences": F.coalesce("differences", F.array().cast(result.rows.schema["differences"].dataType))})
    assert shown(read) == shown(expected)


def test_frames_of_any_rows_are_those_of_the_encoder_of_one_row(spark):
    """Rows in whole batches against row by row: empty maps, null values, wide and narrow rows, many bytes; and frames without the sizes of their rows."""
    changes = [("c0", "a", ""), ("c1", "", "é漢😀")]
    rows = [(("added", "removed", "modified", "unchanged")[k * 7 % 4], f"k{k}" * (k % 4), {f"c{j}": ("x" * j, None, "漢")[(k + j) % 3] for j in range(k % 9)}, {"n": f"v{k}"} if k % 5 else {}, changes[: k % 3]) for k in range(500)]
    rows += [("modified", "long", {"a": "ü" * 300_000}, {"a": "b" * 2_000_000}, []), ("unchanged", "", {"a": "1"}, None, None), ("added", "z", None, {"a": "2"}, None)]
    entries = [(s, k, None if a is None else list(a.items()), None if b is None else list(b.items()), c) for s, k, a, b, c in rows]  # maps in this order
    of = "array<struct<name:string,value:string>>"
    df = spark.createDataFrame(entries, f"status string, key string, source_row {of}, target_row {of}, differences array<struct<column:string,old_value:string,new_value:string>>").coalesce(1)
    df = df.withColumns({c: F.map_from_entries(c) for c in ("source_row", "target_row")})
    frames = encode_frames(df, 5000).collect()
    plain = [encode_row(s, k, a, b, [dict(zip(("column", "old_value", "new_value"), d, strict=True)) for d in c or []]) for s, k, a, b, c in rows]
    ends = [np.cumsum(np.frombuffer(bytes(f["row_bytes"]), "<u4")).tolist() for f in frames]
    parted = [bytes(f["data"])[20 + lo : 20 + hi] for f, e in zip(frames, ends, strict=True) for lo, hi in zip([0, *e], e, strict=False)]
    assert sorted(parted) == sorted(plain) and all(len(f["data"]) >= 5020 and ([0, *e])[-2] < 5000 for f, e in zip(frames[:-1], ends, strict=False))
    texts = lambda m: m and sorted((k, v or "") for k, v in m.items())
    expected = sorted(str((s, k, texts(a) if s != "added" else None, texts(b) if s in ("added", "modified") else None, c if s == "modified" else [])) for s, k, a, b, c in rows)
    shown = lambda d: sorted(str((r.status, r.key, texts(r.source_row), texts(r.target_row), [tuple(x) for x in r.differences])) for r in d.collect())
    whole = spark.createDataFrame(frames)
    assert shown(decode_frames(whole)) == shown(decode_frames(whole.select("data"))) == expected
    for broken in (whole.withColumn("data", F.expr("substring(data, 1, length(data) - 1)")), whole.withColumn("row_bytes", F.expr("substring(row_bytes, 5)")), whole.withColumn("data", F.expr("concat(substring(data, 1, 4), X'FF', substring(data, 6))"))):
        with pytest.raises(PythonException, match="ValueError"):
            decode_frames(broken).collect()


def test_frames_are_decoded_in_batches(spark):
    """100,000 rows of twelve columns: row by row they took some 20 s of one task's time."""
    rows = spark.range(0, 100_000, 1, 1).select(F.lit("unchanged").alias("status"), F.col("id").cast("string").alias("key"), F.create_map(*[F.lit(x) if k % 2 == 0 else F.concat(F.lit(x), "id") for c in range(12) for k, x in enumerate((f"c{c}", "v"))]).alias("source_row"))
    frames = encode_frames(rows.withColumns({"target_row": F.col("source_row"), "differences": F.expr("cast(array() as array<struct<column:string,old_value:string,new_value:string>>)")})).persist()
    frames.count()
    began = time.perf_counter()
    assert decode_frames(frames).agg(F.sum(F.length(F.element_at("source_row", "c11")))).first()[0] == 588_890
    assert time.perf_counter() - began < 5


def test_no_rows_make_no_frames(spark, result):
    assert encode_frames(result.rows.limit(0)).collect() == [] and decode_frames(encode_frames(result.rows.limit(0))).collect() == []


def test_writing_counts_in_the_same_pass_and_tells_how_far_it_is(spark, result, tmp_path):
    said = []
    assert result.write(f"{tmp_path}/r", lambda p, m: said.append((p, m))) == result.counts()
    assert spark.read.parquet(f"{tmp_path}/r").count() == sum(result.counts().values())
    assert said[-1] == (100.0, "Comparing") and [p for p, _ in said] == sorted(p for p, _ in said)
    assert result.write(f"{tmp_path}/again") == result.counts()


def test_percentages_follow_finished_tasks(spark):
    slow = spark.range(0, 12, 1, 12).rdd.map(lambda r: (time.sleep(0.4), r.id)[1])
    said = []
    assert sorted(followed(spark, slow.collect, lambda p, m: said.append(p), "Waiting", 20, 80, 0.05)) == list(range(12))
    assert said[-1] == 80 and said == sorted(said) and any(20 < p < 79 for p in said)
    told = len(said)
    with pytest.raises(ZeroDivisionError):
        followed(spark, lambda: 1 / 0, lambda p, m: said.append(p), "Failing")
    assert len(said) == told and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_natural_order(spark):
    names = ["id10", "ID2", "id2b", "id", "", "10", "9", "009", "x9y10", "x9y2", "é1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n").collect()
    assert [r.n for r in rows] == ["", "009", "9", "10", "id", "ID2", "id2b", "id10", "x9y2", "x9y10", "é1"]
    view = diff(read_csv_text(spark, "k,n\n" + "\n".join(f"{i},{n or '-'}" for i, n in enumerate(names))), read_csv_text(spark, "k,n\n"), mode="primary-key", key_columns="k").view()
    assert [r.n for r in view.sort_by("n", natural=True, descending=True).page(0, 3).collect()] == ["é1", "x9y10", "x9y2"]
