"""Folders of CSV files at rest and as they arrive; tables prepared by key."""

import random

import pytest
from pyspark.sql import functions as F

from rowdelta import DiffOptions, StreamingConfig, diff, read_csv, read_csv_text, write_csv
from rowdelta.sources.csv_files import CsvStream, RaggedRecord
from rowdelta.sources.dataset import INDEX
from rowdelta.sources.prepared import SeenKeys, prepare
from rowdelta.streaming.incremental import Differ, StreamingKeyDiff, stream_csv

KEYED = DiffOptions(mode="primary-key", key_columns=("id",), case_sensitive=True, ignore_whitespace=False, ignore_empty_vs_null=False)


def folder(path, files):
    path.mkdir(exist_ok=True)
    for name, text in files.items():
        (path / name).write_text(text, newline="")
    return str(path)


def rows(data):
    return [tuple(r) for r in data.named().orderBy(INDEX).collect()]


def test_each_file_of_a_folder_has_the_header(spark, tmp_path):
    path = folder(tmp_path / "a b%", {"2.csv": "id,n\n3,c\n\n4,\n", "1.csv": "id,n\r\n1,a\r\n2, b \r\n", "10 x.csv": "\n\nid,n\n", "3.csv": "", "4.csv": 'id,n\n"5","x,""y"""\n'})
    data = read_csv(spark, path)
    assert data.headers == ("id", "n")
    assert rows(data) == [(0, "1", "a"), (1, "2", "b"), (2, "3", "c"), (3, "4", ""), (4, "5", 'x,"y"')]
    assert rows(read_csv(spark, path, multi_line=True)) == rows(data)
    no_header = folder(tmp_path / "plain", {"b": "3,c", "a": "1,a\n2,b"})
    assert rows(read_csv(spark, no_header)) == rows(read_csv(spark, no_header, has_headers=False)) == [(0, "1", "a"), (1, "2", "b"), (2, "3", "c")]


def test_records_over_lines_in_some_file(spark, tmp_path):
    path = folder(tmp_path / "f", {"1": 'id,n\n1,"a\nb"\n', "2": 'id,n\n2,"c\n\nd"\n3,e\n'})
    assert rows(read_csv(spark, path)) == [(0, "1", "a\nb"), (1, "2", "c\n\nd"), (2, "3", "e")]


def test_blocks_of_one_file_keep_its_order(spark, tmp_path):
    rng = random.Random(2)
    lines = [f"{k},{'x' * rng.randint(0, 40)}" for k in range(3000)]
    path = folder(tmp_path / "big", {"2": "id,n\n" + "\n".join(lines[1500:]), "1": "\n\nid,n\n" + "\n\n".join(lines[:1500]) + "\n"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        data = read_csv(spark, path)
        assert data.df.rdd.getNumPartitions() > 5
        assert [(i, int(k)) for i, k, _ in rows(data)] == [(k, k) for k in range(3000)]
        (tmp_path / "big" / "2").write_text("id,n\n" + "\n".join([*lines[1500:2900], "2900", *lines[2901:]]))
        with pytest.raises(RaggedRecord) as e:
            read_csv(spark, path)
        assert e.value.line == 1402 and e.value.file.endswith("/2") and "2900" in str(e.value)
        assert rows(read_csv(spark, path, validate=False))[2900] == (2900, "2900", "")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_what_is_wrong_with_a_folder(spark, tmp_path):
    with pytest.raises(ValueError, match="b.csv: the header is"):
        read_csv(spark, folder(tmp_path / "h", {"a.csv": "id,n\n1,a\n", "b.csv": "id,m\n2,b\n"}))
    with pytest.raises(RaggedRecord, match="y.csv, line 4: .*2,b,c"):
        read_csv(spark, folder(tmp_path / "r", {"x.csv": "id,n\n1,a\n", "y.csv": "\nid,n\n\n2,b,c\n3\n"}))
    with pytest.raises(RaggedRecord, match="record 2"):
        read_csv(spark, str(tmp_path / "r" / "y.csv"), multi_line=True)


def test_what_is_written_is_read(spark, tmp_path):
    cells = [("1", 'a "b", c'), ("2", ""), ("3", "é\\")]
    write_csv(spark.createDataFrame(cells, "id string, n string").repartition(2), f"{tmp_path}/w")
    assert sorted(r[1:] for r in rows(read_csv(spark, f"{tmp_path}/w"))) == cells


def streamed(spark, tmp_path, files, on_ragged="error"):
    path = folder(tmp_path / "in", files)
    source = read_csv_text(spark, "id,b\n1,x\n2,y\n9,z\n")
    live = StreamingKeyDiff(source, ("id", "b"), KEYED, f"{tmp_path}/out")
    live.start(stream_csv(spark, path, ("id", "b"), on_ragged=on_ragged)).awaitTermination(120)
    return live


def test_a_ragged_record_stops_the_stream_or_is_set_aside(spark, tmp_path):
    files = {"1.csv": "id,b\n1,x\n", "2.csv": "id,b\n2,y\n\n2,y,EXTRA\n3\n4,w\n"}
    live = streamed(spark, tmp_path, files, "reject")
    assert sorted((r.status, r.key) for r in live.finish().collect()) == [("added", "4"), ("removed", "9"), ("unchanged", "1"), ("unchanged", "2")]
    assert sorted((r.file.rpartition("/")[2], r.line, r.text) for r in live.rejected().collect()) == [("2.csv", 4, "2,y,EXTRA"), ("2.csv", 5, "3")]
    (tmp_path / "strict").mkdir()
    with pytest.raises(Exception, match="2.csv, line 4: .*EXTRA"):
        streamed(spark, tmp_path / "strict", files)
    (tmp_path / "clean").mkdir()
    assert streamed(spark, tmp_path / "clean", {"1.csv": "id,b\n1,x\n"}).rejected().count() == 0


def test_a_stream_of_files_with_another_header_or_open_quotes(spark, tmp_path):
    for k, text in enumerate(("id,c\n1,x\n", 'id,b\n1,"x\ny"\n')):
        (tmp_path / str(k)).mkdir()
        with pytest.raises(Exception, match="the header is|goes on over the line's end"):
            streamed(spark, tmp_path / str(k), {"1.csv": text})


def test_a_repeated_key_is_told_after_a_restart(spark, tmp_path):
    streamed(spark, tmp_path, {"1.csv": "id,b\n1,x\n"})
    with pytest.raises(Exception, match='Duplicate Primary Key found in target: "1"'):
        streamed(spark, tmp_path, {"2.csv": "id,b\n5,x\n1,q\n"})
    (tmp_path / "in" / "2.csv").write_text("id,b\n5,x\n2,q\n")
    live = streamed(spark, tmp_path, {})
    assert sorted((r.status, r.key) for r in live.finish().collect()) == [("added", "5"), ("modified", "2"), ("removed", "9"), ("unchanged", "1")]


def test_seen_keys_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rowdelta.sources.prepared.MERGE_EVERY", 3)
    seen = SeenKeys(spark, f"{tmp_path}/seen")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "_key string")
    for epoch in range(7):
        seen.merge(epoch)
        assert seen.repeated(keys(f"k{epoch}", "new"), epoch) is None
        seen.add(keys(f"k{epoch}"), epoch)
    again = SeenKeys(spark, f"{tmp_path}/seen")
    assert sorted(r[0] for r in again.before().collect()) == [f"k{n}" for n in range(7)]
    assert len([p for p in (tmp_path / "seen" / "rows").iterdir() if p.name.startswith("epoch")]) <= 4
    assert again.repeated(keys("k2", "k0"), 7) == "k0" and again.repeated(keys("k6"), 6) is None


def no_exchange_of(df, table):
    """Whether the scan of a table stands in the plan without an exchange above it, up to the first join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(n for n, line in enumerate(lines) if table in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            depth = indent
            if "Exchange" in line or "Join" in line:
                return "Join" in line
    return False


def test_prepared_sides_are_joined_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        source, target = read_csv_text(spark, "id,b\n1,x\n2,y\n9,z\n"), read_csv_text(spark, "id,b\n1,x\n2,q\n3,n\n")
        live = StreamingKeyDiff(source, ("id", "b"), KEYED, f"{tmp_path}/out")
        live._batch(target.named().drop(INDEX), 0)
        part = live._named(target.named(), 1)
        assert no_exchange_of(live.classified(part), "rowdelta_side") and live.classified(part).count() == 3
        assert live.finish().count() == 4
        gone = live.source.df.join(live.seen.before(), "_key", "left_anti")
        assert "Exchange" not in gone._jdf.queryExecution().executedPlan().toString()
        with Differ(source, target, KEYED, StreamingConfig(chunk_size=2)) as chunks:
            assert no_exchange_of(chunks.chunk(0, 2), "rowdelta_side")
            found = sorted((r.status, r.key) for r in chunks.chunks().rows.collect())
            place = chunks._path
        assert found == sorted((r.status, r.key) for r in diff(source, target, KEYED).rows.collect())
        assert not spark._jvm.java.io.File(place).exists()
        again = prepare(source.renamed(("x", "y")), KEYED, f"{tmp_path}/out/source")  # what was written stays
        assert again.df.count() == 3 and sorted(r["_key"] for r in again.df.select(F.col("_key")).collect()) == ["1", "2", "9"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_stream_reads_batches_of_several_files(spark, tmp_path):
    path = folder(tmp_path / "in", {f"{k}.csv": f"id,b\n{2 * k},a\n{2 * k + 1},b\n" for k in range(4)})
    lines = spark.read.text(path, lineSep="\n")
    from rowdelta.sources.csv_files import text_lines

    data = CsvStream(spark, path, ("id", "b")).read(text_lines(lines))
    assert [(i, int(k)) for i, k, _ in rows(data)] == [(k, k) for k in range(8)]
