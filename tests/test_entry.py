"""The entry module, with and without the training-data operators."""

import builtins
import importlib
import os
import sys

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).first().total > 0


@needs_data
@pytest.mark.parametrize("name", ["pk_differences_flat", "content_rows", "search_or", "view_sort_page", "csv_roundtrip"])
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    quoted = ", ".join(f'"{x}"' for x in columns)
    assert found == sorted(str(r) for r in c.execute(f"select {quoted} from ({__spark_entry__.oracle_sql()[name]})").fetchall())


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_operators(monkeypatch):
    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("rowdelta.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", refuse)
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("rowdelta.llm")]:
        monkeypatch.delitem(sys.modules, name)
    bare = importlib.reload(__spark_entry__)
    assert "pk_status_counts" in bare.queries() and not any(n.startswith("op") or n == "pipeline" for n in bare.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
