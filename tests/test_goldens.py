"""Small comparisons with known outcomes: added, removed, modified, unchanged."""

import re

import pytest

from rowdelta import DiffOptions, diff, read_csv_text

PEOPLE = "id,name,age\n"
CASES = {
    # name: (mode, keys, excluded, case, whitespace, empty, headers, source, target, counts or error)
    "simple": ("primary-key", "id", "", 1, 0, 0, 1, PEOPLE + "1,Alice,30\n2,Bob,25", PEOPLE + "1,Alice,30\n2,Bobby,25", (0, 0, 1, 1)),
    "add_remove": ("primary-key", "id", "", 1, 0, 0, 1, PEOPLE + "1,Alice,30\n2,Bob,25\n3,Charlie,35", PEOPLE + "1,Alice,30\n2,Bob,25\n4,David,28", (1, 1, 0, 2)),
    "several_changes": (
        "primary-key", "id", "", 1, 0, 0, 1, "id,name,age,city\n1,Alice,30,NYC\n2,Bob,25,LA\n3,Charlie,35,Chicago",
        "id,name,age,city\n1,Alice,31,NYC\n2,Robert,25,San Francisco\n3,Charlie,35,Chicago", (0, 0, 2, 1),
    ),
    "no_headers": ("primary-key", "Column1", "", 1, 0, 0, 0, "1,Alice,30\n2,Bob,25\n3,Charlie,35", "1,Alice,30\n2,Bob,25\n4,David,28", (1, 1, 0, 2)),
    "header_is_data": ("primary-key", "Column1", "", 1, 0, 0, 1, "1,2,3\nAlice,30,NYC\nBob,25,LA", "1,2,3\nAlice,30,NYC\nCharlie,28,Chicago", (1, 1, 0, 2)),
    "empty_source": ("primary-key", "id", "", 1, 0, 0, 1, PEOPLE, PEOPLE + "1,Alice,30\n2,Bob,25", (2, 0, 0, 0)),
    "empty_target": ("primary-key", "id", "", 1, 0, 0, 1, PEOPLE + "1,Alice,30\n2,Bob,25", PEOPLE, (0, 2, 0, 0)),
    "both_empty": ("primary-key", "id", "", 1, 0, 0, 1, PEOPLE, PEOPLE, (0, 0, 0, 0)),
    "twice_in_source": ("primary-key", "id", "", 1, 0, 0, 1, PEOPLE + "1,Alice,30\n1,Bob,25\n2,Charlie,35", PEOPLE + "1,Alice,30\n2,Bob,25\n3,David,28", 'Duplicate Primary Key found in source: "1". Primary Keys must be unique.'),
    "twice_in_target": ("primary-key", "id", "", 1, 0, 0, 1, PEOPLE + "1,Alice,30\n2,Bob,25\n3,Charlie,35", PEOPLE + "1,Alice,30\n2,Bob,25\n2,David,28", "Duplicate Primary Key found in target"),
    "no_key_in_source": ("primary-key", "id", "", 1, 0, 0, 1, "name,age\nAlice,30\nBob,25", PEOPLE + "1,Alice,30\n2,Bob,25", 'Primary key column "id" not found in source dataset.'),
    "no_key_in_target": ("primary-key", "id", "", 1, 0, 0, 1, PEOPLE + "1,Alice,30\n2,Bob,25", "name,age\nAlice,30\nBob,25", 'Primary key column "id" not found in target dataset.'),
    "two_keys": (
        "primary-key", "first_name, last_name", "", 1, 0, 0, 1, "first_name,last_name,age,city\nAlice,Smith,30,NYC\nBob,Jones,25,LA\nCharlie,Brown,35,Chicago",
        "first_name,last_name,age,city\nAlice,Smith,31,NYC\nBob,Jones,25,San Francisco\nDavid,Wilson,28,Seattle", (1, 1, 2, 0),
    ),
    "content": ("content-match", "", "", 1, 0, 0, 1, "name,age,city\nAlice,30,NYC\nBob,25,LA\nCharlie,35,Chicago", "name,age,city\nAlice,30,NYC\nBob,25,San Francisco\nDavid,28,Seattle", (1, 1, 1, 1)),
    "content_exact": ("content-match", "", "", 1, 0, 0, 1, "id,name,value\n1,Alice,100\n2,Bob,200\n3,Charlie,300", "id,name,value\n1,Alice,100\n2,Bob,200\n4,David,400", (1, 1, 0, 2)),
    "content_alike": ("content_match", "", "", 1, 0, 0, 1, "name,age,city\nAlice,30,New York\nBob,25,Los Angeles\nCharlie,35,Chicago", "name,age,city\nAlice,31,New York City\nRobert,25,LA\nDavid,28,Seattle", (1, 1, 2, 0)),
    "case_counts": ("primary-key", "id", "", 1, 0, 0, 1, "id,name\n1,Alice\n2,Bob", "id,name\n1,alice\n2,BOB", (0, 0, 2, 0)),
    "case_ignored": ("primary-key", "id", "", 0, 0, 0, 1, "id,name\n1,Alice\n2,Bob", "id,name\n1,alice\n2,BOB", (0, 0, 0, 2)),
    "inner_space": ("primary-key", "id", "", 1, 1, 0, 1, "id,name\n1,Alice Smith\n2,Bob Jones", "id,name\n1,  Alice   Smith  \n2,BobJones", (0, 0, 2, 0)),
    "empty_is_null": ("primary-key", "id", "", 1, 0, 1, 1, "id,name,value\n1,Alice,\n2,Bob,null", "id,name,value\n1,Alice,null\n2,Bob,", (0, 0, 0, 2)),
    "excluded": ("primary-key", "id", "timestamp", 1, 0, 0, 1, "id,name,age,timestamp\n1,Alice,30,2023-01-01\n2,Bob,25,2023-01-02", "id,name,age,timestamp\n1,Alice,30,2023-01-03\n2,Bob,25,2023-01-04", (0, 0, 0, 2)),
    "quoted": ("primary-key", "id", "", 1, 0, 0, 1, 'id,name,address\n1,Alice,"123 Main St, Apt 4B"\n2,Bob,"456 Oak Ave"', 'id,name,address\n1,Alice,"123 Main St, Apt 4B"\n2,Bob,"789 Pine Rd"', (0, 0, 1, 1)),
    "quotes_inside": ("primary-key", "id", "", 1, 0, 0, 1, 'id,quote\n1,"She said ""Hello"""\n2,"He said ""Goodbye"""', 'id,quote\n1,"She said ""Hello"""\n2,"He said ""Hi"""', (0, 0, 1, 1)),
    "line_ends": ("primary-key", "id", "", 1, 0, 0, 1, "id,name\r\n1,Alice\r\n2,Bob\n3,Charlie", "id,name\r\n1,Alice\r\n2,Bobby\n3,Charlie", (0, 0, 1, 2)),
}


@pytest.mark.parametrize("how", ["text", "file"])
@pytest.mark.parametrize("name", CASES)
def test_golden(spark, tmp_path, name, how):
    from rowdelta import read_csv

    mode, keys, excluded, case, space, empty, headers, source, target, expected = CASES[name]
    options = DiffOptions(mode=mode, key_columns=keys, excluded_columns=excluded, case_sensitive=bool(case), ignore_whitespace=bool(space), ignore_empty_vs_null=bool(empty))
    sides = []
    for label, text in (("s", source), ("t", target)):
        if how == "file":
            (tmp_path / f"{label}.csv").write_text(text + "\n", newline="")
            sides.append(read_csv(spark, str(tmp_path / f"{label}.csv"), bool(headers)))
        else:
            sides.append(read_csv_text(spark, text, bool(headers)))
    if isinstance(expected, str):
        with pytest.raises(ValueError, match=re.escape(expected)):
            diff(*sides, options)
    else:
        counts = diff(*sides, options).counts()
        assert tuple(counts[s] for s in ("added", "removed", "modified", "unchanged")) == expected


EXAMPLE_SOURCE = "id,name,role,department\n1,Alice,Engineer,R&D\n2,Bob,Designer,Product\n2b,Eve,Analyst,Finance"
EXAMPLE_TARGET = "id,name,role,department\n1,Alice,Senior Engineer,R&D\n2,Bob,Designer,Product\n3,Mallory,Lawyer,Legal"


@pytest.mark.parametrize("strategy", ["set", "greedy"])
@pytest.mark.parametrize("name", ["content", "content_exact", "content_alike"])
def test_content_strategies_agree_on_goldens(spark, name, strategy):
    _, _, _, _, _, _, _, source, target, expected = CASES[name]
    rule = DiffOptions(case_sensitive=True, ignore_whitespace=False, ignore_empty_vs_null=False, strategy=strategy, similarity="row" if strategy == "greedy" else "normalized")
    counts = diff(read_csv_text(spark, source), read_csv_text(spark, target), rule).counts()
    assert tuple(counts.values()) == expected
