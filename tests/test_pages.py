"""Pages of stored views against pages of the views themselves."""

from dataclasses import replace

import pytest

from rowdelta import diff, read_csv_text
from rowdelta.plans.pages import open_pages


@pytest.fixture(scope="module")
def view(spark, tmp_path_factory):
    cell = lambda k: ["", f"ID{k % 40}", f"id{k % 7}x", "Zoë", str(k % 11), "NaN"][k % 6]
    old = "id,name,at\n" + "\n".join(f"{k},{cell(k)},{k}" for k in range(200))
    new = "id,name,more\n" + "\n".join(f"{k},{cell(k * 5)},m" for k in range(30, 260))
    path = str(tmp_path_factory.mktemp("result"))
    result = diff(read_csv_text(spark, old), read_csv_text(spark, new), mode="primary-key", key_columns="id")
    result.write(path)
    return replace(result.view(), rows=spark.read.parquet(path))


@pytest.fixture
def in_ranges(spark):
    """Small tables stay in many ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("kind", "descending"), [("text", True), ("numeric", False), ("natural", True), (None, False)])
def test_stored_pages_are_the_view_s_pages(view, tmp_path, in_ranges, kind, descending):
    shown = view.hide("at")
    if kind:
        shown = shown.sort_by("name", descending, numeric=kind == "numeric", natural=kind == "natural").sort_by("id", numeric=True)
    pages, rows = shown.store(f"{tmp_path}/p"), [tuple(r) for r in shown.table().collect()]
    assert len(pages) == len(rows) == 260 and len(pages.bounds) > 3
    for offset, limit in ((30, 150), (0, 1000), (pages.starts[1], 1), (pages.starts[2] - 1, 2), (250, 50), (260, 5), (3, 0)):
        page = pages.page(offset, limit)
        assert page.columns == shown.table().columns and [tuple(r) for r in page.collect()] == rows[offset : offset + limit]
    again = open_pages(view.rows.sparkSession, f"{tmp_path}/p")
    assert (again.columns, again.kind, again.descending, again.starts) == (pages.columns, pages.kind, pages.descending, pages.starts)
    assert [tuple(r) for r in again.page(100, 3).collect()] == rows[100:103]


def test_the_page_of_a_value(view, tmp_path, in_ranges):
    named = lambda v: (v.sort_by("name"), v.sort_by("name", descending=True), v.sort_by("id", numeric=True), v.sort_by("id", descending=True, natural=True))
    behind = (lambda r, x: r["name"] >= x, lambda r, x: r["name"] <= x, lambda r, x: float(r["id"]) >= float(x), lambda r, x: int(r["id"]) <= int(x))
    for n, (shown, late) in enumerate(zip(named(view), behind, strict=True)):
        pages, rows = shown.store(f"{tmp_path}/{n}"), shown.table().collect()
        for value in ("", "ID3", "id3x", "~") if n < 2 else ("-5" if n == 2 else "0", "9", "100", "259", "1000"):
            at = next((k for k, r in enumerate(rows) if late(r, value)), len(rows))
            assert pages.position(value) == at
            assert pages.page_from(value, 4).collect() == rows[at : at + 4]
    with pytest.raises(ValueError, match="negative"):
        pages.page(-1, 5)


def test_a_page_reads_its_ranges_only_and_sorts_no_more_than_itself(view, tmp_path, in_ranges):
    pages = view.sort_by("name").store(f"{tmp_path}/p")
    page = pages.page(pages.starts[3] + 1, 2)
    assert len(page.inputFiles()) == 1 and f"part={pages.bounds[3]['part']}/" in page.inputFiles()[0]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(at), GreaterThanOrEqual(at,1), LessThanOrEqual(at,2)]" in plan


def test_a_view_without_rows_has_no_pages(view, tmp_path):
    pages = view.search("nothing-like-it").sort_by("name").store(f"{tmp_path}/p")
    assert len(pages) == 0 and pages.page(0, 10).columns == view.table().columns and pages.page(0, 10).collect() == [] and pages.position("x") == 0


def test_a_value_has_no_place_in_the_display_order(view, tmp_path):
    with pytest.raises(ValueError, match="sorted by no column"):
        view.store(f"{tmp_path}/p").position("x")
