"""Queries on a result: search, filters, sort, pages and counts. Everything stays one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowdelta.plans.pages import StoredPages, store_pages
from rowdelta.plans.search import SearchToken, parse_search, search_predicate

#: The order in which a result is shown.
DISPLAY_ORDER = ("modified", "added", "removed", "unchanged")


def natural_key(value: Column) -> Column:
    """A key under which ``ID2`` comes before ``id10``: the runs of digits and of other letters, digits without leading zeros behind their length."""
    runs = F.regexp_extract_all(F.lower(value), F.lit("([0-9]+|[^0-9]+)"), 1)
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 9, "0"), bare(x))).otherwise(x))


def sort_value(value: Column, kind: str) -> Column:
    """A shown value as a key of one of the three ways to sort."""
    return value.try_cast("double") if kind == "numeric" else natural_key(value) if kind == "natural" else value


@dataclass(frozen=True)
class View:
    rows: DataFrame
    source_headers: tuple[str, ...]
    target_headers: tuple[str, ...]
    hidden: tuple[str, ...] = ()
    status: str | None = None
    sort: tuple[tuple[str, bool, str], ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        """The target's columns, then those that only the source has."""
        return list(dict.fromkeys((*self.target_headers, *self.source_headers)))

    def display(self, name: str) -> Column:
        """The value shown: the target's where there is one and the row isn't unchanged, else the source's."""
        target, source = F.try_element_at("target_row", F.lit(name)), F.try_element_at("source_row", F.lit(name))
        return F.when(F.col("status") == "unchanged", F.coalesce(source, F.lit(""))).otherwise(F.coalesce(target, source, F.lit("")))

    def change_text(self, name: str) -> Column:
        """``old → new`` where the cell differs, else the value shown."""
        cell = F.try_element_at(F.filter("differences", lambda x: x["column"] == name), F.lit(1))
        return F.when(cell.isNotNull(), F.concat(cell["old_value"], F.lit(" → "), cell["new_value"])).otherwise(self.display(name))

    def _searched(self, name: str) -> Column:
        """What search sees of a column: a changed row's new value, or its old one if the target lacks the column."""
        return F.coalesce(F.try_element_at("target_row", F.lit(name)), F.try_element_at("source_row", F.lit(name)), F.lit(""))

    def search(self, query: str | list[SearchToken], strict_or: bool = False) -> View:
        tokens = parse_search(query, strict_or) if isinstance(query, str) else query
        names = self.columns
        text = F.concat_ws(" ", F.col("status"), F.col("key"), *[self._searched(n) for n in names])
        cell = {"type": F.col("status"), "key": F.col("key")} | {n: self._searched(n) for n in names}
        return replace(self, rows=self.rows.where(search_predicate(tokens, text, cell)))

    def only_differences(self) -> View:
        return replace(self, rows=self.rows.where(F.col("status") != "unchanged"))

    def filter_column(self, name: str, value: str) -> View:
        """Keep rows whose shown value contains ``value``, whatever the case."""
        return replace(self, rows=self.rows.where(F.lower(self.display(name)).contains(value.lower())))

    def filter_type(self, value: str) -> View:
        """Keep rows of a status, as a column filter: counts see it."""
        return replace(self, rows=self.rows.where(F.lower("status") == value.lower()))

    def with_status(self, value: str | None) -> View:
        """Show one status only; counts don't see it. ``None`` or ``all`` shows every one."""
        return replace(self, status=None if value in (None, "all") else value)

    def hide(self, *names: str) -> View:
        return replace(self, hidden=tuple(dict.fromkeys((*self.hidden, *names))))

    def show(self, *names: str) -> View:
        return replace(self, hidden=tuple(n for n in self.hidden if n not in names))

    def sort_by(self, name: str, descending: bool = False, numeric: bool = False, natural: bool = False) -> View:
        """Sort by a column: as text, ``numeric`` (what is no number last) or ``natural``, runs of digits by their value and letters whatever their case."""
        return replace(self, sort=(*self.sort, (name, descending, "numeric" if numeric else "natural" if natural else "text")))

    def counts(self) -> DataFrame:
        """Rows of each status after search and column filters, whatever status is shown."""
        from rowdelta.plans.diff import status_counts

        return status_counts(self.rows)

    def shown(self) -> DataFrame:
        """The rows after all filters, that of the status included."""
        return self.rows if self.status is None else self.rows.where(F.col("status") == self.status)

    def visible_count(self) -> int:
        return self.shown().count()

    def sort_keys(self) -> list[tuple[Column, bool]]:
        """What rows are sorted by, and whether from the greatest on; what is null stands last. No two rows are equal in all of it."""
        rank = F.array_position(F.array(*[F.lit(s) for s in DISPLAY_ORDER]), F.col("status"))
        last = [(rank, False), (F.coalesce("target_idx", "source_idx"), False), (F.coalesce("source_idx", "target_idx"), False)]
        value = lambda name: F.col("status") if name == "type" else F.col("key") if name == "key" else self.display(name)
        return [*[(sort_value(value(name), kind), descending) for name, descending, kind in self.sort], *last]

    def _order(self) -> list[Column]:
        return [v.desc_nulls_last() if descending else v.asc_nulls_last() for v, descending in self.sort_keys()]

    def table(self) -> DataFrame:
        """Status, key and the visible columns, in order."""
        names = [n for n in self.columns if n not in self.hidden]
        return self.shown().orderBy(*self._order()).select("status", "key", *[self.display(n).alias(n) for n in names])

    def page(self, offset: int, limit: int) -> DataFrame:
        """A slice of the sorted rows; Spark keeps only the first ``offset + limit`` of each partition. For pages far down see ``store``."""
        names = [n for n in self.columns if n not in self.hidden]
        return self.shown().orderBy(*self._order()).offset(offset).limit(limit).select("status", "key", *[self.display(n).alias(n) for n in names])

    def store(self, path: str) -> StoredPages:
        """Sort once and write the sorted rows, so that any page, however deep, is read without sorting the rows before it."""
        return store_pages(self, path)
