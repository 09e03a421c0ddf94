"""CSV files, alone or as a folder, at rest or as they arrive.

Files are read by Spark in blocks. A block is read by one task, line by line, so a record's place is told by its file, its block and a running number inside the
task. One pass counts the records of each block and notes its first record, its first ragged record and its first line that leaves a quote open; with
these few rows a second, lazy pass takes the header off each file and numbers all records in the order of file names.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rowdelta.functions.normalize import unicode_trim
from rowdelta.sources.csv_text import auto_names, header_warnings, looks_like_data
from rowdelta.sources.dataset import INDEX, Dataset

_BAD = "_bad_record"
_OPTIONS = {
    "lineSep": "\n", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "emptyValue": "", "nullValue": "\u0000",
    "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "maxCharsPerColumn": "-1",
}


#: Blocks whose places are sent to every task, some 150 bytes each; with more of them records and places are joined by a shuffle.
SENT_BLOCKS = 100_000


class RaggedRecord(ValueError):
    """A record of another length than the header; ``file`` and ``line`` (from 1) say which."""

    def __init__(self, file: str, line: int, text: str, width: int, unit: str = "line") -> None:
        super().__init__(f"CSV error: {file}, {unit} {line}: another number of fields than the first record, which has {width}: {text[:200]}")
        self.file, self.line = file, line


def _schema(width: int) -> str:
    return ", ".join([*[f"c{i} string" for i in range(width)], f"{_BAD} string"])


def _cells(width: int, of: str = "") -> list[Column]:
    return [F.coalesce(unicode_trim(F.col(f"{of}c{i}")), F.lit("")).alias(f"c{i}") for i in range(width)]


def _lines(frame: DataFrame) -> DataFrame:
    """Lines of text files (``text_lines``) with a running number."""
    return frame.select("file", "start", F.regexp_replace("value", "\r$", "").alias("text"), F.monotonically_increasing_id().alias("line"))


def _marked(lines: DataFrame, width: int) -> DataFrame:
    """Records with ``line`` and ``mark``, which grow with the place in the block, the raw ``text`` and ``bad``, the text if ragged. Blank lines are none."""
    parsed = lines.where("text != ''").withColumn("r", F.from_csv("text", _schema(width), _OPTIONS))
    bad = F.when(F.col(f"r.{_BAD}").isNotNull(), F.col("text"))
    return parsed.select("file", "start", "line", F.monotonically_increasing_id().alias("mark"), "text", bad.alias("bad"), *_cells(width, "r."))


def _whole_records(raw: DataFrame, width: int) -> DataFrame:
    """The same for records that may go on over a line's end, by Spark's reader; lines are then records."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("mark")]
    return raw.select(*place, F.col(_BAD).alias("bad"), *_cells(width)).select("file", "start", F.col("mark").alias("line"), "mark", F.lit("").alias("text"), "bad", *[f"c{i}" for i in range(width)])


def text_lines(frame: DataFrame) -> DataFrame:
    return frame.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


@dataclass(frozen=True)
class Records:
    """Marked records and the blocks that hold them, in the order of files; ``lines`` are those they were read from, if they are lines."""

    marked: DataFrame
    blocks: list[Row]
    width: int
    lines: DataFrame | None

    @cached_property
    def _shifts(self) -> dict[tuple[str, int], int]:
        """What makes a line's running number its number in the file, for each block. Only looked for where a line has to be named."""
        found, shifts = self.lines if self.lines is not None else self.marked, {}
        starts = found.groupBy("file", "start").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n")).collect()
        for _, of in groupby(sorted(starts, key=lambda b: (b["file"], b["start"])), lambda b: b["file"]):
            before = 0
            for b in of:
                shifts[b["file"], b["start"]] = before - b["first"] + 1
                before += b["n"]
        return shifts

    def _line(self, block: Row, line: int) -> int:
        return line + self._shifts[block["file"], block["start"]]

    @property
    def open_quote(self) -> tuple[str, int] | None:
        """File and line of the first line that leaves a quote open."""
        return next(((b["file"], self._line(b, b["open"])) for b in self.blocks if b["open"] is not None), None)

    def ragged(self) -> RaggedRecord | None:
        """The first record of another length."""
        found = next((b for b in self.blocks if b["bad"] is not None), None)
        return found and RaggedRecord(found["file"], self._line(found, found["bad"]), found["bad_text"], self.width, "record" if self.lines is None else "line")

    def heads(self) -> dict[str, tuple[list[str], int]]:
        """The first record of each file, and its mark."""
        return {b["file"]: (list(b["cells"]), b["first"]) for b in reversed(self.blocks)}

    def placed(self, header: list[str] | None, name_lines: bool = False) -> DataFrame:
        """``_row_idx``, the cells, file, text and whether the record is ragged. With a ``header`` the first record of each file has to be it, and is left out."""
        heads = self.heads() if header is not None else {}
        for file, (cells, _) in sorted(heads.items()):
            if cells != header:
                raise ValueError(f"CSV error: {file}: the header is {cells}, but should be {header}")
        rows, at = [], 0
        for b in self.blocks:
            skipped = b["file"] in heads and heads[b["file"]][1] == b["first"]
            at -= skipped
            rows.append((b["file"], b["start"], at - b["first"], b["first"] if skipped else -1, self._shifts[b["file"], b["start"]] if name_lines else 0))
            at += b["n"]
        places = self.marked.sparkSession.createDataFrame(rows, "file string, start long, shift long, head long, line_shift long")
        places = F.broadcast(places) if len(rows) <= SENT_BLOCKS else places
        found = self.marked.join(places, ["file", "start"]).where("mark != head")
        return found.select((F.col("mark") + F.col("shift")).alias(INDEX), *[f"c{i}" for i in range(self.width)], "file", (F.col("line") + F.col("line_shift")).alias("line"), "text", F.col("bad").isNotNull().alias("ragged"))


def records(marked: DataFrame, width: int, lines: DataFrame | None = None) -> Records:
    """Look through marked records once: a row for each block comes to the driver."""
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"')))
    bad_line = F.when(F.col("bad").isNotNull(), F.col("line"))
    stats = marked.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("mark").alias("first"), F.min_by(F.array(*[f"c{i}" for i in range(width)]), "mark").alias("cells"),
        F.min(bad_line).alias("bad"), F.min_by("bad", bad_line).alias("bad_text"), F.min(F.when(quotes % 2 == 1, F.col("line"))).alias("open"),
    )
    return Records(marked, sorted(stats.collect(), key=lambda b: (b["file"], b["start"])), width, lines)


def _head(spark: SparkSession, path: str) -> list[list[str]]:
    """The first two records of the first file, by name, that has any; as many of its lines are read as they take."""
    for file in sorted(spark.read.text(path).inputFiles()):
        text = spark.read.text(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file)), lineSep="\n")
        n = 64
        while True:
            lines = [r["value"] for r in text.limit(n).collect()]
            rows = [r for r in csv.reader(io.StringIO("\n".join(lines) + "\n", newline="")) if r]
            if len(rows) > 2 or len(lines) < n:
                break
            n *= 8
        if rows:
            return [[c.strip() for c in row] for row in rows[:2]]
    return []


def read_csv(spark: SparkSession, path: str, has_headers: bool = True, multi_line: bool | None = None, validate: bool = True) -> Dataset:
    """A CSV file, or a folder of them as one table, by Spark's reader.

    With headers each file begins with the same one; if the first file's header looks like data, no file has one. Rows are numbered in the order of file names and of lines. A
    file is split between tasks unless a record goes on over a line's end (``multi_line``; None looks, in the same pass that counts). A record of another length than the
    first is an error that names file and line; with ``validate=False`` it is cut or filled with empty cells. Empty files have no records; no record at all gives a dataset without columns.
    """
    head = _head(spark, path)
    if not head:
        return Dataset(spark.createDataFrame([], f"{INDEX} long"), ())
    width = len(head[0])
    header = head[0] if has_headers and not looks_like_data(head[0], head[1] if len(head) > 1 else None) else None
    found = None
    if not multi_line:
        lines = _lines(text_lines(spark.read.text(path, lineSep="\n")))
        found = records(_marked(lines, width), width, lines)
        if multi_line is None and any(b["open"] is not None for b in found.blocks):
            found = None
    if found is None:
        raw = spark.read.schema(_schema(width)).options(**_OPTIONS, multiLine=True, columnPruning=False).csv(path)
        found = records(_whole_records(raw, width), width)
    if validate and (error := found.ragged()):
        raise error
    names = header or auto_names(width)
    rows = found.placed(header).select(INDEX, *[f"c{i}" for i in range(width)])
    return Dataset(rows, tuple(names), header_warnings(names, has_headers))


@dataclass(frozen=True)
class CsvStream:
    """A folder that CSV files arrive in, under the rules of ``read_csv``.

    ``lines`` is the stream; ``read`` makes a micro-batch of it a dataset. With ``has_headers`` each file begins with the header. ``on_ragged`` is ``error``, which names file and line and
    stops the stream, or ``reject``: such records are left out and handed to ``rejected`` (file, line, text).
    """

    spark: SparkSession
    path: str
    headers: tuple[str, ...]
    has_headers: bool = True
    files_per_batch: int = 1
    on_ragged: str = "error"
    rejected: Callable[[DataFrame, int], None] | None = None

    @property
    def lines(self) -> DataFrame:
        return text_lines(self.spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", self.files_per_batch).text(self.path))

    def read(self, batch: DataFrame, epoch: int = 0) -> Dataset:
        """A batch of lines as rows, numbered within the batch in the order of file names. Records may not go on over a line's end."""
        width = len(self.headers)
        lines = _lines(batch)
        found = records(_marked(lines, width), width, lines)
        if found.open_quote:
            raise ValueError("CSV error: {}, line {}: a record goes on over the line's end, which a stream of lines can't take".format(*found.open_quote))
        if self.on_ragged == "error" and (error := found.ragged()):
            raise error
        some = any(b["bad"] is not None for b in found.blocks)
        rows = found.placed(list(self.headers) if self.has_headers else None, name_lines=some)
        if some and self.rejected:
            self.rejected(rows.where("ragged").select("file", "line", "text"), epoch)
        return Dataset(rows.where("not ragged").select(INDEX, *[f"c{i}" for i in range(width)]), self.headers)


def write_csv(df: DataFrame, path: str) -> None:
    """A DataFrame of strings as CSV files with a header each, quoted so that ``read_csv`` gives the same cells back."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
