"""Keyed and content-based comparison of tables on Spark."""

from rowdelta.options import PROFILES, DiffOptions, StreamingConfig
from rowdelta.plans.diff import DiffResult, diff
from rowdelta.plans.view import View
from rowdelta.sources.csv_files import read_csv, write_csv
from rowdelta.sources.csv_text import read_csv_bytes, read_csv_text, sample
from rowdelta.sources.dataset import Dataset, from_table

__all__ = ["PROFILES", "Dataset", "DiffOptions", "DiffResult", "StreamingConfig", "View", "diff", "from_table", "read_csv", "read_csv_bytes", "read_csv_text", "sample", "write_csv"]
