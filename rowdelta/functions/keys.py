"""Row keys and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowdelta.functions.normalize import normalized
from rowdelta.options import DiffOptions


def row_key(values: list[Column]) -> Column:
    """Raw values joined by ``|``."""
    return F.concat_ws("|", *values)


def fingerprint(values: list[Column], options: DiffOptions) -> Column:
    """Normalised values joined by ``||``."""
    return F.concat_ws("||", *[normalized(v, options) for v in values])


def fingerprint_hash(values: list[Column], options: DiffOptions) -> Column:
    """64-bit hash of the normalised values; equal hashes need a look at the values."""
    return F.xxhash64(*[normalized(v, options) for v in values])
