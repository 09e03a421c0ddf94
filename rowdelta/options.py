"""Options of a comparison, chunked runs and session profiles."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

KEY, CONTENT = "primary-key", "content-match"


@dataclass(frozen=True)
class DiffOptions:
    """How two datasets are compared. The defaults are those of an interactive user."""

    mode: str = CONTENT
    key_columns: tuple[str, ...] = ()
    excluded_columns: tuple[str, ...] = ()
    case_sensitive: bool = False
    ignore_whitespace: bool = True
    ignore_empty_vs_null: bool = True
    has_headers: bool = True
    #: A pair of rows is a match when its score is above this.
    threshold: float = 0.5
    #: ``normalized`` scores equal values 1 and others by Jaro-Winkler on normalised values; ``row`` works on raw values, by
    #: Jaro-Winkler for values of up to 20 bytes and by normalised edit distance for longer ones.
    similarity: str = "normalized"
    #: ``set`` matches exact rows first and lets each remaining row propose its best partner; ``greedy`` goes row by row.
    strategy: str = "set"
    #: ``error`` or ``last``: what a repeated key does.
    on_duplicate: str = "error"
    #: Whether both sides of the candidate lookup are normalised, or only the target's letters are lower-cased.
    normalize_candidates: bool = False
    #: Whether differences carry a word diff.
    text_diff: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "mode", self.mode.replace("_", "-"))
        for name in ("key_columns", "excluded_columns"):
            object.__setattr__(self, name, _names(getattr(self, name)))
        for name, allowed in (("mode", (KEY, CONTENT)), ("similarity", ("normalized", "row")), ("strategy", ("set", "greedy")), ("on_duplicate", ("error", "last"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")

    def but(self, **changes: object) -> DiffOptions:
        return replace(self, **changes)


def _names(value: str | tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """A list of names, or a text with commas between them; blanks go."""
    parts = value.split(",") if isinstance(value, str) else value
    return tuple(p.strip() if isinstance(value, str) else p for p in parts if p.strip())


@dataclass(frozen=True)
class StreamingConfig:
    chunk_size: int = 5000
    enable_progress: bool = True
    progress_interval: int = 10

    def with_progress_interval(self, interval: int) -> StreamingConfig:
        return replace(self, progress_interval=interval)


@dataclass(frozen=True)
class Profile:
    """Session settings for a kind of run."""

    name: str
    chunk_size: int
    settings: dict[str, str] = field(default_factory=dict)

    def apply(self, spark: SparkSession) -> None:
        for key, value in self.settings.items():
            spark.conf.set(key, value)


PROFILES = {
    "SPEED": Profile("SPEED", 50_000, {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m", "spark.sql.files.maxPartitionBytes": "256m"}),
    "BALANCED": Profile("BALANCED", 10_000, {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m", "spark.sql.files.maxPartitionBytes": "128m"}),
    "MEMORY": Profile("MEMORY", 5_000, {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "32m"}),
    "DEBUG": Profile("DEBUG", 5_000, {"spark.sql.adaptive.enabled": "false"}),
}
