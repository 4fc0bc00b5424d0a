"""Schemas of the engine's tables, and the options that its operators share.

A segment is one row; transcripts stay normalised (a row for each segment) and are nested only in
``transcripts.nested``.  Segments are ordered within their document by ``ord``.
"""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_SPEAKER = "unknown"
DEFAULT_CONFIDENCE = 1.0
TIME_TOLERANCE = 0.5
LEAST_DURATION = 0.1

SEGMENT = "doc_id string, ord long, seg_id string, speaker string, start_time double, end_time double, content string, confidence double"
SPEAKER = "ord int, id string, name string, aliases array<string>"
EVIDENCE = "id string, transcript_id string, segment_ids array<string>, category string, description string, importance string, context_before string, context_after string"
IMPORTANCE = ("HIGH", "MEDIUM", "LOW")


class ConfigurationError(ValueError):
    """Options that contradict themselves."""


class InvalidFilterError(ConfigurationError):
    """A file filter that no file could pass."""


class DirectoryNotFoundError(FileNotFoundError):
    """A folder to scan that is missing, or no folder."""


@dataclass(frozen=True)
class MergeOptions:
    time_tolerance: float = TIME_TOLERANCE
    #: Accepted and checked; no operator depends on it.
    min_gap: float = 0.1

    def __post_init__(self):
        if self.time_tolerance < 0 or self.min_gap < 0:
            raise ConfigurationError("time_tolerance and min_gap must not be negative")


@dataclass(frozen=True)
class BatchOptions:
    skip_on_error: bool = True
    merge_segments: bool = True
    #: None: told by a byte order mark, else UTF-8.
    encoding: str | None = None
    default_speaker: str = DEFAULT_SPEAKER
    default_confidence: float = DEFAULT_CONFIDENCE
    #: "labelled" or "timestamped".
    parser: str = "labelled"
    merge: MergeOptions = MergeOptions()
    #: Tasks that read and parse at the same time at most; None: as many as there are cores.
    max_concurrent: int | None = None

    def __post_init__(self):
        if self.max_concurrent is not None and self.max_concurrent < 1:
            raise ConfigurationError("max_concurrent must be positive")
        if self.parser not in ("labelled", "timestamped"):
            raise ConfigurationError(f"no such parser: {self.parser}")
        if not 0 <= self.default_confidence <= 1:
            raise ConfigurationError("default_confidence must lie in [0, 1]")
