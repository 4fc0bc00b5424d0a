"""Configuration from YAML: speakers and the period of analysis.

Unlike a loader that falls back to defaults in silence, ``load`` raises on a file that it can't parse; without any
file the defaults hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from colloquy.schema import SPEAKER, ConfigurationError

SECTION = "colloquy"
DEFAULT_PATHS = tuple(Path(p) for p in ("colloquy.yaml", "colloquy.yml", "config/colloquy.yaml", "config/colloquy.yml", ".colloquy.yaml", ".colloquy.yml"))


@dataclass(frozen=True)
class Speaker:
    id: str
    name: str
    aliases: tuple[str, ...] = ()

    def matches(self, name: str) -> bool:
        return name == self.name or name in self.aliases


@dataclass(frozen=True)
class AnalysisPeriod:
    start: str
    end: str

    def __post_init__(self):
        try:
            begin, stop = date.fromisoformat(self.start), date.fromisoformat(self.end)
        except ValueError as e:
            raise ConfigurationError(f"dates must be YYYY-MM-DD: {e}") from e
        if begin > stop:
            raise ConfigurationError("the period ends before it starts")


@dataclass(frozen=True)
class Configuration:
    version: str = "0.1.0"
    speakers: tuple[Speaker, ...] = ()
    analysis_period: AnalysisPeriod | None = None
    #: Any other settings, as they stand in the file.
    rest: dict = field(default_factory=dict)

    def speaker_by_id(self, speaker_id: str) -> Speaker | None:
        return next((s for s in self.speakers if s.id == speaker_id), None)

    def speaker_by_name(self, name: str) -> Speaker | None:
        return next((s for s in self.speakers if s.matches(name)), None)

    def speaker_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, s.id, s.name, list(s.aliases)) for i, s in enumerate(self.speakers)], SPEAKER)

    def get(self, key: str, default: Any = None) -> Any:
        """A setting by its path, such as ``analysis_period.start``."""
        value: Any = {"version": self.version, "speakers": self.speakers, "analysis_period": self.analysis_period} | self.rest
        for part in key.split("."):
            value = value.get(part) if isinstance(value, dict) else getattr(value, part, None)
            if value is None:
                return default
        return value


def find_path(paths: tuple[Path, ...] = DEFAULT_PATHS) -> Path | None:
    return next((p for p in paths if p.exists()), None)


def parse(data: dict) -> Configuration:
    """From a file's content; a section named ``colloquy`` may enclose it."""
    data = dict(data.get(SECTION) or data)
    try:
        speakers = tuple(Speaker(str(s["id"]), str(s["name"]), tuple(s.get("aliases") or ())) for s in data.pop("speakers", None) or ())
        period = data.pop("analysis_period", None)
        period = AnalysisPeriod(str(period["start"]), str(period["end"])) if period else None
    except (KeyError, TypeError, AttributeError) as e:
        raise ConfigurationError(f"malformed configuration: {e}") from e
    return Configuration(str(data.pop("version", "0.1.0")), speakers, period, data)


def load(path: str | Path | None = None) -> Configuration:
    found = Path(path) if path is not None else find_path()
    if found is None or not found.exists():
        return Configuration()
    import yaml

    try:
        return parse(yaml.safe_load(found.read_text(encoding="utf-8")) or {})
    except (yaml.YAMLError, ValueError) as e:
        raise ConfigurationError(f"{found}: {e}") from e


_current: dict[Path | None, Configuration] = {}


def current(path: str | Path | None = None) -> Configuration:
    """The configuration, loaded once for a path."""
    key = Path(path) if path is not None else None
    if key not in _current:
        _current[key] = load(key)
    return _current[key]


def reload(path: str | Path | None = None) -> Configuration:
    """Loads it afresh for all later calls of ``current``."""
    _current.pop(Path(path) if path is not None else None, None)
    return current(path)
