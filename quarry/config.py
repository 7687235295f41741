"""Settings, checked where they are made: their values become literals in plans."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from quarry.functions.maps import SEVERITIES

#: Names of settings files, in the order in which they are looked for.
NAMES = ["quarry.toml", "quarry.json", "pyproject.toml"]


def _between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not be {value}")


@dataclass(frozen=True)
class TokenSettings:
    max_tokens: int = 4000
    overlap_tokens: int = 200
    min_tokens: int = 500

    def __post_init__(self) -> None:
        _between("max_tokens", self.max_tokens, 1000, 8000)
        _between("overlap_tokens", self.overlap_tokens, 50, 500)
        _between("min_tokens", self.min_tokens, 100, 1000)
        if self.overlap_tokens >= self.max_tokens / 2:
            raise ValueError("overlap_tokens must be less than half of max_tokens")


@dataclass(frozen=True)
class ScanSettings:
    severity_threshold: str = "low"
    confidence_threshold: float = 0.3
    types: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("*.pyc", "__pycache__", ".git")
    max_file_mb: float = 50.0

    def __post_init__(self) -> None:
        _between("confidence_threshold", self.confidence_threshold, 0, 1)
        if self.severity_threshold not in SEVERITIES:
            raise ValueError(f"severity_threshold must be one of {SEVERITIES}")
        if self.max_file_mb <= 0:
            raise ValueError("max_file_mb must be positive")


@dataclass(frozen=True)
class Settings:
    tokens: TokenSettings = field(default_factory=TokenSettings)
    scan: ScanSettings = field(default_factory=ScanSettings)
    context_lines: int = 10
    min_node_lines: int = 50

    @classmethod
    def production(cls) -> Settings:
        return cls(tokens=TokenSettings(6000, 300), scan=ScanSettings(max_file_mb=50.0))

    @classmethod
    def development(cls) -> Settings:
        return cls(tokens=TokenSettings(3000, 150))

    @classmethod
    def from_dict(cls, data: dict) -> Settings:
        scan = {k: tuple(v) if isinstance(v, list) else v for k, v in data.get("scan", {}).items()}
        rest = {k: v for k, v in data.items() if k not in ("tokens", "scan")}
        return cls(tokens=TokenSettings(**data.get("tokens", {})), scan=ScanSettings(**scan), **rest)

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """From a JSON or TOML file; of a ``pyproject.toml`` its table ``tool.quarry``."""
        path = Path(path)
        data = json.loads(path.read_text()) if path.suffix == ".json" else tomllib.loads(path.read_text())
        return cls.from_dict(data.get("tool", {}).get("quarry", {}) if path.name == "pyproject.toml" else data)

    @classmethod
    def find(cls, start: str | Path) -> Settings:
        """From the nearest settings file at ``start`` or above it; the defaults if there is none."""
        for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
            for name in NAMES:
                if (folder / name).is_file() and (name != "pyproject.toml" or "quarry" in tomllib.loads((folder / name).read_text()).get("tool", {})):
                    return cls.load(folder / name)
        return cls()

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    def merged(self, **scan) -> Settings:
        """With the scan settings that are given and not None."""
        return replace(self, scan=replace(self.scan, **{k: v for k, v in scan.items() if v is not None}))
