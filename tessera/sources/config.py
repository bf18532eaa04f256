"""Project configuration from TOML: validated once on the driver."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass
from pathlib import Path, PurePosixPath


class ConfigError(ValueError):
    pass


def find_root(start: str | Path | None = None, name: str = "project.toml") -> Path:
    """The nearest folder, from start upward, that has the configuration file."""
    here = Path(start or ".").resolve()
    for folder in (here, *here.parents):
        if (folder / name).is_file():
            return folder
    raise ConfigError(f"no {name} in {here} or above")


@dataclass(frozen=True)
class Config:
    root: Path
    values: dict

    def text(self, section: str, key: str) -> str:
        v = self._get(section, key)
        if not isinstance(v, str) or not v.strip():
            raise ConfigError(f"{section}.{key} must be text")
        return v

    def digest(self, section: str, key: str) -> str:
        if not re.fullmatch(r"[0-9a-f]{64}", v := self.text(section, key)):
            raise ConfigError(f"{section}.{key} must be 64 hex digits")
        return v

    def number(self, section: str, key: str) -> int:
        v = self._get(section, key)
        if isinstance(v, bool) or not isinstance(v, int):
            raise ConfigError(f"{section}.{key} must be an integer")
        return v

    def path(self, section: str, key: str) -> Path:
        p = PurePosixPath(self.text(section, key))
        if p.is_absolute() or ".." in p.parts:
            raise ConfigError(f"{section}.{key} must stay inside the project")
        return self.root / p

    def _get(self, section: str, key: str):
        try:
            return self.values[section][key]
        except (KeyError, TypeError):
            raise ConfigError(f"{section}.{key} is missing") from None


def load_config(root: str | Path, name: str = "project.toml") -> Config:
    with open(Path(root) / name, "rb") as f:
        return Config(Path(root), tomllib.load(f))
