"""Settings of a collection: a TOML file beside the documents, checked before any job starts."""

from __future__ import annotations

import tomllib
from pathlib import Path

FILE = "dossier.toml"
# Every setting with its default, and what it may be.
DEFAULTS = {
    "title": "Untitled collection", "description": "", "language": "en", "jurisdiction": "us", "base_url": "", "include": [], "exclude": [],
    "ocr": {"languages": ["eng"], "mode": "auto", "psm": 3, "auto_rotate": True, "timeout": 120.0},
    "render": {"dpi": 150, "widths": [1600, 900], "thumb_width": 240, "formats": ["avif", "webp"], "max_megapixels": 40.0},
    "safety": {"hidden_text": "stop", "publish_originals": True, "strip_metadata": False},
    "search": {"enabled": True, "language": "", "min_query": 2},
}
CHOICES = {"jurisdiction": ("us", "uk", "ca", "eu"), "ocr.mode": ("auto", "always", "never"), "safety.hidden_text": ("stop", "warn"), "render.formats": ("avif", "webp", "jpeg", "png")}
RANGES = {"ocr.psm": (0, 13), "ocr.timeout": (1, 3600), "render.dpi": (72, 600), "render.widths": (200, 6000), "search.min_query": (1, 20)}
NOT_EMPTY = ("ocr.languages", "render.widths")


class ConfigError(ValueError):
    """Settings that a person has to mend."""


def find(start: str | Path, levels: int = 3) -> Path | None:
    """The settings file of a folder, in it or up to three levels above."""
    start = Path(start).resolve()
    here = start if start.is_dir() else start.parent
    return next((p / FILE for p in [here, *here.parents][: levels + 1] if (p / FILE).is_file()), None)


def _kind(value) -> str:
    return "true or false" if isinstance(value, bool) else "a number" if isinstance(value, int | float) else "a list" if isinstance(value, list) else "a table" if isinstance(value, dict) else "text"


def merged(given: dict, defaults: dict = DEFAULTS, prefix: str = "") -> dict:
    """Defaults with what is given; a name that is unknown or a value of another kind is an error."""
    for name, value in given.items():
        if name not in defaults:
            raise ConfigError(f"unknown setting {prefix}{name}; known are {', '.join(sorted(defaults))}")
        if _kind(value) != _kind(defaults[name]):
            raise ConfigError(f"{prefix}{name} should be {_kind(defaults[name])}")
    return {name: merged(given.get(name, {}), default, f"{prefix}{name}.") if isinstance(default, dict) else given.get(name, default) for name, default in defaults.items()}


def checked(settings: dict) -> dict:
    def at(path: str):
        value = settings
        for part in path.split("."):
            value = value[part]
        return value

    for path, choices in CHOICES.items():
        value = at(path)
        if bad := [v for v in (value if isinstance(value, list) else [value]) if v not in choices]:
            raise ConfigError(f"{path} = {bad[0]!r} is none of {', '.join(choices)}")
    for path, (low, high) in RANGES.items():
        value = at(path)
        if bad := [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, bool) or not isinstance(v, int | float) or not low <= v <= high]:
            raise ConfigError(f"{path} = {bad[0]!r} is outside {low} to {high}")
    for path in NOT_EMPTY:
        if not at(path):
            raise ConfigError(f"{path} is empty")
    if settings["base_url"] and not settings["base_url"].startswith(("http://", "https://", "/")):
        raise ConfigError("base_url should start with https:// or /")
    return settings


def load(path: str | Path | None) -> dict:
    """The settings of a file; the defaults without one."""
    if path is None:
        return checked(merged({}))
    try:
        return checked(merged(tomllib.loads(Path(path).read_text(encoding="utf-8"))))
    except (OSError, tomllib.TOMLDecodeError, ConfigError) as error:
        raise ConfigError(f"{path}: {error}") from error
