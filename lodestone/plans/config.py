"""Configuration of an index, kept as JSON."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from ..operators.hybrid import ALPHA, THRESHOLD, TOP_K
from ..sources.collect import TEXT_EXTENSIONS
from .store import Files

FILE = "config.json"
#: Names the folder of an index outright.
STORE_VARIABLE = "LODESTONE_DIR"
FOLDER = ".lodestone"


@dataclass
class Config:
    enabled: bool = True
    top_k: int = TOP_K
    threshold: float = THRESHOLD
    alpha: float = ALPHA  # 0: vectors alone, 1: BM25 alone
    extra_extensions: list[str] = field(default_factory=list)
    exclude_extensions: list[str] = field(default_factory=list)
    tracked_paths: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)


def load_config(store: str | Files) -> Config:
    """Defaults with what the file sets; a missing or malformed file is the defaults.

    ``store`` is a local folder, or one of any file system as :class:`Files`."""
    try:
        text = store.read_text(FILE) if isinstance(store, Files) else Path(store, FILE).read_text("utf-8")
        said = json.loads(text or "{}")
        return Config(**{f.name: said[f.name] for f in fields(Config) if f.name in said})
    except (OSError, ValueError, TypeError):
        return Config()


def save_config(store: str | Files, config: Config) -> None:
    text = json.dumps(asdict(config), indent=2)
    if isinstance(store, Files):
        store.write_text(FILE, text)
    else:
        Path(store, FILE).write_text(text, "utf-8")


def normalize_ext(ext: str) -> str:
    bare = ext.strip().lower()
    return bare if not bare or bare.startswith(".") else f".{bare}"


def resolve_extensions(config: Config) -> list[str]:
    """Default extensions with the extra ones, without the excluded ones; sorted."""
    extra, gone = ({n for e in es if (n := normalize_ext(e))} for es in (config.extra_extensions, config.exclude_extensions))
    return sorted((set(TEXT_EXTENSIONS) | extra) - gone)


def global_store() -> str:
    return os.path.join(os.path.expanduser("~"), FOLDER)


def resolve_store(create: bool = False, legacy: str | None = None) -> str:
    """Folder of the index: the variable's; else the nearest above the working directory and below home;
    with ``create`` one in the working directory; else the one in home.

    A ``legacy`` folder becomes the one in home if that is missing."""
    if named := os.environ.get(STORE_VARIABLE):
        os.makedirs(named, exist_ok=True)
        return named
    home, at = os.path.expanduser("~"), os.getcwd()
    while at != home:
        if os.path.isdir(found := os.path.join(at, FOLDER)):
            return found
        if (up := os.path.dirname(at)) == at:
            break
        at = up
    if create:
        os.makedirs(here := os.path.join(os.getcwd(), FOLDER), exist_ok=True)
        return here
    top = global_store()
    if not os.path.isdir(top):
        if legacy and os.path.isdir(legacy):
            try:
                os.rename(legacy, top)
                return top
            except OSError:
                pass
        os.makedirs(top, exist_ok=True)
    return top
