"""Settings of an index, and guards about where things may lie."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, fields, replace

from passagelake.errors import LakeError
from passagelake.text.chunking import CHUNKER_VERSION


@dataclass(frozen=True)
class Config:
    exclude: tuple[str, ...] = ()
    drop_fences: tuple[str, ...] = ()
    budget_tokens: int = 110
    min_words: int = 3
    quick_sync_limit: int = 20
    dimensions: int = 384
    default_count: int = 8
    most_count: int = 50


def load(path: str) -> Config:
    """The defaults, overridden by a JSON file; a broken file changes nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    except (OSError, ValueError):
        given = {}
    known = {f.name for f in fields(Config)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known} if isinstance(given, dict) else {}
    return replace(Config(), **values)


def save(path: str, config: Config) -> None:
    write_atomic(path, json.dumps(asdict(config), indent=1))


def settings_hash(config: Config) -> str:
    """Changes when passages must be made anew."""
    told = {"chunker": CHUNKER_VERSION, "budget": config.budget_tokens, "minWords": config.min_words, "dropFences": sorted(config.drop_fences)}
    return hashlib.sha256(json.dumps(told, separators=(",", ":")).encode()).hexdigest()[:16]


def clamp_count(count: int | None, config: Config = Config()) -> int:
    if count is None:
        return config.default_count
    if not isinstance(count, int) or isinstance(count, bool) or count < 1:
        raise LakeError("USAGE")
    return min(count, config.most_count)


def is_inside(path: str, folder: str) -> bool:
    """Whether a path is a folder or lies in it, links resolved."""
    p, f = os.path.realpath(os.path.expanduser(path)), os.path.realpath(os.path.expanduser(folder))
    return p == f or p.startswith(f.rstrip(os.sep) + os.sep)


def check_index_outside(index: str, source: str) -> None:
    if is_inside(index, source):
        raise LakeError("INDEX_IN_SOURCE")


def check_one_source(root: str) -> None:
    """Not the home folder, not a folder of several collections, not inside one."""
    real = os.path.realpath(os.path.expanduser(root))
    if not os.path.isdir(real):
        raise LakeError("SOURCE_MISSING", path=root)
    marked = lambda p: os.path.isdir(os.path.join(p, ".obsidian"))
    above, parent = real, os.path.dirname(real)
    inside = False
    while parent != above:
        inside |= marked(parent)
        above, parent = parent, os.path.dirname(parent)
    below = sum(marked(e.path) for e in os.scandir(real) if e.is_dir(follow_symlinks=False))
    if real == os.path.realpath(os.path.expanduser("~")) or inside or (below > 1 and not marked(real)):
        raise LakeError("NOT_ONE_SOURCE", path=root)


# Folder names that cloud drives use.
_CLOUD = ("Dropbox", "OneDrive", "Google Drive", "GoogleDrive", "Mobile Documents", "CloudStorage", "iCloudDrive", "Box")


def in_cloud_folder(path: str) -> bool:
    return any(p == c or p.startswith(c + " ") or p.startswith(c + "-") for p in os.path.realpath(path).split(os.sep) for c in _CLOUD)


def tildify(path: str) -> str:
    home = os.path.expanduser("~")
    return "~" + path[len(home) :] if path == home or path.startswith(home + os.sep) else path


def write_atomic(path: str, text: str) -> None:
    """Whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.{os.getpid()}.tmp"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
