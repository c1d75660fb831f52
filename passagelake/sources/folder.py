"""A folder of Markdown notes as tables.

The walk lists one folder after another on the driver (names only), in raw name order, and decides
for each entry what it is; reading and hashing run on the executors. Symbolic links are never
followed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
import unicodedata
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from passagelake import schema
from passagelake.errors import LakeError

OTHER = "other"


def note_key(relative: str) -> str:
    """Forward slashes, NFC, no-break spaces as spaces."""
    return unicodedata.normalize("NFC", relative.replace(os.sep, "/")).replace(" ", " ")


def exclude_path(entry: str, root: str) -> str:
    """An exclude entry as a key: without ./, closing slash, or the root in front."""
    path = entry.replace(os.sep, "/").rstrip("/")
    root = root.replace(os.sep, "/").rstrip("/")
    path = path[len(root) + 1 :] if path.startswith(f"{root}/") else path
    return note_key(re.sub(r"\A(?:\./)+", "", path))


def under_any(key: str, entries: list[str]) -> str | None:
    """The first entry that is the key or a folder above it, without regard to case."""
    k = key.lower()
    return next((e for e in entries if e and (k == e.lower() or k.startswith(e.lower() + "/"))), None)


def app_excludes(root: str) -> tuple[Callable[[str], bool], list[str]]:
    """Test of a key against the filters in the note app's settings, and warnings about bad ones."""
    try:
        with open(os.path.join(root, ".obsidian", "app.json"), encoding="utf-8") as f:
            filters = json.load(f).get("userIgnoreFilters") or []
    except (OSError, ValueError, AttributeError):
        return lambda key: False, []
    tests: list[Callable[[str], bool]] = []
    bad = 0
    for x in filters:
        if not isinstance(x, str) or not x:
            bad += 1
        elif len(x) > 1 and x[0] == x[-1] == "/":
            try:
                tests.append(lambda key, r=re.compile(x[1:-1], re.I): bool(r.search(key)))
            except re.error:
                bad += 1
        else:
            tests.append(lambda key, p=x.lower(): key.lower().startswith(p))
    return lambda key: any(t(key) for t in tests), [f"{bad} exclude filters of the app were not understood"] * bool(bad)


@dataclass
class Walk:
    notes: list[tuple] = field(default_factory=list)
    left_out: list[tuple] = field(default_factory=list)
    other_files: int = 0
    warnings: list[str] = field(default_factory=list)
    unreadable: list[str] = field(default_factory=list)
    unmatched: list[str] = field(default_factory=list)


def walk(root: str, exclude: tuple[str, ...] = ()) -> Walk:
    """Every entry below root: a note, a note that is left out (first reason that holds), or another file."""
    if not os.path.isdir(root):
        raise LakeError("SOURCE_MISSING", path=root)
    out = Walk()
    entries = [exclude_path(e, root) for e in exclude]
    matched: set[str] = set()
    ignored, out.warnings = app_excludes(root)
    seen: set[str] = set()

    def visit(folder: str, forced: str | None) -> None:
        at = os.path.join(root, folder) if folder else root
        try:
            listed = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError:
            out.unreadable.append(note_key(folder) or ".")
            return
        for e in listed:
            path = f"{folder}/{e.name}" if folder else e.name
            stub = re.fullmatch(r"\.(.+\.md)\.icloud", e.name, re.I | re.S)
            if stub is not None:
                leave(note_key(f"{folder}/{stub[1]}" if folder else stub[1]), "not-downloaded", e)
                continue
            if e.name.startswith("."):
                continue
            key = note_key(path)
            is_note = e.name.lower().endswith(".md")
            if e.is_symlink():
                leave(key, "symlink", e) if is_note else count_other()
                continue
            hit = under_any(key, entries)
            if hit is not None:
                matched.add(hit)
            if e.is_dir(follow_symlinks=False):
                nested = os.path.isdir(os.path.join(at, e.name, ".obsidian"))
                visit(path, forced or ("nested-vault" if nested else None) or ("excluded" if hit is not None else None))
            elif not e.is_file(follow_symlinks=False):
                continue
            elif not is_note:
                count_other()
            else:
                reason = forced or ("excluded" if hit is not None else "obsidian-excluded" if ignored(key) else "duplicate-path" if key in seen else None)
                if reason is not None:
                    leave(key, reason, e)
                else:
                    seen.add(key)
                    size, when = details(e)
                    out.notes.append((key, path, os.path.join(at, e.name), size, when))

    def details(e: os.DirEntry) -> tuple[int, int]:
        s = os.lstat(e.path)
        return (s.st_size if stat.S_ISREG(s.st_mode) else 0), s.st_mtime_ns // 1_000_000

    def leave(key: str, reason: str, e: os.DirEntry) -> None:
        out.left_out.append((key, reason, *details(e), e.path))

    def count_other() -> None:
        out.other_files += 1

    visit("", None)
    out.unmatched = [x for x in entries if x not in matched and not any(p.startswith(".") for p in x.split("/"))]
    return out


def tables(spark: SparkSession, found: Walk) -> tuple[DataFrame, DataFrame]:
    """(notes, left_out) of a walk."""
    return spark.createDataFrame(found.notes, schema.NOTE_FILES), spark.createDataFrame(found.left_out, schema.LEFT_OUT)


#: Seconds after which a read is given up: the note is still in the cloud.
READ_TIMEOUT = 10.0
#: So many notes that time out stop a sync.
MOST_TIMEOUTS = 3


def read_bytes(path: str, timeout: float = READ_TIMEOUT, read: Callable[[str], bytes] | None = None) -> bytes:
    """A file's bytes; TimeoutError if they do not come in time."""

    def plain(p: str) -> bytes:
        with open(p, "rb") as f:
            return f.read()

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(read or plain, path).result(timeout)
    finally:
        pool.shutdown(wait=False)


def read_notes(notes: DataFrame, timeout: float = READ_TIMEOUT) -> DataFrame:
    """(key, content, sha256, problem): the bytes of each note; what cannot be read is told, not thrown.

    The note must be the same size before and after, or it is read once more.
    """

    def one(path: str) -> tuple[bytes | None, str | None, str | None]:
        for _ in range(2):
            try:
                before = os.stat(path)
                content = read_bytes(path, timeout)
                after = os.stat(path)
            except TimeoutError:
                return None, None, "not-downloaded"
            except FileNotFoundError:
                return None, None, "missing"
            except OSError:
                return None, None, "unreadable"
            if (before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns):
                return content, hashlib.sha256(content).hexdigest(), None
        return None, None, "changing"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *one(p)) for k, p in zip(f["key"], f["abs"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "content", "sha256", "problem"])

    return notes.select("key", "abs").mapInPandas(run, "key string, content binary, sha256 string, problem string")


def registry_lookup(registry: dict, root: str) -> dict:
    """How the note app names a folder: its base name, or its id if several known folders share that."""
    real = os.path.realpath(root)
    vaults = {i: os.path.realpath(v["path"]) for i, v in (registry.get("vaults") or {}).items() if isinstance(v, dict) and v.get("path")}
    mine = next((i for i, p in vaults.items() if p == real), None)
    if mine is None:
        return {"state": "unknown", "vault": None}
    name = os.path.basename(real)
    shared = sum(os.path.basename(p) == name for p in vaults.values()) > 1
    return {"state": "known", "vault": mine if shared else name}
