"""The properties block at the top of a note. The reader takes any text and never fails."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from passagelake.text import SPACE, SPACES, trim

# Fixed patterns of the note format.
_OFF = re.compile(rf"index[{SPACE}]*:[{SPACE}]*[\"']?(?:false|no|off|0)[\"']?[{SPACE}]*\Z", re.I)
_PROPERTY = re.compile(rf"[A-Za-z_][A-Za-z0-9_ .\-/]{{0,40}}:(?:[{SPACE}].*)?\Z", re.S)
_ITEM = re.compile(rf"[{SPACE}]*-(?:[{SPACE}]|\Z)")
_LISTED = re.compile(rf"(aliases|alias|tags|tag)[{SPACE}]*:(.*)\Z", re.I | re.S)


@dataclass
class Properties:
    body_start: int = 0
    index_off: bool = False
    aliases: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)


def _plausible(line: str) -> bool:
    """Blank, a property, a list item, an indented line, a comment or an end mark."""
    bare = trim(line)
    if bare in ("", "...") or bare[0] == "#":
        return True
    return line[0] in SPACES or bool(_PROPERTY.match(line) or _ITEM.match(line))


def _value(raw: str) -> str:
    v = trim(raw)
    if len(v) > 0 and v[0] in "\"'" and v[-1] == v[0]:
        v = v[1:-1]
    if (m := re.fullmatch(r"\[\[([^\]]*)\]\]", v)) is not None:
        v = m[1].rsplit("|", 1)[-1]
    return trim(v)


def _values(raw: str) -> list[str]:
    v = trim(raw)
    listed = v[1:-1].split(",") if len(v) > 1 and v[0] == "[" and v[-1] == "]" and v[:2] != "[[" else [v]
    return [x for x in map(_value, listed) if x]


def read_properties(lines: list[str]) -> Properties:
    """The block counts if line 1 and a later line are ---, and every line between could be a property.

    A line that takes the note out of the index counts even if the block does not.
    """
    fenced = [i for i, x in enumerate(lines) if x.rstrip(SPACES) == "---"]
    if not fenced or fenced[0] != 0 or len(fenced) < 2:
        return Properties()
    block = lines[1 : fenced[1]]
    off = any(map(_OFF.match, block))
    if not all(map(_plausible, block)):
        return Properties(index_off=off)
    found = Properties(fenced[1] + 1, off)
    into: list[str] | None = None
    for line in block:
        m = _LISTED.match(line)
        if m is not None:
            into = found.aliases if m[1].lower().startswith("alias") else found.tags
            into += _values(m[2])
        elif into is not None and _ITEM.match(line):
            item = _value(re.sub(rf"\A[{SPACE}]*-[{SPACE}]?", "", line))
            into += [item] if item else []
        else:
            into = None
    return found
