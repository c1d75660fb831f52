"""Lines of a note to sections of plain text: fences, headings, comments, inline syntax."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from urllib.parse import urlsplit

from passagelake.text import SPACE, SPACES, trim

TEXT, CODE, SKIP = "text", "code", "skip"
NEVER = 1 << 60

# Fixed patterns of the note format.
_FENCE = re.compile(r" {0,3}(`+|~+)(.*)\Z", re.S)
_HEADING = re.compile(rf" {{0,3}}(#{{1,6}})[ \t]+(.*?)[{SPACE}]*\Z", re.S)
_CLOSE_HASHES = re.compile(rf"[{SPACE}]+#+[{SPACE}]*\Z")


@dataclass(frozen=True)
class Line:
    text: str
    number: int
    code: bool = False


@dataclass
class Section:
    heads: list[str]
    line: int
    lines: list[Line] = field(default_factory=list)


def decode(content: bytes) -> list[str]:
    """Lines of a note's bytes: UTF-8 with replacement, without byte-order mark, any line end."""
    text = content.decode("utf-8", "replace").removeprefix("\ufeff")
    return re.sub(r"\r\n?", "\n", text).split("\n")


def _marker(line: str) -> tuple[str, int, str] | None:
    """Character, length and rest of a line that begins with a run of fence characters."""
    m = _FENCE.match(line)
    return None if m is None else (m[1][0], len(m[1]), m[2])


def line_kinds(lines: list[str], start: int, drop: tuple[str, ...] = ()) -> tuple[list[str], int]:
    """Kind of each line, and the 1-based line from which text stands below a fence that never closed.

    A fence that has no proper close ends at the first later run of its character, whatever follows
    it there; one that has not even that is no fence.
    """
    kinds = [TEXT] * len(lines)
    marks = [(i, *m) for i in range(start, len(lines)) if (m := _marker(lines[i])) is not None]
    recovered, resume = NEVER, start
    for k, (i, char, length, info) in enumerate(marks):
        if i < resume or length < 3 or (char == "`" and "`" in info):
            continue
        ends = [(j, trim(rest) == "") for j, c, n, rest in marks[k + 1 :] if c == char and n >= length]
        proper = next((j for j, bare in ends if bare), None)
        end = proper if proper is not None else next((j for j, _ in ends), None)
        if end is None:
            continue
        if proper is None:
            recovered = min(recovered, end + 1)
        language = re.split(rf"[{SPACE}{{,]+", trim(info))[0].lower()
        kinds[i : end + 1] = [SKIP, *[SKIP if language in drop else CODE] * (end - i - 1), SKIP]
        resume = end + 1
    return kinds, recovered


def sections(lines: list[str], start: int = 0, drop: tuple[str, ...] = ()) -> tuple[list[Section], int]:
    """Sections in order, each with the headings above it, and the line of line_kinds()."""
    kinds, recovered = line_kinds(lines, start, drop)
    trail: dict[int, str] = {}
    out = [Section([], start + 1)]
    for i in range(start, len(lines)):
        if kinds[i] == SKIP:
            continue
        m = _HEADING.match(lines[i]) if kinds[i] == TEXT else None
        if m is None:
            out[-1].lines.append(Line(lines[i], i + 1, kinds[i] == CODE))
            continue
        level = len(m[1])
        trail = {n: t for n, t in trail.items() if n < level} | {level: trim(_CLOSE_HASHES.sub("", m[2]))}
        out.append(Section(list(trail.values()), i + 1))
    return out, recovered


def _outside_ticks(text: str) -> list[tuple[int, int]]:
    """Ranges of a line that are not inside inline code; an odd tick opens code to the line's end."""
    ticks = [m.start() for m in re.finditer("`", text)]
    edges = [-1, *ticks, len(text)]
    return [(a + 1, b) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if n % 2 == 0]


def _cut(lines: list[Line], a: tuple[int, int], b: tuple[int, int]) -> None:
    """Remove from position a to position b (line index, column), in place; lines between are left empty."""
    (i, x), (j, y) = a, b
    if i == j:
        lines[i] = replace(lines[i], text=lines[i].text[:x] + lines[i].text[y:])
        return
    lines[j] = replace(lines[j], text=lines[j].text[y:])
    for k in range(i + 1, j):
        lines[k] = replace(lines[k], text="", code=False)
    lines[i] = replace(lines[i], text=lines[i].text[:x])


def strip_comments(lines: list[Line]) -> list[Line]:
    """Without balanced %% and HTML comments outside code; a mark without partner stays."""
    lines = list(lines)
    for opens, closes in (("%%", "%%"), ("<!--", "-->")):
        pattern = re.compile("|".join(map(re.escape, dict.fromkeys((opens, closes)))))
        marks = [(i, m.start(), m[0]) for i, line in enumerate(lines) if not line.code for a, b in _outside_ticks(line.text) for m in pattern.finditer(line.text, a, b)]
        pairs, begun = [], None
        for i, at, mark in marks:
            if begun is None:
                begun = (i, at) if mark == opens else None
            elif mark == closes:
                pairs.append((begun, (i, at + len(closes))))
                begun = None
        for a, b in reversed(pairs):
            _cut(lines, a, b)
    return lines


def flatten_wiki(inner: str, embed: bool) -> str:
    """What a reader sees of a wiki link or an embed."""
    link = inner.replace("\\|", "|")
    if embed:
        name = trim(link.split("|", 1)[0].split("#", 1)[0].rsplit("/", 1)[-1])
        note = re.sub(r"(?i)\.md\Z", "", name)
        return "" if note == name and re.search(r"\.[A-Za-z0-9]{1,5}\Z", name) else note
    if " | " in link:
        return " ".join(map(trim, link.split(" | ", 1)))
    if "|" in link:
        return trim(link.split("|", 1)[1])
    path, _, fragment = link.partition("#")
    parts = [trim(f) for f in fragment.split("#") if f and f[0] != "^"]
    return " > ".join(x for x in (trim(path.rsplit("/", 1)[-1]), " > ".join(parts)) if x)


def host(url: str) -> str:
    """Host name of a URL, empty if there is none."""
    try:
        name = urlsplit(url).hostname or ""
        return name if name.isascii() else name.encode("idna").decode()
    except (ValueError, UnicodeError):
        return ""


# Fixed patterns of the note format, applied in this order.
_INLINE = (
    (re.compile(r"!\[\[([^\]]*)\]\]"), lambda m: flatten_wiki(m[1], True)),
    (re.compile(r"\[\[([^\]]*)\]\]"), lambda m: flatten_wiki(m[1], False)),
    (re.compile(rf"!?\[([^\]]*)\]\((?:[^(){SPACE}]|\([^(){SPACE}]*\))*(?:[{SPACE}]+\"[^\"]*\")?\)"), lambda m: m[1]),
    (re.compile(rf"<(https?://[^>{SPACE}]+)>"), lambda m: host(m[1])),
    (re.compile(rf"(?<![A-Za-z0-9_])https?://[^{SPACE}<>)\]]+"), lambda m: host(m[0])),
    (re.compile(rf"</?[a-zA-Z][a-zA-Z0-9-]*(?:[{SPACE}][^<>]*)?/?>"), lambda m: ""),
    (re.compile(rf"\[\^[^\]{SPACE}]+\]"), lambda m: ""),
    (re.compile(r"\*\*|==|~~|`"), lambda m: ""),
)
_QUOTE = re.compile(rf"\A[{SPACE}]*(?:>[{SPACE}]?)+")
_CALLOUT = re.compile(rf"\A\[![^\]]+\][+-]?[{SPACE}]*")
_RULE = re.compile(rf"\A[{SPACE}]*([-*_])(?:[{SPACE}]*\1){{2,}}[{SPACE}]*\Z")
_TABLE_RULE = re.compile(rf"\A[{SPACE}]*\|?[{SPACE}]*:?-+:?[{SPACE}]*(?:\|[{SPACE}]*:?-+:?[{SPACE}]*)*\|?[{SPACE}]*\Z")
_TASK = re.compile(rf"\A([{SPACE}]*(?:[-*+]|[0-9]+[.)])[{SPACE}])\[[ xX]\][{SPACE}]")
_BLOCK_ID = re.compile(rf"[{SPACE}]\^[A-Za-z0-9-]+[{SPACE}]*\Z")


def clean_inline(text: str) -> str:
    for pattern, shown in _INLINE:
        text = pattern.sub(shown, text)
    return text


def clean_line(raw: str) -> str | None:
    """The words of a line; None if it carries none."""
    line = _CALLOUT.sub("", _QUOTE.sub("", raw))
    if _RULE.match(line) or ("|" in line and _TABLE_RULE.match(line)):
        return None
    line = clean_inline(_BLOCK_ID.sub("", _TASK.sub(r"\1", line)))
    if line.lstrip(SPACES)[:1] == "|":
        line = "; ".join(c for c in map(trim, line.split("|")) if c)
    return trim(re.sub(r"[ \t]+", " ", line)) or None
