"""A note's bytes to its passages. The same bytes, key and settings always give the same passages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from passagelake.text import SPACES, trim, word_list
from passagelake.text.frontmatter import read_properties
from passagelake.text.markdown import clean_inline, clean_line, decode, sections, strip_comments
from passagelake.text.packing import Unit, pack

CHUNKER_VERSION = 1
# Tokens that a passage's prefix and its aliases may take, and that a cut title and heading keep.
PREFIX_CAP, ALIAS_CAP, TITLE_CAP, HEADING_CAP, LEAST_BUDGET = 28, 12, 16, 10, 8


def simple_count(text: str) -> int:
    """A token counter without a model: a mark costs 1, a word one for each six characters begun."""
    return sum(1 if not w[0].isalnum() and len(w) == 1 else max(1, -(-len(w) // 6)) for part in word_list(text.lower()) for w in re.findall(r"[^\W_]+|[^\w]|_", part))


@dataclass(frozen=True)
class Settings:
    count: Callable[[str], int] = simple_count
    budget: int = 110
    min_words: int = 3
    drop_fences: tuple[str, ...] = ()


@dataclass
class Passage:
    n: int
    trail: list[str]
    heads: list[str]
    head_repeats: bool
    line: int
    text: str
    embed_text: str
    recovered: bool


@dataclass
class Note:
    title: str
    indexable: bool
    aliases: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    passages: list[Passage] = field(default_factory=list)


def cut_to_tokens(text: str, most: int, count: Callable[[str], int]) -> str:
    """The longest beginning of whole words within the limit; of a first word that is too long, a halved one."""
    if count(text) <= most:
        return text
    words = word_list(text)
    for n in range(1, len(words) + 1):
        if count(" ".join(words[:n])) > most:
            if n > 1:
                return " ".join(words[: n - 1])
            word = words[0]
            while len(word) > 1 and count(word) > most:
                word = word[: (len(word) + 1) // 2]
            return word
    return " ".join(words)


def prefix_of(folder: str | None, title: str, alias: str, trail: list[str], count: Callable[[str], int]) -> str:
    """Where a passage stands, as text before it, in the fullest form within the cap; an alias comes on top of that."""
    last = trail[-1:]
    forms = [
        lambda: [folder, title, *trail],
        lambda: [folder, title, *last],
        lambda: [None, title, *last],
        lambda: [None, cut_to_tokens(title, TITLE_CAP, count), *[cut_to_tokens(h, HEADING_CAP, count) for h in last]],
    ]
    joined = lambda parts: " > ".join(x for x in parts if x)
    parts = next((p for p in (f() for f in forms[:-1]) if count(joined(p)) <= PREFIX_CAP), None) or forms[-1]()
    if alias:
        parts = [parts[0], f"{parts[1]} {alias}", *parts[2:]]
    return joined(parts)


def alias_part(aliases: list[str], count: Callable[[str], int]) -> str:
    """As many aliases as fit, in brackets."""
    fitting = ""
    for n in range(1, len(aliases) + 1):
        text = f"(also: {', '.join(aliases[:n])})"
        if count(text) > ALIAS_CAP:
            break
        fitting = text
    return fitting


def shown_aliases(aliases: list[str], title: str) -> list[str]:
    """Aliases that are not the title in another case, and hold no slash."""
    return [a for a in aliases if a.lower() != title.lower() and "/" not in a]


def section_words(units: list[Unit]) -> int:
    return sum(len(word_list(u.text)) for u in units)


def chunk(content: bytes, key: str, settings: Settings = Settings(), folder_in_prefix: bool = False) -> Note:
    count = settings.count
    lines = decode(content)
    *folders, name = key.split("/")
    title = re.sub(r"(?i)\.md\Z", "", name)
    found = read_properties(lines)
    note = Note(title, not found.index_off, found.aliases, found.tags)
    if found.index_off:
        return note
    parts, recovered = sections(lines, found.body_start, settings.drop_fences)
    repeats = Counter(trim(s.heads[-1]).lower() for s in parts if s.heads)
    alias = alias_part(shown_aliases(found.aliases, title), count)
    folder = folders[-1] if folder_in_prefix and folders else None
    for section in parts:
        shown = [((x.text.rstrip(SPACES) or None) if x.code else clean_line(x.text), x.number) for x in strip_comments(section.lines)]
        units = [Unit(text, number) for text, number in shown if text]
        if section_words(units) < settings.min_words:
            continue
        trail = [t for t in (" ".join(word_list(clean_inline(h))) for h in section.heads) if t]
        if trail and trail[0].lower() == title.lower():
            del trail[0]
        plain = prefix_of(folder, title, "", trail, count)
        opening = prefix_of(folder, title, alias, trail, count) if alias else plain
        prefixes = [plain if note.passages else opening, plain]
        budgets = [max(LEAST_BUDGET, settings.budget - count(p)) for p in prefixes]
        for i, piece in enumerate(pack(units, lambda k, b=budgets: b[min(k, 1)], count)):
            repeated = bool(section.heads) and repeats[trim(section.heads[-1]).lower()] > 1
            note.passages.append(Passage(len(note.passages), trail, section.heads, repeated, piece.line, piece.text, f"{prefixes[min(i, 1)]}\n{piece.text}", piece.line > recovered))
    return note
