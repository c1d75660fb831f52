"""Lines to pieces that fit a token budget. A word is cut only if it is larger than a piece."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from passagelake.text import SPACE, word_list

Count = Callable[[str], int]
_LISTED = re.compile(rf"\A[{SPACE}]*(?:[-*+]|[0-9]+[.)])[{SPACE}]|;[{SPACE}]")
#: A last piece under this share of its budget is balanced with the one before.
TINY = 0.4


@dataclass(frozen=True)
class Unit:
    text: str
    line: int


def _finer(part: str) -> tuple[list[str], str]:
    """The next finer split of a part, and what joins its pieces: sentences, words, around marks, halves."""
    sentences = [x for x in re.split(rf"(?<=[.?!;])[{SPACE}]+", part) if x]
    if len(sentences) > 1:
        return sentences, " "
    words = word_list(part)
    if len(words) > 1:
        return words, " "
    bits: list[str] = []
    for c in part:
        mark = unicodedata.category(c)[0] in "PS"
        if bits and not mark and unicodedata.category(bits[-1][-1])[0] not in "PS":
            bits[-1] += c
        else:
            bits.append(c)
    if len(bits) > 1:
        return bits, ""
    middle = (len(part) + 1) // 2
    return [x for x in (part[:middle], part[middle:]) if x], ""


def split_text(text: str, budget: int, count: Count) -> list[str]:
    """Pieces of one text within the budget, as full as whole parts make them."""

    def filled(parts: list[str], glue: str) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        used = 0
        for part in [*parts, None]:
            size = 0 if part is None else count(part)
            if held and (part is None or used + size > budget):
                out.append(glue.join(held))
                held, used = [], 0
            if part is None:
                break
            if size <= budget:
                held.append(part)
                used += size
                continue
            finer, joint = _finer(part)
            out += [part] if len(finer) < 2 else filled(finer, joint)
        return out

    return filled([text], " ")


Group = list[tuple[Unit, int]]


def _balanced(first: Group, last: Group, room: tuple[int, int]) -> int:
    """Where to cut the lines of both groups so that they are nearest in size; inside a list only if nothing else will do."""
    both = first + last
    total = sum(n for _, n in both)
    options = []
    left = 0
    for cut in range(1, len(both)):
        left += both[cut - 1][1]
        if left <= room[0] and total - left <= room[1]:
            listed = all(_LISTED.search(both[k][0].text) for k in (cut - 1, cut))
            options.append((abs(2 * left - total) + (total / 2 if listed else 0), cut))
    return min(options)[1] if options else len(first)


def pack(units: list[Unit], budget_of: Callable[[int], int], count: Count) -> list[Unit]:
    """Pieces of whole lines, each within the budget of its place; a tiny last piece shares the lines of the one before."""
    groups: list[Group] = []
    held: Group = []
    used = 0
    for unit in units:
        size = count(unit.text)
        whole = size <= budget_of(len(groups) + bool(held))
        if held and (not whole or used + size > budget_of(len(groups))):
            groups.append(held)
            held, used = [], 0
        if whole:
            held.append((unit, size))
            used += size
        else:
            least = min(budget_of(len(groups)), budget_of(len(groups) + 1))
            groups += [[(Unit(part, unit.line), count(part))] for part in split_text(unit.text, least, count)]
    if held:
        groups.append(held)
    if len(groups) > 1:
        first, last = groups[-2:]
        room = budget_of(len(groups) - 2), budget_of(len(groups) - 1)
        if len(first) > 1 and sum(n for _, n in last) < TINY * room[1]:
            both, cut = first + last, _balanced(first, last, room)
            groups[-2:] = [both[:cut], both[cut:]]
    return [Unit("\n".join(u.text for u, _ in g), g[0][0].line) for g in groups]
