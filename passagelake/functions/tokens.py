"""Tokens of the exact-words list: lower-case runs of letters, digits and marks of at most 64 characters."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_RULES = 1
MAX_TOKEN = 64
TOKEN = r"[\p{L}\p{N}\p{M}]+"

# Words too common to tell one passage from another.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are aren as at be because been before being below between both but by "
    "can cannot could couldn did didn do does doesn doing don down during each few for from further get had hadn has hasn "
    "have haven having he her here hers him his how i if in into is isn it its just ll me more most my no nor not now of off "
    "on once only or other our out over own re same shan she should shouldn so some such than that the their them then there "
    "these they this those through to too under until up ve very was wasn we were weren what when where which while who whom "
    "why will with won would wouldn you your yours".split()
)
_STOP = frozenset(STOP_WORDS)


def tokenise(text: Column) -> Column:
    """Array of the tokens of a text, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) <= MAX_TOKEN)


def is_distinctive(token: Column) -> Column:
    """Neither a stop word nor a single letter from a to z."""
    return ~token.isin(*STOP_WORDS) & ~token.rlike(r"\A[a-z]\z")


def distinctive(tokens: Column) -> Column:
    """The distinctive tokens of an array; the stop words are a hash set."""
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS) & ((F.length(t) > 1) | ~t.between("a", "z")))


def has_phrase(fields: Column, phrase: list[str]) -> Column:
    """Whether one of the fields (array of texts) holds the tokens of a phrase as neighbours; a phrase never spans two fields."""
    wanted = F.lit(f" {' '.join(phrase)} ")
    return F.exists(fields, lambda f: F.contains(F.concat(F.lit(" "), F.array_join(tokenise(f), " "), F.lit(" ")), wanted))


def hash_token(token: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, for tokens of the basic plane."""
    units = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


class _Kept(dict):
    """Code point to itself if it is a letter, digit or mark, else to a space; filled as it is asked."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = c if unicodedata.category(c)[0] in "LNM" else " "
        return self[point]


_KEPT = _Kept()


def tokens_of(text: str) -> list[str]:
    """tokenise() on the driver, for a question."""
    spaced = text.lower().translate(_KEPT)
    return [t for t in spaced.split(" ") if t and (len(t) <= MAX_TOKEN // 2 or len(t.encode("utf-16-le")) // 2 <= MAX_TOKEN)]


def distinctive_of(token: str) -> bool:
    return token not in _STOP and not ("a" <= token <= "z" and len(token) == 1)


def read_question(question: str) -> dict[str, list]:
    """Distinctive words, each once in order of first use, and the quoted phrases that hold one of them."""
    quoted = [tokens_of(m) for m in re.findall(r"[\"\u201c]([^\"\u201c\u201d]+)[\"\u201d]", question)]
    words = list(dict.fromkeys(t for t in tokens_of(question) if distinctive_of(t)))
    return {"words": words, "phrases": [p for p in quoted if any(map(distinctive_of, p))]}
