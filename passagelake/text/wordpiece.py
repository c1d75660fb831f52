"""WordPiece token counts from a tokenizer's JSON, after the BERT normaliser."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from passagelake.text import SPACES

# Code points that are words of their own.
_IDEOGRAPHS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2F800, 0x2FA1F))
_ASCII_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def is_ideograph(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in _IDEOGRAPHS)


def without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


class WordPiece:
    """count() and tokenize() as a model with this tokenizer would see a text."""

    def __init__(self, tokenizer: dict):
        model, norm = tokenizer.get("model") or {}, tokenizer.get("normalizer") or {}
        if model.get("type") != "WordPiece" or not isinstance(model.get("vocab"), dict):
            raise ValueError("not a WordPiece tokenizer")
        if norm.get("type") != "BertNormalizer":
            raise ValueError("a normaliser that is not understood")
        self.vocab = frozenset(model["vocab"])
        self.joint = model.get("continuing_subword_prefix") or "##"
        self.longest = model.get("max_input_chars_per_word") or 100
        self.unknown = model.get("unk_token") or "[UNK]"
        self.lower = norm.get("lowercase") is not False
        strip = norm.get("strip_accents")
        self.strip = self.lower if strip is None else bool(strip)
        self.clean = norm.get("clean_text") is not False
        self.spaced = norm.get("handle_chinese_chars") is not False
        self.pieces = lru_cache(200_000)(self._pieces)

    def words(self, text: str) -> list[str]:
        if self.strip:
            text = without_marks(text)
        if self.lower:
            text = text.lower()
            text = without_marks(text) if self.strip else text
        out = [""]
        for c in text:
            kind = unicodedata.category(c)
            if c == "\ufeff":
                continue
            if c in SPACES:
                out.append("")
            elif self.clean and (c == "\ufffd" or kind in ("Cc", "Cf", "Cn", "Co")):
                continue
            elif (self.spaced and is_ideograph(c)) or c in _ASCII_MARKS or kind[0] == "P":
                out += [c, ""]
            else:
                out[-1] += c
        return [w for w in out if w]

    def _pieces(self, word: str) -> tuple[str, ...]:
        """Longest known beginning, again and again; one unknown token if that gets stuck."""
        if len(word) > self.longest:
            return (self.unknown,)
        out: list[str] = []
        at = 0
        while at < len(word):
            lead = self.joint if at else ""
            end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in self.vocab), None)
            if end is None:
                return (self.unknown,)
            out.append(lead + word[at:end])
            at = end
        return tuple(out)

    def tokenize(self, text: str) -> list[str]:
        return [p for w in self.words(text) for p in self.pieces(w)]

    def count(self, text: str) -> int:
        return sum(len(self.pieces(w)) for w in self.words(text))
