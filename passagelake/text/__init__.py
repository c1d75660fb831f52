"""Pure-Python kernels for what is sequential in Markdown: no Spark in here."""

import re

#: White space of the note format, as a regex class body and as a set of characters.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{SPACE}]", c))


def trim(text: str) -> str:
    return text.strip(SPACES)


def word_list(text: str) -> list[str]:
    return [w for w in re.split(f"[{SPACE}]+", text) if w]
