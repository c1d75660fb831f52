"""Line cleaning as one Spark expression. Wiki links in their simple forms only; the kernel in text/ knows all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the note format; the rule's back reference is written out.
QUOTE, CALLOUT = r"^[ \t]*(?:>[ \t]?)+", r"^\[![^\]]+\][+-]?[ \t]*"
RULE = r"^[ \t]*(?:-(?:[ \t]*-){2,}|\*(?:[ \t]*\*){2,}|_(?:[ \t]*_){2,})[ \t]*$"
TABLE_RULE = r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
TASK, BLOCK_ID = r"^([ \t]*(?:[-*+]|[0-9]+[.)])[ \t])\[[ xX]\][ \t]", r"[ \t]\^[A-Za-z0-9-]+[ \t]*$"
INLINE = (
    (r"!\[\[[^\]]*\.[A-Za-z0-9]{1,5}\]\]", ""),
    (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"),
    (r"!?\[\[([^\]#|]*)\]\]", "$1"),
    (r"!?\[([^\]]*)\]\([^()\s]*\)", "$1"),
    (r"</?[a-zA-Z][a-zA-Z0-9-]*(?:[ \t][^<>]*)?/?>", ""),
    (r"\[\^[^\]\s]+\]", ""),
    (r"\*\*|==|~~|`", ""),
)
HEADING = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*$"


def clean_line(raw: Column) -> Column:
    """The words of a line; null if it carries none."""
    line = F.regexp_replace(F.regexp_replace(raw, QUOTE, ""), CALLOUT, "")
    nothing = line.rlike(RULE) | (F.contains(line, F.lit("|")) & line.rlike(TABLE_RULE))
    text = F.regexp_replace(F.regexp_replace(line, TASK, "$1"), BLOCK_ID, "")
    for pattern, shown in INLINE:
        text = F.regexp_replace(text, pattern, shown)
    cells = F.array_join(F.filter(F.transform(F.split(text, r"\|"), lambda c: F.trim(c)), lambda c: c != ""), "; ")
    text = F.when(text.rlike(r"^[ \t]*\|"), cells).otherwise(text)
    text = F.btrim(F.regexp_replace(text, r"[ \t]+", " "))
    return F.when(~nothing & (text != ""), text)


def heading_level(line: Column) -> Column:
    return F.nullif(F.length(F.regexp_extract(line, HEADING, 1)), F.lit(0))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(line, HEADING, 2), r"[ \t]+#+[ \t]*$", ""))
