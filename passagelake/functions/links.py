"""Links back to a note, and the short forms in which results are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript sees it; Java's \s is ASCII only.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SNIPPET = 400


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def encode_strict(text: Column) -> Column:
    """Percent encoding of all but letters, digits and - _ . ~"""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def strip_heading(heading: Column) -> Column:
    plain = F.regexp_replace(heading, r"%%|\[\[|\]\]|[:#|^\\]", " ")
    return trimmed(F.regexp_replace(plain, rf"{SPACE}+", " "))


def heading_part(heads: Column, repeats: Column) -> Column:
    """What follows # in a link: the last heading, or the whole chain if the last one is repeated; null to link to the note alone."""
    deepest = strip_heading(F.element_at(heads, -1))
    chain = F.transform(heads, strip_heading)
    return (
        F.when(F.coalesce(F.size(heads), F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(deepest == "", F.lit(None).cast("string"))
        .when(~F.coalesce(repeats, F.lit(False)), deepest)
        .when(F.forall(chain, lambda h: h != ""), F.array_join(chain, "#"))
    )


def build_link(vault: Column, path: Column, heads: Column, repeats: Column, recovered: Column) -> Column:
    """Link of a passage (path in NFC); null if the vault is unknown or the path holds a #."""
    heading = F.when(~F.coalesce(recovered, F.lit(False)), heading_part(heads, repeats))
    file = F.translate(path, "\u00a0", " ")
    target = F.when(heading.isNotNull(), F.concat(file, F.lit("#"), heading)).otherwise(file)
    known = vault.isNotNull() & (vault != "") & ~F.contains(path, F.lit("#"))
    return F.when(known, F.concat(F.lit("obsidian://open?vault="), encode_strict(vault), F.lit("&file="), encode_strict(target)))


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """White space collapsed, and cut at the last space within the first most + 1 characters."""
    flat = trimmed(F.regexp_replace(text, rf"{SPACE}+", " "))
    at_word = F.regexp_extract(flat, rf"\A(.{{0,{most}}})(?= )", 1)
    cut = F.when(at_word == "", F.left(flat, F.lit(most))).otherwise(at_word)
    return F.when(F.length(flat) <= most, flat).otherwise(cut)


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != ""))


def title_of(key: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(key, "/"), -1), r"(?i)\.md\z", "")


def folder_of(key: Column) -> Column:
    """Name of the folder a note is in, null at the top."""
    parts = F.split(key, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, F.lit(-2)))


def index_name(path: Column) -> Column:
    """Name of the folder that holds the index of a source: its base name made safe, and 8 hex digits of the path's hash."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[^A-Za-z0-9._-]+", "-")
    return F.concat(base, F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))
