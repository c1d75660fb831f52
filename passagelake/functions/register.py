"""The functions as SQL functions of a session: Spark inlines their bodies, so that they run inside code generation.

    register(spark)
    spark.sql("SELECT tokenise(text), snippet(mask_secrets(text)) FROM documents")
    spark.sql("SELECT key, p.* FROM notes, LATERAL note_passages(key, content, false) p")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from passagelake.functions import links, markdown, screen, tokens
from passagelake.text.chunking import chunk


def _text(s: str) -> str:
    """A string as a raw SQL literal, in which back slashes stand for themselves."""
    if '"' not in s:
        return f'r"{s}"'
    if "'" not in s:
        return f"r'{s}'"
    raise ValueError("a pattern with both kinds of quotes")


def _replace(value: str, steps) -> str:
    for pattern, shown in steps:
        value = f"regexp_replace({value}, {_text(pattern)}, {_text(shown)})"
    return value


def definitions() -> dict[str, str]:
    """Function name with its signature, to the body."""
    stop = ", ".join(f"'{w}'" for w in tokens.STOP_WORDS)
    flat = _replace("t", [(links.SPACE + "+", " "), (rf"\A{links.SPACE}+|{links.SPACE}+\z", "")])
    line = _replace("raw", [(markdown.QUOTE, ""), (markdown.CALLOUT, "")])
    inline = _replace(line, [(markdown.TASK, "$1"), (markdown.BLOCK_ID, ""), *[(p.replace('"', "\\x22"), s) for p, s in markdown.INLINE]])
    secret = " OR ".join(f"t RLIKE {_text(p)}" for p in screen.SECRET_RULES.values())
    instruction = " OR ".join(f"t RLIKE {_text(p)}" for p in screen.INSTRUCTION_RULES.values())
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"
    norm = lambda a: f"coalesce(nullif(sqrt({dot(a, a)}), 0D), 1D)"
    return {
        "tokenise(t STRING) RETURNS ARRAY<STRING>": f"filter(regexp_extract_all(lower(t), {_text(tokens.TOKEN)}, 0), x -> length(x) <= {tokens.MAX_TOKEN})",
        "distinctive(ts ARRAY<STRING>) RETURNS ARRAY<STRING>": f"filter(ts, x -> x NOT IN ({stop}) AND (length(x) > 1 OR NOT x BETWEEN 'a' AND 'z'))",
        "clean_line(raw STRING) RETURNS STRING": f"CASE WHEN {line} RLIKE {_text(markdown.RULE)} OR (contains({line}, '|') AND {line} RLIKE {_text(markdown.TABLE_RULE)}) THEN NULL ELSE nullif(btrim(regexp_replace(CASE WHEN {inline} RLIKE {_text('^[ \\t]*[|]')} THEN array_join(filter(transform(split({inline}, '[|]'), c -> trim(c)), c -> c <> ''), '; ') ELSE {inline} END, {_text('[ \\t]+')}, ' ')), '') END",
        "snippet(t STRING) RETURNS STRING": f"CASE WHEN length({flat}) <= {links.SNIPPET} THEN {flat} ELSE coalesce(nullif(regexp_extract({flat}, {_text(rf'\A(.{{0,{links.SNIPPET}}})(?= )')}, 1), ''), left({flat}, {links.SNIPPET})) END",
        "mask_secrets(t STRING) RETURNS STRING": _replace("t", [(p, screen.MASK) for p in screen.SECRET_RULES.values()]),
        "screen_flags(t STRING) RETURNS ARRAY<STRING>": f"filter(array(CASE WHEN {secret} THEN '{screen.SECRET}' END, CASE WHEN {instruction} THEN '{screen.INSTRUCTION}' END), x -> x IS NOT NULL)",
        "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"{dot('a', 'b')} / ({norm('a')} * {norm('b')})",
        "note_title(k STRING) RETURNS STRING": f"regexp_replace(element_at(split(k, '/'), -1), {_text(r'(?i)\.md\z')}, '')",
        "encode_strict(s STRING) RETURNS STRING": "replace(replace(replace(url_encode(s), '+', '%20'), '*', '%2A'), '%7E', '~')",
    }


@udtf(returnType="n int, title string, trail array<string>, heads array<string>, head_repeats boolean, line int, text string, embed_text string, recovered boolean")
class NotePassages:
    """note_passages(key, content, folder_in_prefix): the passages of one note."""

    def eval(self, key: str, content: bytes, folder_in_prefix: bool) -> Iterator[tuple]:
        note = chunk(bytes(content or b""), key or "", folder_in_prefix=bool(folder_in_prefix))
        for p in note.passages:
            yield p.n, note.title, p.trail, p.heads, p.head_repeats, p.line, p.text, p.embed_text, p.recovered


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    names = []
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(")[0])
    spark.udtf.register("note_passages", NotePassages)
    return [*names, "note_passages"]
