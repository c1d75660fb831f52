"""Markdown kernels: inputs and the results that the note format asks for."""

import pytest

from passagelake.text.chunking import Settings, alias_part, chunk, cut_to_tokens, prefix_of, simple_count
from passagelake.text.frontmatter import read_properties
from passagelake.text.markdown import Line, clean_inline, clean_line, flatten_wiki, host, sections, strip_comments
from passagelake.text.packing import Unit, pack, split_text
from passagelake.text.wordpiece import WordPiece


@pytest.mark.parametrize(
    ("inner", "embed", "want"),
    [("Note|shown", False, "shown"), ("Note#Heading", False, "Note > Heading"), ("#Same", False, "Same"), ("A#^block", False, "A"), ("A#H|b", False, "b"), ("A | B", False, "A B"), ("image.png", True, ""), ("Note#Heading", True, "Note"), ("Folder/Note.md", True, "Note"), ("a/b/Note", False, "Note"), ("Note\\|shown", False, "shown")],
)
def test_wiki_links(inner, embed, want):
    assert flatten_wiki(inner, embed) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("see https://example.com/a/b?c", "see example.com"),
        ("<https://Example.com/x>", "example.com"),
        ("a [text](http://x.y/z) b", "a text b"),
        ('a ![alt](p(1).png "t") b', "a alt b"),
        ("note[^1] here", "note here"),
        ("**bold** ==mark== ~~gone~~ `code`", "bold mark gone code"),
        ("- [x] buy felt", "- buy felt"),
        ("1. [ ] buy felt", "1. buy felt"),
        ("a line ^abc123", "a line"),
        ("| --- | :-: |", None),
        ("| a | b |", "a; b"),
        ("- - -", None),
        ("***", None),
        ("> [!note]+ Title", "Title"),
        ("> > deep", "deep"),
        ("  \t ", None),
        ("<b class='x'>t</b>", "t"),
    ],
)
def test_lines(raw, want):
    assert clean_line(raw) == want


def test_hosts():
    assert [host(u) for u in ("https://A.b:80/x", "nonsense", "http://[bad")] == ["a.b", "", ""]
    assert clean_inline("x") == "x"


def lines_of(text):
    return [Line(t, i + 1) for i, t in enumerate(text.split("\n"))]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a %%x%% b", "a  b"), ("a %%x\ny\nz%% b", "a \n\n b"), ("stray %% here", "stray %% here"), ("`%%` and `%%`", "`%%` and `%%`"), ("a <!-- x --> b", "a  b"), ("a <!-- x", "a <!-- x"), ("--> a <!-- b --> c", "--> a  c")],
)
def test_comments(text, want):
    assert "\n".join(x.text for x in strip_comments(lines_of(text))) == want


def test_comments_in_code_stay():
    code = [Line("%%x%%", 1, True)]
    assert strip_comments(code) == code


def test_properties():
    got = read_properties("---\naliases:\n  - One\n  - '[[Two|2]]'\ntags: [a, \"b\"]\nindex: true\n---\nbody".split("\n"))
    assert (got.body_start, got.index_off, got.aliases, got.tags) == (7, False, ["One", "2"], ["a", "b"])
    assert read_properties(["---", "aliases: x", "no end"]).body_start == 0
    assert read_properties(["---", "this is prose, not a property", "---"]).body_start == 0
    assert read_properties(["text"]).body_start == 0


@pytest.mark.parametrize(("line", "off"), [("index: false", True), ("Index: No", True), ("index : 'off'", True), ('index: "0"', True), ("index: true", False), ("indexes: false", False), ("  index: false", False), ("index: falsey", False)])
def test_index_key(line, off):
    assert read_properties(["---", line, "---"]).index_off is off
    assert read_properties(["---", line, "prose that is no property at all", "---"]).index_off is off


def test_sections_and_fences():
    parts, recovered = sections("intro\n# A\n~~~py\n# no\n~~~\n## B ##\ntext\n# C".split("\n"))
    assert [s.heads for s in parts] == [[], ["A"], ["A", "B"], ["C"]] and recovered > 100
    assert [(x.text, x.code) for x in parts[1].lines] == [("# no", True)]
    parts, _ = sections("````\n```\n# no\n```\n````\n# yes".split("\n"))
    assert [s.heads for s in parts] == [[], ["yes"]]
    parts, recovered = sections("```js\ncode\n# hidden\n``` and more\n# below".split("\n"))
    assert parts[-1].heads == ["below"] and recovered == 4
    assert sections(["```a`b", "# x"])[0][-1].heads == ["x"]
    assert not sections("```dataview\nq\n```".split("\n"), 0, ("dataview",))[0][0].lines


def test_packing_keeps_everything_within_the_budget():
    line = " ".join(f"{'word ' * 19}end." for _ in range(50)).strip()
    pieces = split_text(line, 110, simple_count)
    assert " ".join(pieces) == line and all(simple_count(p) <= 110 and p.endswith("end.") for p in pieces)
    assert "".join(split_text("x" * 5000, 100, simple_count)) == "x" * 5000
    rows = [Unit(f"row {i}; cell", i) for i in range(300)]
    packed = pack(rows, lambda n: 110, simple_count)
    assert "\n".join(p.text for p in packed) == "\n".join(r.text for r in rows)
    sizes = [simple_count(p.text) for p in pack([Unit("one two three", i) for i in range(38)], lambda n: 110, simple_count)]
    assert max(sizes) <= 110 and abs(sizes[-1] - sizes[-2]) <= 6


def test_prefixes():
    assert prefix_of("F", "T", "(also: x)", ["a", "b"], simple_count) == "F > T (also: x) > a > b"
    assert prefix_of("F", "T", "", ["long " * 30, "b"], simple_count) == "F > T > b"
    assert prefix_of("long " * 30, "T", "", ["b"], simple_count) == "T > b"
    assert prefix_of(None, "w " * 40, "", ["h " * 40], simple_count) == "w " * 15 + "w > " + "h " * 9 + "h"
    assert alias_part(["one", "two", "three " * 20], simple_count) == "(also: one, two)"
    assert cut_to_tokens("x" * 600, 16, simple_count) == "x" * 75


def test_notes():
    note = chunk(b"\xef\xbb\xbf# Top\r\nFirst words here.\r\n\r\n## Second\r\nMore words stand here.", "Folder/Top.md", folder_in_prefix=True)
    assert [(p.n, p.line, p.trail, p.text) for p in note.passages] == [(0, 2, [], "First words here."), (1, 5, ["Second"], "More words stand here.")]
    assert note.passages[1].embed_text == "Folder > Top > Second\nMore words stand here."
    assert chunk(b"---\nindex: off\n---\nx y z w", "a.md").indexable is False
    assert chunk(b"", "a.md").passages == [] and chunk(b"too short", "a.md").passages == []
    assert chunk(b"# A\none two three\n# a\nfour five six", "n.md").passages[1].head_repeats
    assert chunk(b"```dataview\nq r s t\n```\n```js\nkeep this code line\n```", "n.md", Settings(drop_fences=("dataview",))).passages[0].text == "keep this code line"
    assert chunk(b"```js\ncode code code\n``` x\n# Below\nwords that are below", "n.md").passages[-1].recovered


def test_word_pieces():
    w = WordPiece({"normalizer": {"type": "BertNormalizer"}, "model": {"type": "WordPiece", "unk_token": "[UNK]", "vocab": dict.fromkeys(["water", "##ing", "##s", "[UNK]", "庭", "園", "cafe", "!"], 1)}})
    assert w.tokenize("Watering waters") == ["water", "##ing", "water", "##s"]
    assert w.tokenize("9f86") == ["[UNK]"] and w.tokenize("庭園") == ["庭", "園"]
    assert w.count("x" * 200) == 1 and w.tokenize("Café!") == ["cafe", "!"]
    with pytest.raises(ValueError):
        WordPiece({"model": {"type": "BPE"}})
