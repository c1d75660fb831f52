"""Nulls in any column, empty and long texts, repeated rows, empty tables, and columns with clashing names."""

import pytest

import corpus_pipeline as C
from passagelake.llm import bpe, embeddings, htmltext, langid, linededup, mixing, quality, simhash, toxicity, warc

NAMES = ["score", "size", "fp", "d", "h", "target", "n_copies", "kept", "rank", "component", "row", "rest", "spans", "n_lines"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
LONG = "\n".join(f"line {i} of a long text with word{i % 97} and more words in it" for i in range(20_000))
TEXTS = [None, "", " \n\t ", "one", "one", "x" * 100_000, LONG, LONG, "The same text that two rows hold.\nAnd a line.", "The same text that two rows hold.\nAnd a line.", "#" * 50, "\x00\x1f  \U0001f600 é"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, [None, "en", "de"][i % 3], [None, "a", "b"][i % 3], None if t is None else len(t), *["clash"] * len(NAMES)) for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[8]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (2, 1, None), (2, 1, 1)], "doc_id long, quality int, toxic int")


def run_all(docs, labels):
    """Every operator's result on documents, by name."""
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    sized = mixing.sizes(docs, ["doc_id", "source"])
    yield "quality", quality.filtered(docs)
    yield "mixing", mixing.draw(sized, mixing.plan(sized))
    yield "toxicity", toxicity.score(docs, toxicity.fitted(docs, labels), ["doc_id"])
    yield "langid", langid.predict(docs, langid.fitted(docs), ["doc_id"])
    yield "simhash", simhash.near_duplicates(docs)
    yield "linededup", linededup.deduplicated(docs)
    yield "bpe", bpe.encode(docs, path, P.PATTERN)


def test_odd_documents(odd, labels):
    n = odd.count()
    for name, out in run_all(odd, labels):
        assert out.count() == n, name


def test_empty_tables(empty, labels):
    for name, out in run_all(empty, labels):
        assert out.count() == 0, name


def test_defined_results(odd):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    assert [got[i]["fingerprint"] for i in (0, 1, 2)] == ["0" * 16] * 3 and {got[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert got[None]["component_id"] == 4  # the document without id has the text of document 4
    cut = {r["doc_id"]: r for r in linededup.deduplicated(odd).collect()}
    assert cut[6]["n_deleted"] == 0 and cut[7]["n_deleted"] == cut[7]["n_lines"] == 20_000 and cut[7]["text"] == ""
    assert cut[0]["text"] is None and cut[2]["text"] == " \n\t "
    found = {r["doc_id"]: r for r in langid.predict(odd, langid.fitted(odd), ["doc_id"]).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (0, 1, 2, 10))
    left = simhash.survivors(odd)
    assert left.columns == odd.columns and left.filter("doc_id = 8").count() == 1 and left.filter("doc_id in (1, 2, 7, 9)").count() == 0


def test_without_labels_nothing_is_toxic(spark, odd, empty, labels):
    assert toxicity.fitted(odd, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score(odd, None, ["doc_id"]).collect()} == {0.0}
    assert toxicity.kept(odd, None, 0.7).count() == odd.count()


def test_pipeline_stages_on_odd_documents(spark, odd, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        for name, stage in C.STAGES[:-1]:
            path = f"{tmp_path}/{name}-{docs is odd}"
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            assert {r[n] for r in out.select(*NAMES).collect() for n in NAMES} <= {"clash"}, name
            out.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
        assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, label string, k0 int, node int"
    rows = [(1, [1.0, 0.0], "a", 1, 1), (2, [2.0, 0.0], "a", 1, 1), (2, [2.0, 0.0], "a", 1, 1), (None, [1.0, 0.0], "a", 1, 1), (3, [1e200, 1.0], "a", 1, 1), (4, [1.0, 0.0, 0.0], "a", 1, 1), (5, [float("inf"), 0.0], "a", 1, 1), (6, [1.0, 0.0], None, 1, 1)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["n_links"] == 3 and got[3]["component_id"] == 1 and got[4]["n_links"] == 0 and got[None]["n_links"] == 0 and not got[None]["kept"]
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, digest string"
    big = "<article>" + "<p>A paragraph of a long page.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "x", "x"), (2, "u", "", "x", "x"), (3, "u", big, "x", "x"), (4, "u\r\nx", big, "x", "x"), (None, "u", big, "x", "x"), (4, "u\r\nx", big, "x", "x"), (5, "u", "<p>unclosed <b <a href='x", "x", "x"), (6, "u", "<script>if (a<b) {}", "x", "x"), (7, "u", "<!-- never closed <p>x</p>", "x", "x"), (8, "u", "<" * 5000 + "'\"" * 500, "x", "x")]
    pages = spark.createDataFrame(rows, schema)
    texts = {r["page_id"]: r for r in htmltext.extract(pages, ["page_id", "url"]).collect()}
    assert texts[1]["text"] == texts[2]["text"] == texts[6]["text"] == texts[7]["text"] == ""
    assert texts[3]["text"].count("\n") == 19_999
    got = warc.archive(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["record_type"] == "response" and by[4]["refers_to"] == 3 and by[None]["refers_to"] == 3 and by[1]["payload_bytes"] == 0
    nothing = spark.createDataFrame([], schema)
    assert htmltext.extract(nothing, ["page_id"]).count() == warc.archive(nothing).count() == 0


def test_character_references_and_white_space():
    net = htmltext.trained()
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>Some  text\n here&nbsp;&eacute;. And more text follows it.<p>More text of the article stands here.<br>On.</article><footer>&copy; x</footer></body></html>"
    assert htmltext.main_texts([page], net) == ["A & B\nSome text here é. And more text follows it.\nMore text of the article stands here. On."]


def test_html_as_browsers_read_it():
    read = lambda page: [b.text for b in htmltext.blocks(page)]
    assert read('<p title="1<2">Hello there</p>') == ["Hello there"]
    assert read("<p data-x='<b>' class=\"a>b\">in</p>") == ["in"]
    assert read('One <svg viewBox="0"></p><p>Two</p>') == read("<p>One <video src=x><p>Two") == read("<p>One<iframe src=x><canvas><object><p>Two") == ["One", "Two"]
    assert read("<p>Let <math><mi>x</mi></math> be</p>") == ["Let x be"]
    assert read("<p>Text <button>Share</button> more</p>") == ["Text more"]
    assert read("<p>unclosed <b <a href='x") == ["unclosed"]
    assert read("<!--><p>x</p><!-- y --!><p>z") == ["x", "z"]
    assert read('<p a="x>y</p><p>z</p>') == ["y", "z"]
    assert read("a < b and 2<3") == ["a < b and 2<3"]
    assert read("<p>a</p><script>if (a<b) { '</p>' }</script><p>c") == ["a", "c"]


def test_long_pages_are_labelled_in_pieces(monkeypatch):
    net = htmltext.trained()
    page = "<nav><a href=x>Home</a></nav><article>" + "".join(f"<p>Paragraph {i} of a long page, with words.</p>" for i in range(300)) + "</article><footer>&copy; x</footer>"
    whole = htmltext.main_texts([page, "<p>x"], net)
    monkeypatch.setattr(htmltext, "STEPS", 64)
    assert htmltext.main_texts([page, "<p>x"], net) == whole and whole[0].count("\n") == 299


def test_long_texts_are_bundled_in_pieces(monkeypatch):
    import numpy as np

    text = "Ein langer Text, mit Wörtern; und mehr 12 davon. " * 200
    whole, n = langid.bundles([text])
    monkeypatch.setattr(langid, "SCAN", 500)
    assert [*langid.parts(["a" * 300, "b" * 300, text, None, "c"])] == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert "".join(langid.pieces(text)) == text and len([*langid.pieces(text)]) > 10
    cut, m = langid.bundles([text])
    assert np.array_equal(whole, cut) and n == m
