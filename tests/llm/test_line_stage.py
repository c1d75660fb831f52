"""The pipeline's line stage holds each text once."""

import corpus_pipeline
from passagelake.llm import linededup


def texts_in(kind):
    return sum(f.name == "text" or texts_in(f.dataType) for f in kind) if kind.typeName() == "struct" else 0


def test_each_text_is_carried_once(spark, monkeypatch):
    seen, whole = [], linededup.deduplicated
    monkeypatch.setattr(linededup, "deduplicated", lambda docs: seen.append(docs.schema) or whole(docs))
    run = "\n".join(f"line {i} of a passage" for i in range(12))
    rows = [(1, f"{run}\nfirst end", "a", 7, "kept"), (2, f"own begin\n{run}", None, None, "kept"), (3, run, "b", 7, "kept"), (4, None, "b", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, n_deleted string")
    out = corpus_pipeline.cut_repeated_lines(spark, docs, "")
    assert [texts_in(s) for s in seen] == [1]
    assert out.schema.simpleString() == docs.schema.simpleString()
    first = f"{run}\nfirst end"
    assert sorted(map(tuple, out.collect())) == [(1, first, "a", len(first), "kept"), (2, "own begin", None, 9, "kept"), (4, None, "b", None, None)]
    few = corpus_pipeline.cut_repeated_lines(spark, docs.select("text", "doc_id"), "")
    assert few.columns == ["text", "doc_id"] and few.count() == 3
