"""The whole way: a folder to an index, questions, audits, snapshots, streams, and the registered queries."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from passagelake import audit, catalog, config, search, store, sync
from passagelake.embedding import HashingEmbedder
from passagelake.errors import ERRORS, LakeError, as_lake_error
from passagelake.sources import folder
from passagelake.streaming import incremental

E = HashingEmbedder(64)
C = config.Config(dimensions=64)
LATER = 10**15  # no note is racy then


@pytest.fixture
def notes(tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    for name, text in {"Tomatoes.md": "Start the tomatoes indoors six weeks before the last frost.\n\n## Watering\nWater the tomatoes at the root, never on the leaves. Tomatoes hate wet leaves.\n", "Beans.md": "Sow beans after the last frost date, when the soil is warm.\n", "Kitchen/Soup.md": "# Stock\nSimmer the stock for two hours.\n# Beans\nAdd the beans near the end.\n# Salt\nSalt at the table.\n", "Off.md": "---\nindex: false\n---\nhidden words\n", "Empty.md": "", "pic.png": "x"}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return root


def test_sync_search_audit(spark, notes, tmp_path):
    base = str(tmp_path / "index")
    run = lambda **k: sync.sync(spark, str(notes), base, C, E, now_ms=LATER, **k)
    first = run()
    assert (first.added, first.left_out, first.other_files) == (3, 2, 1)
    again = run()
    assert (again.added, again.unchanged, again.snapshot) == (0, 3, None)
    ready = sync.ready(spark, base, "Notes")
    assert ready.passages.count() == 6
    found = search.search(ready, ["stock hours"], E, 2)
    best = found.meaning.orderBy("rank").first()
    assert (best["key"], best["n"], best["link"]) == ("Kitchen/Soup.md", 0, "obsidian://open?vault=Notes&file=Kitchen%2FSoup.md%23Stock")
    without = search.search(ready, ["stock hours"], E, 2, exact_words=False)
    assert sorted(without.meaning.collect()) == sorted(found.meaning.collect()) and without.exact.count() == 0
    exact = search.exact_list(ready, ['"last frost" date', "beans"]).orderBy("place", F.desc("score")).collect()
    assert (exact[0]["key"], exact[0]["words"]) == ("Beans.md", ["last", "frost", "date"]) or exact[0]["key"] in ("Beans.md", "Kitchen/Soup.md")
    assert found.reading.first()["notes"] == found.meaning.select("key").unionByName(found.exact.select("key")).distinct().count()
    checks = sync.status(spark, str(notes), base, C)
    assert checks.count() == 9 and audit.in_step(checks).first()["in_step"]
    assert audit.in_step(sync.verify(spark, base, E)).first()["in_step"]

    os.rename(notes / "Beans.md", notes / "Kitchen" / "Beans.md")
    (notes / "Tomatoes.md").write_text("Only one line about tomatoes now.\n")
    (notes / "New.md").write_text("A new note with some words.\n")
    assert not audit.in_step(sync.status(spark, str(notes), base, C)).first()["in_step"]
    moved = run()
    assert (moved.renamed, moved.updated, moved.added, moved.removed) == (1, 1, 1, 0)
    assert audit.in_step(sync.status(spark, str(notes), base, C)).first()["in_step"]
    # Increments lead to the same index as a start from nothing.
    incremental_ = {t: sorted(map(str, store.Store(spark, base).read(t).collect())) for t in ("passages", "postings", "lengths")}
    run(full=True)
    assert incremental_ == {t: sorted(map(str, store.Store(spark, base).read(t).collect())) for t in ("passages", "postings", "lengths")}
    for f in notes.rglob("*.md"):
        f.unlink()
    with pytest.raises(LakeError) as e:
        run()
    assert e.value.code == "SOURCE_EMPTY"


def test_walk(tmp_path):
    root = tmp_path / "v"
    for p in ("A.md", "NOTE.MD", "photo.png", "board.canvas", ".hidden.md", ".trash/x.md", ".Cloud.md.icloud", "Nested/.obsidian/app.json", "Nested/n.md", "Templates/t.md", "old/private.md", "_under.md"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x")
    (root / ".obsidian").mkdir()
    (root / ".obsidian" / "app.json").write_text(json.dumps({"userIgnoreFilters": ["/PRIVATE/", "nothing", 3]}))
    os.symlink(root / "A.md", root / "link.md")
    got = folder.walk(str(root), ("templates", "./absent/", ".secret"))
    assert [n[0] for n in got.notes] == ["A.md", "NOTE.MD", "_under.md"]
    assert {k: r for k, r, *_ in got.left_out} == {"Cloud.md": "not-downloaded", "link.md": "symlink", "Nested/n.md": "nested-vault", "Templates/t.md": "excluded", "old/private.md": "obsidian-excluded"}
    assert got.other_files == 2 and got.unmatched == ["absent"] and len(got.warnings) == 1
    with pytest.raises(LakeError):
        folder.walk(str(tmp_path / "missing"))


def test_snapshots_survive_a_crash(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "i"))
    assert s.meta() is None and s.read("notes").count() == 0
    empty = {t: spark.createDataFrame([], d) for t, d in store.TABLES.items() if t != "meta"}
    meta = spark.createDataFrame([(1, 0, 1, "h", "m", 4, 0, 0)], store.TABLES["meta"])
    first = s.commit(empty | {"meta": meta})
    assert s.meta()["stamp"] == 1
    os.makedirs(os.path.join(s.base, "data-000007"))  # a write that never switched
    assert s.current() == first and s.remove_orphans() == ["data-000007"]
    with pytest.raises(LakeError) as e:
        s.commit(empty | {"meta": meta}, still_ours=lambda: False)
    assert e.value.code == "LOCK_LOST" and s.current() == first
    s.commit(empty | {"meta": meta}, content_changed=False)
    assert s.meta()["stamp"] == 1
    with s.lock() as ours:
        assert ours()
        with pytest.raises(LakeError):
            with s.lock():
                pass


def test_torn_log_and_recovery(spark):
    lines = ['{"op":"header","note":1}', '{"op":"put","path":"a","sha256":"x","passages":2}', '{"op":"put","path":"b","sha256":"y","passages":1}', '{"op":"del","path":"a"}', '{"op":"put","pa', '{"op":"put","path":"c"}']
    log = store.scan_log(spark.createDataFrame(list(enumerate(lines)), "offset int, value string"))
    assert log.count() == 4
    manifest = spark.createDataFrame([("a", "x", 1, 1, False, 2, False, 0, None)], store.TABLES["notes"])
    got = store.recover(manifest, log, 1).collect()
    assert [(r["key"], r["racy"]) for r in got] == [("b", True)]


def test_stream_is_idempotent(spark, tmp_path):
    landing, base = tmp_path / "landing", str(tmp_path / "base")
    landing.mkdir()

    def land(name, rows):
        (landing / name).write_text("\n".join(json.dumps(dict(zip(("op", "key", "text", "version"), r, strict=True))) for r in rows))
        incremental.start(spark, str(landing), base, str(tmp_path / "checkpoint")).awaitTermination()
        return {r["key"]: r["text"] for r in incremental.current(spark, base).collect()}

    assert land("1.json", [("put", "a", "one", 1), ("put", "b", "two", 2)]) == {"a": "one", "b": "two"}
    assert land("2.json", [("del", "a", None, 3), ("put", "b", "old", 1)]) == {"b": "two"}
    assert land("3.json", [("put", "b", "two", 2), ("put", "c", "three", 4)]) == {"b": "two", "c": "three"}


def test_settings_and_guards(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load(path) == config.Config()
    config.save(path, config.Config(min_words=5, exclude=("a",)))
    assert config.load(path).min_words == 5
    assert config.settings_hash(config.Config(drop_fences=("b", "a"))) == config.settings_hash(config.Config(drop_fences=("a", "b"))) != config.settings_hash(config.Config(min_words=9))
    assert config.clamp_count(None) == 8 and config.clamp_count(900) == 50
    with pytest.raises(LakeError):
        config.clamp_count(0)
    with pytest.raises(LakeError):
        config.check_index_outside(str(tmp_path / "n" / "i"), str(tmp_path / "n"))
    assert len(ERRORS) == 20 and as_lake_error(OSError(28, "full")).code == "DISK_FULL" and as_lake_error(ValueError()).code == "INTERNAL"
    assert folder.registry_lookup({"vaults": {"x": {"path": str(tmp_path)}}}, str(tmp_path)) == {"state": "known", "vault": tmp_path.name}


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_registered_query_agrees_with_duckdb(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in catalog.SQL:
        assert rows
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) and v == v else v
    order = sorted(columns)
    assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr) == sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
