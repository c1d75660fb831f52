"""The pipeline's near-duplicate stage against all pairs."""

import numpy as np

import corpus_pipeline


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_links_all_of_similarity_four_fifths(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts.append(" ".join(w))
        for changes in (1, 2, 3, 4, 5, 6, 7, 8):
            v = list(w)
            for at in rng.choice(200, changes, replace=False):
                v[at] = "other"
            texts.append(" ".join(v))
    texts += ["", "few words", "few words", "few other words"]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()}
    assert got == {find(i) for i in range(len(texts))}


def test_edited_copies_of_one_text_are_joined_inside_small_blocks(spark):
    """Copies that share most buckets, of which few pairs are similar enough: blocks of any size give the same groups."""
    from passagelake.llm import nearcopies
    from passagelake.llm.common import prepare

    prepare(spark)
    rng = np.random.default_rng(5)
    base = [np.int64(x) for x in rng.integers(-(1 << 60), 1 << 60, 100)]
    sets = []
    for i in range(60):
        kept = rng.choice(100, 88, replace=False)
        sets.append(sorted(int(base[j]) for j in kept) + [i * 1000 + j for j in range(i % 9)])
    rows = [(0, 7, i, len(s), i // 2 * 2 if i < 10 else i, s) for i, s in enumerate(sets)]
    placed = spark.createDataFrame(rows, "band int, value long, fp long, n long, component long, set array<long>")
    root = [r[4] for r in rows]

    def groups(edges):
        label = list(root)
        for a, b in edges:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    true = [(a, b) for a in range(60) for b in range(a) if 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))]
    assert 0 < len(true) < 60 * 59 // 2
    expected = groups(true)
    for cell, hashes in ((4096, 1 << 21), (7, 1 << 21), (4096, 500)):
        got = [(r["a"], r["b"]) for r in nearcopies.joining(placed, cell, hashes).collect()]
        assert {(max(p), min(p)) for p in got} <= set(true)
        assert groups(got) == expected


def test_pipeline_links_all_that_simhash_links(spark):
    """Texts of many equal shingles differ in few bits, while their sets, which hold those once, are not similar."""
    from passagelake.llm import simhash

    rng = np.random.default_rng(9)
    texts = []
    for _ in range(4):
        said = " ".join(f"w{x}" for x in rng.integers(0, 5000, 5))
        texts += [" ".join([said] * 150 + [f"w{x}" for x in rng.integers(0, 5000, 12)]) for _ in range(3)]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for _ in range(4)]
    bits = [simhash.fingerprint(t.encode()) & (1 << 64) - 1 for t in texts]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            assert 5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b])
            if (bits[a] ^ bits[b]).bit_count() <= 4:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert set(root) == {0, 3, 6, 9, 12, 13, 14, 15}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()}
    assert got == set(root)
