"""The shared parts: components, cells, running sums, archives."""

import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from passagelake.llm import cells, components, ranking, simhash, warc


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(r.randrange(5000, 5200), r.randrange(5000, 5200)) for _ in range(150)] + [(7, 7)]
    r.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components.connected(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in root if x in got} and {x for a, b in edges if a != b for x in (a, b)} == set(got)
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size", [3, 1000])
def test_every_pair_of_a_bucket_meets_once(spark, size):
    rows = spark.range(40).select(F.col("id"), (F.col("id") % 3).alias("k"))
    dealt = cells.deal(rows, ["k"], F.col("id"), size)
    groups = {}
    for x in dealt.collect():
        groups.setdefault((x["k"], x["low"], x["high"]), []).append((x["id"], x["block"]))
    met = [frozenset((a, b)) for (_, low, high), m in groups.items() for i, (a, x) in enumerate(m) for b, y in m[i + 1 :] if low == high or x != y]
    assert len(met) == len(set(met)) == sum(n * (n - 1) // 2 for n in (14, 13, 13))


def test_running_sums_by_group_and_over_all(spark):
    rows = [(i, None if i % 4 == 0 else f"g{i % 2}", i * 7 % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(5)
    got = {x["id"]: x["before"] for x in ranking.running_sums(df, [F.col("id")], "v", "g").collect()}
    sums = {}
    for i, g, v in rows:
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    ranks = {x["v"]: x["rank"] for x in ranking.dense_rank(df, ["v"]).collect()}
    assert ranks == {v: i for i, v in enumerate(sorted({v for _, _, v in rows}))}


def test_simhash_finds_all_links_in_dense_groups(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for _ in range(400)} | {int(x) for x in rng.integers(0, 1 << 63, 400)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {x["node"]: x["component"] for x in components.connected(simhash.links(df, cell=50)).collect()}
    label = {x: x for x in signed}

    def find(x):
        return x if label[x] == x else find(label[x])

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    assert all(found.get(x, x) == find(x) for x in signed)


def test_normaliser_rewrites_each_record_as_a_member():
    class Kept(io.BytesIO):
        def close(self):
            pass

    records = [warc.head(i, f"http://x/{i}", "response", None, f"{i:064x}", 3000 * i) + b"\r\n\r\nWARC/1.1" * (300 * i) + b"\r\n\r\n" for i in range(5)]
    records = [warc.head(i, f"http://x/{i}", "response", None, f"{i:064x}", 3600 * i) + b"\r\n\r\nWARC/1.1" * (300 * i) + b"\r\n\r\n" for i in range(5)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = z.compress(b"".join(records)) + z.flush()
    out, index = Kept(), Kept()
    assert warc.normalise(io.BytesIO(raw), out, index) == 5
    import json

    for line, record in zip(index.getvalue().splitlines(), records, strict=True):
        at = json.loads(line)
        assert zlib.decompress(out.getvalue()[at["offset"] : at["offset"] + at["length"]], 31) == record
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(z_cut(records[1][:-40])), Kept(), Kept())


def z_cut(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def test_bit_map_holds_all_ids_and_few_others(spark):
    from passagelake.llm.common import BitMap

    ids = spark.range(1000).selectExpr("xxhash64(id) AS id")
    marks = BitMap.of(ids, "id")
    assert all(r["id"] in marks for r in ids.collect())
    others = spark.range(1000, 101_000).selectExpr("xxhash64(id) AS id")
    assert others.filter(marks.holds(others["id"])).count() < 100 and ids.filter(marks.holds(ids["id"])).count() == 1000
    assert 5 not in BitMap.of(ids.limit(0), "id")


def test_rows_that_share_a_bit_with_a_revisit_are_still_responses(spark, monkeypatch):
    from passagelake.llm import common, warc

    monkeypatch.setattr(common.BitMap, "BITS", 8)
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{'x' * 200}{i % 300}</p>") for i in range(400)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive(pages, with_payload=True).collect()}
    assert len(got) == 400
    for i, r in got.items():
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i < 300 else ("revisit", i - 300))
        assert r["payload"] == (f"<p>{'x' * 200}{i % 300}</p>".encode() if i < 300 else b"")
