"""SimHash groups against brute force."""

import random

import numpy as np
import pytest
import xxhash

from waybill.llm import simhash
from waybill.llm.queries import QUERIES


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    """Smallest position reachable from each."""
    prints = np.array(prints, np.uint64)
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query(spark, small_dir, rows):
    rows = rows.sort_values("doc_id")
    prints = [slow_print(t) for t in rows.text]
    ids = rows.doc_id.tolist()
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, components(prints, 2))}
    got = QUERIES["op10_simhash"](spark, small_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want and len(got) == len(want)


def planted(n, seed):
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):  # chains and balls of near ones, also far along a chain
        p = rng.choice(prints)
        for _ in range(rng.randrange(1, 3)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    centre = rng.getrandbits(64)
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(0, 40, 3) for b in range(41, 64, 2)]
    return sorted(set(prints))


@pytest.mark.parametrize("max_shard, radius", [(4096, 2), (3, 2), (5, 3)])
def test_links_lose_nothing(spark, max_shard, radius):
    prints = planted(300, max_shard + radius)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5)
    stars = simhash.groups(simhash.fingerprint_links(distinct, radius, max_shard)).collect()
    root = {r["a"]: r["b"] for r in stars}
    got = [root.get(p, p) for p in signed]
    want = components(prints, radius)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_bk_forest_finds_all_pairs():
    prints = np.array(planted(200, 1), np.uint64)
    shard = np.sort(np.arange(len(prints)) % 3)
    forest = simhash.Forest(shard, prints)
    q, node = forest.near(np.arange(len(prints)), 2)
    near = (np.bitwise_count(prints[:, None] ^ prints) <= 2) & (shard[:, None] == shard) & ~np.eye(len(prints), dtype=bool)
    assert sorted(zip(q.tolist(), node.tolist())) == sorted(zip(*map(lambda x: x.tolist(), np.nonzero(near))))
    depth = np.bitwise_count(prints[forest.key // 65] ^ prints[forest.child])
    assert (depth == forest.key % 65).all()  # each child sits under its distance


def test_batches_cut_between_shards():
    prints = np.array(planted(150, 4), np.uint64)
    import pyarrow as pa

    shard = np.sort(np.arange(len(prints)) % 40)
    table = pa.table({"shard": shard, "fp": prints.view(np.int64)})
    for size, held in ((7, 1), (50, 20), (10_000, 10)):
        out = [r for b in simhash._link_batches(iter(table.to_batches(max_chunksize=size)), 2, held) for r in b.to_pylist()]
        whole = simhash.star_links(shard, prints, 2)
        assert {(r["fp"], r["to"]) for r in out} == set(zip(whole[0].view(np.int64).tolist(), whole[1].view(np.int64).tolist()))


def test_edges(edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by_id = {r["id"]: r for r in got}
    assert by_id[1]["component"] == by_id[2]["component"] == 1
    assert by_id[4]["fp"] == by_id[5]["fp"] == by_id[6]["fp"] == 0 and by_id[6]["component"] == 4
    assert by_id[None]["component"] is None
    kept = simhash.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=lambda i: i or 0) == [None, 1, 3, 4, 7, 8, 9, 10, 11]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.deduplicate(no_docs).count() == 0
