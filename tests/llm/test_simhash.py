import random

import numpy as np
import pytest
import xxhash

from graticule.llm import simhash
from graticule.llm.common import join_groups

from .helpers import DATA, ODD_TEXTS, documents, words


def brute_fingerprint(text, k=4):
    w = words(text)
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, distance):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bits = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= distance):
            parent[top(i)] = top(int(j))
    low = {}
    for i, d in enumerate(ids):
        r = top(i)
        if d is not None:
            low[r] = min(d, low.get(r, d))
    return [low.get(top(i)) for i in range(len(ids))]


def expected(ids, texts):
    fps = [brute_fingerprint(t) for t in texts]
    return sorted(zip(ids, (f"{f:016x}" for f in fps), brute_components(ids, fps, 4), strict=True), key=str)


def got(spark, folder):
    df = simhash.op1_simhash(spark, folder)
    assert df.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    return sorted((tuple(r)[:3] for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table(DATA / "sf0.01/documents.parquet").to_pylist()
    assert got(spark, str(DATA / "sf0.01")) == expected([r["doc_id"] for r in rows], [r["text"] for r in rows])


def test_odd_rows(spark, tmp_path):
    import pyarrow as pa

    texts = [*ODD_TEXTS, "one two three four five six"]
    ids = [*range(len(ODD_TEXTS)), None]
    folder = documents(tmp_path, texts, ids, key=("k", pa.string()), fp=(1, pa.int64()))
    assert got(spark, folder) == expected(ids, texts)


def test_empty_table(spark, tmp_path):
    assert got(spark, documents(tmp_path, [])) == []


@pytest.mark.parametrize("most", [16384, 40])
def test_dense_groups(spark, most, monkeypatch):
    """Chains, near copies and random fingerprints, also where keys are cut into chunks."""
    monkeypatch.setattr(simhash, "MOST", most)
    random = np.random.default_rng(3)
    base = random.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    hub = int(base[0])
    for _ in range(500):
        x = hub
        for b in random.choice(64, random.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    x = int(base[1])
    for b in range(0, 40, 4):
        x ^= 0b1111 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in simhash.components(prints, 4).collect()}
    assert [found[i] for i in range(len(fps))] == brute_components(list(range(len(fps))), fps, 4)


def test_segments_leave_two_in_agreement():
    masks = simhash.segments(4)
    assert len(masks) == 15
    for seed in range(200):
        random = np.random.default_rng(seed)
        diff = sum(1 << int(b) for b in random.choice(64, 4, replace=False))
        assert any(not diff & m for m in masks)


def test_references_are_walsh_rows():
    r = simhash.references()
    gaps = np.bitwise_count(r[:, None] ^ r[None, :])
    assert set(gaps[~np.eye(64, dtype=bool)].tolist()) == {32}


def test_pivot_keys_find_every_close_pair(spark):
    """Pairs within four bits share a key of partial distances; of random pairs few do."""
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(300)]
    near = [x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for x in base]
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(base + near)]
    keys = {r.i: set(r["keys"]) for r in spark.createDataFrame(rows, "i int, fp long").select("i", simhash.pivot_keys(4).alias("keys")).collect()}
    assert all(keys[i] & keys[i + 300] for i in range(300))
    assert sum(bool(keys[i] & keys[j]) for i in range(300) for j in range(i)) <= 5


def test_common_keys_are_dealt_out(spark):
    big = spark.createDataFrame([(i % 7 if i % 3 else None, i) for i in range(4000)], "k int, v int")
    small = spark.createDataFrame([(k, 400 if k < 5 else 1, k * 10) for k in range(6)], "k int, n int, w int")
    for how in ("inner", "left"):
        want = sorted(map(tuple, big.join(small.drop("n"), "k", how).collect()), key=str)
        assert sorted(map(tuple, join_groups(big, small, "k", "n", how).select("k", "v", "w").collect()), key=str) == want
