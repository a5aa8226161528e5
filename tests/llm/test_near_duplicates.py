"""Near copies that a cut of the near-dedup stage would leave or take wrongly."""

import random

import numpy as np
import pyarrow as pa

from graticule.llm import near_duplicates

from .helpers import documents
from .test_pipeline import jaccard, shingles


def kept(spark, folder):
    return {r.doc_id for r in near_duplicates.deduplicated(spark.read.parquet(f"{folder}/documents.parquet")).collect()}


def test_near_copies_among_texts_of_one_template(spark, tmp_path):
    """Texts at about 0.7 to each other, with near copies planted among them: a hub that is no near copy hides no pair."""
    rnd = random.Random(5)
    fresh = iter(f"w{i}" for i in range(10**6))
    template = [next(fresh) for _ in range(200)]

    def own(n):
        return [next(fresh) for _ in range(n)]

    texts, pairs = [], []
    for i in range(400):
        tail = own(39)
        texts.append(" ".join(template + tail))
        if i % 10 == 0:
            pairs.append(len(texts) - 1)
            texts.append(" ".join(template + tail[:24] + own(15)))
    order = rnd.sample(range(len(texts)), len(texts))
    place = {k: i for i, k in enumerate(order)}
    a, b, c = (shingles(texts[i]) for i in (0, 1, 3))
    assert jaccard(a, b) > 0.85 and 0.65 < jaccard(a, c) < 0.75
    folder = documents(tmp_path, [texts[k] for k in order])
    gone = set(range(len(texts))) - kept(spark, folder)
    expected = {max(place[k], place[k + 1]) for k in pairs}
    print(len(gone & expected), len(expected), len(gone - expected))
    assert not gone - expected and len(gone) >= 0.95 * len(expected)


def test_keys_and_clusters_in_chunks(spark, tmp_path, monkeypatch):
    """A cluster of several chunks is split and loses no pair; a crowded key's chunks lose no link."""
    monkeypatch.setattr(near_duplicates, "ROWS", 16)
    fresh = iter(f"w{i}" for i in range(10**6))
    template = [next(fresh) for _ in range(100)]
    texts = []
    for _ in range(60):
        tail = [next(fresh) for _ in range(16)]
        texts += [" ".join(template + tail), " ".join(template + tail[:12] + [next(fresh) for _ in range(4)])]
    out = kept(spark, documents(tmp_path, texts))
    assert sum(2 * i in out for i in range(60)) == 60 and sum(2 * i + 1 in out for i in range(60)) <= 3


def test_rows_beyond_a_sweep_meet_every_row_before():
    node = np.arange(40000)
    steps = np.zeros((len(node), 2), np.uint64)
    steps[:, 0] = (np.uint64(1) << (node % 64).astype(np.uint64)) - np.uint64(1)  # neighbours are one bit apart, the ends 63
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(node), np.int64)), pa.array(node), *(pa.array(steps[:, i].view(np.int64)) for i in (0, 1))], ["key", "node", "hi", "lo"])
    whole = pa.Table.from_batches(near_duplicates._paired(None)([batch])).to_pydict()
    assert len(whole["u"]) == len(node) - 1 and not any(whole["over"])
    cut = pa.Table.from_batches(near_duplicates._paired(8192)([batch.slice(i, 10000) for i in range(0, 40000, 10000)])).to_pydict()
    assert (cut["u"], cut["v"], cut["over"]) == ([0], [len(node)], [1])


def test_repeated_lines_count_once(spark, tmp_path):
    """Equal bodies with a different line repeated in each: the shingles are mostly the same, their occurrences are not."""
    fresh = iter(f"w{i}" for i in range(10**6))
    texts = []
    for _ in range(20):
        body = " ".join(next(fresh) for _ in range(300))
        for _ in range(2):
            line = " ".join(next(fresh) for _ in range(12))
            texts.append("\n".join([body] + [line] * 60))
    # an endless repetition and the same with another end
    texts += ["the quick brown fox " * 4000, "the quick brown fox " * 4000 + "tail"]
    assert jaccard(shingles(texts[0]), shingles(texts[1])) > 0.85 and jaccard(shingles(texts[-2]), shingles(texts[-1])) == 0.8
    assert kept(spark, documents(tmp_path, texts)) == set(range(0, 42, 2))


def test_long_texts_are_decided_exactly(spark, tmp_path):
    """Pairs of 1,500 words at 0.79 stay, at 0.81 they go, whatever a sample of their shingles says."""
    fresh = iter(f"w{i}" for i in range(10**6))
    texts, near = [], set()
    for i in range(40):
        words = [next(fresh) for _ in range(1500)]
        same = 1320 if i % 2 else 1345
        texts += [" ".join(words), " ".join(words[:same] + [next(fresh) for _ in range(1500 - same)])]
        share = jaccard(shingles(texts[-2]), shingles(texts[-1]))
        assert abs(share - (0.785 if i % 2 else 0.81)) < 0.006, share
        if share >= 0.8:
            near.add(2 * i + 1)
    gone = set(range(80)) - kept(spark, documents(tmp_path, texts))
    print(len(gone & near), len(near), len(gone - near))
    assert gone <= near and len(gone) >= 18


def test_pivots_discard_unrelated_pairs_and_no_near_one():
    """Largest coordinate differences never exceed the bits that differ, and pass few unrelated pairs."""
    random = np.random.default_rng(7)
    a = random.integers(0, 1 << 64, (5000, 2), np.uint64)
    b = a.copy()
    for _ in range(near_duplicates.WIDEST):  # up to so many bits differ
        bit = random.integers(0, 128, len(b))
        b[np.arange(len(b)), bit // 64] ^= np.uint64(1) << (bit % 64).astype(np.uint64)
    table = near_duplicates.pivot_table
    assert (near_duplicates.largest_difference(table(a), table(b)) <= near_duplicates._gap(a, b)).all()
    far = near_duplicates.largest_difference(table(a), table(a[::-1]))
    assert (far <= near_duplicates._gap(a, a[::-1])).all()
    print("unrelated pairs left", (far <= near_duplicates.WIDEST).mean())
    assert (far <= near_duplicates.WIDEST).mean() < 0.05
    assert not (near_duplicates.largest_difference(table(a[:9]), table(a[:9]))).any()
    # the largest difference over references that are written out
    rows = np.packbits(near_duplicates.walsh(8), axis=1).ravel()
    for x, y in zip(a[:20].view(np.uint8).reshape(-1, 16), b[:20].view(np.uint8).reshape(-1, 16), strict=True):
        gaps = [[int(np.bitwise_count(p ^ r)) - int(np.bitwise_count(q ^ r)) for r in [*rows, *~rows]] for p, q in zip(x, y, strict=True)]
        both = [np.array([x]).view(np.uint64), np.array([y]).view(np.uint64)]
        assert near_duplicates.largest_difference(*map(table, both)).tolist() == [sum(map(max, gaps))]


def test_every_bit_link_passes_the_pivots(monkeypatch):
    """Small keys and crowded ones: no pair is linked that the pivots discard."""
    node = np.arange(60)
    key = np.where(node < 10, 1, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(np.zeros(60, np.int64)), pa.array(node)], ["key", "node", "hi", "lo"])
    assert sorted(pa.Table.from_batches(near_duplicates._paired(None)([batch])).to_pydict()["v"]) == [*range(1, 10), *range(11, 60)]
    monkeypatch.setattr(near_duplicates, "largest_difference", lambda a, b: np.full(max(a.shape[1], b.shape[1]), 128))
    assert pa.Table.from_batches(near_duplicates._paired(None)([batch])).num_rows == 0


def test_keys_are_distances_to_partial_references():
    """Equal keys of a table: equal distances to all its partial references, which only equal bits have."""
    near = np.arange(1 << 16, dtype=np.uint16)
    bits = np.unpackbits(near.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    far = (bits[:, None, :] ^ near_duplicates.walsh(16)[None]).sum(axis=2)
    assert len(np.unique(far, axis=0)) == 1 << 16
    random = np.random.default_rng(8)
    hi, lo = (random.integers(-(1 << 63), 1 << 63, 3000) for _ in range(2))
    hi[1500:], lo[1500:] = hi[:1500], lo[:1500]
    lo[1500:] ^= 1 << random.integers(0, 60, 1500)  # one bit apart
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(hi), pa.array(lo)], ["node", "hi", "lo"])
    keys = np.concatenate([b.column(0).to_numpy().reshape(8, 3000) for b in near_duplicates._keyed([batch])])
    assert len(keys) == near_duplicates.TABLES and len(np.unique(keys, axis=0)) == len(keys)
    same = keys[:, :1500] == keys[:, 1500:]
    assert same.any(axis=0).all() and 0.8 < same.mean() < 0.95  # a table sees 16 of 128 bits
