import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from graticule.llm import ann

from .helpers import DATA, write_table

SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("block", pa.int64())])


def brute(rows, k=20):
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            scores = sorted({(-float((np.array(q, np.float32).astype(float) * np.array(v, np.float32).astype(float)).sum()), j) for j, v in rows if j != i and len(v) == len(q)})
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def got(spark, folder):
    df = ann.op7_ann(spark, folder)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def recall(found, true):
    assert {q for q, v in true.items() if v} == set(found)
    hits = total = 0
    for q, best in true.items():
        exact = dict(best)
        for i, s in found.get(q, []):
            if i in exact:
                assert math.isclose(s, exact[i], rel_tol=1e-12, abs_tol=1e-12)
        hits += len({i for i, _ in best} & {i for i, _ in found.get(q, [])})
        total += len(best)
        order = [(-s, i) for i, s in found.get(q, [])]
        assert order == sorted(order) and q not in {i for i, _ in found.get(q, [])}
    return hits / total


def test_recall(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = pq.read_table(DATA / sf / "embeddings.parquet").to_pylist()
        r = recall(got(spark, str(DATA / sf)), brute([(x["vec_id"], x["embedding"]) for x in rows]))
        print(sf, r)
        assert r >= 0.9


def test_blocks_norms_and_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    random = np.random.default_rng(1)
    rows = [(i, (random.normal(size=8) * random.uniform(0.01, 100)).astype(np.float32).tolist()) for i in range(300)]
    hot = random.normal(size=8).astype(np.float32).tolist()
    rows += [(i, hot) for i in range(300, 400)]
    rows += [(400, None), (420, []), (440, [0.0] * 8), (460, [float("nan")] + [1.0] * 7), (480, [None] + [1.0] * 7), (500, [float("inf")] * 8), (None, hot), (520, [1.0, 2.0]), (521, [2.0, 1.0]), (540, [1.0] * 3), (20, rows[20][1]), (340, hot)]
    write_table(tmp_path, "embeddings", [{"vec_id": i, "embedding": v, "label": None, "block": 1} for i, v in rows], SCHEMA)
    true, found = brute(rows), got(spark, str(tmp_path))
    assert recall(found, true) >= 0.95
    assert found[320] == true[320] or [i for i, _ in found[320]] == [i for i, _ in true[320]]
    assert found[520] == [(521, 4.0)] and 540 not in found


def test_empty(spark, tmp_path):
    write_table(tmp_path, "embeddings", [], SCHEMA)
    assert got(spark, str(tmp_path)) == {}


def test_recall_of_a_full_block():
    """A block of its full size: recall, and the share of its rows that is verified."""
    random = np.random.default_rng(3)
    centres = random.normal(size=(400, 64))
    vectors = (centres[random.integers(0, 400, ann.BLOCK)] + 0.7 * random.normal(size=(ann.BLOCK, 64))).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.arange(ann.BLOCK)
    index = ann.Index(ids, vectors)
    query, found, _ = index.nearest(ids[:64], vectors[:64], 20)
    scores = vectors[:64].astype(float) @ vectors.T.astype(float)
    scores[ids[:64], ids[:64]] = -np.inf
    true = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    r = np.mean([len(set(found[query == i]) & set(true[i])) / 20 for i in range(64)])
    share = index.verified / 64 / ann.BLOCK
    print("full block", r, "verified", share)
    assert r >= 0.95 and share < 0.25


def test_windows_hold_what_a_scan_of_the_lines_finds():
    random = np.random.default_rng(4)
    vectors = random.normal(size=(3000, 16))
    index = ann.Index(np.arange(3000), vectors)
    values = index.tall @ index.lines
    for half in (0.05, 0.4, 1.5, 9.0):
        at = values[17]
        low = np.array([np.searchsorted(index.values[j], at[j] - half, "left") for j in range(ann.LINES)])
        high = np.array([np.searchsorted(index.values[j], at[j] + half, "right") for j in range(ann.LINES)])
        kind = index.places[0].dtype
        want = np.flatnonzero((np.abs(values - at) <= half).sum(axis=1) >= ann.NEED)
        assert index.candidates(low.astype(kind), (high - low).astype(kind)).tolist() == want.tolist()


def test_doubles_and_ids_with_several_vectors(spark, tmp_path):
    """Scores of doubles are those of the doubles; an id with several vectors counts with its best product."""
    random = np.random.default_rng(6)
    rows = [(i, random.normal(size=6).tolist()) for i in range(100)] + [(20, random.normal(size=6).tolist()), (7, random.normal(size=6).tolist()), (None, [1.0] * 6)]
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    write_table(tmp_path, "embeddings", [{"vec_id": i, "embedding": v} for i, v in rows], schema)
    found = got(spark, str(tmp_path))
    assert set(found) == {0, 20, 40, 60, 80}
    for q, best in found.items():
        assert len({i for i, _ in best}) == len(best) == 20
        for i, score in best:
            want = max(float(np.dot(a, b)) for x, a in rows if x == q for y, b in rows if y == i)
            assert math.isclose(score, want, rel_tol=1e-12, abs_tol=1e-12)
