import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graticule.llm import suffix_dedup as sd

from .helpers import DATA, ODD_TEXTS, documents


def brute(ids, texts):
    data = [(t or "").encode() for t in texts]
    where = defaultdict(int)
    for d in data:
        for i in range(len(d) - 199):
            where[hash(d[i : i + 200])] += 1
    out = []
    for i, d in zip(ids, data, strict=True):
        gone = np.zeros(len(d) + 1, np.int64)
        for a in range(len(d) - 199):
            if where[hash(d[a : a + 200])] > 1:
                gone[a] += 1
                gone[a + 200] -= 1
        bad = np.cumsum(gone)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], bad.astype(np.int8)))) == 1)
        rest = np.frombuffer(d, np.uint8)[~bad].tobytes()
        out.append((i, len(d), int(bad.sum()), len(edges), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in sd.op2_suffix_dedup(spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_whole_table_against_brute_force(spark):
    rows = pq.read_table(DATA / "sf0.01/documents.parquet").to_pylist()
    result = got(spark, str(DATA / "sf0.01"))
    assert result == brute([r["doc_id"] for r in rows], [r["text"] for r in rows])
    assert sum(r[2] for r in result) > 0


@pytest.mark.parametrize("crowd", [4096, 3])
def test_planted_passages(spark, tmp_path, crowd, monkeypatch):
    monkeypatch.setattr(sd, "CROWD", crowd)
    rnd = random.Random(4)

    def prose(n):
        return "".join(rnd.choice("abcdefgh é") for _ in range(n))

    shared = [prose(n) for n in (199, 200, 201, 260, 400, 900)]
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 1000]
    for _ in range(60):
        t = prose(rnd.randint(0, 600))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 40)
            t += s[a : len(s) - rnd.randint(0, 40)] + prose(rnd.randint(0, 300))
        texts.append(t)
    texts += [shared[4]] * 12 + [prose(150) + shared[3] + prose(150) for _ in range(20)] + ["ab" * 300, "\x00" * 500, "q" * 200, "z" * 201] + texts[-3:]
    ids = [*range(len(texts) - 3), None, 5, 5]
    folder = documents(tmp_path, texts, ids, row=(1, pa.int64()), kind=("x", pa.string()))
    assert got(spark, folder) == brute(ids, texts)


def test_very_long_and_empty(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    texts = ["x" * 60000, None, "the quick brown fox " * 4000, "y" * 199]
    assert got(spark, documents(tmp_path / "a", texts)) == brute(range(4), texts)
    assert got(spark, documents(tmp_path / "b", [])) == []


def strings_told(entries, spans):
    """(row, place) of every string of entries that spans name."""
    return {(row, at + i) for row, at, n in spans for i in range(n)}


def test_family_of_stored_levels(spark, tmp_path):
    """Batches meet the levels of earlier ones, also after reopening; levels are in suffix order and grow geometrically."""
    rnd = random.Random(9)
    gram = bytes(range(32))
    rights = [bytes(rnd.choice(b"ab") for _ in range(168)) for _ in range(6)]
    lefts = [bytes(rnd.choice(b"ab") for _ in range(168)) for _ in range(6)]
    rows = []
    for row in range(90):
        right = rnd.choice(rights)[: rnd.randint(0, 168)] + bytes(rnd.choice(b"ab") for _ in range(168))
        left = rnd.choice(lefts)[: rnd.randint(0, 168)] + bytes(rnd.choice(b"ab") for _ in range(168))
        rows.append((row, 0, 169, 1, 5, 0, gram + right[:168], left[:168]))
    body = {r[0]: r[7][::-1] + r[6] for r in rows}
    family, told, sizes = None, set(), []
    for i in range(0, 90, 10):
        if i in (0, 50):
            family = sd.Family(spark, f"file://{tmp_path}/index")
        more = family.add(spark.createDataFrame(rows[i : i + 10], sd.ENTRY))
        told |= strings_told(rows, map(tuple, more.collect()))
        sizes.append([n for _, n in family.levels])
        seen = defaultdict(list)
        for row in range(i + 10):
            for at in range(169):
                seen[body[row][at : at + 200]].append((row, at))
        assert told == {x for v in seen.values() if len(v) > 1 for x in v}
    assert told and sizes[-1] == [80, 10] and max(map(len, sizes)) <= 4
    for level in family.levels:
        files = [[(r.crowd, bytes(r.suffix)) for r in spark.read.parquet(str(f)).collect()] for f in (tmp_path / "index" / f"level-{level[0]:06d}-{level[1]}").glob("*.parquet")]
        assert all(f == sorted(f) for f in files) and sum(map(len, files)) == level[1]


def test_pieces_and_equal_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sd, "PASS", 700)
    rnd = random.Random(6)

    def prose(n):
        return "".join(rnd.choice("abcdefgh ") for _ in range(n))

    shared = prose(900)
    texts = [prose(1500) + shared[:600] + prose(2000) + shared[300:] + prose(777), prose(699) + shared, prose(5000)] + [prose(30) + shared[:230] + prose(10)] * 40
    ids = [0, 1, 2, *[3] * 40]
    assert got(spark, documents(tmp_path, texts, ids)) == brute(ids, texts)
