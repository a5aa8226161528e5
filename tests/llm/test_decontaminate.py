import hashlib
import random

import pyarrow as pa
import pytest

from graticule.llm import decontaminate as dec

from .helpers import DATA, ODD_TEXTS, documents, duck, write_table

BENCH = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def brute(texts, items):
    out = []
    for i, t in texts:
        w, hit, found = dec.words_of((t or "").encode()), set(), set()
        for item, text in items:
            p = dec.words_of((text or "").encode())
            n = min(10, len(p))
            for k in range(len(p) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[k : k + n]:
                        hit |= set(range(j, j + n))
                        found |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in dec.op4_decontaminate(spark, folder).select(COLUMNS).collect()), key=str)


def test_whole_table_against_sql(spark):
    folder = str(DATA / "sf0.01")
    rows = got(spark, folder)
    assert rows == sorted(duck(folder, f"SELECT {','.join(COLUMNS)} FROM ({dec.OP4_SQL})", ("documents", "benchmark")), key=str)
    assert any(r[5] for r in rows) and not all(r[5] for r in rows)


@pytest.mark.parametrize("most", [100_000, 15])
def test_odd_rows(spark, tmp_path, most, monkeypatch):
    monkeypatch.setattr(dec, "SLICE", most)
    rnd = random.Random(5)
    texts = [*[t for t in ODD_TEXTS if t is None or len(t) < 1000], *[" ".join(rnd.choice("ab cd EF".split()) for _ in range(rnd.randint(0, 60))) for _ in range(40)]]
    items = [(1, "ab cd ab cd ab ef ef ab cd ab cd ef"), (2, "Ef-ef"), (3, None), (4, ""), (None, "one two three"), (10, "ab ab ab ab"), (1, "cd"), (5, "ab cd ab cd ab ef ef ab cd ab cd ef"), (11, "caf\u00e9 \u00e9t\u00e9")]
    folder = documents(tmp_path, texts, k0=(1, pa.int32()), items=("x", pa.string()))
    write_table(tmp_path, "benchmark", [{"item_id": i, "text": t} for i, t in items], BENCH)
    assert got(spark, folder) == brute(list(enumerate(texts)), items)


def test_empty_tables(spark, tmp_path):
    for n, (texts, items) in enumerate([([], [(1, "a b")]), (["a b"], [])]):
        (tmp_path / str(n)).mkdir()
        folder = documents(tmp_path / str(n), texts)
        write_table(tmp_path / str(n), "benchmark", [{"item_id": i, "text": t} for i, t in items], BENCH)
        assert got(spark, folder) == brute(list(enumerate(texts)), items)
