import math

import pyarrow as pa
import pytest

from graticule.llm import mixing

from .helpers import DATA, ODD_TEXTS, documents, duck

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def rows_of(spark, folder):
    return sorted((tuple(r) for r in mixing.op6_mixing(spark, folder).select(COLUMNS).collect()), key=str)


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:3] == y[:3] and x[4] == y[4] and math.isclose(x[3], y[3], rel_tol=1e-12)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    folder = str(DATA / sf)
    same(rows_of(spark, folder), sorted(duck(folder, f"SELECT {','.join(COLUMNS)} FROM ({mixing.OP6_SQL})", ("documents",)), key=str))


def test_targets_and_closeness(spark):
    folder = str(DATA / "sf0.01")
    df = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).toPandas()
    total = df["size"].sum()
    per = df.groupby("source", dropna=False).agg(s=("size", "sum"), t=("target", "first"), k=("taken", "sum"), big=("size", "max"))
    assert abs(per.t.sum() - 1.5 * total) < 1e-6 * total
    assert (per.t <= 2 * per.s + 1e-9).all()
    assert ((per.k - per.t).abs() <= per.big).all()
    assert (df.taken <= 2 * df["size"]).all()
    # uncapped sources share one level by weight
    w = dict(zip(sorted(per.index), [3, 1, 2] * 10, strict=False))
    levels = {round(per.t[s] / w[s], 6) for s in per.index if per.t[s] < 2 * per.s[s] - 1e-6}
    assert len(levels) == 1
    assert rows_of(spark, folder) == rows_of(spark, folder)


def test_odd_rows(spark, tmp_path):
    texts = [*ODD_TEXTS, *ODD_TEXTS]
    sources = (["b", None, "a", "B", "", "b"] * 4)[: len(texts)]
    ids = [*range(len(texts) - 2), None, 3]
    folder = documents(tmp_path, texts, ids, sources, size=(1, pa.int64()), target=("x", pa.string()))
    same(rows_of(spark, folder), sorted(duck(folder, f"SELECT {','.join(COLUMNS)} FROM ({mixing.OP6_SQL})", ("documents",)), key=str))


def test_no_words_and_empty(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert [r[3:] for r in rows_of(spark, documents(tmp_path / "a", ["", None]))] == [(0.0, 0), (0.0, 0)]
    assert rows_of(spark, documents(tmp_path / "b", [])) == []
