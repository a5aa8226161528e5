import pyarrow as pa
import pytest

from graticule.llm import license_scan as ls

from .helpers import DATA, ODD_TEXTS, documents, duck

COLUMNS = ["doc_id", "path", "license", "score", "origin"]


def rows_of(spark, folder):
    return sorted((tuple(r) for r in ls.op3_license_scan(spark, folder).select(COLUMNS).collect()), key=str)


def sql_rows(folder):
    return sorted(duck(folder, f"SELECT {','.join(COLUMNS)} FROM ({ls.OP3_SQL})", ("documents",)), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_against_sql(spark, sf):
    folder = str(DATA / sf)
    rows = rows_of(spark, folder)
    assert rows == sql_rows(folder)
    assert any(r[4] == "own" for r in rows)


def test_inheritance_and_odd_rows(spark, tmp_path):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    texts = [*ODD_TEXTS, "short " * 20 + "\n" + mit, "prose " * 100, "prose " * 100 + "\n" + gpl, "a\n" + gpl, "b\n" + gpl.upper() + "\n" + mit, "All rights", "the license of the king is under the work"]
    sources = ["s0"] * (len(texts) - 3) + ["s1", None, "s0"]
    ids = [*range(len(texts) - 1), None]
    folder = documents(tmp_path, texts, ids, sources, path=("p", pa.string()), license=("x", pa.string()))
    rows = rows_of(spark, folder)
    assert rows == sql_rows(folder)
    by = {r[0]: r for r in rows}
    n = len(ODD_TEXTS)
    assert by[n][2] == "mit" and by[n + 2][2:] == ("gpl-3.0", 1.0, "own")
    assert by[n + 1][2] == "mit" or by[n + 1][4] == "s0"


def test_nearest_ancestor(spark):
    rows = [("a/LICENSE", True, "mit", 0.9), ("a/COPYING", True, "gpl-3.0", 1.0), ("a/b/LICENSE", True, "bsd-3-clause", 0.7), ("a/b/c/d/x.py", False, None, None), ("a/c/y.py", False, None, None), ("ab/z.py", False, None, None), (None, True, "mit", 1.0), ("top.py", False, None, None)]
    files = spark.createDataFrame(rows, "path string, is_license_file boolean, license string, score double")
    out = {r.folder: (r.license, r.origin) for r in ls.inherited(files).collect()}
    assert out == {"a": ("gpl-3.0", "a"), "a/b": ("bsd-3-clause", "a/b"), "a/b/c/d": ("bsd-3-clause", "a/b"), "a/c": ("gpl-3.0", "a")}
    root = spark.createDataFrame([*rows, ("LICENSE", True, "mit", 1.0)], files.schema)
    assert {r.folder: r.license for r in ls.inherited(root).collect()}["ab"] == "mit"


def test_empty(spark, tmp_path):
    assert rows_of(spark, documents(tmp_path, [])) == []
