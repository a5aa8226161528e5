"""Small fixtures and brute-force versions for the operators' tests."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

DATA = Path("/root/testdata")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
LONG = "the quick brown fox " * 4000


def write_table(folder: Path, name: str, rows: list[dict], schema: pa.Schema) -> None:
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), folder / f"{name}.parquet")


def documents(folder: Path, texts: list, ids: list | None = None, sources: list | None = None, **clash) -> str:
    """A documents table with these texts; ``clash`` adds columns."""
    ids = ids or list(range(len(texts)))
    sources = sources or ["src0"] * len(texts)
    rows = [{"doc_id": i, "text": t, "lang": None, "source": s, "n_chars": None} | {k: v[0] for k, v in clash.items()} for i, t, s in zip(ids, texts, sources, strict=True)]
    schema = SCHEMA
    for k, (_, kind) in clash.items():
        schema = schema.append(pa.field(k, kind))
    write_table(folder, "documents", rows, schema)
    return str(folder)


def duck(folder: str, sql: str, names: tuple[str, ...]) -> list[tuple]:
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con.execute(sql).fetchall()


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


ODD_TEXTS = [None, "", " \n\t", "one", "ONE", "one two three", "one two three four five six", "one two three four five six", "caf\u00e9 \u00e9t\u00e9 \u4e2d\u6587 a\u0301", LONG, LONG + "tail", "x" * 50000]
