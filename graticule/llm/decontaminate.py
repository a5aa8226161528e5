"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ten consecutive words of every benchmark item; an item of fewer words is one shorter pattern.
Patterns of one length form a searcher.  Its symbols are words and its blocks are two words (one, for one-word patterns):

* the shift table gives, for each block that occurs in a pattern, the least distance of its end to a pattern's end; any
  other block lets the search skip ``length - block + 1`` words;
* a block with shift zero selects a bucket by suffix; a bucket's patterns are told apart by the hash of their first word;
* the words themselves are compared before an occurrence counts.

A benchmark is sent to the tasks in slices of at most ``SLICE`` patterns, each slice a pass over the documents' words whose
hits are merged; so what a task holds is bounded whatever the benchmark's size.  For the usual benchmark that is one slice
in one pass over the documents.

Null and empty texts have no words.  Items without words never occur.  Items with a null id mark words as hit but are not
counted or listed; equal ids count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN_WORD, arrow_rows, cut, table

WIDTH = 10
#: Patterns per slice: about 50 MB in a worker.
SLICE = 100_000


def words_of(text: bytes | None) -> list[bytes]:
    return PLAIN_WORD.findall(text.lower()) if text else []


class Searcher:
    """Wu-Manber over the word patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[bytes | tuple, int] = {}
        self.buckets: dict[bytes | tuple, dict[int, list[tuple[list[bytes], set]]]] = {}

    def _block(self, words: list[bytes], end: int) -> bytes | tuple:
        return (words[end - 1], words[end]) if self.block == 2 else words[end]

    def add(self, pattern: list[bytes], item: object) -> None:
        for end in range(self.block - 1, self.length):
            block = self._block(pattern, end)
            self.shift[block] = min(self.shift.get(block, self.skip), self.length - 1 - end)
        bucket = self.buckets.setdefault(self._block(pattern, self.length - 1), {}).setdefault(hash(pattern[0]), [])
        for known, items in bucket:
            if known == pattern:
                items.add(item)
                return
        bucket.append((pattern, {item}))

    def search(self, words: list[bytes], hits: list[int], items: set) -> None:
        """Adds the start of every occurrence to ``hits`` and its items to ``items``."""
        shift, skip, lead = self.shift.get, self.skip, self.length - self.block
        two, at, last = self.block == 2, lead, len(words) - self.block
        while at <= last:  # a block starts at `at`
            block = (words[at], words[at + 1]) if two else words[at]
            step = shift(block, skip)
            if step:
                at += step
                continue
            start = at - lead
            for pattern, owners in self.buckets.get(block, {}).get(hash(words[start]), ()):
                if words[start : start + self.length] == pattern:
                    hits.append(start)
                    items |= owners
            at += 1


class Search:
    """Searchers for all pattern lengths of a set of items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int = WIDTH):
        self.searchers: dict[int, Searcher] = {}
        for item, words in items:
            n = min(width, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                self.searchers.setdefault(n, Searcher(n)).add(words[i : i + n], item)

    def run(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """A flag for each word that lies in an occurrence, and the items that occur."""
        cover, items = np.zeros(len(words) + 1, np.int64), set()
        for length, searcher in self.searchers.items():
            if len(words) >= length:
                hits: list[int] = []
                searcher.search(words, hits, items)
                np.add.at(cover, np.array(hits, np.int64), 1)
                np.add.at(cover, np.array(hits, np.int64) + length, -1)
        return np.cumsum(cover)[:-1] > 0, items


def _searched(items: list[tuple[object, list[bytes]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items)
        for batch in batches:
            counts, marked, flags, found = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_buffer().to_pybytes() if text.is_valid else None)
                hit, ids = search.run(words)
                counts.append(len(words))
                marked.append(int(hit.sum()))
                flags.append(np.packbits(hit).tobytes() if hit.any() else b"")
                found.append(sorted(str(i) for i in ids if i is not None))
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), pa.array(marked, pa.int64()), pa.array(flags, pa.binary()), pa.array(found, pa.list_(pa.string()))], [*batch.schema.names[:-1], "n_words", "n_hit", "hit_bits", "items"])

    return run


def slices(benchmark: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their words, fetched one at a time in groups of at most ``SLICE`` patterns (a longer item stands alone)."""
    part, size, any_ = [], 0, False
    for r in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(r.text.encode() if r.text else None)
        if part and size + len(words) > SLICE:
            yield part
            part, size = [], 0
        any_ = True
        part.append((r.item_id, words))
        size += len(words)
    if part or not any_:
        yield part


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``docs(*keep, text)`` -> keep, n_words, n_hit, hit_bits (packed flags, empty if none), items (ids as sorted strings)."""
    arrow_rows(docs.sparkSession, 500)
    names = [f"k{i}" for i in range(len(keep))]
    merged = None
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    row = first = None
    for part in slices(benchmark):
        if merged is not None and row is None:  # a second slice: rows need a name of their own, so they are written once
            source = cut(source.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
            row = "row"
            merged = source.select("row", *names, "text").mapInArrow(_searched(first), f"row long, {schema}, n_words long, n_hit long, hit_bits binary, items array<string>")
        if merged is None:
            first = part
            merged = source.mapInArrow(_searched(part), f"{schema}, n_words long, n_hit long, hit_bits binary, items array<string>")
        else:
            more = source.select("row", "text").mapInArrow(_searched(part), "row long, n_words long, n_hit long, hit_bits binary, items array<string>")
            more = more.select("row", F.col("hit_bits").alias("bits2"), F.col("items").alias("items2"))
            merged = merged.join(more, "row").withColumn("hit_bits", _or_bits("hit_bits", "bits2"))
            merged = merged.select("row", *names, "n_words", n_bits("hit_bits").alias("n_hit"), "hit_bits", F.array_sort(F.array_union("items", "items2")).alias("items"))
    return merged.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "n_words", "n_hit", "hit_bits", "items")


def _or_bits(a: str, b: str):
    @F.pandas_udf("binary")
    def both(x, y):
        import pandas as pd

        return pd.Series([p or q if not p or not q else (np.frombuffer(p, np.uint8) | np.frombuffer(q, np.uint8)).tobytes() for p, q in zip(x, y, strict=True)])

    return both(a, b)


def n_bits(bits: str):
    """Set bits of a binary column."""

    @F.pandas_udf("long")
    def count(x):
        import pandas as pd

        return pd.Series([int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) for b in x])

    return count(bits)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pats AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM pats),
wins AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT wins.r, wins.i, wins.n, pats.item_id FROM wins JOIN pats ON wins.n = pats.n AND wins.p = pats.p),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS k FROM occ) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
