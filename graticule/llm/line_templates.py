"""Line dedup with a log-template tree of fixed depth.

A line's tokens are its white-space-separated words; tokens with a digit are variable from the start and become ``<*>``.
The tree has three levels: the number of tokens, the first token, the second token.  A leaf holds templates.  A line joins
the leaf's template with which it has the largest share of equal tokens, if that is ``ALIKE`` or more (the earliest of equal
ones), and every token in which they differ becomes ``<*>`` in it; else it starts a template.  Lines come in the order of
their hashes, so results don't depend on partitions.

A template that occurs in ``DOCUMENTS`` documents or more recurs, and all its lines are dropped everywhere.

Lines are reduced to distinct masked lines with counts before they move, and a leaf's lines stream through one task that
holds the leaf's templates only.  Blank lines are kept.  Null texts are empty.  Rows equal in id and text are one document
in counts, and are each returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, cut, join_groups, table

DOCUMENTS, ALIKE, WILD = 10, 0.6, "<*>"
_DIGIT = re.compile(r"\d")


def masked(line: str) -> list[str]:
    tokens = line.split()
    return [WILD if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def line_hash(tokens: list[str]) -> int:
    return _hash(" ".join(tokens))


def leaf_hash(tokens: list[str]) -> int:
    return _hash(f"{len(tokens)} {' '.join(tokens[:2])}")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) -> distinct masked lines of the batch: (leaf, line, n, text)."""
    for batch in batches:
        counts: dict[str, int] = {}
        for text in dict(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)).values():
            for line in {" ".join(masked(x)) for x in (text or "").split("\n")} - {""}:
                counts[line] = counts.get(line, 0) + 1
        tokens = [k.split(" ") for k in counts]
        yield pa.RecordBatch.from_arrays([pa.array([leaf_hash(t) for t in tokens], pa.int64()), pa.array([_hash(k) for k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64()), pa.array(list(counts), pa.string())], ["leaf", "line", "n", "text"])


class Leaf:
    """Templates of one leaf as rows of token hashes; 0 is the wildcard."""

    def __init__(self):
        self.templates = np.zeros((0, 0), np.uint64)
        self.used = 0
        self.support: list[int] = []
        self.lines: list[list[tuple[int, int]]] = []  # with the documents of each

    def add(self, line: int, n: int, text: str) -> None:
        tokens = np.array([0 if t == WILD else xxhash.xxh3_64_intdigest(t) | 1 for t in text.split(" ")], np.uint64)
        if self.used:
            equal = (self.templates[: self.used] == tokens) & (tokens != 0)
            share = equal.sum(axis=1) / len(tokens)
            best = int(share.argmax())
            same = bool((self.templates[best] == tokens).all())
            if share[best] >= ALIKE or same:
                self.templates[best][self.templates[best] != tokens] = 0
                self.support[best] += n
                self.lines[best].append((line, n))
                return
        if self.used == len(self.templates):
            grown = np.zeros((max(4, 2 * self.used), len(tokens)), np.uint64)
            if self.used:
                grown[: self.used] = self.templates
            self.templates = grown
        self.templates[self.used] = tokens
        self.used += 1
        self.support.append(n)
        self.lines.append([(line, n)])

    def recurring(self) -> Iterator[tuple[int, int, int]]:
        """(line, template, n) of templates that may recur; a template is named by its first line."""
        for support, lines in zip(self.support, self.lines, strict=True):
            if support >= DOCUMENTS:
                yield from ((x, lines[0][0], n) for x, n in lines)


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (leaf, line) -> (line, template, n)."""
    leaf, at = Leaf(), None
    line = text = None
    count = 0

    def told(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["line", "template", "n"])

    for batch in batches:
        leaves, lines, ns = (batch.column(i).to_numpy() for i in range(3))
        texts = batch.column(3)
        # a leaf's only row with too few documents says nothing
        company = np.zeros(len(leaves) + 1, bool)
        company[1:-1] = leaves[1:] == leaves[:-1]
        look = company[1:] | company[:-1] | (ns >= DOCUMENTS)
        if len(look):
            look[0] = look[-1] = True
        out: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(look).tolist():
            if lines[i] == line and leaves[i] == at:
                count += int(ns[i])
                continue
            if line is not None:
                leaf.add(line, count, text)
            if leaves[i] != at:
                out += leaf.recurring()
                leaf, at = Leaf(), leaves[i]
            line, count, text = int(lines[i]), int(ns[i]), texts[i].as_py()
        yield told(out)
    if line is not None:
        leaf.add(line, count, text)
    yield told(list(leaf.recurring()))


def _row_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, lines = [], []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {line_hash(t) for t in map(masked, (text or "").split("\n")) if t}
            lines += found
            rows += [row] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lines, pa.int64())], ["row", "line"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, digest, kept = [], [], [], []
        for text, bad in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = text.split("\n") if text else []
            bad = set(bad or ())
            stay = [x for x in lines if not bad or not (t := masked(x)) or line_hash(t) not in bad]
            total.append(len(lines))
            gone.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
            digest.append(hashlib.sha256(kept[-1].encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(kept)], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])


def drop_templates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_lines, n_dropped, kept_sha256, kept (the text without recurring lines)."""
    arrow_rows(docs.sparkSession, 500)
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64("doc_id", text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = rows.select("row", "text").mapInArrow(_lines, "leaf long, line long, n long, text string")
    found = cut(lines.repartition("leaf").sortWithinPartitions("leaf", "line").mapInArrow(_templates, "line long, template long, n long"), "line-templates")
    places = rows.select("row", "text").mapInArrow(_row_lines, "row long, line long")
    where = cut(join_groups(places, found, "line", "n"), "line-places")
    recurring = cut(where.groupBy("template").agg(F.countDistinct("row").alias("n")).where(F.col("n") >= DOCUMENTS), "line-recurring")
    bad = join_groups(where, recurring, "template", "n").groupBy("row").agg(F.collect_set("line").alias("bad"))
    return rows.join(bad, "row", "left").select("doc_id", "text", "bad").mapInArrow(_kept, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
