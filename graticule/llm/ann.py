"""Approximate nearest neighbours by inner product with collision-counting hashing.

Vectors are dealt to blocks by a hash of their id; a block is indexed by one task, and every query visits every block of its
dimension, in a stream, so a task holds one block however many queries there are.  A block's index has ``LINES`` single random
projections, each kept as a sorted array of values, and each row's place in each array.

A query starts with a window around its own projection on every line, found by searching the sorted arrays.  A row whose
places lie in the windows of at least ``COLLISIONS`` of the lines is a candidate, and candidates are verified by their
products.  Virtual rehashing widens all windows by ``GROWTH`` until the rule of collisions and distances stops it: a row at
distance ``d`` lies in a window of half-width ``h`` with probability erf(h / d / sqrt 2), so ``h >= REACH * d`` gives it the
collisions it needs, ``CONFIDENCE`` deviations to spare.  A query stops at the first ``h`` that reaches as far as its verified
neighbours in this block: as many as the block can be expected to hold of the ``k``, and three deviations more.

Inner products become distances by one more coordinate, sqrt(largest norm^2 - norm^2), which queries have as zero.

Equal vectors: of each distinct vector the ``k + 1`` smallest ids are indexed; no other copy can be among the k nearest.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; vectors meet
only those of their own dimension.  Rows equal in id and vector count once.  An id with several vectors asks and answers with
each of them; of its products with another id the largest counts.  Vectors of doubles stay doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, table

NEAREST, EVERY = 20, 20
BLOCK = 16384
LINES, COLLISIONS, CONFIDENCE, GROWTH, SEED = 192, 0.55, 0.3, 1.1, 5
#: Queries whose windows are looked up together; rows whose places are compared together; rows that set the first windows.
TOGETHER, CHUNK, SAMPLE = 64, 2048, 64
NEED = math.ceil(COLLISIONS * LINES)


def _reach() -> float:
    """Half-width of a window, by distance, at which a row's expected collisions pass ``NEED`` by ``CONFIDENCE`` deviations."""
    low, high = 0.0, 10.0
    for _ in range(100):
        mid = (low + high) / 2
        p = math.erf(mid / math.sqrt(2))
        low, high = (low, mid) if p * LINES - CONFIDENCE * math.sqrt(LINES * p * (1 - p)) >= NEED else (mid, high)
    return high


REACH = _reach()


def expected(k: int, blocks: int) -> int:
    """How many of k + 1 neighbours a block holds at most, but for three deviations (the one more is the query itself)."""
    mean = (k + 1) / blocks
    return min(k + 1, math.ceil(mean + 3 * math.sqrt(mean)))


class Index:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        n, d = self.vectors.shape
        exact = self.vectors.astype(np.float64)
        self.single = self.vectors.astype(np.float32)
        norms = (exact**2).sum(axis=1)
        top = norms.max()
        self.scale = 1 / np.sqrt(top) if top > 0 else 1.0
        tall = np.concatenate((exact * self.scale, np.sqrt(np.maximum(top - norms, 0))[:, None] * self.scale), axis=1)
        random = np.random.default_rng([SEED, d])
        self.lines = random.normal(size=(d + 1, LINES))
        self.values = np.ascontiguousarray((tall @ self.lines).T)
        places = np.empty((LINES, n), np.uint16 if n < 1 << 16 else np.uint32)
        for line in range(LINES):
            rows = np.argsort(self.values[line], kind="stable")
            places[line, rows] = np.arange(n)
            self.values[line] = self.values[line, rows]
        self.places = [np.ascontiguousarray(places[:, i : i + CHUNK]) for i in range(0, n, CHUNK)]
        self.moved, self.inside = np.empty((LINES, CHUNK), places.dtype), np.empty((LINES, CHUNK), bool)  # work space
        self.sample = tall[random.integers(0, n, SAMPLE)]
        self.tall = tall
        self.first: dict[int, float] = {}
        self.verified = 0

    def start(self, k: int) -> float:
        """The first windows' half-width: what a quarter of the sampled rows need."""
        if k not in self.first:
            n = len(self.ids)
            close = np.partition(self.sample @ self.tall.T, max(0, n - k), axis=1)[:, max(0, n - k)]
            far = np.sqrt(np.maximum(2 - 2 * close, 0))
            self.first[k] = REACH * float(np.percentile(far, 25)) or REACH * float(far.max()) or 0.1
        return self.first[k]

    def candidates(self, low: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Rows whose places lie in the windows [low, low + width) of at least ``NEED`` lines."""
        counts = []
        for places in self.places:
            moved, inside = self.moved[:, : places.shape[1]], self.inside[:, : places.shape[1]]
            np.subtract(places, low[:, None], out=moved)  # unsigned: places below wrap around
            np.less(moved, width[:, None], out=inside)
            counts.append(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8))
        return np.flatnonzero(np.concatenate(counts) >= NEED)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, blocks: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of up to k neighbours for each query found in this block."""
        n, kind = len(self.ids), self.places[0].dtype
        q = queries.astype(np.float64)
        length = np.sqrt((q**2).sum(axis=1))
        at = (q / length[:, None]) @ self.lines[:-1]
        hope = expected(k, blocks)
        half, open_, found = self.start(hope), np.arange(len(q)), {}
        while len(open_):
            low = np.stack([np.searchsorted(self.values[j], at[open_, j] - half, "left") for j in range(LINES)], axis=1)
            high = np.stack([np.searchsorted(self.values[j], at[open_, j] + half, "right") for j in range(LINES)], axis=1)
            width = (high - low).astype(kind)
            low = low.astype(kind)
            still = []
            for x, i in enumerate(open_.tolist()):
                near = self.candidates(low[x], width[x])
                done = len(near) == n
                if done or len(near) >= hope:
                    with np.errstate(over="ignore", invalid="ignore"):
                        rough = self.single[near] @ queries[i].astype(np.float32)
                    if not done:
                        last = float(np.partition(rough, len(rough) - hope)[len(rough) - hope])
                        far = math.sqrt(max(0.0, 2 - 2 * last * self.scale / length[i])) if math.isfinite(last) else math.inf
                        done = half >= REACH * far
                if done:
                    self.verified += len(near)
                    found[i] = (near, rough)
                else:
                    still.append(i)
            open_ = np.array(still, np.int64)
            half *= GROWTH
        out_q, out_v, out_s = [], [], []
        for i, (near, rough) in found.items():
            other = self.ids[near] != query_ids[i]
            near, rough = near[other], rough[other]
            if len(near) > k:  # what is clearly beyond the k best in single precision needs no exact product
                near = near[~(rough < np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-5 * length[i] / self.scale)]
            score = (self.vectors[near].astype(np.float64) * q[i]).sum(axis=1)
            best = np.lexsort((self.ids[near], -score))[:k]
            out_q.append(np.full(len(best), query_ids[i]))
            out_v.append(self.ids[near[best]])
            out_s.append(score[best])
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _searched(k: int):
    """Rows (block, kind, vec_id, vector, blocks) in order, a block's vectors (kind 0) before its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index = None, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            blocks, kinds, row_ids = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, index, ids, vectors = blocks[a], None, [], []
                part = lists.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                if kinds[a] == 0:
                    ids.append(row_ids[a:b])
                    vectors.append(part)
                    continue
                if not ids:
                    continue
                if index is None:
                    index = Index(np.concatenate(ids), np.concatenate(vectors))
                for i in range(0, b - a, TOGETHER):
                    q, v, s = index.nearest(row_ids[a + i : min(b, a + i + TOGETHER)], part[i : i + TOGETHER], k, batch.column(4)[a].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, embedding)`` without the rows that take no part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = F.forall(x, lambda v: v == 0)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kept = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), kept.alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True))).dropDuplicates()


def search(vectors: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """The k nearest of ``vectors(vec_id, embedding)`` for those rows where ``is_query`` holds: query_id, rank, vec_id, score."""
    rows = usable(vectors).withColumn("dim", F.size("embedding"))
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n")
    sizes = indexed.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("dim", "d")
    placed = indexed.join(sizes, F.col("dim") == F.col("d")).select(F.struct("dim", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("b")).alias("at"), F.lit(0).alias("kind"), "vec_id", "embedding", "blocks")
    asked = rows.where(is_query).join(sizes, F.col("dim") == F.col("d"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "dim", "vec_id", "embedding", "blocks").select(F.struct("dim", "b").alias("at"), F.lit(1).alias("kind"), "vec_id", "embedding", "blocks")
    both = placed.union(asked).select((F.col("at.dim").cast("long") * (1 << 31) + F.col("at.b")).alias("block"), "kind", "vec_id", "embedding", "blocks")
    arrow_rows(vectors.sparkSession, 2000)
    found = both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_searched(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)
