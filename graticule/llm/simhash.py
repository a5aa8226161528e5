"""SimHash near-dedup over pivot distance tables.

A fingerprint is a 64-bit majority vote over the XXH64 hashes of a text's word shingles.  Distinct fingerprints become the
rows of pivot tables.  Two fingerprints within ``d`` bits differ by at most ``d`` in their Hamming distance to *every*
reference fingerprint, so a pair whose largest coordinate difference exceeds ``d`` is discarded without being compared.

Full-width references spread random fingerprints over only some twenty distances, so they discard pairs but cannot be
joined on.  The pivot table therefore also has *partial* references, ``PARTIAL`` to each of ``d + 2`` segments, whose distance
counts the bits of their segment alone.  At most ``d`` segments hold a differing bit, so a pair within ``d`` is at equal
distance from all partial references of at least two segments: these distances, for every choice of two segments, are the
join keys, and no pair is lost.

Inside a key's rows a breadth-first sweep emits a spanning forest of the links instead of all pairs: rows already in the
same tree are not compared again, so a dense group of near copies costs about one comparison per row.  Keys with more rows
than ``MOST`` are cut into chunks and every pair of chunks becomes a group of its own, which keeps the answer exact.

Null and empty texts have no words: fingerprint zero, linked like any other.  Rows with equal doc_id are kept; a null
doc_id never names a component unless all its members are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, arrow_rows, connected_components, cut, join_groups, table

#: Rows of a key that one sweep takes.
MOST = 16384
#: Groups up to this size are compared with vector operations over the whole batch.
SMALL = 32


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    spans = SPACED_WORD.findall(text.lower())
    if not spans:
        return 0
    joined, n, digest = b" ".join(spans), len(spans), xxhash.xxh64_digest
    if n <= words:
        packed, count = digest(joined, 42), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, spans), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: n - words])).tolist()
        packed, count = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]), n - words + 1
    votes = np.zeros(64, np.int64)
    rows = np.frombuffer(packed, np.uint8).reshape(-1, 8)
    for i in range(0, count, 65536):
        votes += np.unpackbits(rows[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > count).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp)``, fp as a signed 64-bit integer."""
    arrow_rows(docs.sparkSession, 500)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(words), "doc_id long, fp long")


#: Partial references to a segment.
PARTIAL = 8


def parts(distance: int) -> list[int]:
    """Masks of ``distance + 2`` segments."""
    edges = np.linspace(0, 64, distance + 3).round().astype(int).tolist()
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def segments(distance: int) -> list[int]:
    """Masks of what the references of a join key see: every choice of two segments."""
    return [a | b for a, b in combinations(parts(distance), 2)]


def pivot_keys(distance: int) -> Column:
    """Column ``fp`` -> an array of join keys: the distances to the partial references of two segments, for any two."""

    def signed(x: int) -> Column:
        return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")

    random = np.random.default_rng(17)
    far = [[F.bit_count(F.col("fp").bitwiseXOR(signed(int(r))).bitwiseAND(signed(mask))) for r in random.integers(0, 1 << 64, PARTIAL, np.uint64)] for mask in parts(distance)]
    return F.array(*[F.xxhash64(F.lit(i), *a, *b) for i, (a, b) in enumerate(combinations(far, 2))])


def references() -> np.ndarray:
    """64 full-width reference fingerprints: the rows of the 64 x 64 Walsh matrix, any two 32 bits apart."""
    rows = np.arange(64)
    odd = np.bitwise_count(rows[:, None] & rows[None, :]) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, one byte each."""
    return np.bitwise_count(fps[:, None] ^ references()[None, :])


def survivors(fps: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int, pivots: np.ndarray | None = None) -> np.ndarray:
    """Which index pairs are within ``distance``: largest coordinate difference first, then the bits themselves."""
    pivots = pivot_table(fps) if pivots is None else pivots
    keep = np.ones(len(left), bool)
    for k in range(0, 64, 8):
        at = np.flatnonzero(keep)
        if not len(at):
            break
        gap = np.abs(pivots[left[at], k : k + 8].astype(np.int8) - pivots[right[at], k : k + 8].astype(np.int8)).max(axis=1)
        keep[at[gap > distance]] = False
    at = np.flatnonzero(keep)
    keep[at] = np.bitwise_count(fps[left[at]] ^ fps[right[at]]) <= distance
    return keep


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``fps`` as index pairs, by breadth-first sweeps over what is not reached yet."""
    rest, out = np.arange(len(fps)), []
    pivots = pivot_table(fps)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            hub, front = int(front[0]), front[1:]
            near = np.abs(pivots[rest, :8].astype(np.int8) - pivots[hub, :8].astype(np.int8)).max(axis=1) <= distance
            at = np.flatnonzero(near)
            near[at] = survivors(fps, np.full(len(at), hub), rest[at], distance, pivots)
            out += [(hub, int(x)) for x in rest[near]]
            front, rest = np.concatenate((front, rest[near])), rest[~near]
    return out


def _linked(distance: int, most: int | None):
    """Rows (key, fp) sorted by key -> edges (u, v, 0); for keys of over ``most`` rows one row (key, rows, 1)."""

    def links(key: np.ndarray, fp: np.ndarray, u: list, v: list, over: list) -> None:
        if len(key) < 2:
            return
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        inside = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        k, f = key[inside], fp[inside]
        if len(k):
            bits, pivots = f.view(np.uint64), None
            for step in range(1, SMALL):
                at = np.flatnonzero(k[step:] == k[:-step])
                if not len(at):
                    break
                pivots = pivot_table(bits) if pivots is None else pivots
                ok = at[survivors(bits, at, at + step, distance, pivots)]
                u.append(f[ok])
                v.append(f[ok + step])
        for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            if most and n > most:
                over.append((int(key[a]), n))
                continue
            part = fp[a : a + n]
            for i, j in forest(part.view(np.uint64), distance):
                u.append(part[i : i + 1])
                v.append(part[j : j + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        counted = 0  # rows of an overlong key that were let go

        def flush(final: bool) -> pa.RecordBatch:
            nonlocal held, counted
            key, fp = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            cutoff = len(key) if final else int(np.searchsorted(key, key[-1]))
            if counted and key[0] != key[-1]:  # the overlong key ends here
                first = int(np.searchsorted(key, key[0], "right"))
                over = [(int(key[0]), counted + first)]
                key, fp, cutoff, counted = key[first:], fp[first:], cutoff - first, 0
            elif counted and final:
                over, cutoff = [(int(key[0]), counted + len(key))], 0
            else:
                over = []
            u: list = []
            v: list = []
            links(key[:cutoff], fp[:cutoff], u, v, over)
            held = [] if final else [(key[cutoff:], fp[cutoff:])]
            if most and not final and len(held[0][0]) > 2 * most:  # only its size matters from here on
                counted += len(held[0][0]) - 1
                held = [(held[0][0][-1:], held[0][1][-1:])]
            us, vs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
            o = np.array(over, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((us, o[:, 0]))), pa.array(np.concatenate((vs, o[:, 1]))), pa.array(np.concatenate((np.zeros(len(us), np.int32), np.ones(len(o), np.int32))))], ["u", "v", "over"])

        rows = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= 65536:
                yield flush(False)
                rows = 0
        if held and sum(len(x[0]) for x in held):
            yield flush(True)

    return run


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "fp")


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Distinct ``fps(fp)`` -> ``(u, v)`` links whose components are those of all pairs within ``distance`` bits."""
    rows = fps.select(F.explode(pivot_keys(distance)).alias("key"), "fp")
    found = cut(_ordered(rows).mapInArrow(_linked(distance, MOST), "u long, v long, over int"), "simhash-links")
    edges = found.where("over = 0").select("u", "v")
    over = found.where("over = 1").select(F.col("u").alias("key"), F.ceil(F.col("v") / (MOST // 2)).cast("int").alias("chunks"))
    if over.isEmpty():
        return edges
    chunk = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.xxhash64("key", F.least(F.col("c"), o), F.greatest(F.col("c"), o)))
    split = rows.join(over, "key").withColumn("c", chunk).select(F.explode(pairs).alias("key"), "fp")
    return edges.union(_ordered(split).mapInArrow(_linked(distance, None), "u long, v long, over int").select("u", "v"))


def components(prints: DataFrame, distance: int = 4) -> DataFrame:
    """``prints(doc_id, fp, ...)``, a written table -> the same rows with ``component_id``, the smallest doc_id linked to each."""
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-groups")
    roots = connected_components(links(groups.select("fp"), distance), "simhash-roots").withColumnRenamed("node", "fp")
    named = cut(groups.join(roots, "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")), "simhash-named")
    lowest = cut(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("fps")), "simhash-lowest")
    owner = cut(join_groups(named, lowest, "root", "fps").select("fp", "n", "component_id"), "simhash-owners")
    return join_groups(prints, owner, "fp", "n")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over all documents: 4-word shingles, 4 bits."""
    prints = cut(fingerprints(table(spark, sf_dir, "documents"), 4), "simhash-prints")
    return components(prints, 4).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
