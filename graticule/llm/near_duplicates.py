"""Near-dedup of documents at a similarity of 0.8 over five-word shingles, on the pivot tables of ``simhash``.

At a Jaccard similarity of 0.8 about 15 % of a fingerprint's bits differ, far more than subsets of agreeing segments can
cover.  So this form is probabilistic where ``simhash.components`` is exact:

* fingerprints have 128 bits (similarity 0.8: 19 +- 4 bits differ; unrelated texts: 64 +- 6);
* each of ``TABLES`` tables has ``KEY_BITS`` partial references, the Walsh rows over as many random bits; equal distances to
  all of them (which only equal bits have) are the join key.  A pair at 0.8 shares a key in some table with probability 0.95,
  at 0.85 with 0.99;
* rows under a key are discarded by pivots: a pair whose largest coordinate difference exceeds ``WIDEST`` differs in more bits
  than that.  The references are all 128-bit words that choose, for each byte, one of the eight Walsh rows or its complement;
  distances to them are sums over bytes, so the largest difference over all 16^16 is found from 8 distances a byte;
* what is left is linked up to ``WIDEST`` differing bits, which an unrelated pair does once in 10^9; these links only gather
  clusters of texts that may be alike;
* fingerprints of few shingles are coarse: sets of up to ``FEW`` are linked exactly, by what is left without one shingle;
* within a cluster every two texts are compared by their whole shingle sets, unless verified links join them already.

Identical texts are one node from the start.  Keys with many rows give a spanning forest of the bit links; keys with more than
``SWEEP`` rows, and clusters of more than ``ROWS`` texts or ``VOLUME`` shingles, are cut into chunks, and every pair of chunks
is a group of its own, which loses no pair.  Each document belongs to one component over verified pairs; the smallest
doc_id of each stays (null ids last), of rows equal in id and text one.

Texts without words are copies only of identical texts; null is the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, arrow_rows, connected_components, cut

WORDS, SIMILARITY = 5, 0.8
TABLES, KEY_BITS, WIDEST, SEED = 40, 16, 30, 11
#: Groups up to this size give all pairs, larger ones a forest; rows of a key that one sweep takes.
SMALL, SWEEP = 16, 8192
#: Of two sets up to this size at 0.8 or more, each lacks at most one shingle of the other.
FEW = 9
#: Texts and shingles of a cluster's chunk.
ROWS, VOLUME = 1024, 1 << 20


def profile(text: bytes, words: int = WORDS) -> tuple[bytes, np.ndarray] | None:
    """128-bit fingerprint and the sorted 64-bit hashes of the distinct shingles; None without words."""
    spans = SPACED_WORD.findall(text.lower())
    if not spans:
        return None
    joined, n, digest = b" ".join(spans), len(spans), xxhash.xxh3_128_digest
    if n <= words:
        packed = digest(joined)
    else:
        ends = np.cumsum(np.fromiter(map(len, spans), np.int64, n) + 1)
        packed = b"".join([digest(joined[a:b]) for a, b in zip([0, *ends[: n - words].tolist()], (ends[words - 1 :] - 1).tolist(), strict=True)])
    shingles, first = np.unique(np.frombuffer(packed, "<u8")[::2], return_index=True)
    rows = np.frombuffer(packed, np.uint8).reshape(-1, 16)[first]  # each distinct shingle votes once
    votes = np.zeros(128, np.int64)
    for i in range(0, len(rows), 32768):
        votes += np.unpackbits(rows[i : i + 32768], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(rows)).tobytes(), shingles


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 0.0


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, hi, lo, size, parts = [], [], [], [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            p = profile(text.as_buffer().to_pybytes()) if text.is_valid else None
            if p:
                a, b = np.frombuffer(p[0], ">i8").tolist()
                key.append(k)
                hi.append(a)
                lo.append(b)
                size.append(len(p[1]))
                parts.append(_parts(p[1]))
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), *(pa.array(x, pa.int64()) for x in (hi, lo, size)), pa.array(parts, pa.list_(pa.int64()))], ["body", "hi", "lo", "size", "parts"])


def _parts(shingles: np.ndarray) -> list[int] | None:
    """Names of a small set and, from five on, of what is left without any one of its shingles; None of larger sets."""
    if len(shingles) > FEW:
        return None
    whole = shingles.sum(dtype=np.uint64)
    less = whole - shingles if len(shingles) > 4 else shingles[:0]
    return np.concatenate((np.array([whole], np.uint64), less)).view(np.int64).tolist()


def walsh(n: int) -> np.ndarray:
    """The rows of the Walsh matrix as bits, any two ``n / 2`` apart."""
    rows = np.arange(n)
    return (np.bitwise_count(rows[:, None] & rows[None, :]) & 1).astype(np.uint8)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Fingerprints (n, 2) -> (8, n, 16): the distances of each byte to its eight partial references."""
    parts = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 16)
    return np.stack([np.bitwise_count(parts ^ r) for r in np.packbits(walsh(8), axis=1).ravel()]).view(np.int8)


def largest_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two pivot tables -> their largest coordinate difference over the references that bytes' references make up.

    A complement's distance is 8 less the row's, so differences have either sign, and a sum's largest is the sum of each byte's.
    """
    most = np.abs(a[0] - b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        np.maximum(most, np.abs(x - y), out=most)
    words = np.ascontiguousarray(most).view(np.uint64)
    return ((words[:, 0] + words[:, 1]) * np.uint64(0x0101010101010101)) >> np.uint64(56)  # the sum of 16 bytes, 128 at most


def _near(fp: np.ndarray, pivots: np.ndarray, left, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows are within ``WIDEST`` bits (``left``: rows or one row): by pivots first, then by the bits."""
    near = largest_difference(pivots[:, left] if np.ndim(left) else pivots[:, left][:, None], pivots[:, right]) <= WIDEST
    at = np.flatnonzero(near)
    near[at] = _gap(fp[left[at] if np.ndim(left) else left], fp[right[at]]) <= WIDEST
    return near


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each table: the distances to its partial references, hashed to one number with the table's."""
    random = np.random.default_rng(SEED)
    chosen = [np.sort(random.choice(128, KEY_BITS, replace=False)) for _ in range(TABLES)]
    signs = 1 - 2 * walsh(KEY_BITS).T.astype(np.float32)
    weights = random.integers(-(1 << 63), 1 << 63, (TABLES, KEY_BITS))
    for batch in batches:
        node, hi, lo = (batch.column(i).to_numpy() for i in range(3))
        bits = np.unpackbits(np.stack((hi, lo), axis=1).astype(">i8").view(np.uint8).reshape(-1, 16), axis=1)
        for i in range(0, TABLES, 8):
            far = [((KEY_BITS - (1 - 2 * bits[:, chosen[t]].astype(np.float32)) @ signs) / 2).astype(np.int64) for t in range(i, i + 8)]
            keys = np.concatenate([x @ weights[t] for t, x in enumerate(far, i)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.tile(x, 8)) for x in (node, hi, lo))], ["key", "node", "hi", "lo"])


def _bit_forest(node: np.ndarray, fp: np.ndarray) -> tuple[list[int], list[int]]:
    rest, u, v = np.arange(len(node)), [], []
    pivots = pivot_table(fp)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            hub, front = front[0], front[1:]
            near = _near(fp, pivots, hub, rest)
            u += [int(node[hub])] * int(near.sum())
            v += node[rest[near]].tolist()
            front, rest = np.concatenate((front, rest[near])), rest[~near]
    return u, v


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16) + np.bitwise_count(a[..., 1] ^ b[..., 1])


def _stars(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The links' components with a link from each one's smallest node to every other: only components count."""
    ends, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    top = list(range(len(ends)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    low = np.array([root(i) for i in range(len(ends))], np.int64)
    other = np.flatnonzero(low != np.arange(len(ends)))
    return np.stack((ends[low[other]], ends[other]), axis=1) if len(other) else np.zeros((0, 2), np.int64)


def _paired(most: int | None):
    """Rows (key, node, hi, lo) in order of key -> bit links (u, v, 0); for keys of over ``most`` rows one row (key, rows, 1)."""

    def links(rows: np.ndarray, us: list, vs: list, over: list) -> None:
        key = rows[:, 0]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(rows) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [len(rows)])))
        small = rows[np.repeat((sizes > 1) & (sizes <= SMALL), sizes)] if len(rows) else rows
        fp = np.ascontiguousarray(small[:, 2:]).view(np.uint64)
        pivots = pivot_table(fp)
        for step in range(1, SMALL):
            at = np.flatnonzero(small[step:, 0] == small[:-step, 0])
            if not len(at):
                break
            at = at[_near(fp, pivots, at, at + step)]
            us.append(small[at, 1])
            vs.append(small[at + step, 1])
        for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            if most and n > most:
                over.append((int(key[a]), n))
                continue
            u, v = _bit_forest(rows[a : a + n, 1], rows[a : a + n, 2:].view(np.uint64))
            us.append(np.array(u, np.int64))
            vs.append(np.array(v, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counted = 0  # rows of an overlong key that were let go

        def flush(final: bool) -> pa.RecordBatch:
            nonlocal held, counted
            rows = np.concatenate(held)
            over: list[tuple[int, int]] = []
            if counted and (final or rows[0, 0] != rows[-1, 0]):  # the overlong key ends here
                first = int(np.searchsorted(rows[:, 0], rows[0, 0], "right"))
                over.append((int(rows[0, 0]), counted + first))
                rows, counted = rows[first:], 0
            cutoff = len(rows) if final else int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            us: list = []
            vs: list = []
            links(rows[:cutoff], us, vs, over)
            held = [rows[cutoff:]]
            if most and len(held[0]) > most + 1:  # only its size matters from here on
                counted += len(held[0]) - 1
                held = [held[0][-1:]]
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            pairs = _stars(u, v)
            o = np.array(over, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate((pairs[:, i], o[:, i]))) for i in (0, 1)), pa.array(np.repeat(np.array([0, 1], np.int32), [len(pairs), len(o)]))], ["u", "v", "over"])

        count = 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1))
            count += batch.num_rows
            if count >= 32768:
                yield flush(False)
                count = 0
        if sum(map(len, held)):
            yield flush(True)

    return run


def bit_links(nodes: DataFrame) -> DataFrame:
    """``nodes(node, hi, lo)`` -> (u, v) whose components are those of all pairs with a key in common and few bits apart."""
    arrow_rows(nodes.sparkSession, 500)
    keyed = nodes.select("node", "hi", "lo").mapInArrow(_keyed, "key long, node long, hi long, lo long")

    def found(rows: DataFrame, most: int | None) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "hi", "lo", "node").mapInArrow(_paired(most), "u long, v long, over int")

    first = cut(found(keyed, SWEEP), "near-bits")
    pairs = first.where("over = 0").select("u", "v")
    over = first.where("over = 1").select(F.col("u").alias("key"), F.ceil(F.col("v") / (SWEEP // 2)).cast("int").alias("chunks"))
    if over.isEmpty():
        return pairs
    split = keyed.join(over, "key").select(F.explode(_chunk_pairs("key")).alias("key"), "node", "hi", "lo")
    return pairs.union(found(split, None).select("u", "v"))


def part_links(nodes: DataFrame) -> DataFrame:
    """``nodes(node, parts)`` -> (u, v): each node of a part with the part's smallest."""
    named = nodes.select(F.explode("parts").alias("part"), "node")
    low = named.groupBy("part").agg(F.min("node").alias("u"))
    return named.join(low, "part").select("u", F.col("node").alias("v")).where("u <> v")


def _chunk_pairs(whole: str) -> Column:
    """Names of the groups that a node is in: its chunk of ``whole`` with each other chunk."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: (o != own) | (F.col("chunks") == 1))
    return F.transform(others, lambda o: F.xxhash64(whole, F.least(own, o), F.greatest(own, o)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [profile(t.as_buffer().to_pybytes())[1].tobytes() for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["root", "chunks", "node", "shingles"])


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the pairs at ``SIMILARITY`` or more: only a verified link takes a set out of the comparisons."""
    sizes, out = np.array([len(x) for x in sets]), []
    terms, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark, rest = np.zeros(len(terms), np.int64), np.arange(len(sets))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            hub = front.pop()
            own = flat[starts[hub] : starts[hub] + sizes[hub]]
            at = rest[np.minimum(sizes[rest], sizes[hub]) / np.maximum(sizes[rest], sizes[hub]) >= SIMILARITY]
            if not len(at):
                continue
            mark[own] = 1
            first = np.cumsum(sizes[at]) - sizes[at]
            both = np.add.reduceat(mark[flat[np.repeat(starts[at] - first, sizes[at]) + np.arange(sizes[at].sum())]], first)
            mark[own] = 0
            near = at[both / (sizes[at] + sizes[hub] - both) >= SIMILARITY]
            out += [(hub, int(x)) for x in near]
            front += near.tolist()
            rest = rest[~np.isin(rest, near)]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, node, shingles) in order of group -> verified links (u, v)."""
    at, nodes, sets = None, [], []
    for batch in batches:
        found: list[tuple[int, int]] = []
        for group, node, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if group != at:
                found += [(nodes[i], nodes[j]) for i, j in forest(sets)] if len(sets) > 1 else []
                at, nodes, sets = group, [], []
            nodes.append(node)
            sets.append(np.frombuffer(shingles.as_buffer().to_pybytes(), "<u8"))
        yield _links(found)
    yield _links([(nodes[i], nodes[j]) for i, j in forest(sets)] if len(sets) > 1 else [])


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the rows that stay."""
    arrow_rows(docs.sparkSession, 500)
    body = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    prints = docs.select(body.alias("body"), F.col("text").cast("string").alias("text"))
    # one node for each distinct text; its number is a hash of the digest
    nodes = cut(prints.mapInArrow(_profiled, "body string, hi long, lo long, size long, parts array<long>").dropDuplicates(["body"]).withColumn("node", F.xxhash64("body")), "near-nodes")
    clusters = connected_components(bit_links(nodes).union(part_links(nodes)), "near-clusters")
    volume = nodes.select("node", "size").join(clusters, "node").groupBy("root").agg(F.ceil(F.greatest(F.count("*") / ROWS, F.sum("size") / VOLUME)).cast("int").alias("chunks"))
    members = cut(clusters.join(volume, "root").select("root", "chunks", "node"), "near-members")
    arrow_rows(docs.sparkSession, 500)
    # equal texts become one before they move
    texts = prints.groupBy(F.xxhash64("body").alias("node")).agg(F.first("text").alias("text")).join(members, "node").select("root", "chunks", "node", "text")
    sets = texts.mapInArrow(_sets, "root long, chunks int, node long, shingles binary").select(F.explode(_chunk_pairs("root")).alias("group"), "node", "shingles")
    links = sets.repartition("group").sortWithinPartitions("group", "node").mapInArrow(_verified, "u long, v long")
    roots = connected_components(links, "near-roots")
    # every text's group: its component, or else itself; the first row of a group stays
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), body.alias("body")).withColumn("node", F.xxhash64("body"))
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("d"), F.col("body").alias("b"))
    grouped = named.select("id", "node", "body").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group"))
    kept = cut(grouped.agg(F.min(order).alias("o")).select(F.col("o.d").alias("d"), F.col("o.b").alias("b")), "near-kept")
    stay = named.join(kept, F.col("id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")))
    # rows alike in id and text are one document
    return stay.dropDuplicates(["id", "body"]).select("row.*")
