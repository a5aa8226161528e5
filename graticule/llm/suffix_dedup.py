"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere else, in the same document or another.

*Sampled suffixes.*  Every string of ``LENGTH`` bytes elects an anchor, the ``GRAM`` bytes in it with the smallest hash
(leftmost first).  Equal strings elect equal anchors at equal offsets, so repeats are met at anchors alone, about one in 85
bytes.  Consecutive strings with one anchor form a run, known by its anchor's hash and its own.  Equal runs count as one: a
run that occurs twice repeats as a whole.  An anchor that occurs in one run only has no repeats.  The runs of all other
anchors, on most corpora the edges of copies, go into the index.

*Index family* (``Family``).  An index entry is the suffix that begins at a run's anchor, with the bytes before the anchor,
to the run's ends.  A batch of runs gets a suffix array: a table of its entries in lexicographic order.  It is merge-scanned
against all existing levels; neighbours in the merged order share the longest prefixes, and a match of ``LENGTH`` bytes or
more around an anchor tells the strings inside it, of new and old entries.  Levels are tables in shared storage, so a later
batch, in this process or another, meets them; of levels of about equal size two become one, so an entry is moved a
logarithmic number of times.

*Scan.*  Entries with one anchor join in order of falling common prefix, the smaller group into the larger, which is kept in
order of the bytes before the anchor; so each entry's longest match to the left is known for every length to the right, after
a logarithmic number of insertions an entry, however many entries share the anchor.

Anchors of more than ``CROWD`` different runs (boilerplate in that many contexts) are dealt to several groups of that size;
their strings are in addition counted by name across groups, partial counts first.  Names are 96 bits of two independent
hashes; runs are compared by 64 bits of anchor and 64 of content.  Documents are told apart by a hash of id and text: rows
equal in both have equal results.  Null texts are empty.  Long texts are taken in overlapping pieces of ``PASS`` bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, cut, scratch_path, table

LENGTH, GRAM = 200, 32
#: Bytes that one vector pass takes, runs under one anchor in one group (at most 400 bytes each).
PASS, CROWD = 1 << 20, 65536
#: Batches in which a whole table's runs reach the index.
BATCHES = 4

_U = np.uint64
_MULTIPLIERS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)]
_TABLES = np.random.default_rng(20).integers(0, 2**64, (2, 256), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def runs(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of the texts that ``data`` concatenates, ``starts`` being their offsets and the end.

    Returns first string, number of strings, anchor position (all offsets into ``data``) and anchor hash of each run.
    """
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    h, width = _TABLES[0][data], 1
    factor = _MULTIPLIERS[0]
    while width < gram:  # hashes of twice the width from those of the width
        h = h[:-width] * factor + h[width:]
        factor = factor * factor + _U(2)
        width *= 2
    h = _mixed(h)
    bits = _U(32)  # of the hash as many decide, whatever the length of the pass; the others hold the place
    low = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:  # minima over twice the width
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - length + 1], low[span - width : span - width + n - length + 1])
    anchor = (low & ((_U(1) << bits) - _U(1))).astype(np.int64)
    ok = np.zeros(n - length + 2, np.int64)  # strings inside one text
    a, b = starts[:-1], starts[1:] - length + 1
    use = b > a
    ok[a[use]] += 1
    ok[b[use]] -= 1
    good = np.cumsum(ok)[:-1] > 0
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])
    # texts that touch: the last string of one and the first of the next never share an anchor, so they differ already
    first = np.flatnonzero(change)
    count = np.diff(np.concatenate((first, [len(anchor)])))
    keep = good[first]
    first, count = first[keep], count[keep]
    return first, count, anchor[first], h[anchor[first]]


def names(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``length`` bytes at each position: the suffix array's sort key (leading bytes first) and a check."""
    out = []
    for k in range(2):
        powers = np.cumprod(np.full(len(data) + 1, _MULTIPLIERS[k]), dtype=np.uint64)
        inverse = _U(pow(int(_MULTIPLIERS[k]), -1, 1 << 64))
        back = np.cumprod(np.full(len(data) + 1, inverse), dtype=np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLES[k][data] * powers[:-1], dtype=np.uint64)))
        out.append(_mixed((total[at + length] - total[at]) * back[at]))
    lead = np.zeros(len(at), np.uint64)
    for i in range(4):
        lead = (lead << _U(8)) | data[at + i].astype(np.uint64)
    return (lead << _U(32)) | (out[0] >> _U(32)), out[1]


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def matches(suffixes: list[bytes], lefts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Of entries in order of suffix: per entry the matches of ``LENGTH`` bytes or more, as (bytes before, bytes from the anchor).

    ``lefts`` are the bytes before the anchors, last byte first.  Of a set of matches only the largest are given: for every
    length to the right the longest to the left.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in suffixes]
    best = [-1] * len(suffixes)
    groups = {i: [(left, i)] for i, left in enumerate(lefts)}
    top = list(range(len(suffixes)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    def met(i: int, j: int, right: int) -> None:
        n = common_prefix(lefts[i], lefts[j])
        for k in (i, j):
            if n > best[k]:
                best[k] = n
                if n + right >= LENGTH:
                    out[k].append((n, right))

    shared = [common_prefix(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    for k in sorted(range(len(shared)), key=lambda k: -shared[k]):
        if shared[k] < GRAM:
            break
        a, b = root(k), root(k + 1)
        if len(groups[a]) < len(groups[b]):
            a, b = b, a
        into = groups[a]
        for entry in groups.pop(b):
            at = bisect_left(into, entry)
            if at:
                met(entry[1], into[at - 1][1], shared[k])
            if at < len(into):
                met(entry[1], into[at][1], shared[k])
            into.insert(at, entry)
        top[b] = a
    return out


ENTRY = "row long, at int, n int, kind int, ha long, crowd int, suffix binary, prefix binary"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order of (crowd, suffix) with ``new`` -> (row, at, n) of strings that repeat, of anchors with a new entry."""
    held: list[tuple] = []

    def scan() -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        if len(held) < 2 or not any(e[-1] for e in held):
            return out
        for (row, at, n, kind, _, _, _, prefix, _), found in zip(held, matches([e[6] for e in held], [e[7] for e in held]), strict=True):
            if kind != 1:  # known to repeat as a whole
                continue
            for left, right in found:
                first, last = max(0, len(prefix) - left), min(n - 1, len(prefix) - LENGTH + right)
                if first <= last:
                    out.append((row, at + first, last - first + 1))
        return out

    def told(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["row", "at", "n"])

    key = None
    for batch in batches:
        found: list[tuple[int, int, int]] = []
        for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            this = (entry[5], entry[6][:GRAM])
            if this != key:
                found += scan()
                held, key = [], this
            held.append(entry)
        yield told(found)
    yield told(scan())


class Family:
    """Suffix arrays of geometrically growing sizes: tables ``level-<number>-<entries>`` in ``folder``, found again when reopened."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.levels: list[tuple[int, int]] = []  # (number, entries), the oldest first
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        self.store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.store.exists(path):
            for status in self.store.listStatus(path):
                name = status.getPath().getName()
                if self.store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")):
                    number, entries = name.split("-")[1:]
                    self.levels.append((int(number), int(entries)))
            self.levels.sort()

    def _path(self, level: tuple[int, int]) -> str:
        return f"{self.folder}/level-{level[0]:06d}-{level[1]}"

    def _read(self, level: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self._path(level))

    @staticmethod
    def _arranged(entries: DataFrame) -> DataFrame:
        return entries.repartition("ha", "crowd").sortWithinPartitions("crowd", "suffix", "prefix")

    def _write(self, entries: DataFrame, count: int) -> None:
        level = (max((n for n, _ in self.levels), default=0) + 1, count)
        self._arranged(entries).write.parquet(self._path(level))
        self.levels.append(level)

    def add(self, entries: DataFrame) -> DataFrame:
        """Adds a batch of entries; (row, at, n): strings, new or old, that are seen to repeat with the batch."""
        while len(self.levels) > 1 and 2 * self.levels[-1][1] >= self.levels[-2][1]:  # merge before a batch, not after the last
            a, b = self.levels[-2:]
            self._write(self._read(a).union(self._read(b)), a[1] + b[1])
            for level in (a, b):
                self.levels.remove(level)
                self.store.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(level)), True)
        every = entries.withColumn("new", F.lit(True))
        for level in self.levels:
            every = every.union(self._read(level).withColumn("new", F.lit(False)))
        told = cut(self._arranged(every).mapInArrow(_scanned, "row long, at int, n int"), "suffix-told")
        self._write(entries, entries.count())
        return told


def _passes(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text's number, offset, bytes): whole texts, or of a long one pieces that overlap by one byte less than a string."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), PASS):
            piece = t[a : a + PASS + LENGTH - 1]
            if group and size + len(piece) > PASS:
                yield group
                group, size = [], 0
            group.append((i, a, piece))
            size += len(piece)
    if group:
        yield group


OCCURRENCE = np.dtype([("row", "<i8"), ("at", "<i4")])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) -> a row for each distinct run of the batch with all its occurrences there."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
        parts = []
        for group in _passes(texts):
            owner, offset, pieces = zip(*group, strict=True)
            blob = b"".join(pieces)
            starts = np.concatenate(([0], np.cumsum([len(t) for t in pieces])))
            first, count, anchor, ha = runs(np.frombuffer(blob, np.uint8), starts)
            hash_ = xxhash.xxh3_64_intdigest
            hf = np.array([hash_(blob[i:j]) for i, j in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)], np.uint64)
            piece = np.searchsorted(starts, first, "right") - 1
            occurrence = np.zeros(len(first), OCCURRENCE)
            occurrence["row"], occurrence["at"] = rows[np.array(owner)[piece]], np.array(offset)[piece] + first - starts[piece]
            parts.append((ha, hf, count, anchor - first, occurrence))
        if not parts:
            continue
        ha, hf, count, off, occurrence = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((hf, ha))
        ha, hf, count, off, occurrence = ha[order], hf[order], count[order], off[order], occurrence[order]
        new = np.ones(len(ha), bool)
        new[1:] = (ha[1:] != ha[:-1]) | (hf[1:] != hf[:-1])
        at = np.flatnonzero(new)
        ends = np.concatenate((at[1:], [len(ha)])) * OCCURRENCE.itemsize
        raw = pa.py_buffer(occurrence.tobytes())
        offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes())
        where = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, raw])
        yield pa.RecordBatch.from_arrays([pa.array(ha[at].view(np.int64)), pa.array(hf[at].view(np.int64)), pa.array(count[at].astype(np.int32)), pa.array(off[at].astype(np.int32)), where], ["ha", "hf", "n", "off", "occ"])


def _sorted_out(crowd: int):
    """Rows in order of (ha, hf) -> kind 0: a run that repeats as a whole; kind 1 (only one) and 2 (repeats): a run to look at.

    State is a constant number of rows: an anchor's first run waits for a second one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_ha = last_hf = None
        waiting: tuple | None = None  # the only row of (ha, hf) so far: (occ, n, off)
        multiple = False
        first: tuple | None = None  # first run of the anchor, told once there is a second
        seen = 0
        out: list[tuple] = []

        def whole(occ: bytes, n: int, off: int) -> None:
            for row, at in np.frombuffer(occ, OCCURRENCE).tolist():
                out.append((row, at, n, off, 0, 0, 0))

        def end_run() -> None:
            nonlocal waiting, multiple, first, seen
            if waiting is None:
                return
            occ, n, off = waiting
            row, at = np.frombuffer(occ, OCCURRENCE, 1)[0].tolist()
            this = (row, at, n, off, 2 if multiple else 1, last_ha, seen // crowd)
            if seen == 0:
                first = this
            else:
                if first:
                    out.append(first)
                    first = None
                out.append(this)
            seen += 1
            waiting, multiple = None, False

        for batch in batches:
            ha, hf, n, offs = (batch.column(i).to_numpy() for i in range(4))
            occ = batch.column(4)
            lengths = pa.compute.binary_length(occ).to_numpy()
            # a row needs a look if its anchor may have company, or if it occurs more than once by itself
            company = np.zeros(len(ha) + 1, bool)
            company[1:-1] = ha[1:] == ha[:-1]
            look = company[1:] | company[:-1] | (lengths > OCCURRENCE.itemsize)
            if len(look):
                look[0] = look[-1] = True
            for i in np.flatnonzero(look).tolist():
                a, f = int(ha[i]), int(hf[i])
                if a != last_ha:
                    end_run()
                    last_ha, last_hf, first, seen = a, f, None, 0
                elif f != last_hf:
                    end_run()
                    last_hf = f
                value, count, off = occ[i].as_py(), int(n[i]), int(offs[i])
                if waiting is None:
                    waiting = (value, count, off)
                    if len(value) > OCCURRENCE.itemsize:
                        multiple = True
                        whole(value, count, off)
                else:
                    if not multiple:
                        whole(*waiting)
                        multiple = True
                    whole(value, count, off)
            yield _told(out)
            out = []
        end_run()
        yield _told(out)

    return run


_TOLD = "row long, at int, n int, off int, kind int, ha long, crowd int"


def _told(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [()] * 7
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "at", "n", "off", "kind", "ha", "crowd"])


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, looks) -> an index entry for each run to look at."""
    for batch in batches:
        out, suffix, prefix = [], [], []
        for row, text, looks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            for x in looks:
                out.append((row, x["at"], x["n"], x["off"], x["kind"], x["ha"], x["crowd"]))
                anchor = x["at"] + x["off"]
                suffix.append(data[anchor : x["at"] + x["n"] + LENGTH - 1])
                prefix.append(data[x["at"] : anchor][::-1])
        told = _told(out)
        yield pa.RecordBatch.from_arrays([*(told.column(c) for c in ("row", "at", "n", "kind", "ha", "crowd")), pa.array(suffix, pa.binary()), pa.array(prefix, pa.binary())], ["row", "at", "n", "kind", "ha", "crowd", "suffix", "prefix"])


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, check, run number and offset of every string of the batch's runs."""
    body = [p.as_py()[::-1] + x.as_py() for p, x in zip(batch.column("prefix"), batch.column("suffix"), strict=True)]
    data = np.frombuffer(b"".join(body), np.uint8)
    n = batch.column("n").to_numpy().astype(np.int64)
    starts = np.cumsum([0, *[len(b) for b in body]])[:-1]
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key, check = names(data, starts[owner] + offset)
    return key, check, owner, offset


def _named(counted: bool):
    """Runs with bytes -> their strings' names: with counts, those of a batch added up; else with row and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                key, check, owner, offset = _entries(part)
                if counted:
                    order = np.lexsort((check, key))
                    key, check = key[order], check[order]
                    at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]))))
                    yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(check[at].view(np.int64)), pa.array(np.diff(np.concatenate((at, [len(key)]))))], ["key", "check", "times"])
                else:
                    use = part.column("kind").to_numpy()[owner] == 1
                    owner, offset = owner[use], offset[use]
                    yield pa.RecordBatch.from_arrays([pa.array(key[use].view(np.int64)), pa.array(check[use].view(np.int64)), pa.array(part.column("row").to_numpy()[owner]), pa.array((part.column("at").to_numpy()[owner] + offset).astype(np.int32))], ["key", "check", "row", "at"])

    return run


def removed_spans(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first string, number of strings) -> the maximal byte runs that they cover."""
    out: list[list[int]] = []
    for a, n in sorted(starts):
        b = a + n + LENGTH - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, gone, spans_, digest, kept = [], [], [], [], []
        for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans = removed_spans([(x["at"], x["n"]) for x in found or []])
            left, at = [], 0
            for a, b in spans:
                left.append(data[at:a])
                at = b
            rest = b"".join([*left, data[at:]])
            size.append(len(data))
            gone.append(len(data) - len(rest))
            spans_.append(len(spans))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    spark = docs.sparkSession
    arrow_rows(spark, 500)
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64("doc_id", text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = rows.select("row", "text").mapInArrow(_run_rows, "ha long, hf long, n int, off int, occ binary")
    told = cut(found.repartition("ha").sortWithinPartitions("ha", "hf").mapInArrow(_sorted_out(CROWD), _TOLD), "suffix-runs")
    looks = told.where("kind > 0")
    # sets, not lists: rows equal in id and text have a run in common each, and are one row here
    per_row = looks.groupBy("row").agg(F.collect_set(F.struct("at", "n", "off", "kind", "ha", "crowd")).alias("looks"))
    parts = rows.select("row", "text").join(per_row, "row").select("row", "text", "looks").mapInArrow(_with_bytes, ENTRY)
    parts = cut(parts.dropDuplicates(["row", "at"]), "suffix-parts")
    family = Family(spark, scratch_path(spark, "suffix-family"))
    repeats = None
    for i in range(BATCHES):
        more = family.add(parts.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(BATCHES)) == i))
        repeats = more if repeats is None else repeats.union(more)
    # anchors with more runs than a group takes: their strings are counted across groups
    crowds = looks.where("crowd > 0").select("ha").distinct()
    if not crowds.isEmpty():
        crowded = parts.join(crowds, "ha", "left_semi").select(*parts.columns)
        many = crowded.mapInArrow(_named(True), "key long, check long, times long").groupBy("key", "check").agg(F.sum("times").alias("times")).where("times > 1")
        across = crowded.mapInArrow(_named(False), "key long, check long, row long, at int").join(many, ["key", "check"]).select("row", "at", F.lit(1).alias("n"))
        repeats = repeats.union(across)
    spans = told.where("kind = 0").select("row", "at", "n").union(repeats).groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("found"))
    return rows.join(spans, "row", "left").select("doc_id", "text", "found").mapInArrow(_judged, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
