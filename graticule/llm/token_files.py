"""Token-id files: one zstandard dictionary for the corpus, one frame per document, an offset index per file.

A shard holds a run of documents in ascending doc_id order::

    frames | index (40 bytes a document: doc_id, offset, frame length, tokens, flag for a null id) | trailer

The trailer (40 bytes) carries a magic number, the document count, the tokens before the shard, the index offset, the first
eight bytes of the dictionary's SHA-256 and the width of an id in a frame (2 or 4 bytes, little endian).  A short document
is read with three range reads (trailer, index, frame) and the shared dictionary, without touching its neighbours.

Jobs: documents are encoded once into a scratch table; its ids and counts alone give the shards' bounds and starts; then the
encoded documents are shuffled once, a shard to a task.  Tasks write shards under temporary names and rename them, so a retried task
leaves whole files only.

A null text is empty; every document ends with the end id.  Null doc_ids sort first.  Rows with equal doc_ids are all
written, ordered by their ids' bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, cut, scratch_path, table

MAGIC = b"GRTOK002"
TRAILER, TRAILER_BYTES = "<8sQQQ8s", 40
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("null", "<u4"), ("n_tokens", "<u8"), ("spare", "<u8")])
#: Documents whose ids train the dictionary, and the ids taken of each: bounded, chosen by hash.
TRAIN_DOCS, TRAIN_IDS, DICTIONARY_BYTES = 2000, 4096, 65536
#: Tokens of a shard, about.
PART_TOKENS = 4_000_000
#: Words whose ids a worker remembers.
WORDS = 600_000
#: Python's str.split() also cuts at these, the tokenizer does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Characters beyond Latin-1, and what may begin a special token, are left to the tokenizer's own normalizer and splitter.
NOT_PLAIN = re.compile("[^\x00-\xff]|<\\|")
_LATIN = [chr(i) for i in range(256)]
#: Latin-1 bytes: commas and full stops; signs, which a comma after them would belong to.
_STOP = np.array([c in ",." for c in _LATIN])
_SIGN = np.array([not (c.isalnum() or c.isspace()) for c in _LATIN])


def torn(raw: bytes) -> bool:
    """Whether setting commas and full stops apart could cut a run of signs."""
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_STOP[data])
    return bool(_SIGN[data[at[at > 0] - 1]].any())


class WordEncoder:
    """The tokenizer's ids as little-endian uint32 bytes, words cached.

    The vocabulary's splitter drops white space and never joins across it, so a text's ids are those of its
    white-space-separated words, one after another; and a word's are those of its pieces (letters, one digit, other signs).
    Lower-cased words are cached; where no run of signs could be torn, commas and full stops at word ends are set apart
    first, so that they don't multiply the words.  Only a new piece reaches the library's model.  Words outside Latin-1 or
    with a special token's beginning go to the library whole, as do texts with control characters on which the notions of
    white space differ.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces_of = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0d\x20\x85\xa0\p{L}\p{N}]+").findall
        # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.words.get(piece)
        if ids is None:
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
            ids = self.words[piece] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids

    def word(self, word: str, plain: bool) -> bytes:
        """Ids of a word, lower-cased if ``plain``."""
        if plain and word.isalpha():
            return self.piece(word)
        if not plain and NOT_PLAIN.search(word):
            return self.whole(word)
        return b"".join(map(self.piece, self.pieces_of(word.lower())))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > WORDS:
            self.words.clear()
        known, out = self.words, []
        look = known.get
        for text in texts:
            if NOT_SPACE.search(text):
                out.append(self.whole(text))
                continue
            try:
                raw = None if "<|" in text else text.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is not None:
                text = text.lower()
                if not torn(raw):
                    text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
                words = text.split()
                ids = list(map(look, words))
                if None in ids:
                    for i, x in enumerate(ids):
                        if x is None:
                            w = words[i]
                            ids[i] = look(w) or known.setdefault(w, self.word(w, True))
            else:
                ids = [self.word(w, False) for w in text.split()]
            out.append(b"".join(ids))
        return out


@cache
def encoder_of(path: str) -> WordEncoder:
    """A worker's encoder, which outlives its tasks."""
    return WordEncoder(path)


def _encoded(path: str, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = encoder_of(path), struct.pack("<I", end)
        for batch in batches:
            ids = [x + tail for x in encoder.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([packed(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def packed(ids: bytes) -> bytes:
    """uint32 ids as uint16 after a width byte 2, where all fit; else the ids after a 4."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\x04" + ids


def unpacked(frame: bytes) -> np.ndarray:
    return np.frombuffer(frame, "<u2" if frame[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def train_dictionary(encoded: DataFrame, documents: int) -> bytes:
    """A zstandard dictionary from a hash-chosen sample of serialized ids, about ``TRAIN_DOCS`` of the table's ``documents``.

    Of a long document a run from a place that a hash names; a sample that gives no dictionary means frames without one.
    """
    bound = int((1 << 62) * min(1.0, TRAIN_DOCS / max(1, documents)))
    chosen = encoded.where(F.xxhash64("doc_id", "n_tokens").bitwiseAND(F.lit((1 << 62) - 1)) < bound)
    width = F.when(F.expr("substring(ids, 1, 1)") == F.lit(b"\x04"), 4).otherwise(2)
    first = F.pmod(F.xxhash64("n_tokens", "doc_id", F.lit(1)), F.greatest(F.col("n_tokens") - TRAIN_IDS * 2 / width + 1, F.lit(1)).cast("long"))
    run = F.substring("ids", (2 + width * first).cast("int"), 2 * TRAIN_IDS)
    rows = chosen.select(F.concat(F.expr("substring(ids, 1, 1)"), run).alias("ids")).limit(2 * TRAIN_DOCS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(bytes(r.ids) for r in rows)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _written(folder: str, dictionary: bytes, starts: dict[int, int]) -> Callable:
    mark = hashlib.sha256(dictionary).digest()[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = open_folder(folder)
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        name, temporary, at, entries, out, part = "", "", 0, [], None, 0
        for batch in batches:
            for part, doc_id, ids in zip(*(batch.column(i) for i in (0, 1, 2)), strict=True):
                part = part.as_py()
                if out is None:
                    name, temporary = f"{root}/shard-{part:06d}.tok", f"{root}/.shard-{part:06d}-{context.taskAttemptId()}"
                    out = store.open_output_stream(temporary)
                raw = ids.as_buffer().to_pybytes()
                frame = press.compress(raw)
                entries.append((doc_id.as_py() or 0, at, len(frame), not doc_id.is_valid, (len(raw) - 1) // (2 if raw[:1] == b"\x02" else 4), 0))
                out.write(frame)
                at += len(frame)
        if out is not None:
            out.write(np.array(entries, ENTRY).tobytes())
            out.write(struct.pack(TRAILER, MAGIC, len(entries), starts[part], at, mark))
            out.close()
            store.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([len(entries)], pa.int64())], ["shard", "n_docs"])

    return run


def in_parts(encoded: DataFrame) -> DataFrame:
    """Adds ``part``: ascending runs of doc_ids of about ``PART_TOKENS`` tokens each.  Only ids and counts are read for it."""
    row = encoded.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    parts = max(1, -(-(row.t or 0) // PART_TOKENS))
    bounds = encoded.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100_000).alias("b")).first().b if parts > 1 and row.n else None
    if not bounds:
        return encoded.withColumn("part", F.lit(0))
    bounds = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))])
    return encoded.withColumn("part", F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))), F.lit(0)))


def write_files(encoded: DataFrame, folder: str) -> DataFrame:
    """``encoded(doc_id, n_tokens, ids)`` -> shard files and their list (shard, n_docs)."""
    spark = encoded.sparkSession
    encoded = in_parts(encoded)
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).orderBy("part").collect()  # one row a shard
    dictionary = train_dictionary(encoded, sum(r.docs for r in totals))
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/ids.zdict") as out:
        out.write(dictionary)
    starts, before = {}, 0
    for r in totals:
        starts[r.part], before = before, before + r.n
    arrow_rows(spark, 500)
    placed = encoded.repartitionById(max(starts, default=0) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids").select("part", "doc_id", "ids")
    shards = placed.mapInArrow(_by_part(_written(folder, dictionary, starts)), "shard string, n_docs long")
    return cut(shards, "token-shards")


def _by_part(write: Callable) -> Callable:
    """Feeds ``write`` one part at a time: a partition may hold none, one or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []

        def one() -> Iterator[pa.RecordBatch]:
            """Batches of the part at hand; what follows it stays in ``left``."""
            first = None
            while True:
                if not left:
                    batch = next(batches, None)
                    if batch is None:
                        return
                    left.append(batch)
                batch = left.pop()
                if not batch.num_rows:
                    continue
                parts = batch.column(0).to_numpy()
                first = parts[0] if first is None else first
                n = int(np.searchsorted(parts, first, "right"))
                if n < batch.num_rows:
                    left.append(batch.slice(n))
                if n:
                    yield batch.slice(0, n)
                if left:
                    return

        while True:
            made = list(write(one()))
            yield from made
            if not made:
                return

    return run


class Shard:
    """One token file, read by ranges."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        store, root = open_folder(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        magic, self.count, self.start, self.index_at, mark = struct.unpack(TRAILER, self.file.read_at(TRAILER_BYTES, size - TRAILER_BYTES))
        if magic != MAGIC or mark != hashlib.sha256(dictionary).digest()[:8]:
            raise ValueError(f"{name}: not a token file of this dictionary")
        self.index = np.frombuffer(self.file.read_at(self.count * ENTRY.itemsize, self.index_at), ENTRY)
        self.plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        e = self.index[i]
        return unpacked(self.plain.decompress(self.file.read_at(int(e["length"]), int(e["offset"]))))

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document with this id."""
        at = np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["null"] == 0))
        return self.ids(int(at[0])) if len(at) else None


def read_dictionary(folder: str) -> bytes:
    store, root = open_folder(folder)
    with store.open_input_stream(f"{root}/ids.zdict") as f:
        return f.read()


def read_files(shards: DataFrame, folder: str) -> DataFrame:
    """Every document of the shard files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                dictionary = read_dictionary(folder) if dictionary is None else dictionary
                shard, at = Shard(folder, name, dictionary), 0
                at = shard.start
                for a in range(0, shard.count, 4096):
                    rows = []
                    for i in range(a, min(a + 4096, shard.count)):
                        ids = shard.ids(i)
                        rows.append((at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                    e = shard.index[a : a + 4096]
                    start, n, crc = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(e["doc_id"].astype(np.int64), mask=e["null"] != 0), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    number = F.regexp_extract("shard", r"(\d+)", 1).cast("int")
    last = shards.agg(F.max(number)).first()[0] or 0
    return shards.repartitionById(last + 1, number).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """``docs(doc_id, text)`` -> scratch table (doc_id, n_tokens, ids)."""
    arrow_rows(docs.sparkSession, 250)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(_encoded(tokenizer, end), "doc_id long, n_tokens long, ids binary"), "token-ids")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    return read_files(write_files(tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2), folder), folder)


__all__ = ["Shard", "WordEncoder", "op5_token_files", "read_dictionary", "read_files", "tokenize", "write_files"]
