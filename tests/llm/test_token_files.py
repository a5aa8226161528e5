import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graticule.llm import token_files
from graticule.llm.common import scratch_path

from .helpers import DATA, ODD_TEXTS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def expected(ids, texts):
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for i, t in order:
        x = ids_of(t)
        out.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    return sorted(out, key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in token_files.op5_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=str)


def test_whole_table_against_the_library(spark):
    rows = pq.read_table(DATA / "sf0.01/documents.parquet").to_pylist()
    assert got(spark, str(DATA / "sf0.01")) == expected([r["doc_id"] for r in rows], [r["text"] for r in rows])


def test_odd_rows(spark, tmp_path):
    texts = [*ODD_TEXTS, "a<|endoftext|>b <|startoftext|>", "a\x1cb\x1f, c\x85d\u00a0e\u2003f\u180eg", "\u03a3\u0391\u03a3 \u0130 e\u0301"]
    ids = [*range(len(texts) - 1), None]
    assert got(spark, documents(tmp_path, texts, ids, part=(1, pa.int32()), n_tokens=("x", pa.string()))) == expected(ids, texts)


def test_empty_table(spark, tmp_path):
    assert got(spark, documents(tmp_path, [])) == []


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(st.one_of(st.characters(), st.sampled_from(" \n\t\x0b\x1c\x85\u00a0\u2028'<|>,.se"))))
def test_cached_words_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(token_files.WordEncoder(PATH).encode([text])[0], "<u4").tolist() == ids_of(text)[:-1]


def test_short_document_access(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} and others " * (i + 1)) for i in range(50)], "doc_id long, text string")
    folder = scratch_path(spark, "t")
    shards = token_files.write_files(token_files.tokenize(docs, PATH, 2), folder).collect()
    dictionary = token_files.read_dictionary(folder)
    found = {}
    for r in shards:
        shard = token_files.Shard(folder, r.shard, dictionary)
        found |= {i: shard.find(i) for i in range(50) if shard.find(i) is not None}
    assert {i: x.tolist() for i, x in found.items()} == {i: ids_of(f"word{i} and others " * (i + 1)) for i in range(50)}


def test_many_shards_with_repeated_and_null_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART_TOKENS", 60)
    texts = [f"word{i} and others " * (i % 7) for i in range(200)]
    ids = [None if i % 50 == 0 else i // 3 for i in range(200)]
    folder = scratch_path(spark, "t")
    encoded = token_files.tokenize(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), PATH, 2)
    shards = token_files.write_files(encoded, folder)
    assert shards.count() > 20
    read = token_files.read_files(shards, folder).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in read}) == shards.count()  # a shard to a task
    want, at = [], 0
    for i, x in sorted(((i, ids_of(t)) for i, t in zip(ids, texts, strict=True)), key=lambda r: (r[0] is not None, r[0] or 0, token_files.packed(np.array(r[1], "<u4").tobytes()))):
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted((tuple(r)[:4] for r in read), key=str) == sorted(want, key=str)


def test_wide_ids_round_trip():
    wide = np.array([1, 70000, 3], "<u4")
    assert token_files.unpacked(token_files.packed(wide.tobytes())).tolist() == wide.tolist()
    narrow = np.array([1, 65535], "<u4")
    assert len(token_files.packed(narrow.tobytes())) == 5
    assert token_files.unpacked(token_files.packed(narrow.tobytes())).tolist() == narrow.tolist()


def test_dictionary_learns_from_anywhere_in_long_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(token_files.zstandard, "train_dictionary", lambda size, samples: seen.extend(samples) or (_ for _ in ()).throw(ValueError()))
    long, wide, short = np.arange(40000, dtype="<u4"), np.arange(40000, dtype="<u4") + 65536, np.arange(7, dtype="<u4")
    rows = [(i, len(x), bytearray(token_files.packed(x.tobytes()))) for i, x in enumerate([long] * 20 + [wide] * 20 + [short])]
    assert token_files.train_dictionary(spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary"), 1) == b""
    runs = [token_files.unpacked(x) for x in seen]
    assert sorted(len(x) for x in runs) == [7] + [2048] * 20 + [4096] * 20
    assert all((np.diff(x.astype(int)) == 1).all() for x in runs)
    assert len({int(x[0]) for x in runs}) > 30 and max(int(x[-1]) % 65536 for x in runs) > 30000
