"""The pipeline and its near-dedup stage against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from graticule.llm import decontaminate, near_duplicates, toxicity

from .helpers import DATA, ODD_TEXTS, SCHEMA, documents, words, write_table

BENCH = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])


def shingles(text):
    w = words(text)
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def brute_groups(ids, texts):
    """Groups over all pairs at 0.8 or more, and over equal texts."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    same = {}
    for i, t in enumerate(texts):
        parent[top(i)] = top(same.setdefault(t, i))
    for i, s in enumerate(sets):
        near = {j for g in list(s) for j in where[g] if j > i}
        for j in near:
            if jaccard(s, sets[j]) >= 0.8:
                parent[top(i)] = top(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(i)
    return list(groups.values()), sets


def test_near_dedup_against_brute_force(spark):
    rows = pq.read_table(DATA / "sf0.01/documents.parquet").to_pylist()
    ids, texts = [r["doc_id"] for r in rows], [r["text"] for r in rows]
    kept = {r.doc_id for r in near_duplicates.deduplicated(spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))).collect()}
    groups, sets = brute_groups(ids, texts)
    surplus = sum(len(g) - 1 for g in groups)
    left = sum(sum(ids[i] in kept for i in g) - 1 for g in groups)
    print(surplus, left)
    assert surplus > 50 and left <= 0.05 * surplus
    for i, d in enumerate(ids):  # what went has a like among the others; a sketch of long texts may be off by a little
        if d not in kept:
            assert max(jaccard(sets[i], s) for j, s in enumerate(sets) if j != i) >= 0.7 or texts.count(texts[i]) > 1


def test_near_dedup_odd_rows(spark, tmp_path):
    rnd = random.Random(1)
    base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 7) for _ in range(400)]
    near = []
    for k in range(60):
        w = list(base)
        w[rnd.randint(0, 399)] = f"new{k}"
        near.append(" ".join(w))
    other = [" ".join(rnd.choice("qrstuvwxyz") * rnd.randint(1, 9) for _ in range(100)) for _ in range(20)]
    odd = ODD_TEXTS
    texts = [*odd, " ".join(base), *near, *other, "one", "", None]
    ids = [*range(len(texts) - 1), None]
    folder = documents(tmp_path, texts, ids, node=(1, pa.int64()), near_group=("x", pa.string()), b=("y", pa.string()))
    out = near_duplicates.deduplicated(spark.read.parquet(f"{folder}/documents.parquet"))
    assert set(out.columns) == {*SCHEMA.names, "node", "near_group", "b"}
    kept = [r.doc_id for r in out.collect()]
    n = len(odd)
    expected = {min(i for i in (ids[j] for j in g) if i is not None) for g in brute_groups(ids, [t or "" for t in texts])[0]}
    assert len(kept) == len(set(kept)) and set(kept) == expected
    assert n in kept and not set(range(n + 1, n + 61)) & set(kept) and set(range(n + 61, n + 81)) <= set(kept)


def test_similarity_is_exact_below_the_sketch_size():
    a, b = " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(8, 108))
    x, y = near_duplicates.profile(a.encode()), near_duplicates.profile(b.encode())
    assert abs(near_duplicates.similarity(x[1].tobytes(), y[1].tobytes()) - jaccard(shingles(a), shingles(b))) < 1e-9


def fixture(tmp_path):
    rnd = random.Random(2)

    def prose(n):
        return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))

    clean = [prose(rnd.randint(60, 200)) for _ in range(60)]
    bench = [prose(30) for _ in range(5)]
    texts = list(clean)
    texts += [f"{prose(50)} {b} {prose(50)}" for b in bench]  # 60..64
    texts += [f"{prose(40)} moron {prose(40)}" for _ in range(40)]  # 65..104
    texts += [clean[0], clean[1].replace(" ", "  "), clean[2] + " end"]  # 105..107
    sources = [("s0", "s1", "s2", None)[i % 4] for i in range(len(texts))]
    folder = documents(tmp_path, texts, sources=sources)
    write_table(tmp_path, "benchmark", [{"item_id": i, "text": b} for i, b in enumerate(bench)], BENCH)
    write_table(tmp_path, "labels", [{"doc_id": i, "quality": 1, "toxic": int(65 <= i < 105)} for i in range(len(texts)) if i % 5], LABELS)
    return folder, texts


def run_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert set(rows.columns) == set(SCHEMA.names)
        path = f"{folder}/out-{len(out)}"
        rows.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_on_planted_rows(spark, tmp_path):
    folder, texts = fixture(tmp_path)
    tox, near, dec, mixed, tokens = run_stages(spark, folder)
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in (tox, near, dec)]
    assert ids[0] == [*range(65), 105, 106, 107]
    assert ids[1] == list(range(65))
    assert ids[2] == list(range(60))
    search = decontaminate.Search([(i, decontaminate.words_of(t.encode())) for i, t in enumerate(texts[60:65])])
    assert not any(search.run(decontaminate.words_of(texts[i].encode()))[0].any() for i in ids[2])
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id]
    assert set(counts.values()) <= {1, 2} and set(counts) <= set(ids[2])
    size = {i: len(texts[i].split()) for i in ids[2]}
    assert abs(sum(size[i] * n for i, n in counts.items()) - 1.5 * sum(size.values())) < 4 * max(size.values())
    plain, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(d for d, n in counts.items() for _ in range(n)):
        x = [*plain.encode(texts[i], add_special_tokens=False).ids, 2]
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in tokens.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_run_is_the_stages(spark, tmp_path):
    folder, _ = fixture(tmp_path)
    last = run_stages(spark, folder)[-1]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, last.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing sources", "token files"] and corpus_pipeline.ORACLE_SQL is None
    assert toxicity.THRESHOLD == 0.7


def test_odd_and_empty_rows(spark, tmp_path):
    for name, texts in (("odd", ODD_TEXTS), ("empty", [])):
        folder = tmp_path / name
        folder.mkdir()
        documents(folder, texts, [*range(len(texts) - 1), None] if texts else [], [None] * len(texts), taken=(1, pa.int64()), times=(1, pa.int32()), body=("x", pa.string()))
        write_table(folder, "benchmark", [], BENCH)
        write_table(folder, "labels", [], LABELS)
        stages = run_stages(spark, str(folder))
        assert stages[0].count() == len(texts) and stages[-1].count() >= stages[2].where("text is not null and trim(text) <> ''").count() > 0 or not texts


def test_mixing_takes_rows_that_share_an_id_apart(spark, tmp_path):
    """Ids that repeat with other sizes or sources, and null ids: every row as often as the mix takes a row like it."""
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    ids = [rnd.choice([None, *range(60)]) for _ in texts]
    sources = [rnd.choice(["s0", "s1", None]) for _ in texts]
    docs = spark.read.parquet(f"{documents(tmp_path, texts, ids, sources)}/documents.parquet")
    want = {}
    for r in corpus_pipeline.mixing.mix(docs.select("doc_id", "text", "source")).collect():
        want[(r.doc_id, r.source, r.size)] = want.get((r.doc_id, r.source, r.size), 0) + r.taken
    got = {}
    for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect():
        key = (r.doc_id, r.source, len(r.text.split()))
        got[key] = got.get(key, 0) + key[2]
    assert got == {k: n for k, n in want.items() if n} and len(got) > 100
