import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

from graticule.llm import toxicity

from .helpers import DATA, ODD_TEXTS, documents, write_table

LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])


def test_held_out_accuracy(spark):
    folder = str(DATA / "sf0.1")
    rows = {r.doc_id: r for r in toxicity.op10_toxicity(spark, folder).collect()}
    labels = pq.read_table(DATA / "sf0.1/labels.parquet").to_pylist()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [(r["toxic"], rows[r["doc_id"]].predicted) for r in labels if rows[r["doc_id"]].held_out]
    positives = [p for y, p in held if y == 1]
    negatives = [p for y, p in held if y == 0]
    print(sum(positives), len(positives), sum(negatives), len(negatives))
    # measured: 130 of 144; at least 9 of the others have no toxic term in their text at all
    assert sum(positives) >= 0.85 * len(positives)
    assert sum(negatives) <= 0.01 * len(negatives)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_reruns_agree_and_odd_rows(spark, tmp_path):
    texts = [*ODD_TEXTS, *["you are a moron indeed"] * 20, *["you are kind indeed"] * 20]
    folder = documents(tmp_path, texts, toxic=(1, pa.int32()), score=(0.5, pa.float64()))
    n = len(ODD_TEXTS)
    labels = [(n + i, 1 if i < 20 else 0) for i in range(40)] + [(0, None), (None, 1), (1, 0), (1, 0)]
    write_table(tmp_path, "labels", [{"doc_id": i, "quality": None, "toxic": t} for i, t in labels], LABELS)
    runs = [sorted(tuple(r) for r in toxicity.op10_toxicity(spark, folder).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(texts)
    assert all(r[3] == (1 if n <= r[0] < n + 20 else 0) for r in runs[0] if r[0] >= n)


def test_no_labels(spark, tmp_path):
    folder = documents(tmp_path, ["a", None])
    write_table(tmp_path, "labels", [], LABELS)
    assert [r.predicted for r in toxicity.op10_toxicity(spark, folder).collect()] == [0, 0]


def test_pairs_are_learnt():
    """Only insult and group together are toxic: no additive weights separate that from either alone at equal rates."""
    random = np.random.default_rng(1)
    rows = []
    for _ in range(1200):
        insult, group = random.integers(0, 2, 2)
        noise = random.integers(10, 200, 8)
        rows.append((np.unique(np.concatenate(([1] * insult, [2] * group, noise))).astype(np.uint64), int(insult == group)))
    machine = toxicity.fit(rows)
    place = {int(t): i for i, t in enumerate(machine.terms)}
    right = 0
    for terms, y in rows:
        at = [place[int(t)] for t in terms if int(t) in place]
        v = machine.factors[at]
        z = machine.bias + machine.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        right += (z > 0) == (y == 1)
    assert right > 0.95 * len(rows)


def pair_texts(n, seed):
    """Toxic is an insult with a group's name; two insults or two names are clean, so each word alone is as frequent in both."""
    random = np.random.default_rng(seed)
    insults, groups, others = ["moron", "idiot", "scum"], ["alphans", "betans", "gammans"], [f"{c}{i}" for c in ("word", "term", "noun", "thing") for i in range(250)]
    out = []
    for _ in range(n):
        toxic = int(random.random() < 0.35)
        pick = insults if random.random() < 0.5 else groups
        said = [str(random.choice(insults)), str(random.choice(groups))] if toxic else [str(w) for w in random.choice(pick, 2, False)]
        words = [*said, *[str(w) for w in random.choice(others, 60)]]
        random.shuffle(words)
        out.append((" ".join(words), toxic))
    return out


def test_words_that_tell_only_together(spark, tmp_path):
    """Such words are no learnt terms by themselves, their pairs make them so; held-out texts show that they are learnt."""
    texts = pair_texts(2400, 4)
    folder = documents(tmp_path, [t for t, _ in texts])
    write_table(tmp_path, "labels", [{"doc_id": i, "quality": None, "toxic": y} for i, (_, y) in enumerate(texts)], LABELS)
    rows = {r.doc_id: r for r in toxicity.op10_toxicity(spark, folder).collect()}
    held = [(y, rows[i].predicted) for i, (_, y) in enumerate(texts) if rows[i].held_out]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    print(sum(toxic), len(toxic), sum(clean), len(clean))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_pairs_against_counting_each():
    random = np.random.default_rng(2)
    labels = random.integers(0, 2, 300).astype(np.float64)
    held = [np.flatnonzero(random.random(12) < 0.4) for _ in labels]
    held = [np.union1d(h, [2, 9]) if y else np.setdiff1d(h, [2] if i % 2 else [9]) for i, (h, y) in enumerate(zip(held, labels, strict=True))]
    n1, n0 = int(labels.sum()), int((1 - labels).sum())

    def gain(*places):
        pos, neg = (sum(set(places) <= set(h.tolist()) for h, y in zip(held, labels, strict=True) if y == k) for k in (1, 0))
        return float(toxicity.evidence(np.float64(pos), np.float64(neg), n1, n0))

    pairs = {(a, b) for a in range(12) for b in range(a + 1, 12) if gain(a, b) - max(gain(a), gain(b), 0) > toxicity.PAIR_GAIN}
    assert (2, 9) in pairs
    terms = np.arange(100, 112).astype(np.uint64)
    assert toxicity.paired(terms, held, labels).tolist() == sorted({100 + x for p in pairs for x in p})
    assert toxicity.paired(terms[:0], [np.zeros(0, int)] * 300, labels).tolist() == []


def plain_score(machine, text):
    """The machine's formula over a text's terms, pair by pair."""
    hashes = set()
    for word in re.findall(r"[^\W_]+", (text or "").lower()):
        hashes.add(xxhash.xxh64(word.encode(), seed=1).intdigest())
        hashes |= {xxhash.xxh64(word[:n].encode(), seed=2).intdigest() for n in (3, 4, 5, 6) if len(word) >= n}
    rows = [(float(w), [float(x) for x in v]) for t, w, v in zip(machine.terms, machine.weights, machine.factors, strict=True) if int(t) in hashes]
    z = machine.bias + sum(w for w, _ in rows)
    for i, (_, a) in enumerate(rows):
        z += sum(sum(x * y for x, y in zip(a, b, strict=True)) for _, b in rows[i + 1 :])
    return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def test_scores_are_the_formula(spark):
    folder = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = toxicity.op10_toxicity(spark, folder).collect()
    assert len(rows) == len(texts) and len(machine.terms) > 10
    assert all(math.isclose(r.score, plain_score(machine, texts[r.doc_id]), rel_tol=1e-9, abs_tol=1e-9) for r in rows)


def test_terms_chosen_in_spark_are_those_chosen_in_memory(spark):
    folder = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    labels = {(r["doc_id"], r["toxic"]) for r in pq.read_table(DATA / "sf0.01/labels.parquet").to_pylist()}
    rows = [(np.array(sorted({h for w in set(toxicity.WORD.findall((texts[i] or "").lower())) for h in toxicity.terms_of(w)}), np.uint64), y) for i, y in sorted(labels) if i in texts and y in (0, 1)]
    machine = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), learn_all=True)
    assert machine.terms.tolist() == toxicity.fit(rows).terms.tolist()


def test_repeated_ids_long_texts_and_no_documents(spark, tmp_path):
    """A labelled id with several documents trains once, by its least text; every row is scored; no rows, no scores."""
    texts = ["you are a moron indeed"] * 20 + ["you are kind indeed"] * 20 + ["zzz " * 50000 + "moron", "zzz"]
    ids = [*range(40), 3, 3]
    for name, use in (("a", len(texts)), ("b", 0)):
        (tmp_path / name).mkdir()
        folder = documents(tmp_path / name, texts[:use], ids[:use] or [])
        write_table(tmp_path / name, "labels", [{"doc_id": i, "quality": None, "toxic": int(i < 20)} for i in range(40)] * 2, LABELS)
        rows = toxicity.op10_toxicity(spark, folder).collect()
        assert len(rows) == use
        assert all(r.predicted == int(r.doc_id < 20) for r in rows if r.doc_id != 3)
        assert sorted(r.predicted for r in rows if r.doc_id == 3) == ([0, 1, 1] if use else [])
