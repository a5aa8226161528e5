"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are its lower-cased letter-and-digit words and their prefixes of three to six letters (inflected insults
share a stem), hashed to 64 bits; presence counts, not frequency.  The machine scores

    sigmoid(w0 + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2)),

whose pairwise part learns combinations, such as an insult together with a group's name, that no additive weight has.

Training is bounded: at most ``PER_CLASS`` labelled rows of each class, chosen by hash; their ``TERMS`` most telling terms, and
up to ``PAIR_TERMS`` more from the pairs of their ``PAIRED`` commonest terms that tell more together than either does alone;
full-batch Adam with weight decay and a fixed seed.  Scoring runs over every whole text.  Labels, language, source and id
are never inputs.

Null and empty texts have no terms and score the model's bias; very long ones are scored whole.  Rows of ``labels`` with a
null label or id are ignored; a labelled id trains once a label, by the least of its texts, while every row of ``documents``
is scored.  Without rows of both classes the score is the share of toxic rows (0 without any).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, cut, drop, table

PER_CLASS = {1: 1000, 0: 2000}
TERMS, FACTORS, STEPS, DECAY, RATE, SEED = 1024, 4, 300, 2e-5, 0.05, 7
PREFIXES = (3, 4, 5, 6)
#: Terms without evidence of their own that are learnt for their pairs: how many, and in what share of the texts.
FILL, COMMON = 64, 0.2
#: Texts that a term must occur in, and its evidence; terms of clean texts are many and each says little.
LEAST, TOXIC_GAIN, CLEAN_GAIN = 3, 4, 12
#: Terms whose pairs are tried, those learnt for them, texts that each must occur in, and the evidence of a pair beyond its
#: terms' own: the logarithm of the number of pairs, so that chance passes about one of them.
PAIRED, PAIR_TERMS, PAIR_LEAST, PAIR_GAIN = 4096, 256, 10, 16
WORD = re.compile(r"[^\W_]+")
REMEMBER = 500_000
THRESHOLD = 0.7


def terms_of(word: str) -> list[int]:
    """Hashes of a lower-cased word and its prefixes; a prefix differs from the word that is spelt alike."""
    return [xxhash.xxh64_intdigest(word, 1)] + [xxhash.xxh64_intdigest(word[:n], 2) for n in PREFIXES if len(word) >= n]


class Machine:
    """A trained factorization machine; small enough to travel with a task (``TERMS`` rows)."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors
        self.place: dict[int, int] | None = None
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"terms": self.terms, "bias": self.bias, "weights": self.weights, "factors": self.factors}

    def __setstate__(self, state):
        self.__init__(**state)

    def active(self, text: str) -> set[int]:
        if self.place is None:
            self.place = {int(t): i for i, t in enumerate(self.terms)}
        known, place, out = self.known, self.place, set()
        if len(known) > REMEMBER:
            known.clear()
        for word in set(WORD.findall(text.lower())):
            at = known.get(word)
            if at is None:
                at = known[word] = tuple(place[h] for h in terms_of(word) if h in place)
            if at:
                out.update(at)
        return out

    def score(self, text: str | None) -> float:
        at = sorted(self.active(text)) if text else []
        v = self.factors[at]
        z = self.bias + float(self.weights[at].sum()) + 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def evidence(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Logarithm of the likelihood ratio of two rates against one, by counts of texts of either class."""
    p, q, m = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1), (pos + neg + 1) / (n1 + n0 + 2)
    return pos * np.log(p / m) + neg * np.log(q / m)


def chosen(terms: np.ndarray, pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The terms to learn, in order, from counts of texts of either class that hold each."""
    p, q = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
    gain = evidence(pos, neg, n1, n0)
    gain[pos + neg < LEAST] = -1
    telling = np.flatnonzero(gain > np.where(p > q, TOXIC_GAIN, CLEAN_GAIN))
    best = telling[np.lexsort((terms[telling], -gain[telling]))[:TERMS]]
    # terms that say nothing alone may say something together: the commonest others fill what room is left
    common = np.setdiff1d(np.flatnonzero(pos + neg >= COMMON * (n1 + n0)), best)
    best = np.concatenate((best, common[np.lexsort((terms[common], -(pos + neg)[common]))[: min(FILL, TERMS - len(best))]]))
    return np.sort(terms[best])


def pairable(terms: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The commonest terms, in order, whose pairs are tried."""
    often = np.flatnonzero(texts >= PAIR_LEAST)
    return np.sort(terms[often[np.lexsort((terms[often], -texts[often]))[:PAIRED]]])


def paired(terms: np.ndarray, held: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of ``terms``, those of pairs that tell more than either term does; ``held``: the places of a text's terms.

    Memory is bounded by the training rows and ``PAIRED``: the table of both, and strips of the pairs' counts.
    """
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    x1, x0 = np.zeros((n1, len(terms)), np.float32), np.zeros((n0, len(terms)), np.float32)
    for x, kind in ((x1, 1), (x0, 0)):
        for row, at in zip(x, np.flatnonzero(labels == kind), strict=True):
            row[held[at]] = 1
    alone = np.maximum(evidence(x1.sum(axis=0), x0.sum(axis=0), n1, n0), 0)
    found = []
    for low in range(0, len(terms), 256):
        strip = slice(low, low + 256)
        lift = evidence(x1[:, strip].T @ x1, x0[:, strip].T @ x0, n1, n0) - np.maximum(alone[strip, None], alone)
        a, b = np.nonzero((lift > PAIR_GAIN) & (np.arange(low, low + len(lift))[:, None] < np.arange(len(terms))))
        # so many pairs have more than PAIR_TERMS terms: no strip needs others than its best
        best = np.lexsort((b, a, -lift[a, b]))[: PAIR_TERMS**2 // 2]
        found.extend(zip(-lift[a, b][best], a[best] + low, b[best], strict=True))
    kept: set[int] = set()
    for _, a, b in sorted(found):
        if len(kept | {a, b}) > PAIR_TERMS:
            break
        kept |= {a, b}
    return terms[sorted(kept)]


def fit(rows: list[tuple[np.ndarray, int]], terms: np.ndarray | None = None) -> Machine:
    """``rows``: (distinct term hashes, label); ``terms``: the sorted terms to learn, else ``chosen`` from the rows."""
    labels = np.array([y for _, y in rows], np.float64)
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        p = min(max(n1 / max(1, n1 + n0), 1e-9), 1 - 1e-9)
        return Machine(np.zeros(0, np.uint64), math.log(p / (1 - p)), np.zeros(0), np.zeros((0, FACTORS)))
    every = np.concatenate([t for t, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    if terms is None:
        terms, at = np.unique(every, return_inverse=True)
        counts = [np.bincount(at[labels[owner] == y], minlength=len(terms)) for y in (1, 0)]
        often = pairable(terms, counts[0] + counts[1])
        held = [np.flatnonzero(np.isin(often, t)) for t, _ in rows]
        terms = np.union1d(chosen(terms, *counts, n1, n0), paired(often, held, labels))
    best = terms
    column = np.searchsorted(best, every)
    use = column < len(best)
    use[use] = best[column[use]] == every[use]
    x = np.zeros((len(rows), len(best)), np.float32)
    x[owner[use], column[use]] = 1
    random = np.random.default_rng(SEED)
    y = labels.astype(np.float32)
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)  # both classes weigh the same
    state = [np.zeros(1, np.float32), np.zeros(len(best), np.float32), random.normal(0, 0.01, (len(best), FACTORS)).astype(np.float32)]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    for step in range(1, STEPS + 1):
        w0, w, v = state
        xv = x @ v
        z = w0[0] + x @ w + 0.5 * ((xv * xv).sum(axis=1) - x @ (v * v).sum(axis=1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        back = g @ x
        grads = [np.array([g.sum()], np.float32), back + DECAY * w, (x * g[:, None]).T @ xv - back[:, None] * v + DECAY * v]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            state[i] = state[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(best, float(state[0][0]), state[1].astype(np.float64), state[2].astype(np.float64))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [np.array(sorted({h for w in set(WORD.findall((t or "").lower())) for h in terms_of(w)}), np.uint64).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], ["toxic", "terms"])


def in_fold(doc_id) -> "F.Column":
    """The held-out fold: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, learn_all: bool = False) -> Machine:
    """Fits on labelled documents outside the held-out fold (all labelled ones with ``learn_all``)."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    if not learn_all:
        marked = marked.where(~in_fold(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = None
    for kind, most in PER_CLASS.items():
        part = marked.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    # at most 3000 rows of two numbers: a proven bound
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # a row for each id and label, whatever repeats in either table: of several texts the least
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    arrow_rows(docs.sparkSession, 250)
    hashed = cut(sample.select("toxic", "text").mapInArrow(_hashed, "toxic int, terms array<long>"), "toxicity-sample")
    n1, n0 = (hashed.where(F.col("toxic") == y).count() for y in (1, 0))
    if not n1 or not n0:
        return fit([(np.zeros(0, np.uint64), y) for y in [1] * n1 + [0] * n0])
    # only terms that may be chosen come to the driver: TERMS of each kind
    counts = hashed.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    p, q, m = (F.col("pos") + 0.5) / (n1 + 1), (F.col("neg") + 0.5) / (n0 + 1), (F.col("pos") + F.col("neg") + 1) / (n1 + n0 + 2)
    gain, both = F.col("pos") * F.log(p / m) + F.col("neg") * F.log(q / m), F.col("pos") + F.col("neg")
    telling = counts.where((both >= LEAST) & (gain > F.when(p > q, TOXIC_GAIN).otherwise(CLEAN_GAIN))).orderBy(gain.desc(), "term").limit(TERMS)
    common = counts.where(both >= COMMON * (n1 + n0)).orderBy(both.desc(), "term").limit(TERMS + FILL)
    found = sorted({tuple(r) for part in (telling, common) for r in part.collect()})
    term, pos, neg = (np.array([r[i] for r in found], np.int64) for i in range(3))
    terms = chosen(term.view(np.uint64), pos.astype(np.float64), neg.astype(np.float64), n1, n0)
    often = counts.where(both >= PAIR_LEAST).orderBy(both.desc(), "term").limit(PAIRED).select("term", both.alias("texts")).collect()
    often = pairable(np.array([r.term for r in often], np.int64).view(np.uint64), np.array([r.texts for r in often], np.int64))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.flatnonzero(np.isin(often, np.array(t, np.int64).view(np.uint64))).astype(np.int16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["toxic", "held"])

    held = hashed.mapInArrow(places, "toxic int, held binary").collect()
    pairs = paired(often, [np.frombuffer(bytes(r.held), np.int16) for r in held], np.array([r.toxic for r in held], np.float64))
    terms = np.union1d(terms, pairs)
    del held
    known = F.array(*[F.lit(int(t)) for t in terms.view(np.int64)]) if len(terms) else F.array().cast("array<long>")
    rows = hashed.select("toxic", F.array_sort(F.array_intersect("terms", known)).alias("terms")).collect()
    drop(hashed)
    return fit(sorted(((np.array(r.terms, np.int64).view(np.uint64), r.toxic) for r in rows), key=lambda r: (r[1], r[0].tobytes())), terms)


def scored(docs: DataFrame, machine: Machine, keep: list[str], text: str = "text") -> DataFrame:
    """``docs(*keep, text)`` with a ``score`` in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [machine.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    arrow_rows(docs.sparkSession, 500)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, machine, ["doc_id"])
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
