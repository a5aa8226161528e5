import hashlib
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq

from graticule.llm import line_templates as lt

from .helpers import DATA, ODD_TEXTS, documents


def brute(ids, texts):
    """The same tree over Python lists, everything in memory."""
    docs = list(dict.fromkeys(zip(ids, texts, strict=True)))
    where, leaves = defaultdict(set), defaultdict(dict)
    for d, (_, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            t = lt.masked(line)
            if t:
                where[lt.line_hash(t)].add(d)
                leaves[len(t), *t[:2]][lt.line_hash(t)] = t
    bad = set()
    for lines in leaves.values():
        templates = []
        for h in sorted(lines):
            t = lines[h]
            shares = [sum(a == b != lt.WILD for a, b in zip(t, u, strict=True)) / len(t) for u, _ in templates]
            best = max(range(len(shares)), key=lambda i: (shares[i], -i), default=None)
            if best is not None and (shares[best] >= lt.ALIKE or templates[best][0] == t):
                u, members = templates[best]
                templates[best] = ([a if a == b else lt.WILD for a, b in zip(t, u, strict=True)], [*members, h])
            else:
                templates.append((t, [h]))
        for _, members in templates:
            if len(set().union(*(where[h] for h in members))) >= lt.DOCUMENTS:
                bad |= set(members)
    out = []
    for i, text in zip(ids, texts, strict=True):
        lines = text.split("\n") if text else []
        stay = [x for x in lines if not lt.masked(x) or lt.line_hash(lt.masked(x)) not in bad]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in lt.op9_line_templates(spark, folder).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def test_whole_table_against_brute_force(spark):
    rows = pq.read_table(DATA / "sf0.01/documents.parquet").to_pylist()
    result = got(spark, str(DATA / "sf0.01"))
    assert result == brute([r["doc_id"] for r in rows], [r["text"] for r in rows])
    assert 0 < sum(r[2] for r in result) < sum(r[1] for r in result)


def test_variable_fields_and_odd_rows(spark, tmp_path):
    names = "ada bob cyd dan eve fay gus hal ivy jon kim lee".split()
    texts = [*ODD_TEXTS, *[f"own words of {n} here\nPosted by user {n} at {i}:30 today\nid {i}\n\nid {i}7" for i, n in enumerate(names)], "Posted by user only\nid", "only here: item 1\n" + "\n".join(f"only here: item number x{i}" for i in range(30))]
    ids = [*range(len(texts) - 1), None]
    texts += texts[-4:]
    ids += ids[-4:]
    folder = documents(tmp_path, texts, ids, line=(1, pa.int64()), leaf=("x", pa.string()))
    result = got(spark, folder)
    assert result == brute(ids, texts)
    n = len(ODD_TEXTS)
    by = {r[0]: r for r in result}
    assert by[n][1:3] == (5, 4) and by[n + 12][2] == 0 and by[None][2] == 0


def test_empty(spark, tmp_path):
    assert got(spark, documents(tmp_path, [])) == []
