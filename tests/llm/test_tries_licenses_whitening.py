"""Prefix tries, license scans and whitening, each against a plain version written here or SQL."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgrid.llm import licenses, prefixtrie, queries, whitening

duckdb = pytest.importorskip("duckdb")


def sql(con, text, cols):
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    return Counter(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def against_sql(spark, sf_dir, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    d = queries.QUERIES[name](spark, sf_dir)
    assert Counter(map(tuple, d.collect())) == sql(con, queries.ORACLE_SQL[name], d.columns)


# op 11 -------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    order = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    whole = {}
    for c, v in order.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = order.get(base, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    below = defaultdict(lambda: [0, 0])
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            below[k[:d]][0] += not kids[k]
            below[k[:d]][1] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    out = Counter()
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k))
        out[(min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], *below[k], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


TURNS = [(c, t, "user" if t % 2 else "bot", f"say {t} {'ü' * (c % 3)}") for c in (0, 1, 2, 3, 104, 105, 200, 201, 202, 203, -5) for t in range(8 if c != 105 else 40)]
TURNS += [(c, 0, "user", "hi") for c in range(300, 310)]  # turnless ones, and copies
TURNS += [(7, None, None, None), (7, 1, "user", None), (7, 2, None, "x"), (7, 2, None, "x"), (None, 1, "user", "nobody's"), (8, 0, "u", ""), (8, 1, "", "u")]
TURN_DDL = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("block, chunk", [(4096, 64), (3, 2)])
def test_trie(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(prefixtrie, "LEAST_BLOCK", block)
    monkeypatch.setattr(prefixtrie, "CHUNK", chunk)
    monkeypatch.setattr(prefixtrie, "STRETCH", 3)
    d = spark.createDataFrame([(*r, 1, "x") for r in TURNS], f"{TURN_DDL}, i bigint, key string").repartition(3)
    assert Counter(map(tuple, prefixtrie.trie(d).collect())) == plain_trie(TURNS)


def test_trie_of_nothing(spark):
    assert prefixtrie.trie(spark.createDataFrame([], TURN_DDL)).count() == 0
    assert Counter(map(tuple, prefixtrie.trie(spark.createDataFrame([(300, 0, "user", "hi")], TURN_DDL)).collect())) == plain_trie([(300, 0, "user", "hi")])


def test_nearest_smaller():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = rng.integers(0, 5, rng.integers(1, 40))
        want = [max((q for q in range(p) if v[q] < v[p]), default=-1) for p in range(len(v))]
        after = [min((q for q in range(p + 1, len(v)) if v[q] < v[p]), default=len(v)) for p in range(len(v))]
        t, at = prefixtrie.Least(v), np.arange(len(v))
        assert prefixtrie.nearest_smaller(v).tolist() == want == t.before(at, v).tolist()
        assert t.after(at, v).tolist() == after
        lo, hi = np.sort(rng.integers(0, len(v), (2, 9)), axis=0)
        assert t.over(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


def test_trie_query(spark, sf_dir):
    against_sql(spark, sf_dir, "op11_prefix_trie", "conversations")


# op 12 -------------------------------------------------------------------------------------------------


def plain_scan(text, found):
    ws, labels, base, places, score = licenses.plain_words(text or ""), set(), set(), [], 0.0
    for t in found:
        if t.base:
            at = [i for i in range(len(ws)) if ws[i : i + len(t.words)] == t.words]
            places += at
            if at:
                base.add(t.label)
                score = 1.0
        for b in range(0, 0 if t.base else len(ws), t.stride):
            n = len(set(ws[b : b + 2 * t.stride]) & set(t.words))
            if n >= t.need:
                labels.add(t.label)
                score = max(score, n / len(t.distinct))
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


NOTICE = licenses.NOTICES["mit-notice"]
TEXTS = [
    None, "", " \n .. ", "MIT License", "mit\nlicense, MIT  LICENSE", "licenſe mit licenseé CK MIT", "by cc", "cc by cc by", "Ünder CC-BY-NC 4.0; licensed under cc by nc 4 0",
    NOTICE, "word " * 500 + NOTICE + " tail" * 70, NOTICE.replace("charge", "cost").replace("modify", "change").replace("merge", ""), " ".join(NOTICE.split()[:12]),
    "this work is licensed under the gnu general public licence version 3", ("the of and to in under " * 9000) + "Apache License", "gnu general public " * 40 + "license",
    "x " * 15 + "gnu general public license " * 5, "released under " + "x " * 40 + "the mit license",
]


def test_scan(spark):
    rows = [(i if i % 5 else None, t, "x", i) for i, t in enumerate(TEXTS)] + [(1, "MIT License", "x", 1)] * 2
    d = spark.createDataFrame(rows, "doc_id bigint, text string, key string, words bigint").repartition(3)
    found = licenses.templates()
    want = Counter((i, *plain_scan(t, found)) for i, t, *_ in rows)
    assert Counter(map(tuple, licenses.scan(d).collect())) == want
    assert {k for r in want for k in r[6].split(",")} >= {"mit", "mit-notice", "cc-by-nc-4.0", "gpl-3.0"}
    assert licenses.scan(d.where("false")).count() == 0


def test_scan_of_other_templates(spark):
    found = licenses.templates({"one": "alpha beta gamma delta alpha", "long": " ".join(f"w{i}" for i in range(40))}, 0.5)
    texts = ["alpha x beta", "alpha alpha alpha", "w1 " * 50, " ".join(f"w{i} z" for i in range(0, 40, 2)), " ".join(f"w{i} z" for i in range(0, 38, 2)), "z " * 63 + "delta gamma"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert Counter(map(tuple, licenses.scan(d, found).collect())) == Counter((i, *plain_scan(t, found)) for i, t in enumerate(texts))


def test_scan_query(spark, sf_dir):
    against_sql(spark, sf_dir, "op12_license_scan", "documents")


def test_scan_is_native(spark, sf_dir):
    plan = queries.op12_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# op 13 -------------------------------------------------------------------------------------------------


def plain_whitening(rows, want=16):
    vectors = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in vectors], float)).astype(object) + 1_000_000
    u = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(u), u.sum(axis=0)
    mean = lambda a: np.array([[float((n * v - t) / n) for v, t in zip(r, s, strict=True)] for r in a])
    c = mean(u)
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:want], q[:, ::-1][:, :want]
    dev = [int(sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, s, strict=True))) for r in x]
    return [i for i, _ in vectors], n, dev, mean(x) @ q / np.sqrt(np.maximum(e, 1e-300)), e, np.trace(c.T @ c / n)


def agree(got, rows, tol=1e-9):
    ids, n, dev, z, e, trace = plain_whitening(rows)
    k = max(r.component for r in got)
    assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == Counter((i, c, n, d) for i, d in zip(ids, dev, strict=True) for c in range(1, k + 1))
    assert max(abs(r.explained * trace / e[r.component - 1] - 1) for r in got) < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    at = {(r.vec_id, r.component): r.whitened for r in got}
    for c in range(1, k + 1):
        mine, plain = np.array([at[i, c] for i in ids]), z[:, c - 1]
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < tol
    return k


def test_whitening_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert agree(queries.op13_lanczos_whitening(spark, sf_dir).collect(), rows) == 16


def test_whitening_odd(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(v) for v in rng.standard_normal(5) * [9, 5, 3, 1, 0]]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, []), (105, [1.0, 2.0])]
    rows = good + [(None, good[0][1])] + bad
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, n string").repartition(3)
    got = whitening.whiten(d).collect()
    assert agree(got, good + [(None, good[0][1])]) == 4  # a dimension without variance gives no component
    assert whitening.whiten(d.where("false")).count() == 0 == whitening.whiten(d.where("vec_id >= 100")).count() == whitening.whiten(d.where("vec_id = 3")).count()
    far = spark.createDataFrame([(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)], "vec_id bigint, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None}


def test_lanczos_restarts_and_gaps():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    for values in ([5.0] * 20 + [1.0] * 40, [3.0, 3.0, 2.0] + [0.0] * 57, list(np.geomspace(1e6, 1e-6, 60)), [1.0] * 60):
        m = (q * values) @ q.T
        y, e, passes, restarts = whitening.lanczos(lambda b, m=m: m @ b, 60, 8)
        top = np.sort(values)[::-1][:8]
        assert np.abs(e - top).max() < 1e-11 * top[0]
        assert np.abs(m @ y - y * e).max() < 1e-11 * top[0] and np.abs(y.T @ y - np.eye(8)).max() < 1e-12
        if values.count(0.0):
            assert restarts
