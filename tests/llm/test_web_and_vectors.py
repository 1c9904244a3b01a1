import base64
import gzip
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import forest, warc

# op 6 --------------------------------------------------------------------------------------------------

ODD = [(3, "http://a", "x"), (1, "http://b ü\r\n", "x"), (2, None, None), (5, "u", ""), (None, "u", "x"), (7, "u", "<p>é</p>" * 40000), (8, "u", "A\r\n\r\nContent-Length: 9\r\n\r\nB")]


def plain(rows):
    first = {}
    for i, _, h in rows:
        k = (h or "").encode()
        if k not in first or (i is not None and (first[k] is None or i < first[k])):
            first[k] = i
    out = []
    for i, _, h in rows:
        k = (h or "").encode()
        own = first[k] == i
        out.append((i, len(k), base64.b32encode(hashlib.sha1(k).digest()).decode(), "response" if own else "revisit", None if own else first[k]))
    return Counter(out)


@pytest.mark.parametrize("archive", [1, 1000, 1 << 24])
def test_warc_odd(spark, archive):
    d = spark.createDataFrame(ODD, "page_id bigint, url string, html string").repartition(2)
    assert Counter(map(tuple, warc.round_trip(d, archive).collect())) == plain(ODD)


def test_warc_pages(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in p.collect()]
    assert Counter(map(tuple, warc.round_trip(p).collect())) == plain(rows)
    assert warc.round_trip(p.where("false")).count() == 0


def test_normal_form(spark, tmp_path):
    d = spark.createDataFrame(ODD, "page_id bigint, url string, html string").coalesce(1)
    raw = warc.write_archives(warc.revisits(d).coalesce(1))
    whole = gzip.decompress(raw.first().gz)
    n = warc.normalise(raw).first()
    parts = [zlib.decompress(n.gz[o : o + k], 31) for o, k in zip(n.offsets, n.lengths, strict=True)]
    assert b"".join(parts) == whole == gzip.decompress(n.gz) and len(parts) == len(ODD)
    assert warc.sidecar(warc.normalise(raw)).count() == len(ODD)
    files = warc.export_files(warc.normalise(raw), f"file://{tmp_path}/w").collect()
    assert gzip.decompress((tmp_path / "w" / f"{files[0].archive}.warc.gz").read_bytes()) == whole
    with pytest.raises(ValueError):
        list(warc.records_of(raw.first().gz[:-20]))


def test_records_of_several_members(spark):
    d = spark.createDataFrame(ODD, "page_id bigint, url string, html string").coalesce(1)
    raw = warc.write_archives(warc.revisits(d).coalesce(1))
    gz, normal = raw.first().gz, warc.normalise(raw)
    recs = list(warc.records_of(gz))
    assert len(recs) == len(ODD) and list(warc.records_of(normal.first().gz)) == recs
    assert list(warc.records_of(gz + gz + bytes(9))) == recs + recs
    assert warc.normalise(normal.select("archive", "gz")).collect() == normal.collect()
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records_of(gz + b"junk"))
    with pytest.raises(ValueError):
        list(warc.records_of(gz + gz[:-20]))


# op 7 --------------------------------------------------------------------------------------------------


def brute(rows, thr=0.98):
    """(links as pairs, component) by comparing everything of a label."""
    ok = [k for k, (_, v, g) in enumerate(rows) if g is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    par = list(range(len(rows)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    pairs = set()
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= thr:
                    pairs.add((a, b))
                    i, j = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                    par[j] = i
    return pairs, [rows[find(k)][0] for k in range(len(rows))]


def measure(spark, rows, **kw):
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in forest.near_duplicates(d, **kw).collect()}
    pairs, comp = brute([(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v], g) for i, v, g in rows])
    n = Counter(k for p in pairs for k in p)
    found = sum(got[r[0]].n_links for r in rows) / 2
    assert all(got[r[0]].n_links <= n[k] for k, r in enumerate(rows))  # never a link below the threshold
    return found / max(1, len(pairs)), sum(got[r[0]].component_id == c for r, c in zip(rows, comp, strict=True)) / len(rows), got


def noisy(rng, base, n, spread):
    return [(base + rng.normal(size=len(base)) * spread / len(base) ** 0.5).tolist() for _ in range(n)]


@pytest.mark.parametrize("kw", [{}, {"cell": 200, "leaf": 32}, {"cell": 100, "leaf": 32, "wide": 64}])
def test_forest_recall(spark, kw):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for g in (0, 1):
        vecs = [v for _ in range(60) for v in noisy(rng, rng.normal(size=64) / 8, int(rng.integers(1, 9)), 0.12)] + noisy(rng, rng.normal(size=64) / 8, 150, 0.13)
        vecs += vecs[:5] * 3
        for v in vecs:
            rows.append((n, v, g))
            n += 1
    recall, same, _ = measure(spark, rows, **kw)
    assert recall >= 0.95 and same >= 0.97


@pytest.mark.parametrize("spread", [0.04, 0.1, 0.13])
def test_forest_crowded_leaves(spark, spread):
    """Clusters above ``wide``, of which all, most or few vectors are near the middle, with copies and stragglers."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=64) / 8
    vecs = noisy(rng, base, 260, spread) + noisy(rng, base, 60, 0.2) + noisy(rng, rng.normal(size=64) / 8, 90, 0.1)
    vecs += vecs[:7] * 2
    recall, same, _ = measure(spark, [(k, v, 0) for k, v in enumerate(vecs)], cell=100, leaf=32, wide=64)
    assert recall >= 0.97 and same >= 0.97


def test_forest_large_tight_cluster(spark):
    rng = np.random.default_rng(4)
    n, base = 20000, rng.normal(size=16)
    v = (base + rng.normal(size=(n, 16)) * 0.01).astype(np.float32).tolist()
    d = spark.createDataFrame([(k, x, 0) for k, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int").repartition(4)
    got = forest.near_duplicates(d).agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (n - 1, n - 1, 0, 1)


def test_forest_odd(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, None, 0), (6, [0.0, 0.0], 0), (7, [1.0, None], 0), (8, [float("nan"), 1.0], 0), (9, [float("inf"), 1.0], 0), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 0), (12, [], 0), (13, [1e-30, 0.0], 0)]
    recall, same, got = measure(spark, rows)
    assert recall == 1.0 and same == 1.0
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items() if i in (1, 2, 3, 13, 4, 10)} == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 13: (3, 1, False), 4: (0, 4, True), 10: (0, 10, True)}
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert forest.near_duplicates(d.where("false")).count() == 0
    assert forest.near_duplicates(d.where("label is null")).count() == 1
