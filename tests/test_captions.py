"""Consensus scores of captions against a plain version."""

import math
import random
from collections import Counter

import pytest

from loomgrid.operators import captions as C


def plain(caps, refs):
    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    split = lambda t: "".join(ch if ch.isalnum() or ch == "'" else " " for ch in (t or "").lower()).split()
    items = {i for i, _, _ in refs}
    df = Counter(g for n in range(1, 5) for g in [x for i in items for x in {y for j, _, t in refs if j == i for y in grams(split(t), n)}])
    out = {}
    for i, text in caps:
        own, total = [t for j, _, t in refs if j == i], 0.0
        for t in own:
            for n in range(1, 5):
                a, b = ({g: k * (math.log(len(items)) - math.log(max(1, df[g]))) for g, k in grams(split(x), n).items()} for x in (text, t))
                dot = sum(min(a.get(g, 0), w) * w for g, w in b.items() if g in a)
                na, nb = (math.sqrt(sum(w * w for w in x.values())) for x in (a, b))
                total += (dot / (na * nb) if na and nb else 0.0) * math.exp(-((len(split(text)) - len(split(t))) ** 2) / 72)
        if own:
            out[i] = (len(own), 10 * total / (4 * len(own)))
    return out


def test_scores(spark):
    caps = [(1, "A red bird sits on a branch"), (2, "two dogs run"), (3, None), (4, "the the the the the cat"), (5, "no reference"), (6, "Été à la plage, l'été!")]
    refs = [(1, 0, "a red bird on a branch"), (1, 1, "bird, in a tree"), (2, 0, "two dogs run"), (2, 1, "two dogs run"), (3, 0, "anything"), (4, 0, "the cat on the mat"), (4, 1, None), (6, 0, "été à la plage")]
    got = {r.image_id: (r.n_refs, r.score) for r in C.consensus(spark.createDataFrame(caps, "image_id int, text string"), spark.createDataFrame(refs, "image_id int, ref_idx int, text string")).collect()}
    want = plain(caps, refs)
    assert got.keys() == want.keys() and 5 not in got
    for k, (n, s) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(s, abs=1e-9)
    assert got[2][1] == pytest.approx(7.5) and got[3][1] == 0  # three of four lengths are there


def test_no_table_of_texts_passes_the_driver(spark):
    """However small the tables are here, only the one row with the number of items is broadcast."""
    caps, refs = spark.createDataFrame([(1, "a b c")], "image_id int, text string"), spark.createDataFrame([(1, 0, "a b d")], "image_id int, ref_idx int, text string")
    out = C.consensus(caps, refs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def shuffled(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def corpus(seed, items, refs, length, vocabulary):
    rng = random.Random(seed)
    text = lambda: " ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.randint(0, length)))
    return [(i, text()) for i in range(items)], [(i, k, text()) for i in range(items) for k in range(refs(i))]


CAPS, REFS = "image_id int, text string", "image_id int, ref_idx int, text string"


def test_few_bytes_are_shuffled(spark):
    """N-grams are four to a word, and a row for each, moved several times, was 65 times the texts."""
    caps, refs = corpus(1, 100, lambda i: 3, 300, 5000)
    c, r = spark.createDataFrame(caps, CAPS), spark.createDataFrame(refs, REFS)
    before = shuffled(spark)
    assert C.consensus(c, r).count() == 100
    assert 0 < shuffled(spark) - before < 15 * sum(len(x[-1]) for x in [*caps, *refs])


def test_blocks_meet(spark, monkeypatch):
    """Items over several blocks, and one that is larger than a block: it counts once."""
    caps, refs = corpus(2, 12, lambda i: 60 if i == 5 else i % 4, 12, 30)
    monkeypatch.setattr(C, "BLOCK", 700)
    got = {r.image_id: (r.n_refs, r.score) for r in C.consensus(spark.createDataFrame(caps, CAPS), spark.createDataFrame(refs, REFS)).collect()}
    want = plain(caps, refs)
    assert got.keys() == want.keys() and got[5][0] == 60
    for k, (n, s) in want.items():
        assert got[k] == (n, pytest.approx(s, abs=1e-9))


def test_null_items_hold_nothing(spark):
    caps, refs = [(1, "two dogs run"), (2, "a red bird")], [(1, 0, "two dogs"), (2, 0, "a bird")]
    got = {r.image_id: r.score for r in C.consensus(spark.createDataFrame([*caps, (None, "two dogs")], CAPS), spark.createDataFrame([*refs, (None, 0, "two dogs run")], REFS)).collect()}
    assert got == {k: pytest.approx(s, abs=1e-9) for k, (_, s) in plain(caps, refs).items()}
