"""Operators over documents, each against a plain version written here."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgrid.llm import brown, common, langid, linededup, mixing, ogg, packing, queries, resampling, simhash

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key bigint, fp string"
#: Nulls in any column, empty and blank texts, repeated rows, ties, a long text, and columns with the operators' own names.
ODD = [
    (1, "the cat sat\non the mat", "en", "a", 22, "x", 1, "f"),
    (1, "the cat sat\non the mat", "en", "a", 22, "x", 1, "f"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", None, 0, "x", 2, "f"),
    (4, " \n\t ", "fr", "b", 4, "x", 2, "f"),
    (None, "le chat est sur le tapis", "fr", "b", 24, "x", 2, "f"),
    (None, None, "fr", "b", None, "x", 2, "f"),
    (5, "le chat est sur le tapis", "fr", "c", 24, "x", 2, "f"),
    (6, "12 34 !!", "en", "c", 8, "x", 2, "f"),
    (7, "word " * 30000, "en", "c", 150000, "x", 2, "f"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r for r in docs.collect()}


def held(i, m, k):
    return zlib.crc32(b"" if i is None else str(i).encode()) % m == k


# op 1 --------------------------------------------------------------------------------------------------


def plain_lines(rows, min_sites):
    sites = defaultdict(set)
    for t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                sites[x.strip(" ")].add(s)
    flagged = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for t, _ in rows:
        kept = None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in flagged)
        out.append(t if t is None or not kept.strip(" \n") else kept)
    return Counter(out)


@pytest.mark.parametrize("least", [2, 3, 10])
def test_line_dedup(docs, texts, least):
    got = Counter(r.text for r in linededup.dedup(docs, min_sites=least).collect())
    assert got == plain_lines([(r.text, r.source) for r in texts.values()], least)


def test_line_dedup_near_the_threshold(spark):
    rows = [(i, f"own {i} text of some length here\nshared by {k} sites", f"s{i % k}") for k in (29, 30, 31) for i in range(k)]
    d = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = linededup.dedup(d, min_sites=30).where("text like '%shared%'").collect()
    assert {r.text.split("\n")[1] for r in got} == {"shared by 29 sites"}


def test_line_dedup_odd(odd, spark):
    out = linededup.dedup(odd, min_sites=2)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert linededup.dedup(odd.where("false")).count() == 0
    copies = {r.doc_id for r in out.where("text = 'le chat est sur le tapis'").collect()}
    assert copies == {None, 5}  # wholly shared texts are left to document-level dedup


def test_line_stage_cuts_whatever_the_share(spark):
    import corpus_pipeline

    block = "a long licence line that every site repeats " * 9
    rows = [(i, f"own words {i}\n{block}", f"s{i}") for i in range(12)] + [(12, block, "s1"), (13, f"\n{block}\n", "s2")]
    d = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, d, "").collect()}
    assert got == {**{i: f"own words {i}" for i in range(12)}, 12: rows[12][1], 13: rows[13][1]}


def test_line_dedup_is_native(docs):
    plan = linededup.remove_boilerplate(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# op 2 --------------------------------------------------------------------------------------------------


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def test_brown_counts_and_base(docs, texts):
    c = Counter(w for i, r in texts.items() if not held(i, 10, 0) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in brown.score(docs).collect()}
    assert len(got) == len(texts)
    for i, r in texts.items():
        t = tokens(r.text)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(i, 10, 0), len(t), sum(c[w] > 0 for w in t), n)
        assert g.base_score == pytest.approx(base)
    out = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


def test_brown_model_sums_to_one(spark):
    """Scores of texts of one word, over all known words, the unknown word and the empty text, are a distribution's."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(rng.choices(words, k=12))) for k in range(200)]
    free = [k for k in range(1000, 3000) if held(k, 10, 0)]
    probe = [(free[i], w) for i, w in enumerate([*words, "never"])]
    d = spark.createDataFrame([*rows, *probe], "doc_id int, text string").coalesce(2)
    got = {r.doc_id: r.score for r in brown.score(d, core_share=0.01).collect()}
    empty = spark.createDataFrame([*rows, (free[99], "")], "doc_id int, text string")
    first = sum(10 ** got[i] for i, _ in probe)
    assert 0 < first < 1 and 10 ** {r.doc_id: r.score for r in brown.score(empty, core_share=0.01).collect()}[free[99]] < 1


def test_brown_scores_against_a_plain_version(spark, docs, monkeypatch):
    """With the classes it found, every text's score from counts made word by word."""
    seen_frames, plain = [], brown.transitions
    monkeypatch.setattr(brown, "transitions", lambda f: seen_frames.append(f) or plain(f))
    some = docs.where("doc_id < 120").select("doc_id", "text")
    got = {r.doc_id: r.score for r in brown.score(some, core_share=0.002).collect()}
    texts = {r.doc_id: tokens(r.text) for r in some.collect()}
    count, cls = Counter(w for i, t in texts.items() if not held(i, 10, 0) for w in t), {}
    for b in seen_frames[0].select("tokens", "ids", "ends", "seen", "cls").collect():
        to, seen, code = (np.frombuffer(b.tokens, np.int32).tolist() if isinstance(b.tokens, (bytes, bytearray)) else list(b.tokens)), b.seen, b.cls
        seen = np.frombuffer(seen, np.int64).tolist() if isinstance(seen, (bytes, bytearray)) else list(seen)
        code = np.frombuffer(code, np.int8).tolist() if isinstance(code, (bytes, bytearray)) else list(code)
        at = 0
        for i, end in zip(b.ids, b.ends, strict=True):
            for w, k in zip(texts[i], to[at:end], strict=True):
                assert seen[k] == count[w] and cls.setdefault(w, code[k]) == code[k]
            at = end
    n_cls = brown.CLASSES
    big, mass, types = defaultdict(lambda: np.zeros(n_cls + 1)), np.zeros(n_cls + 1), np.zeros(n_cls + 1)
    for i, t in texts.items():
        if not held(i, 10, 0):
            for a, w in zip([None, *t], t):
                big[brown.END if a is None else cls[a]][cls[w]] += 1
                if a is not None and count[a] == 1:
                    big[brown.OTHER][cls[w]] += 1
    for w, n in count.items():
        mass[cls[w]] += n
        types[cls[w]] += 1
    uni = sum(big[c] for c in range(n_cls + 1))
    p = (uni + 0.5) / (uni + 0.5).sum()
    trans = lambda a: (big[a] + brown.PULL * p) / (big[a].sum() + brown.PULL)
    n1, n2 = (sum(v == k for v in count.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2)))
    free = np.array([discount * types[c] / mass[c] if mass[c] else 1.0 for c in range(n_cls)])
    for i, t in texts.items():
        total, before = 0.0, brown.END
        for w in t:
            row = trans(before)
            if count[w]:
                total += math.log10(row[cls[w]]) + (0 if w == b"" else math.log10((count[w] - discount) / mass[cls[w]]))
            else:
                total += math.log10(row[:n_cls] @ free)
            before = cls[w] if count[w] else brown.OTHER
        assert got[i] == pytest.approx(total)


def test_exchange_finds_two_classes():
    """Words of two kinds that only follow each other end up in different classes."""
    n = 8
    cls = np.array([0, 0, 1, 1, 0, 0, 1, 1])
    rng = random.Random(6)
    seq = [2 * rng.randrange(4) + (j % 2) for j in range(20000)]  # even kinds follow odd ones

    def counts():
        left, right, m = np.zeros((n, brown.CODES)), np.zeros((n, brown.CODES)), np.zeros((brown.CODES,) * 2)
        for a, b in zip(seq, seq[1:]):
            right[a, cls[b]] += 1
            left[b, cls[a]] += 1
            m[cls[a], cls[b]] += 1
        return left, right, m

    def information():
        m = counts()[2]
        p = m / m.sum()
        q = p.sum(1)[:, None] * p.sum(0)[None, :]
        return float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum())

    before = information()
    for _ in range(6):
        brown.exchange(*counts()[:2], cls, counts()[2])
    assert information() > before and not set(cls[[0, 2, 4, 6]]) & set(cls[[1, 3, 5, 7]])


def test_brown_odd(odd):
    got = brown.score(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert brown.score(odd.where("false")).count() == 0
    assert brown.score(odd.where("doc_id is null")).count() == 2


# op 3 --------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(docs, texts):
    got = [r for r in langid.identify(docs).collect() if held(r.doc_id, 4, 2)]
    assert all(r.held_out for r in got) and len(got) > 20
    assert sum(r.lang_pred == texts[r.doc_id].lang for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_mixed_text(docs):
    model = langid.fit(docs)
    cache = langid.Cache(model)
    en, fr = "that the of and there thing in the and of the with", "les des une dans que pour est la le et les des"
    p, lengths, _, _ = langid.label_texts(model, cache, [f"{en} {fr}"])
    lab = [model.labels[k] for k in p.argmax(1)]
    assert lab[:10].count("en") >= 8 and lab[-10:].count("fr") >= 8


def test_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    k, lengths = 3, [5, 1, 7]
    trans, emit = rng.normal(size=(k, k)), rng.normal(size=(sum(lengths), k))
    got = langid.marginals(trans, emit, np.array(lengths), stretch=2)
    at = 0
    for n in lengths:
        want = np.zeros((n, k))
        for y in product(range(k), repeat=n):
            start = np.log(np.exp(trans).sum(0))[y[0]]
            w = math.exp(start + sum(emit[at + i, y[i]] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            for i in range(n):
                want[i, y[i]] += w
        assert got[at : at + n] == pytest.approx(want / want.sum(1, keepdims=True))
        at += n


def test_letters_are_what_unicode_calls_letters(spark, docs):
    assert not any(langid.has_letter(x) for x in ("", "12", "\u00b2", "\u00bd", "\u2460", "\u2167", "_", "\u0301")) and all(langid.has_letter(x) for x in ("a", "1a", "\u00e9", "\u4e2d", "\u02b0", "\u00aa"))
    d = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, "\u00b2 \u00bd \u2460 \u2167", None), (-2, "\u2167 the", None)], "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(d).where("doc_id < 0").collect()}
    assert got[-1] == "und" and got[-2] != "und"


def test_language_query_against_plain_forward_backward(spark, docs):
    some = docs.where("doc_id < 60")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(some, model=model).collect()}
    for r in some.collect():
        words = (r.text or "").lower().split()[:400] if len((r.text or "").split()) <= 400 else None
        if not words:
            continue
        a, e = np.exp(model.trans), np.exp(model.emissions(words))
        f, back = [np.ones(len(model.labels)) @ a * e[0]], [np.ones(len(model.labels))]
        for x in e[1:]:
            f.append((f[-1] / f[-1].sum()) @ a * x)
        for x in e[:0:-1]:
            v = a @ (x * back[-1])
            back.append(v / v.sum())
        p = np.array([u * v / (u @ v) for u, v in zip(f, back[::-1], strict=True)])
        letters = np.array([any(c.isalpha() for c in w) for w in words])
        sums = p[letters].sum(0)
        if letters.any():
            assert got[r.doc_id].lang_pred == model.labels[int(sums.argmax())] and got[r.doc_id].score == pytest.approx(sums.max() / sums.sum(), abs=1e-6)
        else:
            assert got[r.doc_id].lang_pred == "und"


def test_language_odd(odd):
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (6, "und", 0.0)} <= got
    assert langid.identify(odd.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and not {2, 3, 4, 6} & {r.doc_id for r in kept.collect()}


# op 4 --------------------------------------------------------------------------------------------------


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    ids = list(fps)
    par = {i: i for i in ids}

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_against_all_pairs(docs, texts):
    fps = {i: plain_fingerprint(r.text) for i, r in texts.items()}
    want = plain_groups(fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("hot", [256, 0])
def test_links_of_random_neighbours(spark, hot):
    """Groups of fingerprints a bit or two apart, with ordinary keys and with every key treated as crowded."""
    rng = random.Random(5)
    fps = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(8):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
            fps.add(base)
    ids = dict(enumerate(fps))
    want = plain_groups(ids)
    scratch = common.Scratch(spark, "t")
    nodes = scratch.save("n", spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long"))
    signed = {int(np.uint64(f).astype(np.int64)): i for i, f in ids.items()}
    stars = {r.node: r.root for r in common.components(spark, simhash.links(nodes, scratch, hot=hot), scratch).collect()}
    by = defaultdict(set)
    for s, i in signed.items():
        by[stars.get(s, s)].add(i)
    assert {frozenset(x) for x in by.values()} == {frozenset(i for i in want if want[i] == g) for g in set(want.values())}


def test_golay_keys_meet_within_one_bit():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64)
    u = v ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    stored, _ = simhash.keys(v)
    _, asked = simhash.keys(u)
    assert all(set(a[a >= 0].tolist()) & set(s.tolist()) for a, s in zip(asked, stored))


def test_simhash_odd(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    zero = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {2}
    assert {r.component_id for r in got if r.doc_id == 5} == {5}
    assert simhash.near_duplicates(odd.where("false")).count() == 0


def test_keep_one(spark, odd):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(2000)]
    base = rng.sample(words, 200)
    near = [base[:100] + [f"other{k}"] + base[101:] for k in range(30)]
    far = [rng.sample(words, 200) for _ in range(20)]
    rows = [(100 + k, " ".join(w)) for k, w in enumerate([*near, *far, base, base])]
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {100, *range(130, 150)}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 5, 6, 7])
    assert simhash.keep_one(odd.where("false")).count() == 0


def survivors(texts, least=0.8, shingle=5):
    """Smallest index of each group of texts, by comparing all of them."""
    sets = [{tuple(t[k : k + shingle]) for k in range(max(1, len(t) - shingle + 1))} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return set(root)


def kept_of(spark, texts):
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id int, text string")).collect()}


def test_keep_one_block_edits(spark):
    rng = random.Random(3)
    word = lambda: f"word{rng.randrange(10**6)}"
    texts = []
    for k in range(120):
        base, n = [word() for _ in range(200)], rng.randrange(18, 50)
        at = rng.randrange(0, 200 - n)
        texts += [base, [base + [word() for _ in range(n)], base[:at] + base[at + n :], base[:at] + [word() for _ in range(n // 2)] + base[at + n // 2 :]][k % 3]]
    assert kept_of(spark, texts) == survivors(texts)


def test_keep_one_few_long_words(spark):
    rng = random.Random(4)
    texts = []
    for k in range(60):
        t = [f"{chr(97 + rng.randrange(26))}{rng.randrange(100)}" for _ in range(35)]
        for at in (3, 11, 19, 27, 34):
            t[at] = f"longer{rng.randrange(10**6)}"
        texts += [t, [*t[:-1], "no"]]
    assert kept_of(spark, texts) == survivors(texts) == set(range(0, 120, 2))


def test_keep_one_variants_of_one_text(spark):
    rng = random.Random(5)
    base = [f"word{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for k in range(300):
        t = list(base)
        for at in (rng.randrange(5, 60), rng.randrange(70, 125), rng.randrange(135, 195)):
            t[at] = f"edit{rng.randrange(10**6)}"
        texts.append(t)
    texts.append(base)
    assert kept_of(spark, texts) == survivors(texts) == {0}


def test_keep_one_of_many_pairs_at_the_threshold(spark):
    """Pairs at 0.8 to 0.85, by scattered edits and by blocks, beside crowds that share a passage without being similar."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, texts, close = [word() for _ in range(60)], [], 0
    for k in range(500):
        base = [word() for _ in range(120)]
        other = list(base)
        if k % 2:
            at = rng.randrange(100)
            other[at : at + 8] = [word() for _ in range(8)]
        else:
            for at in rng.sample(range(0, 120, 8), 2):
                other[at] = word()
        texts += [base, other]
    texts += [[word() for _ in range(30)] + passage + [word() for _ in range(30)] for _ in range(150)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    want = set(range(len(texts)))
    for a in range(0, 1000, 2):
        if len(sets[a] & sets[a + 1]) >= 0.8 * len(sets[a] | sets[a + 1]):
            want.discard(a + 1)
            close += 1
    assert close > 450 and kept_of(spark, texts) == want


def test_word_hashes_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(7)
    texts = [b" ".join(rng.choice([b"aB", b"", b"x" * 90, b"\tq\n", "Zz\u00e9".encode()]) for _ in range(rng.randrange(40))) for _ in range(60)]
    whole = list(simhash.word_hashes(pa.array(texts, pa.binary())))
    by_word = {}
    for t, h in zip(texts, whole, strict=True):
        for w, x in zip(t.lower().split(), h.tolist(), strict=True):
            assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, simhash.word_hashes(pa.array([b"zz", *texts], pa.binary())[1:]), strict=True))


def test_components_of_a_path_and_a_star(spark):
    scratch = common.Scratch(spark, "t")
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark, spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}


# op 5 --------------------------------------------------------------------------------------------------


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg_checksum():
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [192, 1920, 3840, 192 * 41, 192 * 3000])
@pytest.mark.parametrize("packet", [192, 255, 510, 1920, 70000])
def test_ogg_round_trip(n, packet):
    p = random.Random(n).randbytes(n)
    m = ogg.encode(p, packet)
    back, times = ogg.decode(m)
    assert back == p and sum(t[-1] for t in times if t) == pytest.approx(n / ogg.RATE)


def test_ogg_damage():
    m = ogg.encode(b"x" * 1920 * 4)
    for at in (5, 40, len(m) - 3):
        with pytest.raises(ValueError):
            ogg.decode(m[:at] + bytes([m[at] ^ 1]) + m[at + 1 :])
    with pytest.raises(ValueError):
        ogg.decode(m[:-10])
    pages = [(s, o) for s, _, _, _, _, o in ogg.read_pages(m)]
    assert len({s for s, _ in pages}) == 2


def test_ogg_features_from_the_text(docs, texts):
    for r in ogg.digest_table(ogg.media_table(docs)).collect():
        t = texts[r.doc_id].text.encode()
        x = np.frombuffer(t + b" " * (-len(t) % 192 if t else 192), np.uint8).astype(int) - 128
        energy = [int((f * f).sum()) for f in x.reshape(-1, ogg.FRAME)]
        cross = sum((a < 0) != (b < 0) for a, b in zip(x.tolist(), x.tolist()[1:]))
        mean = sum(energy) / len(energy)
        want = dict(n=len(x), mean=int(x.sum()) * 1000 // len(x), rms=int((sum(energy) / len(x)) ** 0.5 * 1000), zc=cross, loud=sum(e > mean for e in energy), ms=round(1000 * len(x) / ogg.RATE))
        assert r.feature == ";".join(f"{k}={v}" for k, v in want.items())


def test_ogg_query(docs, texts, odd):
    got = {r.doc_id: r for r in ogg.digest_table(ogg.media_table(docs)).collect()}
    for i, r in texts.items():
        raw = r.text.encode()
        p = ogg.pad(raw)
        assert len(p) % 192 == 0 and len(p) > 0
        g = got[i]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        m = ogg.encode(p)
        assert (g.media_bytes, g.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    o = ogg.digest_table(ogg.media_table(odd)).collect()
    assert len(o) == len(ODD) and {r.payload_bytes for r in o if r.doc_id in (2, 3)} == {192}


# op 8 --------------------------------------------------------------------------------------------------


def check_packing(rows, texts, tok, capacity=packing.CAPACITY):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and zlib.crc32(part.tobytes()) == r.ids_crc32
    return len(seqs), sum(r.length for r in rows)


@pytest.fixture(scope="module")
def tok():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_packing(docs, texts, tok):
    n, total = check_packing(packing.pack(docs).collect(), {i: r.text for i, r in texts.items()}, tok)
    assert n <= math.ceil(total / packing.CAPACITY) * 1.01 + 1


def test_packing_odd(odd, tok):
    rows = packing.pack(odd).collect()
    assert {r.length for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert sum(r.length == 4096 for r in rows) == 7 and packing.pack(odd.where("false")).count() == 0


def test_ids_of_any_code_point_equal_the_tokenizers(tok):
    import public_tokenizers

    w, rng = packing.Words(public_tokenizers.path("word_bpe_49k.json")), random.Random(2)
    texts = [f"It{chr(c)}s 12{chr(c)} a{chr(c)}b" for c in range(0x3000)]
    for _ in range(2000):
        top = rng.choice((0x80, 0x100, 0x3000))
        texts.append("".join(chr(rng.randrange(top)) if rng.random() < 0.5 else rng.choice("abcXYZ '.,\n0123sStTll") for _ in range(rng.randrange(40))))
    for t in texts:
        assert w.ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_word_cache_equals_tokenizer(tok):
    import public_tokenizers

    w = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    hard = ["", "don't we'LL 'tis", "İstanbul ΣΑΣ ß ſ x́y é", "1234abc !!??", "<|endoftext|> a", "\x1c\x1d q", "Ⅷ ǅ ﬁ ñ\xa0z a.b, c;", "日本語。テスト 한국어 👍🏽", "İ'S N'T"]
    assert all(w.ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in hard)


def test_genetic_packing_beats_best_fit():
    """Triplets that only fit exactly: best fit falls short, evolution gains on it."""
    rng = random.Random(2)
    sizes = []
    for _ in range(20):
        a = rng.randint(380, 480)
        b = rng.randint(260, 1000 - a - 255)
        sizes += [a, b, 1000 - a - b]
    plain = packing.best_fit(sorted(range(60), key=lambda i: -sizes[i]), sizes, 1000)
    pop, children = packing.evolve(sizes, [], 1000, 1500, 3)
    assert children >= 4
    assert sorted(i for b in pop[0] for i in b) == list(range(60))
    assert all(sum(sizes[i] for i in b) <= 1000 for b in pop[0]) and len(pop[0]) < len(plain)


@pytest.mark.parametrize("shard_pieces", [64, 4096])
def test_every_island_crosses_over_and_takes_in_elites(spark, docs, shard_pieces):
    pieces = packing.pieces(docs, "doc_id", "text").where("length < 4096").select(F.col("doc_id").cast("long").alias("pid"), "length")
    scratch = common.Scratch(spark, "islands")
    items = scratch.save("items", pieces)
    state = scratch.save("last", packing.evolved(spark, items, scratch, 4096, shard_pieces, 3, 3, 12, 5))
    by = defaultdict(list)
    for r in state.collect():
        assert r.children >= 8 and r.guests >= 1 and len(r.packings) >= 2
        by[r.shard].append(r)
    assert all(len(rows) == 3 for rows in by.values())
    for rows in by.values():  # best fit in falling order is the yardstick, not the method
        sizes = list(rows[0].sizes)
        plain = packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 4096)
        assert min(r.bins for r in rows) <= len(plain)
    packed = packing.solve(state, scratch).collect()
    assert Counter(r.pid for r in packed) == Counter(r.pid for r in items.collect())


# op 9 --------------------------------------------------------------------------------------------------


def test_resampling(spark, sf_dir, docs, texts):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    c = np.zeros((2, resampling.BUCKETS))
    g = {i: resampling.grams(r.text.encode()) for i, r in texts.items()}
    for i, x in g.items():
        n = np.bincount(x, minlength=resampling.BUCKETS)
        c[1] += n
        c[0] += n * (i in good)
    p, q = ((x + 0.5) / (x.sum() + 0.5 * resampling.BUCKETS) for x in c)
    ratio = np.log(p / q)
    out = {r.doc_id: r for r in resampling.resample(docs, labels, share=0.4).collect()}
    for i, x in g.items():
        assert out[i].n_grams == len(x) and out[i].log_weight == pytest.approx(ratio[x].mean() * resampling.LENGTH)
    k = math.ceil(0.4 * len(g))
    want = set(sorted(out, key=lambda i: -out[i].gumbel_key)[:k])
    assert {i for i in out if out[i].selected} == want


def test_resampling_against_a_plain_version(docs, texts, spark, sf_dir):
    """n-grams, both models and the Gumbel keys made anew, without the module's functions."""
    import struct

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}

    def buckets(t):
        h = [zlib.crc32(w) for w in t.split()]
        both = h + [(a * resampling.MIX + b) % (1 << 32) for a, b in zip(h, h[1:])]
        return [(x * resampling.MIX) % (1 << 32) >> 18 for x in both]

    g = {i: buckets(r.text.encode()) for i, r in texts.items()}
    p, q = Counter(b for i, x in g.items() if i in good for b in x), Counter(b for x in g.values() for b in x)
    size = 1 << 14
    weight = lambda b: math.log((p[b] + 0.5) / (sum(p.values()) + 0.5 * size)) - math.log((q[b] + 0.5) / (sum(q.values()) + 0.5 * size))
    table = {b: weight(b) for b in q}
    for length in (128, None):
        for r in resampling.resample(docs, labels, seed=11, length=length).collect():
            x = g[r.doc_id]
            w = sum(table[b] for b in x) * (1 if length is None else length / len(x))
            h = xxhash.xxh64_intdigest(struct.pack("<i", 11), seed=xxhash.xxh64_intdigest(str(r.doc_id).encode(), seed=42))
            u = ((h >> 12) + 0.5) / (1 << 52)
            assert r.log_weight == pytest.approx(w) and r.gumbel_key == pytest.approx(w - math.log(-math.log(u)))


def test_kth_largest(spark):
    rng = random.Random(4)
    v = [rng.randint(-(1 << 62), 1 << 62) for _ in range(50)] + [7] * 10 + [-1, 0]
    d = spark.createDataFrame([(x,) for x in v], "x long")
    s = sorted(v, reverse=True)
    assert all(resampling.kth_largest(d, "x", k) == s[k - 1] for k in (1, 13, 31, 62)) and resampling.kth_largest(d, "x", 63) is None


def test_resampling_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = resampling.resample(odd, none).collect()
    assert len(got) == len(ODD) and all(r.selected for r in got)
    some = spark.createDataFrame([(1, 1, None), (7, 0, 0), (None, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    half = resampling.resample(odd, some).collect()
    assert not any(r.selected for r in half if r.n_grams == 0) and any(r.selected for r in half)
    assert resampling.resample(odd.where("false"), some).count() == 0


# op 10 -------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    """Water filling, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def mixed(d):
    m = mixing.mix(d)
    return m.select(m.id.alias("doc_id"), "source", "size", "source_size", "target", "taken").collect()


def check_mix(rows, sizes):
    want = plain_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 2)


def test_mix(docs, texts):
    sizes = Counter()
    for r in texts.values():
        sizes[r.source] += len(r.text.encode().split())
    rows = mixed(docs)
    assert {r.doc_id: r["size"] for r in rows} == {i: len(r.text.encode().split()) for i, r in texts.items()}
    check_mix(rows, sizes)
    assert sorted(rows) == sorted(mixed(docs.repartition(7)))


def test_mix_of_small_sources(spark):
    rows = [(k, "w " * 50, s) for k, s in enumerate(["a", "b", "c", "d"])] + [(10 + k, "w " * 400, "e") for k in range(20)] + [(40, "w", "f")]
    sizes = {"a": 50, "b": 50, "c": 50, "d": 50, "e": 8000, "f": 1}
    check_mix(mixed(spark.createDataFrame(rows, "doc_id int, text string, source string")), sizes)


def test_mix_hot_and_saturated(spark):
    rows = [(k, "a b c d e " * (1 + k % 9), "hot" if k % 3 else f"s{k % 5}") for k in range(6000)] + [(9000, "x y z", "tiny"), (9001, "u v w", None)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    check_mix(mixed(spark.createDataFrame(rows, "doc_id int, text string, source string")), sizes)


def test_apportionment(spark):
    votes = {"a": 53000, "b": 24000, "c": 23000, "d": 600}
    for seats in (1, 4, 7, 10, 33):
        q = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = min(votes, key=lambda k: (-votes[k] / (2 * q[k] + 1), k))
            q[best] += 1
        d = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, p string, votes int, seats int")
        assert {r.p: r.quota for r in mixing.apportion(d, ["g"], "votes", "seats", ["p"]).collect()} == q


def test_mix_expand(docs, odd):
    taken = sum(r.taken for r in mixed(docs))
    out = mixing.expand(docs)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in out.select("text").collect()) == taken
    assert mixing.expand(odd).columns == odd.columns and mixing.expand(odd.where("false")).count() == 0
    check_mix(mixed(odd), {"a": 12, "b": 6, "c": 30009, None: 0})


# queries -----------------------------------------------------------------------------------------------


def test_queries_are_complete():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = common.Scratch(spark, "t")
    start = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = scratch.save(name, stage(spark, docs, sf_dir))
        assert docs.count() > 0 and (k == len(pipeline.STAGES) - 1 or docs.columns == start)
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES[:-1]:
        empty = scratch.save(name, stage(spark, empty, sf_dir))
        assert empty.count() == 0
    assert pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0


def test_shingles_are_counted_on_all_texts(spark):
    texts = [f"these five words are shared by {k}" for k in range(60)]
    d = spark.createDataFrame([(t,) for t in texts + texts[:5]], "t string").select(F.col("t").cast("binary").alias("t"))
    known, counts = simhash.frequent(d, 5, common.Scratch(spark, "test"))
    assert counts.tolist() == [60, 60]  # repeated texts once; one of eight was counted before
    assert len(known) == 2
