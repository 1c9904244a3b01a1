"""Language ID by a linear-chain conditional random field over words.

A word's features are its byte n-grams with boundary marks (those at a mark are its affixes), hashed to weights, and
its entry in a lexicon of frequent training words. Transitions between languages are learned from training
sequences spliced from texts of several languages. Forward-backward gives each word's label
probabilities; long texts are cut into stretches whose transfer matrices are multiplied, so a text of any
length is labelled exactly and whole, and many texts go through each step together.

The classifier is fit on a bounded sample: ``sample_docs`` labelled texts per language, lowest seeded hash first, of
texts of at most ``sample_bytes``. Everything else covers all rows.

Defined cases: a text that is null or has no letter is ``und`` with score 0; words without letters have no
features of their own and take part only as links of the chain; an empty table, or one without labelled
texts, gives ``und`` throughout; a null doc_id is hashed as the empty text; repeated rows are labelled each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import Scratch, remainder, tune

BITS = 17
GRAMS = (2, 3, 4)
GOLDEN = 0x9E3779B97F4A7C15
STRETCH = 64
CACHE = 150_000
SAMPLE_DOCS = 300
SAMPLE_BYTES = 20_000
LEXICON = 4096


def has_letter(text: str) -> bool:
    """A letter is what Unicode calls one (categories L), so neither a Roman numeral sign nor a fraction is."""
    return text.isalpha() or any(map(str.isalpha, text))


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature number, word number) pairs; hashed n-grams first, lexicon entries above them."""
    raw = [w.encode("utf-8", "replace") for w in words]
    buf = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in raw), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 2
    owner = np.repeat(np.arange(len(raw)), lengths)
    ends = np.cumsum(lengths)
    room = ends[owner] - np.arange(len(buf))  # bytes left in the word, this one included
    feats, owners = [], []
    code = buf.copy()
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint64(257) + buf[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(room[: len(code)] >= n)
            h = (code[at] + np.uint64(n * GOLDEN % (1 << 64))) * np.uint64(GOLDEN)
            feats.append((h >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[at])
    own = [(lexicon[w] + (1 << BITS), i) for i, w in enumerate(words) if w in lexicon]
    if own:
        feats.append(np.array([x[0] for x in own], np.int64))
        owners.append(np.array([x[1] for x in own], np.int64))
    return np.concatenate(feats), np.concatenate(owners)


class Model:
    """Weights of a trained field; ``emissions`` are log potentials of words."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, lexicon: dict[str, int]):
        self.labels, self.weights, self.trans, self.lexicon = labels, weights, trans, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        n = len(self.labels)
        out = np.zeros((len(words), n), np.float64)
        at = [i for i, w in enumerate(words) if has_letter(w)]
        if at:
            f, o = features([words[i] for i in at], self.lexicon)
            w = self.weights[f]
            for k in range(n):
                out[at, k] = np.bincount(o, w[:, k], minlength=len(at))
        return np.clip(out, -30, 30)


class Cache:
    """Potentials of words already met by this worker: word -> row of ``table``."""

    def __init__(self, model: Model):
        self.model, self.rows, self.table, self.letters = model, {}, np.zeros((1024, len(model.labels))), np.zeros(1024, bool)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE:
            self.rows = {}
        got = list(map(self.rows.get, words))
        if None in got:
            new = list(dict.fromkeys(w for w, g in zip(words, got) if g is None))
            n = len(self.rows)
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.table[n : n + len(new)] = self.model.emissions(new)
            self.letters[n : n + len(new)] = [has_letter(w) for w in new]
            self.rows |= {w: n + i for i, w in enumerate(new)}
            got = [self.rows[w] if g is None else g for w, g in zip(words, got)]
        return np.array(got, np.int64)


def marginals(trans: np.ndarray, emit: np.ndarray, lengths: np.ndarray, stretch: int = STRETCH, messages: bool = False):
    """Label probabilities (tokens x labels) of sequences laid end to end, exact for any length; with ``messages``
    also each token's forward message, and its backward message times its potential.

    Sequences are cut into stretches; a stretch's product of transfer matrices carries the forward and backward
    messages across it, then messages are spread inside all stretches at once.
    """
    k = emit.shape[1]
    total = int(lengths.sum())
    if not total:
        return np.zeros((0, k))
    a = np.exp(trans - trans.max())
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    n_str = -(-lengths // stretch)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(lengths)), n_str)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_str) - n_str, n_str)
    begin = first[owner] + number * stretch
    size = np.minimum(lengths[owner] - number * stretch, stretch)
    order = np.argsort(-size, kind="stable")  # so that the stretches that reach step t are the first ones
    begin, size, number = begin[order], size[order], number[order]
    s = len(begin)
    active = [int((size > t).sum()) for t in range(int(size[0]))]
    prod = np.broadcast_to(np.eye(k), (s, k, k)).copy()
    for t, m in enumerate(active):
        p = (prod[:m].reshape(-1, k) @ a).reshape(m, k, k) * e[begin[:m] + t][:, None, :]
        prod[:m] = p / p.max(axis=(1, 2), keepdims=True)
    where = np.empty(s, np.int64)
    where[order] = np.arange(s)
    base = np.cumsum(n_str) - n_str
    into, after = np.empty((s, k)), np.empty((s, k))
    f = np.ones((len(lengths), k))
    for j in range(int(n_str.max())):
        seq = np.flatnonzero(n_str > j)
        at = where[base[seq] + j]
        into[at] = f[seq]
        x = np.einsum("si,sij->sj", f[seq], prod[at])
        f[seq] = x / x.max(axis=1, keepdims=True)
    r = np.ones((len(lengths), k))
    for j in range(int(n_str.max()) - 1, -1, -1):
        seq = np.flatnonzero(n_str > j)
        at = where[base[seq] + j]
        after[at] = r[seq]
        x = np.einsum("sij,sj->si", prod[at], r[seq])
        r[seq] = x / x.max(axis=1, keepdims=True)
    out = np.empty((total, k))
    x = into
    # a text's first word has no word before it: the product's first step multiplies ones by the transitions,
    # the same factor for the whole chain's start
    for t, m in enumerate(active):
        x = (x[:m] @ a) * e[begin[:m] + t]
        x /= x.max(axis=1, keepdims=True)
        out[begin[:m] + t] = x
    y = after.copy()
    forward, back = (out.copy(), np.empty_like(out)) if messages else (None, None)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        out[begin[:m] + t] *= y[:m]
        if messages:
            back[begin[:m] + t] = y[:m]
        z = (y[:m] * e[begin[:m] + t]) @ a.T
        y[:m] = z / z.max(axis=1, keepdims=True)
    out /= out.sum(axis=1, keepdims=True)
    return (out, forward, back * e) if messages else out


def train(texts: list[str], langs: list[str], seed: int = 3, epochs: int = 4, length: int = 48, batch: int = 48, rate: float = 0.25, l2: float = 1e-4) -> Model:
    """Maximum conditional likelihood by AdaGrad on sequences spliced from stretches of 4 to 24 words."""
    labels = sorted(set(langs))
    k = len(labels)
    rng = np.random.default_rng(seed)
    parts: list[tuple[list[str], int]] = []
    for t, g in zip(texts, langs, strict=True):
        w, at, c = t.lower().split(), 0, labels.index(g)
        while at < len(w):
            n = int(rng.integers(4, 25))
            parts.append((w[at : at + n], c))
            at += n
    rng.shuffle(parts)
    counts = Counter(w for p, _ in parts for w in p if has_letter(w))
    lexicon = {w: i for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if n > 2}
    index: dict[str, int] = {}
    words = np.array([index.setdefault(w, len(index)) for p, _ in parts for w in p], np.int64)
    gold = np.repeat(np.array([c for _, c in parts]), [len(p) for p, _ in parts])
    vocabulary = list(index)
    lettered = [i for i, w in enumerate(vocabulary) if has_letter(w)]
    f, o = features([vocabulary[i] for i in lettered], lexicon) if lettered else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    o = np.array(lettered, np.int64)[o] if lettered else o
    by = np.argsort(o, kind="stable")
    f, o = f[by], o[by]
    start = np.searchsorted(o, np.arange(len(vocabulary) + 1))
    size = (1 << BITS) + LEXICON
    weights, sq = np.zeros((size, k)), np.full((size, k), 1e-2)
    trans, tsq = np.zeros((k, k)), np.full((k, k), 1e-2)
    model = Model(labels, weights, trans, lexicon)
    n_seq = -(-len(words) // length)
    for _ in range(epochs if k > 1 else 0):
        for chosen in np.array_split(rng.permutation(n_seq), max(1, n_seq // batch)):
            tok = np.concatenate([words[i * length : (i + 1) * length] for i in chosen])
            y = np.concatenate([gold[i * length : (i + 1) * length] for i in chosen])
            lens = np.array([min(length, len(words) - i * length) for i in chosen])
            kinds, inv = np.unique(tok, return_inverse=True)
            span = start[kinds + 1] - start[kinds]
            own = np.repeat(np.arange(len(kinds)), span)
            at = f[np.repeat(start[kinds], span) + np.arange(len(own)) - np.repeat(np.cumsum(span) - span, span)]
            wa = weights[at]
            emit = np.stack([np.bincount(own, wa[:, c], minlength=len(kinds)) for c in range(k)], 1)[inv]
            emit = np.clip(emit, -30, 30)
            p, forward, back = marginals(trans, emit, lens, length, messages=True)
            grad = p.copy()
            grad[np.arange(len(y)), y] -= 1
            # expected and observed transitions inside the sequences
            inner = np.ones(len(tok), bool)
            inner[np.cumsum(lens) - lens] = False
            j = np.flatnonzero(inner)
            pair = forward[j - 1][:, :, None] * np.exp(trans) * back[j][:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            tg = pair.sum(0)
            np.subtract.at(tg, (y[j - 1], y[j]), 1)
            per_word = np.stack([np.bincount(inv, grad[:, c], minlength=len(kinds)) for c in range(k)], 1)
            feats, pos = np.unique(at, return_inverse=True)
            fg = np.stack([np.bincount(pos, per_word[own, c], minlength=len(feats)) for c in range(k)], 1) + l2 * weights[feats]
            sq[feats] += fg * fg
            weights[feats] -= rate * fg / np.sqrt(sq[feats])
            tg = tg / len(chosen) + l2 * trans
            tsq += tg * tg
            trans -= 0.1 * tg / np.sqrt(tsq)
    model.weights = weights.astype(np.float32)
    return model


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, most_bytes: int, seed: int) -> DataFrame:
    """The bounded sample: (text, lang). Only ids and hashes are ranked; texts of the chosen ids are then read."""
    fit = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col, 4) != 2) & (F.octet_length(text_col) <= most_bytes))
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed))
    fit = fit.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
    ranked = fit.select("lang", "h").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= per_lang)
    # written, so that its size is known: the few hashes go to the texts, not the texts to them
    chosen = Scratch(docs.sparkSession, "langid").save("sample", ranked.select("lang", "h").distinct())
    return fit.join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"])


def label_texts(model: Model, cache: Cache, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label probabilities of all words, words per text, letters flag per word, label sums per text)."""
    words = [t.lower().split() if t else [] for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    rows = cache([w for ws in words for w in ws])
    p = marginals(model.trans, cache.table[rows], lengths)
    letters = cache.letters[rows]
    owner = np.repeat(np.arange(len(words)), lengths)
    sums = np.stack([np.bincount(owner, p[:, c] * letters, minlength=len(words)) for c in range(len(model.labels))], 1)
    return p, lengths, letters, sums


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, seed: int = 3) -> Model:
    rows = sample(docs, id_col, text_col, lang_col, per_lang, most_bytes, seed).orderBy("lang", "h").collect()  # bounded by its parameters
    return train([r.text for r in rows], [r.lang for r in rows], seed) if rows else Model([], np.zeros((0, 0)), np.zeros((0, 0)), {})


def predictor(model: Model, texts_at_once: int = 256):
    """A function from texts to (language, share of the text's letter words by probability, share of words whose
    most probable label is another language)."""
    cache = Cache(model)

    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lang, score, mixed = [], np.zeros(len(texts)), np.zeros(len(texts))
        for at in range(0, len(texts), texts_at_once):
            part = texts[at : at + texts_at_once]
            if not model.labels:
                lang += ["und"] * len(part)
                continue
            p, lengths, letters, sums = label_texts(model, cache, part)
            n = sums.sum(axis=1)
            best = sums.argmax(axis=1)
            owner = np.repeat(np.arange(len(part)), lengths)
            other = np.bincount(owner, letters & (p.argmax(axis=1) != best[owner]), minlength=len(part))
            some = np.array([bool(t) and has_letter(t) for t in part]) & (n > 0)
            lang += [model.labels[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            share = np.divide(sums[np.arange(len(part)), best], n, out=np.zeros(len(part)), where=some)
            score[at : at + len(part)] = np.clip(share, 0.0, 1.0)
            mixed[at : at + len(part)] = np.divide(other, n, out=np.zeros(len(part)), where=some)
        return lang, score, mixed

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None, **kw) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, mixed_share."""
    spark = docs.sparkSession
    tune(spark)
    model = model or fit(docs, id_col, text_col, lang_col, **kw)
    shared = spark.sparkContext.broadcast((model.labels, model.weights, model.trans, model.lexicon))  # bounded: BITS, LEXICON, labels

    def run(batches):
        predict = predictor(Model(*shared.value))
        for b in batches:
            lang, score, mixed = predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(mixed)], names=[id_col, "held_out", "lang_pred", "score", "mixed_share"])

    src = docs.select(F.col(id_col), (remainder(id_col, 4) == 2).alias("held_out"), F.col(text_col))
    return src.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, mixed_share double")


def accepted(docs: DataFrame, text_col: str = "text", least: float = 0.5, **kw) -> DataFrame:
    """The documents, in their own columns, whose language is known: not ``und``, and with at least ``least`` of their letter
    words in it by probability."""
    spark = docs.sparkSession
    tune(spark)
    model = fit(docs, text_col=text_col, **kw)
    shared = spark.sparkContext.broadcast((model.labels, model.weights, model.trans, model.lexicon))
    at = docs.columns.index(text_col)

    def run(batches):
        predict = predictor(Model(*shared.value))
        for b in batches:
            lang, score, _ = predict(b.column(at).to_pylist())
            yield b.filter(pa.array([g != "und" and s >= least for g, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
