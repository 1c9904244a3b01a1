"""Language-model scoring with Brown class n-grams.

P(text) is the product over tokens of P(class | class before) * P(word | class). Words get their classes by exchange
clustering: core words (relative frequency at least ``core_share``, so at most 1/core_share of them) are
exchanged one after the other, each into the class that raises the class bigrams' mutual information most,
for ``sweeps`` passes over the corpus; every other word then takes one exchange step against the matrix
so found, from its own neighbours in all training texts. Emissions are discounted absolutely, and what they free is
the probability of an unknown word; transitions are smoothed towards class frequencies. The model sums to
one over known words, the unknown word and the end.

Texts are coded once into blocks (some MB of whole documents with a dictionary of their own). The vocabulary is an
aggregation over block dictionaries, joined back to them, so that passes over the corpus are maps over
blocks; only rows (block word), (word, neighbouring classes) and class matrices move. Words are never gathered.

Defined cases: null and empty texts are the end token alone; repeated rows are scored each and counted each; a null
doc_id is hashed as the empty text; without training texts every word is unknown and scores are those of
an empty model (uniform over classes); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import Scratch, remainder, tune, utf8

#: Classes of words; two more codes stand for the end (and beginning) of a text and, as a neighbour only,
#: for words not yet classed.
CLASSES = 62
END, OTHER, CODES = 62, 63, 64
CORE_SHARE = 2e-5
SWEEPS = 3
BLOCK_BYTES = 8 << 20
#: Weight of class frequencies in a transition row.
PULL = 10.0


def encode(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole documents: words (the first is empty and stands for the end), their counts in training
    texts, tokens as int32 word numbers, and each document's id, end and side."""
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = pa.int64() if kind in ("bigint", "int") else pa.string()

    def run(batches):
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        fresh = lambda: (ids.clear(), ids[b""], [], [], [], [], 0)
        _, _, who, ends, sides, parts, size = fresh()

        def flush():
            tokens = np.concatenate(parts)
            own = np.repeat(np.array(sides, bool), np.diff([0, *ends]))
            counts = np.bincount(tokens[~own], minlength=len(ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([list(ids)], pa.list_(pa.binary())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([tokens.tobytes()], pa.binary()), pa.array([who], pa.list_(id_type)), pa.array([ends], pa.list_(pa.int64())), pa.array([sides], pa.list_(pa.bool_()))],
                names=["words", "counts", "tokens", "ids", "ends", "held"],
            )

        for b in batches:
            for i, t, side in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = t.lower().split()
                w.append(b"")
                parts.append(np.fromiter(map(ids.__getitem__, w), np.int32, len(w)))
                who.append(i)
                sides.append(side)
                ends.append((ends[-1] if ends else 0) + len(w))
                size += len(t) + 1
                if size >= block_bytes:
                    yield flush()
                    _, _, who, ends, sides, parts, size = fresh()
        if who:
            yield flush()

    src = docs.select(F.col(id_col).cast("string" if id_type == pa.string() else "long").alias("i"), utf8(text_col).alias("t"), (remainder(id_col, 10) == 0).alias("held"))
    ddl = f"words array<binary>, counts array<long>, tokens binary, ids array<{'long' if id_type == pa.int64() else 'string'}>, ends array<long>, held array<boolean>"
    return src.mapInArrow(run, ddl).withColumn("block", F.monotonically_increasing_id())


def training(tokens: np.ndarray, ends: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Tokens of the training texts, each ending in token 0, after one leading end."""
    keep = np.repeat(~held, np.diff(np.concatenate([[0], ends])))
    return np.concatenate([np.zeros(1, np.int32), tokens[keep]])


def blocks_of(batch: pa.RecordBatch):
    """Rows of a batch as dicts of numpy arrays; binary columns hold the numbers named in ``KIND``."""
    for k in range(batch.num_rows):
        out = {}
        for name, col in zip(batch.schema.names, batch.columns, strict=True):
            v = col[k]
            if name in KIND:
                out[name] = np.frombuffer(v.as_buffer(), KIND[name])
            elif name == "ids":
                out[name] = v.values
            elif name in ("ends", "held"):
                out[name] = v.values.to_numpy(zero_copy_only=False)
            else:
                out[name] = v.as_py()
        yield out


KIND = {"tokens": np.int32, "core": np.int32, "wid": np.int64, "seen": np.int64, "cls": np.int8}


def placed(blocks: DataFrame, words: DataFrame, names: list[str]) -> DataFrame:
    """Blocks with per-word values of rows (block, lid, value...) as binary columns in the order of lid."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["lid"].to_numpy()
        out = left
        for n in names:
            a = np.empty(len(at), KIND[n])
            a[at] = right[n].to_numpy()
            out = out.append_column(n, pa.array([a.tobytes()], pa.binary()))
        return out.select([*left.schema.names, *names])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields), *(f"{n} binary" for n in names)])
    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(join, ddl)


def g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(left: np.ndarray, right: np.ndarray, cls: np.ndarray, m: np.ndarray) -> int:
    """One sweep in place: words in falling order leave their class and join the best. ``left`` and ``right``
    (words x codes) count neighbours' classes; ``m`` (codes x codes) is the class bigram matrix. Returns moves."""
    moves = 0
    rows, cols = m.sum(1), m.sum(0)
    for w in range(len(cls)):
        a, b, k = left[w], right[w], cls[w]
        na, nb = a.sum(), b.sum()
        m[:, k] -= a
        m[k, :] -= b
        np.maximum(m[:, k], 0, out=m[:, k])  # neighbours' classes are those before this sweep
        np.maximum(m[k], 0, out=m[k])
        rows[k] = m[k].sum()
        cols[k] = m[:, k].sum()
        col, row = m[:, :CLASSES].T, m[:CLASSES]
        gain = (g(col + a) - g(col)).sum(1) + (g(row + b) - g(row)).sum(1)
        gain -= g(cols[:CLASSES] + na) - g(cols[:CLASSES]) + g(rows[:CLASSES] + nb) - g(rows[:CLASSES])
        best = int(gain.argmax())
        if gain[best] <= gain[k] + 1e-9:
            best = int(k)
        moves += best != k
        cls[w] = best
        m[:, best] += a
        m[best, :] += b
        rows[best] += nb
        cols[best] += na
    return moves


def neighbour_counts(blocks: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right) neighbour-class counts of core words and the class bigram matrix. A task adds up
    its blocks before it emits; the result is bounded by the number of core words."""
    n = len(classes)
    full = np.append(classes, OTHER).astype(np.int64)

    def run(batches):
        total = np.zeros(n * 2 * CODES, np.int64)
        pairs = np.zeros(CODES * CODES, np.int64)
        for batch in batches:
            for b in blocks_of(batch):
                t = training(b["tokens"], b["ends"], b["held"])
                core = b["core"][t]
                c = full[core]
                c[t == 0] = END
                pairs += np.bincount(c[:-1] * CODES + c[1:], minlength=CODES * CODES)
                at = np.flatnonzero(core[1:-1] >= 0) + 1
                who = core[at].astype(np.int64) * (2 * CODES)
                total += np.bincount(np.concatenate([who + c[at - 1], who + CODES + c[at + 1]]), minlength=len(total))
        k, p = np.flatnonzero(total), np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k, -1 - p])), pa.array(np.concatenate([total[k], pairs[p]]))], names=["k", "n"])

    found = blocks.select("tokens", "ends", "held", "core").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    k, v = found["k"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    both = np.zeros(n * 2 * CODES)
    both[k[k >= 0]] = v[k >= 0]
    m = np.zeros(CODES * CODES)
    m[-1 - k[k < 0]] = v[k < 0]
    both = both.reshape(n, 2, CODES)
    return both[:, 0], both[:, 1], m.reshape(CODES, CODES)


def other_words(blocks: DataFrame, classes: np.ndarray, m: np.ndarray) -> DataFrame:
    """(wid, cls) of every training word outside the core: one exchange step each. Rows that move are (word, class
    before, class after, count); a word's rows are at most CODES**2 however frequent it is."""
    full = np.append(classes, OTHER).astype(np.int64)

    def run(batches):
        for batch in batches:
            for b in blocks_of(batch):
                t = training(b["tokens"], b["ends"], b["held"])
                core = b["core"][t]
                c = full[core]
                c[t == 0] = END
                at = np.flatnonzero((core[1:-1] < 0) & (t[1:-1] != 0)) + 1
                k, n = np.unique((t[at].astype(np.int64) << 12) | (c[at - 1] << 6) | c[at + 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(b["wid"][k >> 12]), pa.array((k & 4095).astype(np.int16)), pa.array(n.astype(np.int64))], names=["wid", "code", "n"])

    smooth = m + 0.05
    into = np.log(smooth[:, :CLASSES] / smooth[:, :CLASSES].sum(0))
    out = np.log(smooth[:CLASSES] / smooth[:CLASSES].sum(1, keepdims=True))

    def choose(batches):
        for b in batches:
            ends = np.cumsum(np.array(b.column(1).value_lengths()))
            code = b.column(1).flatten().field("code").to_numpy().astype(np.int64)
            n = b.column(1).flatten().field("n").to_numpy().astype(np.float64)
            gain = n[:, None] * (into[code >> 6] + out.T[code & 63])
            best = np.add.reduceat(gain, np.concatenate([[0], ends[:-1]]), axis=0).argmax(1) if len(ends) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int8))], names=["wid", "cls"])

    rows = blocks.select("tokens", "ends", "held", "core", "wid").mapInArrow(run, "wid long, code short, n long")
    rows = rows.groupBy("wid", "code").agg(F.sum("n").alias("n")).groupBy("wid").agg(F.collect_list(F.struct("code", "n")).alias("x"))
    return rows.mapInArrow(choose, "wid long, cls byte")


def transitions(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams (states x classes and end) of the training texts, the last state standing for an unknown
    word and learnt from words seen once, and class unigrams."""

    def run(batches):
        total = np.zeros((CODES, CODES), np.int64)
        for batch in batches:
            for b in blocks_of(batch):
                t = training(b["tokens"], b["ends"], b["held"])
                c = b["cls"][t].astype(np.int64)
                total += np.bincount(c[:-1] * CODES + c[1:], minlength=CODES * CODES).reshape(CODES, CODES)
                once = np.flatnonzero(b["seen"][t[:-1]] == 1)
                total[OTHER] += np.bincount(c[once + 1], minlength=CODES)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total.ravel()[k])], names=["k", "n"])

    out = np.zeros(CODES * CODES)
    for r in blocks.select("tokens", "ends", "held", "cls", "seen").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    out = out.reshape(CODES, CODES)[:, : CLASSES + 1]
    return out, out[: CLASSES + 1].sum(0)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core_share: float = CORE_SHARE, sweeps: int = SWEEPS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "brown")
    coded = scratch.save("coded", encode(docs, id_col, text_col, block_bytes=block_bytes))
    entry = coded.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("lid", "x")).select("block", "lid", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    vocabulary = scratch.save("vocabulary", entry.groupBy("word").agg(F.sum("n").alias("seen")).withColumn("wid", F.monotonically_increasing_id()))
    scratch.release()
    s = vocabulary.where("seen > 0").agg(F.sum("seen").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("seen") == 1, 1)).alias("n1"), F.count(F.when(F.col("seen") == 2, 1)).alias("n2")).first()
    total, kinds = s.n or 0, s.v
    # at most 1/core_share words
    core = vocabulary.where((F.col("seen") >= max(2.0, core_share * total)) & (F.col("word") != F.lit(b""))).select("wid", "seen", F.hex("word").alias("tie")).toPandas().sort_values(["seen", "tie"], ascending=[False, True], ignore_index=True)  # by the words themselves, not by where they lie
    core["core"] = np.arange(len(core), dtype=np.int32)
    core_df = F.broadcast(spark.createDataFrame(core[["wid", "core"]] if len(core) else pd.DataFrame({"wid": pd.Series([], dtype="int64"), "core": pd.Series([], dtype="int32")}), "wid long, core int"))
    known = entry.select("block", "lid", "word").join(vocabulary, "word").join(core_df, "wid", "left").select("block", "lid", "wid", "seen", F.coalesce("core", F.lit(-1)).alias("core"))
    known = scratch.save("known", known)
    scratch.release()
    blocks = scratch.save("blocks", placed(coded.select("block", "tokens", "ids", "ends", "held"), known, ["wid", "core"]))
    scratch.drop(coded)
    scratch.release()
    classes = np.arange(len(core)) % CLASSES
    m = np.zeros((CODES, CODES))
    for k in range(sweeps if len(core) else 0):
        left, right, m = neighbour_counts(blocks, classes)
        if not exchange(left, right, classes, m):
            break
    core["cls"] = classes.astype(np.int8)
    rest = other_words(blocks, classes, m)
    chosen = rest.union(spark.createDataFrame(core[["wid", "cls"]], "wid long, cls byte")) if len(core) else rest
    end = vocabulary.where(F.col("word") == F.lit(b"")).select("wid", F.lit(END).cast("byte").alias("cls"))
    chosen = scratch.save("classes", chosen.union(end))
    scratch.release()
    named = vocabulary.join(chosen, "wid", "left")
    mass, types = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in named.where("seen > 0").groupBy("cls").agg(F.sum("seen").alias("n"), F.count("*").alias("v")).collect():
        mass[r.cls], types[r.cls] = r.n, r.v
    with_class = known.join(chosen, "wid", "left").select("block", "lid", "seen", F.coalesce("cls", F.lit(OTHER)).cast("byte").alias("cls"))
    final = scratch.save("final", placed(blocks.select("block", "tokens", "ids", "ends", "held"), with_class, ["seen", "cls"]))
    scratch.drop(blocks, known)
    scratch.release()
    bigrams, unigrams = transitions(final)
    # transitions to classes and the end, each row pulled towards class frequencies
    p = (unigrams + 0.5) / (unigrams + 0.5).sum()
    trans = (bigrams + PULL * p) / (bigrams.sum(1, keepdims=True) + PULL)
    discount = s.n1 / (s.n1 + 2.0 * s.n2) if s.n1 else 0.5
    discount = min(0.95, max(0.05, discount))
    free = np.where(mass[:CLASSES] > 0, discount * types[:CLASSES] / np.maximum(mass[:CLASSES], 1), 1.0)
    unknown = np.log10(np.maximum(trans[:, :CLASSES] @ free, 1e-300))
    log_trans = np.log10(trans)
    log_mass = np.log10(np.maximum(mass, 1))
    log_base = math.log10(total + 0.1 * (kinds + 1))

    def run(batches):
        for batch in batches:
            for b in blocks_of(batch):
                t, seen, cls = b["tokens"], b["seen"], b["cls"].astype(np.int64)
                word = np.log10(np.maximum(seen - discount, 1e-300)) - log_mass[np.minimum(cls, CLASSES)]
                word[cls == END] = 0.0
                base = np.log10(seen + 0.1) - log_base
                c = cls[t]
                before = np.concatenate([[END], c[:-1]])
                value = np.where(c == OTHER, unknown[before], log_trans[before, np.minimum(c, CLASSES)] + word[t])
                ends = b["ends"]
                start = np.concatenate([[0], ends[:-1]])
                add = lambda x: np.add.reduceat(x, start)
                known_n = add((seen[t] > 0).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b["ids"], pa.array(b["held"]), pa.array(ends - start), pa.array(known_n), pa.array(np.full(len(ends), total, np.int64)), pa.array(add(base[t])), pa.array(add(value))], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = "long" if "array<bigint>" in final.schema["ids"].dataType.simpleString() else "string"
    out = final.select("tokens", "ids", "ends", "held", "seen", "cls").mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType))
