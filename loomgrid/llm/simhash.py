"""SimHash near-duplicates by Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints with at most 2 differing
bits agree in one segment i and differ in at most one bit of another segment j (pigeonhole). Segment j,
read as a 23-bit vector, is decoded with the perfect [23,12,7] Golay code: the stored side gives the index
of its nearest codeword, the asking side the indices of all codewords within 4 bits (one, or six when the
nearest is 3 away). One differing bit cannot leave that set, so (i, segment i, j, index) joins every link;
candidates are verified by their true distance.

A key with more than ``hot`` stored fingerprints is not joined pairwise. Its fingerprints are linked through
the points within one bit of them: two fingerprints are within 2 bits exactly if they share such a point, so
each point's fingerprints are joined to the smallest of them, 65 rows per fingerprint however many meet.

Defined cases: null and empty texts have fingerprint 0 and are linked as any other; texts of one or two words
have one shingle, the whole sequence; repeated rows share everything; a null doc_id is never a component id
unless its whole component has none; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from loomgrid.llm.common import Bloom, Scratch, components, tune, utf8, workers

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = [(i, j) for i in range(3) for j in range(3) if i != j]
#: Generator polynomial of the [23,12,7] Golay code.
GENERATOR = 0xAE3
HOT = 256
STEP = 1 << 14


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit is 1 if set in over half of the shingles' XXH64; words are counted whole, in steps."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + shingle - 1]
        m = max(1, len(part) - shingle + 1)
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(part) >= shingle else [b" ".join(part)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), "<u8", m)
        total += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int = 3):
    @F.arrow_udf(LongType())
    def f(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return f


def syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    v = v.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        v ^= np.where((v >> bit) & 1, GENERATOR << (bit - 11), 0)
    return v


def error_table() -> np.ndarray:
    """For each of the 2048 syndromes up to six error patterns of at most 4 bits, the lightest first, -1 where
    there are fewer. Patterns of weight 4 are listed only beside one of weight 3."""
    from itertools import combinations

    table = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        pats = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for p, s in zip(pats.tolist(), syndromes(pats).tolist()):
            if weight < 4 or bin(int(table[s, 0])).count("1") == 3:
                table[s, used[s]] = p
                used[s] += 1
    return table


ERRORS = error_table()


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of uint64 fingerprints: stored keys (n, 6) and asking keys (n, 36), -1 where there is none."""
    seg = [((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = []
    for s in seg:
        e = ERRORS[syndromes(s)]
        near.append(np.where(e >= 0, (s[:, None] ^ e) >> 11, -1))
    stored, asked = [], []
    for p, (i, j) in enumerate(PAIRS):
        head = (np.int64(p) << 34) | (seg[i] << 12)
        stored.append(head | near[j][:, 0])
        asked.append(np.where(near[j] >= 0, head[:, None] | near[j], -1))
    return np.stack(stored, 1), np.concatenate(asked, 1)


def key_rows(nodes: DataFrame, asking: bool) -> DataFrame:
    """(key, fp) rows of the distinct fingerprints."""

    def rows(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            k = keys(fp.view(np.uint64))[int(asking)]
            who, at = np.nonzero(k >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(k[who, at]), pa.array(fp[who])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(rows, "key long, fp long")


def ball_rows(nodes: DataFrame) -> DataFrame:
    """(point, fp): the 65 points within one bit of each fingerprint."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    return nodes.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")


def links(nodes: DataFrame, scratch: Scratch, distance: int = 2, hot: int = HOT) -> DataFrame:
    """(u, v) rows over distinct fingerprints whose components are those of all links."""
    stored = scratch.save("stored", key_rows(nodes, False))
    crowded = scratch.save("crowded", stored.groupBy("key").count().where(F.col("count") > hot).select("key"))
    asked = scratch.save("asked", key_rows(nodes, True))
    few = asked.join(stored.join(crowded, "key", "left_anti").withColumnRenamed("fp", "v"), "key")
    near = few.where((F.col("fp") != F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= distance))
    pairs = near.select(F.greatest("fp", "v").alias("u"), F.least("fp", "v").alias("v"))
    met = stored.join(crowded, "key", "left_semi").union(asked.join(crowded, "key", "left_semi")).select("fp").distinct()
    ball = ball_rows(met)
    hubs = ball.join(ball.groupBy("point").agg(F.min("fp").alias("v")), "point").select(F.col("fp").alias("u"), "v").where("u <> v")
    return scratch.save("links", pairs.union(hubs).distinct())


def group(spark: SparkSession, rows: DataFrame, rank: str, scratch: Scratch) -> DataFrame:
    """(fp, component): rows carry fp and a sortable ``rank`` column; the component is its smallest rank."""
    nodes = scratch.save("nodes", rows.groupBy("fp").agg(F.min(rank).alias("low")).repartition(workers(spark), "fp"))
    stars = components(spark, links(nodes, scratch), scratch)
    named = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    return scratch.save("named", named.join(lowest, "root").select("fp", "component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "simhash")
    fps = scratch.save("fps", docs.select(F.col(id_col), fingerprint_udf(shingle)(utf8(text_col)).alias("fp")))
    named = group(spark, fps, id_col, scratch)
    return fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Frequent shingles the common order knows of at most; the rest count as rare. It bears on cost alone: any order gives the same pairs.
COMMON = 1 << 16
#: A wide fingerprint's segments of 23 bits, two to a long; the triples of segments that make its keys; and the bits in which
#: texts that meet under a key may differ to be compared (unrelated texts differ in about half of the 138).
WIDE = 6
TRIPLES = [(i, j, k) for i in range(WIDE) for j in range(i + 1, WIDE) for k in range(j + 1, WIDE)]
WIDE_BITS = 46
#: Odd factors that draw a fingerprint's further longs from one hash.
FACTORS = (1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


#: Bytes of texts that are hashed at once; a longer text is hashed in such pieces, cut between words.
PIECE = 1 << 22
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of an odd factor modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, f, np.uint64), dtype=np.uint64)]) for f in (FACTORS[1], pow(FACTORS[1], -1, 1 << 64))]
    return _powers


def hash_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, where each text's words begin and end among them) of texts laid end to end, lower-casing A-Z.

    A word's hash is a polynomial of its bytes, read off running sums, so that no word is ever an object of its own."""
    low = buf + np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
    word = (low != 32) & ((low < 9) | (low > 13))
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    up, down = powers(len(buf) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(FACTORS[2])
    return h ^ (h >> np.uint64(29)), np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array):
    """The word hashes of each text of a binary array, in order."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        to = min(to, len(texts))
        if offsets[to] - offsets[at] <= PIECE:
            h, cut = hash_words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            yield from (h[cut[i] : cut[i + 1]] for i in range(to - at))
        else:
            yield np.concatenate(list(_in_pieces(data[offsets[at] : offsets[to]])))
        at = to


def _in_pieces(buf: np.ndarray):
    gap = np.flatnonzero((buf == 32) | ((buf >= 9) & (buf <= 13)))
    at = 0
    while at < len(buf):
        to = len(buf)
        if to - at > PIECE:
            k = np.searchsorted(gap, at + PIECE)
            to = int(gap[k]) + 1 if k < len(gap) else to
        yield hash_words(buf[at:to], np.array([0, to - at]))[0]
        at = to


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_set(h: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (the whole sequence if it has fewer words), of its words' hashes."""
    if not len(h):
        return np.zeros(1, np.uint64)
    m = max(1, len(h) - shingle + 1)
    c = h[:m].copy()
    for j in range(1, min(shingle, len(h))):
        c = c * np.uint64(FACTORS[1]) + h[j : j + m]
    c = (c ^ (c >> np.uint64(29))) * np.uint64(FACTORS[2])
    return distinct(c ^ (c >> np.uint64(32)))


def shingles_udf(shingle: int):
    @F.arrow_udf(ArrayType(LongType()))
    def f(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(h, shingle).view(np.int64) for h in word_hashes(texts)], pa.list_(pa.int64()))

    return f


#: A byte's bits as eight counters of a byte each, lowest first.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def wide_fingerprint(h: np.ndarray) -> list[int]:
    """Three longs of 46 bits over a text's distinct words (their hashes), a bit 1 if set in over half of them."""
    h = distinct(h)
    drawn = (h * np.array(FACTORS, np.uint64)[:, None]).view(np.uint8)  # a row of 8 bytes a word for each factor
    ones = np.zeros((3, 64), np.int64)
    for at in range(0, len(h), 255):  # a counter holds no more
        lanes = LANES.take(drawn[:, 8 * at : 8 * (at + 255)]).reshape(3, -1, 8)
        ones += np.add.reduce(lanes, axis=1).view(np.uint8).reshape(3, 64)
    bits = np.zeros((3, 64), np.uint8)
    bits[:, :46] = ones[:, 18:] * 2 > len(h)  # the upper bits of a product are the better mixed
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel().tolist()


def shape_udf(shingle: int, least: float, known: np.ndarray, counts: np.ndarray):
    """Of each text: ``key`` (hash of its words), ``wide`` (its wide fingerprint) and ``head``, that is the number of its
    shingles and then the first of them in the common order (rare before frequent, then by hash). Of n shingles a similar text shares
    ceil(least n) or more, so the n - ceil(least n) + 1 first ones hold one that is also among the other text's first."""
    kind = pa.struct([("key", pa.int64()), ("wide", pa.list_(pa.int64())), ("head", pa.list_(pa.int64()))])

    @F.arrow_udf(StructType([StructField("key", LongType()), StructField("wide", ArrayType(LongType())), StructField("head", ArrayType(LongType()))]))
    def f(texts: pa.Array) -> pa.Array:
        keys, wides, heads = [], [], []
        for words in word_hashes(texts):
            keys.append(xxhash.xxh64_intdigest(words.tobytes()))
            wides.append(wide_fingerprint(words))
            h = shingle_set(words, shingle)
            often = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                often = np.where(known[at] == h, counts[at], 0)
            first = h[np.argsort(often, kind="stable")[: len(h) - ceil(least * len(h) - 1e-9) + 1]]
            heads.append(np.concatenate(([len(h)], first.view(np.int64))))
        return pa.StructArray.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(wides, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64()))], fields=list(kind))

    return f


def frequent(texts: DataFrame, shingle: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most COMMON shingles that most texts share, and in how many of all distinct texts; ``texts``: t binary."""
    n = scratch.save("frequent", texts.select("t").distinct().select(F.explode(shingles_udf(shingle)(F.col("t"))).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2"))
    total, lowest = 0, None
    for r in sorted(n.groupBy("n").agg(F.count("*").alias("m")).collect(), reverse=True):
        total += r.m
        if total > COMMON:
            break
        lowest = r.n
    got = sorted((r.h % (1 << 64), r.n) for r in n.where(F.col("n") >= lowest).collect()) if lowest else []
    scratch.drop(n)
    scratch.release()
    return np.array([h for h, _ in got], np.uint64), np.array([c for _, c in got], np.int64)


def golay_rows(classes: DataFrame) -> DataFrame:
    """(at, key): a row per class and triple of segments, ``at`` made of the triple and the three indices of the codewords next to them."""

    def rows(batches):
        for b in batches:
            w = b.column(1).flatten().to_numpy().reshape(-1, 3)
            near = []
            for i in range(WIDE):
                s = (w[:, i // 2] >> (23 * (i % 2))) & ((1 << 23) - 1)
                near.append((s ^ ERRORS[syndromes(s), 0]) >> 11)
            at = np.stack([(np.int64(n) << 36) | (near[i] << 24) | (near[j] << 12) | near[k] for n, (i, j, k) in enumerate(TRIPLES)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(len(w)), len(TRIPLES))))], names=["at", "key"])

    return classes.select("key", "wide").mapInArrow(rows, "at long, key long")


def golay_candidates(classes: DataFrame) -> DataFrame:
    """(u, v): every class of a Golay key with the smallest one under it, if their wide fingerprints are near."""
    rows = golay_rows(classes)
    low = rows.groupBy("at").agg(F.count("*").alias("n"), F.min("key").alias("v")).where("n > 1").drop("n")
    met = rows.join(low, "at").where("key > v").select(F.col("key").alias("u"), "v").distinct()
    wide = lambda k, n: classes.select(F.col("key").alias(k), F.col("wide").alias(n))
    both = met.join(wide("u", "a"), "u").join(wide("v", "b"), "v")
    return both.where(sum((F.bit_count(F.col("a")[i].bitwiseXOR(F.col("b")[i])) for i in range(3)), F.lit(0)) <= WIDE_BITS).select("u", "v")


def groups(classes: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int = 5, least: float = 0.8, block: int = 256) -> DataFrame:
    """Components (node, root) of the classes (long ``key``, ``rid`` of a row, ``wide``, ``head``) whose texts have a Jaccard similarity of at least ``least``.

    Golay keys link most of them: under a key every class meets the smallest. What they miss is made up
    exactly. Texts that similar share a shingle of their heads, always, and the first that they share stands early enough in both
    to leave room for what they must share in all: first every class of such a shingle meets the smallest of another component, then
    all pairs meet that still belong to different ones, by blocks of ``block`` classes.
    Candidates are compared on their heads, then on whole texts (``texts``: rid, text binary).
    """
    spark = classes.sparkSession
    rooted = lambda rows, stars: rows.join(stars.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    even = F.least("m", "k") >= least * F.greatest("m", "k") - 1e-9
    room = even & (F.least(F.col("m") - F.col("i"), F.col("k") - F.col("j")) >= shared(F.col("m"), F.col("k"), least))
    apart = lambda rows: rows.groupBy("at").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), F.max("early").alias("early")).where("a <> b and early").select("at", "n")
    links = verified(golay_candidates(classes), classes, texts, scratch, shingle, least)
    stars = components(spark, links, scratch)
    scratch.release()
    m, early = F.col("head")[0], (F.col("m") - F.col("i") >= shared(F.col("m"), F.col("m"), least)).alias("early")
    heads = rooted(classes.select("key", "head"), stars).select("key", "root", m.alias("m"), F.posexplode(F.expr("slice(head, 2, size(head) - 1)")).alias("i", "at"))
    open_ = scratch.save("open", apart(heads.select("at", "root", early)))
    scratch.release()
    met = scratch.save("met", heads.select("at", "key", "i").join(open_.select("at"), "at"))
    scratch.release()
    sized = classes.select("key", m.alias("m"))
    rows = scratch.save("rows", rooted(met.join(sized, "key"), stars))
    low = rows.groupBy("at").agg(F.min(F.struct("key", "m", "root", "i")).alias("low"))
    star = rows.join(low, "at").select(F.col("key").alias("u"), F.col("low.key").alias("v"), "m", F.col("low.m").alias("k"), "root", F.col("low.root").alias("other"), "i", F.col("low.i").alias("j"))
    more = verified(star.where((F.col("root") != F.col("other")) & room).select("u", "v").distinct(), classes, texts, scratch, shingle, least)
    if not more.isEmpty():
        links = links.union(more)
        stars = components(spark, links, scratch)
        scratch.drop(rows)
        rows = scratch.save("rows", rooted(met.join(sized, "key"), stars))
    rest = scratch.save("rest", rows.join(apart(rows.select("at", "root", early)).select("at", F.ceil(F.col("n") / block).alias("blocks")), "at"))
    scratch.drop(met, open_, rows)
    scratch.release()
    one = rest.select("at", F.col("key").alias("u"), "m", "i", F.col("root").alias("p"), F.pmod(F.xxhash64("key"), F.col("blocks")).alias("part"))
    other = rest.select("at", F.col("key").alias("v"), F.col("m").alias("k"), F.col("i").alias("j"), F.col("root").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"))
    pairs = one.join(other, ["at", "part"]).where((F.col("u") > F.col("v")) & (F.col("p") != F.col("q")) & room)
    more = verified(pairs.select("u", "v").distinct(), classes, texts, scratch, shingle, least)
    scratch.drop(rest)
    return stars if more.isEmpty() else components(spark, links.union(more), scratch)


def shared(m: Column, k: Column, least: float) -> Column:
    """Shingles that sets of m and k must share to be similar."""
    return F.ceil((m + k) * (least / (1 + least)) - 1e-9)


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, least: float) -> DataFrame:
    """The written table of the pairs (u, v) that are similar on whole texts. Texts do not move: their scan tells by a Bloom filter which may
    be asked for, and makes the shingles of these."""
    head = lambda k, n: classes.select(F.col("key").alias(k), F.col("head").alias(n))
    met = pairs.join(head("u", "a"), "u").join(head("v", "b"), "v")
    tail = lambda h: h[0] - F.size(h) + 1
    # of the text whose head ends first, all that is shared up to there is in both heads
    seen = F.size(F.array_intersect(F.slice("a", F.lit(2), F.size("a")), F.slice("b", F.lit(2), F.size("b"))))
    enough = seen + F.greatest(tail(F.col("a")), tail(F.col("b"))) >= shared(F.col("a")[0], F.col("b")[0], least)
    pairs = scratch.save("candidates", met.where(enough).select("u", "v"))
    scratch.release()
    # either end is made distinct by itself: many classes meet few smallest ones
    ends = pairs.select(F.col("u").alias("key")).distinct().union(pairs.select("v").distinct()).distinct()
    named = scratch.save("named", ends.join(classes.select("key", "rid"), "key"))
    asked = Bloom(named.select("rid"))

    def make(batches):
        for b in batches:
            b = b.filter(asked.holds(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(h, shingle).view(np.int64) for h in word_hashes(b.column(1))], pa.list_(pa.int64()))], names=["rid", "s"])

    sets = texts.select("rid", "text", F.xxhash64("rid").alias("h")).mapInArrow(make, "rid long, s array<long>")
    sets = scratch.save("sets", sets.join(named, "rid").select("key", "s"))
    both = pairs.join(sets.select(F.col("key").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("s").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    links = scratch.save("links", both.where(common >= least * (F.size("a") + F.size("b") - common)).select("u", "v"))
    scratch.drop(pairs, named, sets)
    scratch.release()
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, in their own columns, one of each group whose texts hang together by similarities of at least
    ``least`` on word shingles: that with the smallest id (nulls last), and of repeated rows just one. Texts of equal words
    form one class first; ``groups`` links the classes."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "simhash")
    rows = docs.select(F.struct(*docs.columns).alias("row"), utf8(text_col).alias("t"), F.monotonically_increasing_id().alias("rid"))
    shape = shape_udf(shingle, least, *frequent(rows.select("t"), shingle, scratch))
    kept = scratch.save("rows", rows.select("row", "rid", shape(F.col("t")).alias("shape")))
    rank = F.struct(F.col(f"row.`{id_col}`").isNull().alias("late"), F.col(f"row.`{id_col}`").alias("id"), F.col("rid").alias("rid"))
    classes = kept.groupBy("shape.key").agg(F.min(rank).alias("rank"), F.min(F.struct("rid", "shape.wide", "shape.head")).alias("one"))
    classes = scratch.save("classes", classes.select("key", "rank", "one.rid", "one.wide", "one.head"))
    stars = groups(classes, kept.select("rid", utf8(f"row.{text_col}").alias("text")), scratch, shingle, least)
    scratch.release()
    named = classes.select("key", "rank").join(stars.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    chosen = named.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.rid").alias("rid"))
    return kept.join(chosen, "rid", "left_semi").select("row.*")
