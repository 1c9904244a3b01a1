"""Best-fit packing by a grouping genetic algorithm.

Documents become token pieces of at most ``capacity``; full pieces are sequences by themselves. The others
are dealt into shards of about ``shard_pieces``. Several islands evolve packings of each shard: crossover
injects whole well-filled bins of the second parent into the first, removes the first's bins that hold any
of the same pieces, and best-fits the displaced pieces; mutation empties poorly filled bins. Between epochs
every island's elite migrates to the next island (a join on shard and island). Islands begin with best fit in orders
disturbed differently, never in falling order itself, and every island crosses over for some generations and takes in one elite
before the bound ceil(sum/capacity), which proves a packing best, may end the work. What the shards' emptiest bins hold is packed again
together, and that result is used if it takes fewer sequences.

Defined cases: a null or empty text is its end token alone; repeated rows are packed each; a null doc_id is
carried along; an empty table gives an empty result. Rows of islands hold at most a shard; nothing is
gathered beyond it.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import Scratch, tune, utf8, workers

CAPACITY = 4096
END = 1
#: Entries of each of the two generations of a worker's cache: about 60 MB in all.
CACHE = 200_000
#: What sends a text to the tokenizer whole: special tokens' beginning, separators that are no white space to it.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


class Generations(dict):
    """A cache that computes what it lacks; two generations bound it without forgetting what is in use."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old.clear()
            self.old.update(self)
            self.clear()
        self[key] = value
        return value


#: Bytes that byte-level vocabularies show as other characters: those without a visible form of their own.
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
LEVEL = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in SHOWN)}


class Words:
    """Ids of whole texts, equal to those of the tokenizer, by way of a cache of runs.

    For the byte-level vocabulary ``word_bpe_49k`` only: a text is normalised and cut into runs (letters, one digit, other
    marks) as its tokenizer does, and each run goes to the BPE model directly. Texts that hold a special token's string, the
    four separators that only Python takes for white space, or code points too new to be letters or none to all, go to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # the same for Latin-1, where its letters and numbers can be listed: twice as fast
        letters, numbers = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
        self.cut_latin = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^\s{letters}{numbers}]+").findall
        self.runs = Generations(self.run, CACHE)

    def run(self, r: str) -> bytes:
        shown = r if r.isascii() and r.isprintable() else r.encode().decode("latin-1").translate(LEVEL)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        try:
            latin = text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            latin = False
        if any(x in text for x in ODD) or not latin and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        runs = self.cut_latin(text.lower()) if latin else self.cut(self.tok.normalizer.normalize_str(text))
        return b"".join(map(self.runs.__getitem__, runs))


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, id_col: str, text_col: str, vocab: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids and the end token."""

    def cut(batches):
        import public_tokenizers

        w = words(vocab or public_tokenizers.path("word_bpe_49k.json"))
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            who, no, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = w.ids(t) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    who.append(i)
                    no.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(no, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[id_col, "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return src.mapInArrow(cut, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Room:
    """Bins by room left, for best fit in a step: one bit per room size that some bin has."""

    def __init__(self, capacity: int):
        self.capacity, self.bits, self.by = capacity, 0, {}

    def put(self, room: int, b: int) -> None:
        self.by.setdefault(room, []).append(b)
        self.bits |= 1 << room

    def take(self, size: int) -> tuple[int, int]:
        """The bin with the least room for ``size``, as (room, bin), or (-1, -1)."""
        over = self.bits >> size
        if not over:
            return -1, -1
        room = size + (over & -over).bit_length() - 1
        stack = self.by[room]
        b = stack.pop()
        if not stack:
            del self.by[room]
            self.bits ^= 1 << room
        return room, b


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Adds the items in the order given to the fullest bin that has room."""
    bins = [] if bins is None else bins
    room = Room(capacity)
    for k, b in enumerate(bins):
        if (left := capacity - sum(sizes[i] for i in b)) > 0:
            room.put(left, k)
    for i in order:
        left, k = room.take(sizes[i])
        if k < 0:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        if left > sizes[i]:
            room.put(left - sizes[i], k)
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean square of the fill)."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(one: list[list[int]], two: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """``two``'s well-filled bins, or some of them, take the place of ``one``'s bins with the same items."""
    full = sorted(two, key=lambda b: -sum(sizes[i] for i in b))
    share = full[: max(1, len(full) // 2)]
    inject = rng.sample(share, max(1, int(len(share) * rng.uniform(0.2, 0.8))))
    taken = {i for b in inject for i in b}
    keep, loose = [list(b) for b in inject], []
    for b in one:
        if taken.isdisjoint(b):
            keep.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    loose.sort(key=lambda i: -sizes[i])
    return best_fit(loose, sizes, capacity, keep)


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empties the worst bins and a few others, and best-fits their items again."""
    if len(bins) < 2:
        return bins
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    drop = set(order[: max(1, len(bins) // 50)]) | set(rng.sample(range(len(bins)), min(len(bins) - 1, max(2, len(bins) // 30))))
    loose = [i for k in drop for i in bins[k]]
    loose.sort(key=lambda i: -sizes[i] * rng.uniform(0.9, 1.0))
    return best_fit(loose, sizes, capacity, [list(b) for k, b in enumerate(bins) if k not in drop])


def bound(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: the sum's quotient, or the items over half a bin."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def evolve(sizes: list[int], population: list[list[list[int]]], capacity: int, generations: int, seed: int, size: int = 4, at_least: int = 4) -> tuple[list[list[list[int]]], int]:
    """One island's epoch: the population, best first, and how many children it had. An empty population is seeded by best fit
    in disturbed orders. A packing that meets the bound ends the epoch after ``at_least`` generations."""
    rng = random.Random(seed)
    least = bound(sizes, capacity)
    if not population:
        population = [best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.9, 1.0)), sizes, capacity) for _ in range(size)]
    ranked = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    children = 0
    while children < generations and (children < at_least or len(ranked[0][2]) > least):
        one, two = (min(rng.sample(ranked, min(2, len(ranked))), key=lambda x: x[:2])[2] for _ in range(2))
        child = crossover(one, two, sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        children += 1
        ranked = sorted([*ranked, (fitness(child, sizes, capacity), len(population) + children, child)], key=lambda x: x[:2])[:size]
    return [p for _, _, p in ranked], children


def flat(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def unflat(data: bytes) -> list[list[int]]:
    at = np.frombuffer(data, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(at.max()) + 1 if len(at) else 0)]
    for i, k in enumerate(at.tolist()):
        bins[k].append(i)
    return bins


STATE = "shard long, island int, pids array<long>, sizes array<int>, packings array<binary>, bins int, least int, children long, guests long"


def epoch(state: DataFrame, capacity: int, generations: int, seed: int) -> DataFrame:
    """Each island's row evolved; packings are stored as bin numbers, best first."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                sizes = r["sizes"]
                pop, children = evolve(sizes, [unflat(p) for p in r["packings"]], capacity, generations, hash((seed, r["shard"], r["island"])))
                r |= {"packings": [flat(p, len(sizes)) for p in pop], "bins": len(pop[0]), "least": bound(sizes, capacity), "children": r["children"] + children}
                yield pa.RecordBatch.from_pylist([r], schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("pids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("packings", pa.list_(pa.binary())), ("bins", pa.int32()), ("least", pa.int32()), ("children", pa.int64()), ("guests", pa.int64())])
    return state.mapInArrow(run, STATE)


def evolved(spark: SparkSession, items: DataFrame, scratch: Scratch, capacity: int, shard_pieces: int, islands: int, epochs: int, generations: int, seed: int) -> DataFrame:
    """The islands of every shard of items (pid, length) after their last epoch, with their children and the elites they took in."""
    n = items.count()
    shards = max(1, -(-n // shard_pieces))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(shards)).cast("long"))
    rows = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("pid", "length"))).alias("x"))
    none = [F.expr("cast(array() as array<binary>)").alias("packings"), F.lit(0).alias("bins"), F.lit(0).alias("least"), F.lit(0).cast("long").alias("children"), F.lit(0).cast("long").alias("guests")]
    state = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.pid").alias("pids"), F.transform("x.length", lambda v: v.cast("int")).alias("sizes"), *none)
    spread = workers(spark)
    for e in range(epochs):
        state = scratch.save("islands", epoch(state.repartition(spread, "shard", "island"), capacity, generations, seed + e))
        best = state.groupBy("shard").agg(F.min("bins").alias("b"), F.max("least").alias("l"))
        if e == epochs - 1 or e > 0 and best.where("b > l").limit(1).count() == 0:
            break
        elite = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.element_at("packings", 1).alias("guest"))
        state = state.join(elite, ["shard", "island"]).withColumn("packings", F.concat("packings", F.array("guest"))).withColumn("guests", F.col("guests") + 1)
        state = state.select("shard", "island", "pids", "sizes", "packings", "bins", "least", "children", "guests")
    return state


def solve(state: DataFrame, scratch: Scratch) -> DataFrame:
    """(pid, sequence, fill): the best island's packing of each shard."""
    top = state.groupBy("shard").agg(F.min_by(F.struct("pids", "sizes", F.element_at("packings", 1).alias("packing")), F.struct("bins", "island")).alias("t"))

    def spell(batches):
        for b in batches:
            for r in b.to_pylist():
                at = np.frombuffer(r["packing"], "<i4")
                sizes = np.array(r["sizes"], np.int64)
                fill = np.bincount(at, sizes).astype(np.int64)
                order = np.argsort(at, kind="stable")
                start = np.cumsum(sizes[order]) - sizes[order]
                first = np.searchsorted(at[order], at[order])
                offset = np.empty(len(at), np.int64)
                offset[order] = start - start[first]
                yield pa.RecordBatch.from_pydict({"pid": pa.array(r["pids"], pa.int64()), "sequence_id": pa.array((r["shard"] << 20) + at.astype(np.int64)), "offset": pa.array(offset), "fill": pa.array(fill[at])})

    return scratch.save("packed", top.select("shard", "t.*").mapInArrow(spell, "pid long, sequence_id long, offset long, fill long"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, capacity: int = CAPACITY, shard_pieces: int = 4096,
         islands: int = 3, epochs: int = 3, generations: int = 12, loose_fill: float = 0.9995, seed: int = 5) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "packing")
    cut = scratch.save("pieces", pieces(docs, id_col, text_col, vocab, capacity).withColumn("pid", F.monotonically_increasing_id()))
    full = cut.where(F.col("length") == capacity).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    how = (scratch, capacity, shard_pieces, islands, epochs, generations)
    first = solve(evolved(spark, cut.where(F.col("length") < capacity).select("pid", "length"), *how, seed), scratch)
    loose = first.where(F.col("fill") < int(capacity * loose_fill))
    again = solve(evolved(spark, loose.join(cut, "pid").select("pid", "length"), *how, seed + 100), scratch)
    before = loose.where("offset = 0").count()
    after = again.where("offset = 0").count()
    cols = ["pid", "sequence_id", "offset"]
    if after < before:
        packed = first.where(F.col("fill") >= int(capacity * loose_fill)).select(cols).union(again.select("pid", (F.col("sequence_id") + F.lit(1 << 60)).alias("sequence_id"), "offset"))
    else:
        packed = first.select(cols)
    return cut.join(full.union(packed), "pid").drop("pid")
