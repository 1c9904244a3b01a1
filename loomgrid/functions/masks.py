"""Compressed masks: run lengths as the usual compact text, and areas, boxes and overlaps straight from the runs, without their pixels.

A mask is its column-major run lengths, zeros first. The compact text holds each count less the one two before it (from the fourth count on), five
bits to a character, low bits first, with a sixth bit that says that more follow; the last five bits carry the sign.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

#: Fixed values of the text form: bits a character, the bit that tells of more, the sign bit, the first character.
BITS, MORE, SIGN, FIRST = 5, 0x20, 0x10, 48
#: Characters that the longest count can take.
LONGEST = 13
INFO = StructType()
for _name in ("area", "x", "y", "w", "h"):
    INFO = INFO.add(_name, LongType())


def encode(counts: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Texts of masks whose counts follow one another in one array."""
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(counts)) - first
    delta = counts.astype(np.int64)
    back = np.flatnonzero(at > 2)
    delta[back] -= counts[back - 2]
    shifted = delta[:, None] >> (BITS * np.arange(LONGEST))
    low, rest = shifted & (MORE - 1), shifted >> BITS
    more = np.where(low & SIGN, rest != -1, rest != 0)
    used = np.argmin(more, axis=1) + 1
    keep = np.arange(LONGEST) < used[:, None]
    chars = ((low | np.where(more, MORE, 0)) + FIRST).astype(np.uint8)[keep]
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=used, minlength=len(lengths))).astype(int)
    text = chars.tobytes().decode("ascii")
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def decode(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.int64) - FIRST
    if not len(c):
        return np.zeros(0, np.int64)
    last = (c & MORE) == 0
    if not last[-1]:
        raise ValueError("a mask's text ends within a count")
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(c)) - np.repeat(start, np.diff(np.append(start, len(c))))
    value = np.add.reduceat((c & (MORE - 1)) << (BITS * place), start)
    ends = np.flatnonzero(last)
    value -= np.where(c[ends] & SIGN, np.int64(1) << (BITS * (place[ends] + 1)), 0)
    for odd in (0, 1):  # counts two apart are running sums, but for the first three
        k = np.arange(1 if odd else 2, len(value), 2)
        value[k] = np.cumsum(value[k])
    return value


@F.pandas_udf(StringType())
def compact(counts: pd.Series) -> pd.Series:
    """Text of an array of counts; null stays null."""
    there = counts[counts.notna()]
    if not len(there):
        return pd.Series([None] * len(counts), index=counts.index, dtype=object)
    flat = np.concatenate([np.asarray(x, np.int64) for x in there])
    return pd.Series(encode(flat, np.array([len(x) for x in there])), index=there.index, dtype=object).reindex(counts.index)


@F.pandas_udf(ArrayType(LongType()))
def expand(text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else decode(x) for x in text], dtype=object)


@F.pandas_udf(INFO)
def measure(counts: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Area and bounding box (x, y, w, h; zeros for an empty mask) of column-major counts in an image of that height."""
    out = []
    for runs, h in zip(counts, height, strict=True):
        end = np.cumsum(np.asarray(runs, np.int64))
        lo, hi = end[:-1:2] if len(end) % 2 == 0 else end[:-1][::2], end[1::2]
        lo, hi = lo[hi > lo], hi[hi > lo]
        if not len(lo):
            out.append((0, 0, 0, 0, 0))
            continue
        x0, x1 = lo // h, (hi - 1) // h
        whole = x1 > x0  # a run over a column's end touches its bottom and the next one's top
        y0, y1 = np.where(whole, 0, lo % h).min(), np.where(whole, h - 1, (hi - 1) % h).max()
        out.append((int((hi - lo).sum()), int(x0.min()), int(y0), int(x1.max() - x0.min() + 1), int(y1 - y0 + 1)))
    return pd.DataFrame(out, columns=["area", "x", "y", "w", "h"])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Pixels that two masks share, by merging the ends of their runs."""
    ea, eb = np.cumsum(a), np.cumsum(b)
    cuts = np.union1d(ea, eb)
    start = np.concatenate([[0], cuts[:-1]])
    on = (np.searchsorted(ea, start, side="right") % 2 == 1) & (np.searchsorted(eb, start, side="right") % 2 == 1)
    return int((cuts - start)[on].sum())


@F.pandas_udf(StructType().add("inter", LongType()).add("iou", DoubleType()))
def overlap(a: pd.Series, b: pd.Series, crowd: pd.Series) -> pd.DataFrame:
    """Shared pixels and overlap of two arrays of counts; of a crowd ``b`` the overlap is over ``a`` alone. 0 where there is nothing."""
    out = []
    for p, q, c in zip(a, b, crowd, strict=True):
        p, q = np.asarray(p, np.int64), np.asarray(q, np.int64)
        both, own, other = shared(p, q), int(p[1::2].sum()), int(q[1::2].sum())
        union = own if c else own + other - both
        out.append((both, both / union if union else 0.0))
    return pd.DataFrame(out, columns=["inter", "iou"])
