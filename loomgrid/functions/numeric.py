"""Scalar numeric functions: quantising, encodings, losses and schedules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(x: Column, low: float, high: float, levels: int) -> Column:
    if not (isinstance(levels, int) and levels > 1) or low >= high:
        raise ValueError("levels must be over 1 and low below high")
    c = F.greatest(F.least(x, F.lit(high)), F.lit(low)) - low
    return F.least(F.floor(F.lit(float(levels)) * c / (high - low)), F.lit(levels - 1)).cast("long")


def dequantize(q: Column, low: float, high: float, levels: int) -> Column:
    return (q + 0.5) * (high - low) / levels + low


def inverse_sigmoid(x: Column, eps: float = 1e-5) -> Column:
    x = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    return F.log(F.greatest(x, F.lit(eps)) / F.greatest(1 - x, F.lit(eps)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def coordinate_encoding(x: Column, features: int = 128, temperature: float = 10000.0, scale: float = 2 * math.pi) -> Column:
    """Array of ``features`` values: sines at even places, cosines at odd, falling frequencies."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(features - 1)),
        lambda i: F.when(i % 2 == 0, F.sin(x * scale / F.pow(F.lit(temperature), 2 * F.floor(i / 2) / features))).otherwise(F.cos(x * scale / F.pow(F.lit(temperature), 2 * F.floor(i / 2) / features))),
    )


def gaussian_radius(w: Column, h: Column, min_overlap: float = 0.7) -> Column:
    """Least of the radii of three corner configurations."""
    s, p = w + h, w * h
    r1 = (s - F.sqrt(s * s - 4 * p * (1 - min_overlap) / (1 + min_overlap))) / 2
    r2 = (2 * s - F.sqrt(4 * s * s - 16 * (1 - min_overlap) * p)) / 8
    b3, a3, c3 = -2 * min_overlap * s, 4 * min_overlap, (min_overlap - 1) * p
    r3 = (b3 + F.sqrt(b3 * b3 - 4 * a3 * c3)) / (2 * a3)
    return F.least(r1, r2, r3)


def gaussian_value(dx: Column, dy: Column, radius: Column) -> Column:
    """Target of a point at an offset from the centre; sigma is a sixth of the diameter; tiny values are 0."""
    sigma = (2 * radius + 1) / 6
    v = F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))
    return F.when(v < 2.220446049250313e-16, 0.0).otherwise(v)


def make_divisible(v: Column, divisor: int, least: int | None = None, min_ratio: float = 0.9) -> Column:
    low = divisor if least is None else least
    n = F.greatest(F.lit(low), F.floor((v + divisor / 2) / divisor) * divisor)
    return F.when(n < min_ratio * v, n + divisor).otherwise(n).cast("long")


# losses as row metrics ---------------------------------------------------------------------------------


def l1(p: Column, t: Column) -> Column:
    return F.abs(p - t)


def smooth_l1(p: Column, t: Column, beta: float = 1.0) -> Column:
    d = F.abs(p - t)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def balanced_l1(p: Column, t: Column, beta: float = 1.0, alpha: float = 0.5, gamma: float = 1.5) -> Column:
    d = F.abs(p - t)
    b = math.e ** (gamma / alpha) - 1
    return F.when(d < beta, alpha / b * (b * d + 1) * F.log(b * d / beta + 1) - alpha * d).otherwise(gamma * d + gamma / b - alpha * beta)


def mse(p: Column, t: Column) -> Column:
    return (p - t) * (p - t)


def bce_logits(x: Column, t: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


def focal(x: Column, t: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    p = sigmoid(x)
    pt = (1 - p) * t + p * (1 - t)
    return bce_logits(x, t) * (alpha * t + (1 - alpha) * (1 - t)) * F.pow(pt, F.lit(gamma))


def quality_focal(x: Column, score: Column, positive: Column, beta: float = 2.0) -> Column:
    p = sigmoid(x)
    return F.when(positive, bce_logits(x, score) * F.pow(F.abs(score - p), F.lit(beta))).otherwise(bce_logits(x, F.lit(0.0)) * F.pow(p, F.lit(beta)))


def varifocal(x: Column, t: Column, alpha: float = 0.75, gamma: float = 2.0, iou_weighted: bool = True) -> Column:
    p = sigmoid(x)
    pos = F.when(t > 0.0, t if iou_weighted else F.lit(1.0)).otherwise(0.0)
    return bce_logits(x, t) * (pos + alpha * F.pow(F.abs(p - t), F.lit(gamma)) * F.when(t <= 0.0, 1.0).otherwise(0.0))


def dice(p: Column, t: Column, eps: float = 1e-3) -> Column:
    """Of two arrays of equal length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return 1 - 2 * dot(p, t) / (dot(p, p) + eps + dot(t, t) + eps)


def knowledge_distillation(x: Column, soft: Column, temperature: float = 1.0) -> Column:
    """Mean KL divergence of two logit arrays at a temperature, times its square."""

    def probabilities(v):
        e = F.transform(v, lambda y: F.exp(y / temperature))
        s = F.aggregate(e, F.lit(0.0), lambda a, y: a + y)
        return F.transform(e, lambda y: y / s)

    kl = F.zip_with(probabilities(x), probabilities(soft), lambda p, q: q * (F.log(q) - F.log(p)))
    return F.aggregate(kl, F.lit(0.0), lambda a, y: a + y) / F.size(x) * temperature**2


def reduced(loss: Column, weight: Column | None = None, how: str = "mean", avg_factor: float | None = None) -> Column:
    """The aggregate of a loss column: mean, or sum; with ``avg_factor`` the weighted sum over it."""
    w = loss if weight is None else loss * weight
    if avg_factor is not None:
        if how == "sum":
            raise ValueError("avg_factor does not go with sum")
        return F.sum(w) / avg_factor
    return {"mean": F.avg, "sum": F.sum}[how](w)


# schedules ---------------------------------------------------------------------------------------------


def step_schedule(t: Column, base: float, steps: list[int] | int, gamma: float = 0.1, least: float | None = None) -> Column:
    n = F.floor(t / steps) if isinstance(steps, int) else sum((F.when(t >= s, 1).otherwise(0) for s in steps), F.lit(0))
    lr = F.lit(base) * F.pow(F.lit(gamma), n)
    return lr if least is None else F.greatest(lr, F.lit(least))


def exp_schedule(t: Column, base: float, gamma: float) -> Column:
    return F.lit(base) * F.pow(F.lit(gamma), t)


def poly_schedule(t: Column, total: int, base: float, power: float = 1.0, least: float = 0.0) -> Column:
    return (base - least) * F.pow(1 - t / total, F.lit(power)) + least


def inv_schedule(t: Column, base: float, gamma: float, power: float = 1.0) -> Column:
    return F.lit(base) * F.pow(1 + gamma * t, F.lit(-power))


def cosine(start: float, end: float, part: Column, weight: float = 1.0) -> Column:
    return end + 0.5 * weight * (start - end) * (F.cos(math.pi * part) + 1)


def cosine_schedule(t: Column, total: int, base: float, least: float = 0.0) -> Column:
    return cosine(base, least, t / total)


def cosine_restart_schedule(t: Column, periods: list[int], weights: list[float], base: float, least: float = 0.0) -> Column:
    out, start = None, 0
    for p, w in zip(periods, weights, strict=True):
        v = cosine(base, least, (t - start) / p, w)
        out = F.when(t < start + p, v) if out is None else out.when(t < start + p, v)
        start += p
    return out


def cyclic_schedule(t: Column, total: int, base: float, up: float = 10.0, down: float = 1e-4, cycles: int = 1, up_share: float = 0.4) -> Column:
    period = total // cycles
    rise = int(up_share * period)
    at = t % period
    return F.when(at < rise, cosine(base, base * up, at / rise)).otherwise(cosine(base * up, base * down, (at - rise) / (period - rise)))


def one_cycle_schedule(t: Column, total: int, peak: float, rise_share: float = 0.3, div: float = 25.0, final_div: float = 1e4) -> Column:
    rise = float(rise_share * total) - 1
    low = peak / div
    return F.when(t <= rise, cosine(low, peak, t / rise)).otherwise(cosine(peak, low / final_div, (t - rise) / (total - 1 - rise)))


def warmup(t: Column, regular: Column, steps: int, ratio: float = 0.1, kind: str = "linear") -> Column:
    part = t / steps
    k = {"constant": F.lit(ratio), "linear": 1 - (1 - part) * (1 - ratio), "exp": F.pow(F.lit(ratio), 1 - part)}[kind]
    return F.when(t < steps, regular * k).otherwise(regular)


def human_flops(v: Column, units: str | None = None, precision: int = 2) -> Column:
    sizes = {"GFLOPs": 1e9, "MFLOPs": 1e6, "KFLOPs": 1e3}
    text = lambda u: F.concat(F.round(v / sizes[u], precision).cast("string"), F.lit(f" {u}"))
    plain = F.concat(v.cast("string"), F.lit(" FLOPs"))
    if units:
        return text(units) if units in sizes else plain
    whole = lambda s: F.floor(v / s) > 0
    return F.when(whole(1e9), text("GFLOPs")).when(whole(1e6), text("MFLOPs")).when(whole(1e3), text("KFLOPs")).otherwise(plain)


def human_params(v: Column, units: str | None = None, precision: int = 2) -> Column:
    sizes = {"M": 1e6, "K": 1e3}
    text = lambda u: F.concat(F.round(v / sizes[u], precision).cast("string"), F.lit(f" {u}"))
    if units:
        return text(units) if units in sizes else v.cast("string")
    return F.when(F.floor(v / 1e6) > 0, text("M")).when(F.floor(v / 1e3) > 0, F.concat(F.round(v / 1e3, precision).cast("string"), F.lit(" k"))).otherwise(v.cast("string"))


def zero_shot_logit(feature: Column, weight: Column, bias: float = 0.0, temperature: float = 50.0) -> Column:
    """Of two arrays: both made unit vectors, the first times the temperature, dot product plus bias."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return temperature * dot(feature, weight) / (F.greatest(F.sqrt(dot(feature, feature)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(weight, weight)), F.lit(1e-12))) + bias


def fused_score(a: Column, b: Column, power: float = 0.4) -> Column:
    return F.pow(a, F.lit(power)) * F.pow(b, F.lit(1 - power))
