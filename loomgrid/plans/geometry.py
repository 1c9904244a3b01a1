"""Queries over box functions: conversions, augmentation geometry, coders, overlap losses and number helpers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import boxes as B
from loomgrid.functions import numeric as N
from loomgrid.operators import compose as C
from loomgrid.operators import metrics as M
from loomgrid.operators import spatial as P
from loomgrid.plans import fixtures as X
from loomgrid.plans.families import PAIR, Family, other, pair
from loomgrid.plans.fixtures import DET, GT, IMG, area_sql, iou_sql  # noqa: F401

family = Family()
DETS = (X.det, DET, "det", ["det_idx"])
PAIRS = (pair, PAIR, "p", ["det_idx"])
CX, CY, W, H = "((x1 + x2) / 2)", "((y1 + y2) / 2)", "(x2 - x1)", "(y2 - y1)"
GX, GY, GW, GH = "((a1 + a2) / 2)", "((b1 + b2) / 2)", "(a2 - a1)", "(b2 - b1)"


def parts(prefix: str, b) -> dict:
    return {prefix + n: c for n, c in zip(B.Box._fields, b, strict=True)}


def clip_sql(e: str, high) -> str:
    return f"greatest(least({e}, {high}), 0)"


@family(*DETS, cx=CX, cy=CY, w=W, h=H, ncx=clip_sql(f"{CX} / 300", 1), ncy=clip_sql(f"{CY} / 480", 1), nw=clip_sql(f"{W} / 300", 1), ax=f"{CX} * 300", ah=f"{H} * 480", rx1="x1", ry2="y2", wx2="x2", fx1="500 - x2", fy2="480 - y1", fx2="500 - x1")
def box_conversions():
    """MA1-MA6."""
    b = B.box()
    c = B.to_cxcywh(b)
    n, a = B.normalised(*c, 300.0, 480.0), B.rescaled(*c, 300.0, 480.0)
    back, again, f = B.from_cxcywh(*c), B.from_xywh(*B.to_xywh(b)), B.flip(b, 500, 480, "diagonal")
    return dict(cx=c[0], cy=c[1], w=c[2], h=c[3], ncx=n[0], ncy=n[1], nw=n[2], ax=a[0], ah=a[3], rx1=back.x1, ry2=back.y2, wx2=again.x2, fx1=f.x1, fy2=f.y2, fx2=f.x2)


@family(
    *DETS, mx1="500 - x2 * 1.5", my2="y2 * 0.5", ox1="x1", oy2="y2", left="240 - x1", top="250 - y1", right="x2 - 240", cut=clip_sql("240 - x1", 99.9), dx1="x1", sx1=f"{CX} - {W} * 0.75", sy2=f"{CY} + {H} * 0.75",
    lx1=clip_sql("x1 - (x2 - x1 + 1) * 0.25", 399), ly2=clip_sql("y2 + (y2 - y1 + 1) * 0.25", 449), kx2=clip_sql("x2", 399), zx2=clip_sql("x2 * 2.0", 600), zy1=clip_sql("y1 * 0.5", 200),
)
def box_views():
    """MA7-MA12."""
    b = B.box()
    m = B.map_to(b, 500, 480, 1.5, 0.5, "horizontal")
    back = B.map_back(m, 500, 480, 1.5, 0.5, "horizontal")
    px, py = F.lit(240.0), F.lit(250.0)
    d, cut = B.to_distance(px, py, b), B.to_distance(px, py, b, 100.0)
    s, leg = B.about_centre(b, 1.5), B.scaled_legacy(b, 1.5, 400, 450)
    z = B.resized(b, 2.0, 0.5, 600, 200)
    return dict(mx1=m.x1, my2=m.y2, ox1=back.x1, oy2=back.y2, left=d[0], top=d[1], right=d[2], cut=cut[0], dx1=B.from_distance(px, py, *d).x1, sx1=s.x1, sy2=s.y2, lx1=leg.x1, ly2=leg.y2, kx2=B.clip_pixels(b, 400, 450).x2, zx2=z.x2, zy1=z.y1)


FIT = "least(1000.0::DOUBLE / greatest(width, height), 600.0::DOUBLE / least(width, height))"


@family(X.images, IMG, "images", ["image_id"], dict(fw=f"CAST(floor(width * {FIT} + 0.5) AS INT)", fh=f"CAST(floor(height * {FIT} + 0.5) AS INT)", hw="CAST(floor(width * 0.5 + 0.5) AS INT)", pad32="CAST(ceil(width / 32) * 32 AS INT)", pad127="width | 127"), k=FIT)
def image_sizes():
    """MA13, and the padded sizes of MA22 and MA24."""
    w, h = F.col("width"), F.col("height")
    fw, fh, k = B.new_size(w, h, (1000, 600))
    return dict(fw=fw, fh=fh, k=k, hw=B.new_size(w, h, 0.5)[0], pad32=B.padded_size(w, divisor=32), pad127=B.padded_size(w, mask=127))


def keep_sql(x1, y1, x2, y2) -> str:
    return f"({x2}) > ({x1}) AND ({y2}) > ({y1})"


CR = [clip_sql("x1 - 120", 200), clip_sql("y1 - 90", 220), clip_sql("x2 - 120", 200), clip_sql("y2 - 90", 220)]
SH = [clip_sql("x1 + 60", 450), clip_sql("y1 - 40", 430), clip_sql("x2 + 60", 450), clip_sql("y2 - 40", 430)]
MO = [clip_sql("x1 * 0.8 + 300 - 25", 640), clip_sql("y1 * 0.8 + 260 - 10", 640), clip_sql("x2 * 0.8 + 300 - 25", 640), clip_sql("y2 * 0.8 + 260 - 10", 640)]


@family(
    *DETS, dict(kept=keep_sql(*CR), shown=f"({SH[2]}) - ({SH[0]}) > 1 AND ({SH[3]}) - ({SH[1]}) > 1", centred=f"{CX} > 120 AND {CY} > 90 AND {CX} < 320 AND {CY} < 310", seen="x1 < 320 AND x2 > 0 AND y1 < 300 AND y2 > 0"),
    cx1=CR[0], cy1=CR[1], cx2=CR[2], cy2=CR[3], sx1=SH[0], sy1=SH[1], sx2=SH[2], sy2=SH[3], ex1="x1 + 33", ey2="y2 + 44", mx1=MO[0], my1=MO[1], mx2=MO[2], my2=MO[3],
)
def box_crops():
    """MA14-MA18, MA22, FI16 and FI18."""
    b = B.box()
    c, s, e = B.cropped(b, 120, 90, 200, 220), B.shifted(b, 60, -40, 450, 430), B.expanded(b, 33, 44)
    m = B.mosaic_part(b, 0.8, 300, 260, 25, 10, 320, 320)
    patch = B.Box(*(F.lit(float(v)) for v in (120, 90, 320, 310)))
    kept = (B.width(c) > 0) & (B.height(c) > 0)
    return parts("c", c) | parts("s", s) | dict(ex1=e.x1, ey2=e.y2) | parts("m", m) | dict(kept=kept, shown=B.larger_than(s, 1, 1), centred=B.centre_in(b, patch), seen=B.touches_image(b, 320, 300))


FL = "det_idx % 2 = 0"
S1, S2, SY1, SY2 = (clip_sql(f"{c} * 1.25", m) for c, m in (("x1", 480), ("x2", 480), ("y1", 460), ("y2", 460)))
MX1, MX2 = f"(CASE WHEN {FL} THEN 480 - {S2} ELSE {S1} END)", f"(CASE WHEN {FL} THEN 480 - {S1} ELSE {S2} END)"
NX1, NX2, NY1, NY2 = clip_sql(f"{MX1} - 50", 320), clip_sql(f"{MX2} - 50", 320), clip_sql(f"{SY1} - 70", 320), clip_sql(f"{SY2} - 70", 320)


@family(
    *DETS,
    dict(useful=f"({NX2}) - ({NX1}) > 2 AND ({NY2}) - ({NY1}) > 2 AND (({NX2}) - ({NX1})) * (({NY2}) - ({NY1})) / (({MX2} - {MX1}) * ({SY2} - {SY1}) + 1e-16) > 0.2 AND greatest((({NX2}) - ({NX1})) / (({NY2}) - ({NY1}) + 1e-16), (({NY2}) - ({NY1})) / (({NX2}) - ({NX1}) + 1e-16)) < 20"),
    bx1=MX1, bx2=MX2, by1=SY1, tx1=NX1, ty1=NY1, tx2=NX2, ty2=NY2,
)
def box_mixup():
    """MA19."""
    s, t = B.mixup_partner(B.box(), 1.25, 480, 460, F.expr(FL), 50, 70, 320, 320)
    return dict(bx1=s.x1, bx2=s.x2, by1=s.y1) | parts("t", t) | dict(useful=B.still_useful(s, t))


def corners_sql(m, w, h) -> dict[str, str]:
    """Box of the mapped corners by an affine 2x3 matrix, clipped."""
    at = lambda r, x, y: f"({x} * {m[r][0]!r}::DOUBLE + {y} * {m[r][1]!r}::DOUBLE + {m[r][2]!r}::DOUBLE)"
    xs, ys = ([at(r, x, y) for x, y in (("x1", "y1"), ("x2", "y1"), ("x1", "y2"), ("x2", "y2"))] for r in (0, 1))
    return {n: clip_sql(f"{f}({', '.join(v)})", m_) for n, f, v, m_ in (("x1", "least", xs, w), ("y1", "least", ys, h), ("x2", "greatest", xs, w), ("y2", "greatest", ys, h))}


_a = math.radians(8)
AFF = [[1.1 * (math.cos(_a) + math.tan(math.radians(3)) * math.sin(_a)), 1.1 * (-math.sin(_a) + math.tan(math.radians(3)) * math.cos(_a)), 12.0], [1.1 * (math.tan(math.radians(2)) * math.cos(_a) + math.sin(_a)), 1.1 * (-math.tan(math.radians(2)) * math.sin(_a) + math.cos(_a)), -7.0]]
_r = math.radians(-20)
ROT = [[math.cos(_r), math.sin(_r), (1 - math.cos(_r)) * 249.5 - math.sin(_r) * 239.5], [-math.sin(_r), math.cos(_r), math.sin(_r) * 249.5 + (1 - math.cos(_r)) * 239.5]]
WARP = {"w" + k: v for k, v in corners_sql(AFF, 500, 480).items()} | {"r" + k: v for k, v in corners_sql(ROT, 500, 480).items()} | {"h" + k: v for k, v in corners_sql([[1.0, 0.2, 0.0], [0.0, 1.0, 0.0]], 500, 480).items()} | {"v" + k: v for k, v in corners_sql([[1.0, 0.0, 0.0], [0.2, 1.0, 0.0]], 500, 480).items()}


@family(*DETS, **WARP, tx1="greatest(0, x1 - 90)", tx2="least(500, x2 - 90)", uy1="greatest(0, y1 + 90)", uy2="least(480, y2 + 90)")
def box_warps():
    """MA20, MA21."""
    b = B.box()
    t, u = B.translated(b, -90.0, 500, 480), B.translated(b, 90.0, 500, 480, "vertical")
    w = B.warped(b, B.affine_matrix(8, 1.1, 3, 2, 12, -7), 500, 480)
    return parts("w", w) | parts("r", B.rotated(b, 20, 500, 480)) | parts("h", B.sheared(b, 0.2, 500, 480)) | parts("v", B.sheared(b, 0.2, 500, 480, "vertical")) | dict(tx1=t.x1, tx2=t.x2, uy1=u.y1, uy2=u.y2)


BX = ("{c} - {w} / 2", "{c} + {w} / 2")


@family(
    *PAIRS, tt=f"({CY} - b1) / {H} / 4", tb=f"(b2 - {CY}) / {H} / 4", tl=f"({CX} - a1) / {W} / 4", tr=f"(a2 - {CX}) / {W} / 4", tx1="a1", ty2="b2", ux=f"({CX} - a1) / 2", uy1="b1", gx=f"greatest(least(({GX} - {CX}) / 16 + 0.5, 1 - 1e-6), 1e-6)", gw=f"ln(greatest({GW} / {W}, 1e-6))",
    qx1=f"{CX} + (greatest(least(({GX} - {CX}) / 16 + 0.5, 1 - 1e-6), 1e-6) - 0.5) * 16 - {W} / 2 * greatest({GW} / {W}, 1e-6)", ldx=f"({GX} - {CX}) / ({W} + 1)", ldh=f"ln(({GH} + 1) / ({H} + 1))", lx1="a1", ly2="b2", cdw=f"{CX} - {W} * 1.5 / 2", far="300.0",
)
def box_coders():
    """MA25, MA26: encoded parts and boxes decoded again."""
    p, g = B.box(), other()
    t = B.tblr_encode(p, g)
    back = B.tblr_decode(p, t)
    u = B.tblr_encode(p, g, 2.0, by_size=False)
    y = B.grid_encode(p, g, 16.0)
    leg = B.delta_encode(p, g, extra=1)
    grown = B.delta_decode(p, (F.lit(0.0), F.lit(0.0), F.lit(math.log(1.5)), F.lit(0.0)))
    far = B.delta_decode(p, (F.lit(9.0), F.lit(0.0), F.lit(99.0), F.lit(0.0)), max_w=300, max_h=300)
    old = B.delta_decode(p, leg, extra=1)
    return dict(tt=t[0], tb=t[1], tl=t[2], tr=t[3], tx1=back.x1, ty2=back.y2, ux=u[2], uy1=B.tblr_decode(p, u, 2.0, by_size=False).y1, gx=y[0], gw=y[2], qx1=B.grid_decode(p, y, 16.0).x1, ldx=leg[0], ldh=leg[3], lx1=old.x1, ly2=old.y2, cdw=grown.x1, far=far.x2)


def side_sql(start: str, size: str, sign: str, at: str) -> str:
    return f"list_transform(range(0, 4), lambda i: ({start} {sign} (i + 0.5) * {size} - {at}) / {size})"


def _bucket_sql(n: str) -> str:
    start, size, sign, at = {"left": (f"({CX} - {W} * 0.6)", f"({W} * 1.2 / 7)", "+", "a1"), "bottom": (f"({CY} + {H} * 0.6)", f"({H} * 1.2 / 7)", "-", "b2")}[n]
    return side_sql(start, size, sign, at)


BUCKET = f"""{PAIR}, e AS (SELECT det_idx, {_bucket_sql('left')} AS lo, {_bucket_sql('bottom')} AS bo FROM p),
u AS (SELECT det_idx, 'left' AS side, unnest(lo) AS v, unnest(range(0, 4)) AS i FROM e UNION ALL SELECT det_idx, 'bottom', unnest(bo), unnest(range(0, 4)) FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY det_idx, side ORDER BY abs(v), i) AS r FROM u),
s AS (SELECT det_idx, side, CAST(i AS INT) AS line, v, r = 1 AS nearest, CASE WHEN r = 1 OR r <= 2 AND abs(v) < 1 THEN 1.0::DOUBLE ELSE 0 END AS weight, CASE WHEN r = 1 THEN 1.0::DOUBLE WHEN abs(v) < 1 THEN 0 ELSE 1 END AS cls FROM r)"""


def bucket_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA27: a row per side and bucket line."""
    e = pair(spark, sf_dir).select("det_idx", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), B.bucket_encode(B.box(), other(), s, 7, 1.2).alias("e")) for s in ("left", "bottom")))).alias("x"))
    z = e.select("det_idx", "x.side", "x.e.label", F.posexplode(F.arrays_zip(F.col("x.e.offsets").alias("o"), F.col("x.e.weights").alias("w"), F.col("x.e.cls_weights").alias("c"))).alias("line", "z"))
    return z.select("det_idx", "side", F.col("line").cast("int").alias("line"), (F.round("z.o", 6) + 0.0).alias("v"), (F.col("line") == F.col("label")).alias("nearest"), F.col("z.w").alias("weight"), F.col("z.c").alias("cls"))


INTER = "(greatest(least(x2, a2) - greatest(x1, a1), 0) * greatest(least(y2, b2) - greatest(y1, b1), 0))"
UNION = f"({W} * {H} + {GW} * {GH} - {INTER})"
ENC = "(greatest(x2, a2) - least(x1, a1))", "(greatest(y2, b2) - least(y1, b1))"
DIOU = f"({INTER} / ({UNION} + 1e-7) - (pow({CX} - {GX}, 2) + pow({CY} - {GY}, 2)) / (pow({ENC[0]}, 2) + pow({ENC[1]}, 2) + 1e-7))"
IO7 = f"({INTER} / ({UNION} + 1e-7))"
VV = f"(4 / pow(pi(), 2) * pow(atan({GW} / ({GH} + 1e-7)) - atan({W} / ({H} + 1e-7)), 2))"


def smooth_sql(v: str, beta: str) -> str:
    return f"CASE WHEN {v} < {beta} THEN 0.5 * {v} * {v} / {beta} ELSE {v} - 0.5 * {beta} END"


@family(
    *PAIRS, iou=f"{INTER} / greatest({UNION}, 1e-6)", plus=iou_sql("p", "q", 1).replace("q.x1", "p.a1").replace("q.y1", "p.b1").replace("q.x2", "p.a2").replace("q.y2", "p.b2"), iof=f"{INTER} / greatest({W} * {H}, 1e-6)", logl=f"-ln(greatest({INTER} / greatest({UNION}, 1e-6), 1e-6))",
    lin=f"1 - greatest({INTER} / greatest({UNION}, 1e-6), 1e-6)", sq=f"1 - pow(greatest({INTER} / greatest({UNION}, 1e-6), 1e-6), 2)", gl=f"1 - ({INTER} / greatest({UNION}, 1e-7) - ({ENC[0]} * {ENC[1]} - {UNION}) / greatest({ENC[0]} * {ENC[1]}, 1e-7))", dl=f"1 - {DIOU}",
    cl=f"1 - ({DIOU} - CASE WHEN {IO7} > 0.5 THEN {VV} / (1 - {IO7} + {VV} + 1e-7) ELSE 0 END * {VV})",
    bx=smooth_sql(f"(1 - greatest(({GW} - 2 * abs({GX} - {CX})) / ({GW} + 2 * abs({GX} - {CX}) + 1e-3), 0))", "0.2"), bw=smooth_sql(f"(1 - least({GW} / ({W} + 1e-3), {W} / ({GW} + 1e-3)))", "0.2"),
)
def overlap_losses():
    """JO10, JO11, MA34."""
    p, g = B.box(), other()
    b = B.bounded_iou_loss(p, g)
    return dict(iou=B.overlap(p, g), plus=B.overlap(p, g, extra=1), iof=B.overlap(p, g, "iof"), logl=B.iou_loss(p, g), lin=B.iou_loss(p, g, "linear"), sq=B.iou_loss(p, g, "square"), gl=B.giou_loss(p, g), dl=B.diou_loss(p, g), cl=B.ciou_loss(p, g), bx=b[0], bw=b[2])


Z = "(score * 8 - 4)"
SG = f"(1 / (1 + exp(-{Z})))"
BCE = f"(ln(1 + exp({Z})) - {Z} * {{t}})"
LAB = "(CAST(det_idx % 3 = 0 AS INT)::DOUBLE)"
FPT = f"(CASE WHEN det_idx % 3 = 0 THEN 1 - {SG} ELSE {SG} END)"
QT = "(CASE WHEN det_idx % 3 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"
BL = "(abs(x1 - a1) / 50)"
BB = f"({math.e ** 3 - 1!r}::DOUBLE)"


@family(
    *PAIRS, al1="abs(x1 - a1)", sm=smooth_sql("abs(x1 - a1)", "25.0"), ms="(x1 - a1) * (x1 - a1)", bl=f"CASE WHEN {BL} < 1 THEN 0.5 / {BB} * ({BB} * {BL} + 1) * ln({BB} * {BL} + 1) - 0.5 * {BL} ELSE 1.5 * {BL} + 1.5 / {BB} - 0.5 END",
    bce=BCE.format(t=LAB), fl=f"{BCE.format(t=LAB)} * (CASE WHEN det_idx % 3 = 0 THEN 0.25 ELSE 0.75 END) * {FPT} * {FPT}", qf=f"CASE WHEN det_idx % 3 = 0 THEN {BCE.format(t='0.3')} * pow(abs(0.3 - {SG}), 2) ELSE {BCE.format(t='0.0')} * pow({SG}, 2) END",
    vf=f"{BCE.format(t=QT)} * (CASE WHEN det_idx % 3 = 0 THEN 0.3::DOUBLE ELSE 0.75 * pow({SG}, 2) END)", sg=SG, inv="ln(greatest(least(greatest(score * 1.2 - 0.1, 0), 1), 1e-5) / greatest(1 - least(greatest(score * 1.2 - 0.1, 0), 1), 1e-5))", fuse="pow(score, 0.4) * pow(score * 0.5 + 0.25, 0.6)",
    di=f"1 - 2 * (score * {LAB} + (1 - score) * 0.5) / (score * score + (1 - score) * (1 - score) + 1e-3 + {LAB} * {LAB} + 0.25 + 1e-3)",
)
def point_losses():
    """MA30, MA35, WI16."""
    p, t, s, z = F.col("x1"), F.col("a1"), F.col("score"), F.col("score") * 8 - 4
    pos = F.expr("det_idx % 3 = 0")
    y = pos.cast("int").cast("double")
    q = F.when(pos, 0.3).otherwise(0.0)
    return dict(
        al1=N.l1(p, t), sm=N.smooth_l1(p, t, 25.0), ms=N.mse(p, t), bl=N.balanced_l1(p / 50, t / 50), bce=N.bce_logits(z, y), fl=N.focal(z, y), qf=N.quality_focal(z, F.lit(0.3), pos), vf=N.varifocal(z, q), sg=N.sigmoid(z),
        inv=N.inverse_sigmoid(s * 1.2 - 0.1), fuse=N.fused_score(s, s * 0.5 + 0.25), di=N.dice(F.array(s, 1 - s), F.array(y, F.lit(0.5))),
    )


def loss_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA36."""
    loss, w = N.l1(F.col("x1"), F.col("a1")), F.col("score")
    out = pair(spark, sf_dir).groupBy("class_id").agg(N.reduced(loss).alias("m"), N.reduced(loss, how="sum").alias("s"), N.reduced(loss, w).alias("wm"), N.reduced(loss, w, avg_factor=50.0).alias("af"))
    return out.select("class_id", *(F.round(c, 5).alias(c) for c in ("m", "s", "wm", "af")))


def enc_sql(f: str, i: int) -> str:
    return f"{f}(score * 2 * pi() / pow(10000, 2 * floor({i} / 2) / 8))"


@family(
    *DETS, dict(md="CAST(CASE WHEN greatest(16, floor((k0 + 8.0) / 16) * 16) < 0.9 * k0 THEN greatest(16, floor((k0 + 8.0) / 16) * 16) + 16 ELSE greatest(16, floor((k0 + 8.0) / 16) * 16) END AS BIGINT)".replace("k0", "(det_idx % 200 + 1)"), flops="CASE WHEN fl >= 1e9 THEN (fl / 1000000000) || '.0 GFLOPs' WHEN fl >= 1e6 THEN (fl // 1000000) || '.0 MFLOPs' ELSE fl || ' FLOPs' END".replace("fl", "(CASE det_idx % 3 WHEN 0 THEN 7000000000 WHEN 1 THEN 3000000 ELSE 12 END)").replace("/ 1000000000)", "// 1000000000)")),
    e0=enc_sql("sin", 0), e1=enc_sql("cos", 1), e4=enc_sql("sin", 4), e7=enc_sql("cos", 7), gv="exp(-(pow(det_idx % 5, 2) + 4) / (2 * pow((2 * 6.0 + 1) / 6, 2)))",
)
def number_helpers():
    """MA31-MA33, MA41."""
    e = N.coordinate_encoding(F.col("score"), 8)
    v = F.expr("CASE det_idx % 3 WHEN 0 THEN 7000000000 WHEN 1 THEN 3000000 ELSE 12 END")
    return dict(e0=e[0], e1=e[1], e4=e[4], e7=e[7], gv=N.gaussian_value(F.expr("det_idx % 5").cast("double"), F.lit(2.0), F.lit(6.0)), md=N.make_divisible(F.expr("det_idx % 200 + 1"), 16), flops=N.human_flops(v))


SCHED = dict(
    ex="0.1 * pow(0.95, t)", iv="0.1 * pow(1 + 0.01 * t, -0.75)", every="greatest(0.1 * pow(0.5, t // 30), 0.02)", cr="CASE WHEN t < 40 THEN 0.001 + 0.5 * 1.0 * 0.099 * (cos(pi() * t / 40) + 1) ELSE 0.001 + 0.5 * 0.5 * 0.099 * (cos(pi() * (t - 40) / 60) + 1) END",
    cy="CASE WHEN t % 50 < 20 THEN 0.1 * 10 + 0.5 * (0.1 - 0.1 * 10) * (cos(pi() * (t % 50) / 20) + 1) ELSE 0.1 * 1e-4 + 0.5 * (0.1 * 10 - 0.1 * 1e-4) * (cos(pi() * (t % 50 - 20) / 30) + 1) END",
    oc="CASE WHEN t <= 29 THEN 0.4 + 0.5 * (0.016 - 0.4) * (cos(pi() * t / 29) + 1) ELSE 0.016 / 1e4 + 0.5 * (0.4 - 0.016 / 1e4) * (cos(pi() * (t - 29) / 70) + 1) END",
    wl="CASE WHEN t < 25 THEN 0.1 * (1 - (1 - t / 25) * 0.9) ELSE 0.1 END", wc="CASE WHEN t < 25 THEN 0.01 ELSE 0.1 END", we="CASE WHEN t < 25 THEN 0.1 * pow(0.1, 1 - t / 25) ELSE 0.1 END",
)


@family(lambda spark, sf_dir: spark.range(100).withColumnRenamed("id", "t"), "s AS (SELECT range AS t FROM range(0, 100))", "s", ["t"], **SCHED)
def more_schedules():
    """MA38."""
    t = F.col("t").cast("double")
    base = F.lit(0.1)
    return dict(
        ex=N.exp_schedule(t, 0.1, 0.95), iv=N.inv_schedule(t, 0.1, 0.01, 0.75), every=N.step_schedule(t, 0.1, 30, 0.5, 0.02), cr=N.cosine_restart_schedule(t, [40, 60], [1.0, 0.5], 0.1, 0.001), cy=N.cyclic_schedule(t, 100, 0.1, cycles=2), oc=N.one_cycle_schedule(t, 100, 0.4),
        wl=N.warmup(t, base, 25), wc=N.warmup(t, base, 25, kind="constant"), we=N.warmup(t, base, 25, kind="exp"),
    )


ZS = "array_agg(l) AS l FROM (SELECT 1) "


def zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA40: logits against the mean vector of each of three labels."""
    e = X.table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    weights = e.select("label", F.posexplode("embedding").alias("i", "v")).where("label < 3").groupBy("label", "i").agg(F.sum(F.col("v").cast("double")).alias("v"))
    weights = weights.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("w")).withColumnRenamed("label", "class_id")
    out = e.select("vec_id", "embedding").join(F.broadcast(weights))  # three rows
    return out.select("vec_id", "class_id", (F.round(N.zero_shot_logit(F.col("embedding"), F.col("w"), 0.5), 4) + 0.0).alias("logit"))


ZERO = """WITH u AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
w AS (SELECT label AS class_id, i, sum(v) AS w FROM u WHERE label < 3 GROUP BY ALL)
SELECT vec_id, class_id, round(50 * sum(v * w) / (greatest(sqrt(sum(v * v)), 1e-12) * greatest(sqrt(sum(w * w)), 1e-12)) + 0.5, 4) + 0.0 AS logit FROM u JOIN w USING (i) GROUP BY vec_id, class_id"""


@family(*DETS, dict(inb="x1 >= -10 AND y1 >= -10 AND x2 < 410 AND y2 < 410", pin="240 > x1 AND 240 < x2 AND 250 > y1 AND 250 < y2", big=f"{W} > 80 AND {H} > 75", only_low=f"{W} * {H} > 6000"))
def box_predicates():
    """FI13-FI15, FI17, FI19, FI21."""
    b = B.box()
    return dict(inb=B.inside_border(b, 400, 400, 10), pin=B.point_in(F.lit(240.0), F.lit(250.0), b), big=B.larger_than(b, 80, 75), only_low=B.area_between(b, 6000, None))


QUERIES = family.queries | {f.__name__: f for f in (bucket_coder, loss_reduction, zero_shot)}
ORACLE_SQL = family.sql | {
    "bucket_coder": f"WITH {BUCKET} SELECT det_idx, side, line, round(v, 6) + 0.0 AS v, nearest, weight, cls FROM s",
    "loss_reduction": f"WITH {PAIR} SELECT class_id, round(avg(abs(x1 - a1)), 5) AS m, round(sum(abs(x1 - a1)), 5) AS s, round(avg(abs(x1 - a1) * score), 5) AS wm, round(sum(abs(x1 - a1) * score) / 50, 5) AS af FROM p GROUP BY class_id",
    "zero_shot": ZERO,
}
