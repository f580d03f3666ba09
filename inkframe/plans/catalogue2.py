"""Registered queries over colours, boxes, candidates and document trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkframe.functions import parsers as P
from inkframe.operators import boxes as B
from inkframe.operators import colour as C
from inkframe.operators import doctree as D
from inkframe.operators import kernels as K
from inkframe.operators import raster as R
from inkframe.operators import runs as W
from inkframe.operators import select as S
from inkframe.operators import trace as T
from inkframe.plans.catalogue import query
from inkframe.sources import sinks as KS
from inkframe.sources import views as V

# --- colours --------------------------------------------------------------------


@query("A6_background", "rgb", "+ n AS (SELECT image_id, r, g, b, count(*) AS n FROM rgb GROUP BY ALL) SELECT image_id, r, g, b, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS k FROM n) WHERE k = 1")
def _(s, d):
    return C.background(V.px_evt(s, d))


def _directions(origin: str, cut: str, ground: str) -> str:
    dr, dg, db = (f"({c} - {origin})" for c in "rgb")
    arms = []
    for r, g, b in V.INKS:
        vr, vg, vb = r - int(origin), g - int(origin), b - int(origin)
        n2 = vr * vr + vg * vg + vb * vb
        dot = f"({dr} * ({vr}) + {dg} * ({vg}) + {db} * ({vb}))"
        size = f"sqrt({dr} * {dr} + {dg} * {dg} + {db} * {db})"
        arms.append((f"CASE WHEN {size} > 0 THEN round({dot} / ({size} * sqrt({n2})), 9) END", f"{dot} / CAST({n2} AS DOUBLE)"))
    (c0, a0), (c1, a1) = arms
    return f"""+ d AS (SELECT *, {c0} AS c0, {c1} AS c1, {a0} AS a0, {a1} AS a1, {dr} = 0 AND {dg} = 0 AND {db} = 0 AS zero FROM rgb),
lab AS (SELECT image_id, y, x, r, g, b, CASE WHEN zero{cut} THEN {ground} WHEN c0 >= c1 THEN 0 ELSE 1 END AS label,
CASE WHEN zero{cut} THEN 0.0 ELSE greatest(0.0, least(1.0, CASE WHEN c0 >= c1 THEN a0 ELSE a1 END)) END AS cov FROM d)"""


FROM_WHITE = _directions("255", " OR greatest(c0, c1) < sqrt(0.5)", "-1")
FROM_GROUND = _directions("250", "", "0")


def _labelled(s, d):
    return C.labels(V.px_evt(s, d), list(V.INKS))


@query("C7_direction_labels", "rgb", FROM_WHITE + " SELECT image_id, y, x, label, round(cov, 6) AS cov FROM lab")
def _(s, d):
    return _labelled(s, d).select("image_id", "y", "x", "label", F.round("cov", 6).alias("cov"))


@query("C8_background_labels", "rgb", FROM_GROUND + " SELECT image_id, y, x, label, round(cov, 6) AS cov FROM lab")
def _(s, d):
    out = C.labels(V.px_evt(s, d), list(V.INKS), origin=(250, 250, 250), cut=None)
    return out.select("image_id", "y", "x", "label", F.round("cov", 6).alias("cov"))


@query("C4_ink_gray", "rgb", FROM_WHITE + " SELECT image_id, y, x, CASE WHEN label = 0 THEN (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 ELSE 255 END AS gray FROM lab")
def _(s, d):
    out = C.ink_gray(_labelled(s, d), 0, C.luma(F.col("r"), F.col("g"), F.col("b")))
    return out.select("image_id", "y", "x", F.col("gray").cast("int").alias("gray"))


@query("C6_ink_mask", "rgb", FROM_WHITE + " SELECT image_id, count(*) FILTER (label = 0 AND round(cov, 6) >= 0.5) AS n0, count(*) FILTER (label = 1 AND round(cov, 6) >= 0.5) AS n1 FROM lab GROUP BY 1")
def _(s, d):
    x = _labelled(s, d).withColumn("cov", F.round("cov", 6))
    return x.groupBy("image_id").agg(F.count_if(C.ink_mask(0)).alias("n0"), F.count_if(C.ink_mask(1)).alias("n1"))


@query("A5_palette_check", "rgb", FROM_WHITE + """, n AS (SELECT image_id, label, r, g, b, count(*) AS n FROM lab WHERE label >= 0 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY n DESC, r, g, b) AS k FROM n),
m AS (SELECT image_id, label, r, g, b, n, greatest(abs(r - CASE label WHEN 0 THEN 190 ELSE 30 END), abs(g - CASE label WHEN 0 THEN 60 ELSE 28 END), abs(b - CASE label WHEN 0 THEN 110 ELSE 35 END)) AS max_diff FROM t WHERE k = 1)
SELECT *, max_diff <= 12 AS ok FROM m""")
def _(s, d):
    return C.palette_check(_labelled(s, d), list(V.INKS))


@query("A3_band_colour", "rgb", """+ d AS (SELECT *, image_id * 25 + y AS band, r + g + b < 384 AS dark FROM rgb), k AS (SELECT band, bool_or(dark) AS any_dark FROM d GROUP BY 1)
SELECT band, CAST(round_even(median(r), 0) AS BIGINT) AS r, CAST(round_even(median(g), 0) AS BIGINT) AS g, CAST(round_even(median(b), 0) AS BIGINT) AS b FROM d JOIN k USING (band) WHERE dark OR NOT any_dark GROUP BY 1""")
def _(s, d):
    px = V.px_evt(s, d).withColumn("band", F.col("image_id") * 25 + F.col("y"))
    return C.band_colour(px, ("band",), 128)


def _cones(rounds: int) -> str:
    """The greedy rule, a round at a time: the farthest colour left, its cone, and
    whether the cone or its tip alone leaves."""
    parts = ["""+ h AS (SELECT image_id, r, g, b, count(*) AS n FROM rgb GROUP BY ALL),
bg AS (SELECT image_id, arg_max(struct_pack(r := r, g := g, b := b), struct_pack(n := n, r := -r, g := -g, b := -b)) AS c FROM h GROUP BY 1),
f AS (SELECT h.*, r - c.r AS x, g - c.g AS y, b - c.b AS z FROM h JOIN bg USING (image_id)),
t AS (SELECT *, sqrt(CAST(x * x + y * y + z * z AS DOUBLE)) AS dist FROM f),
m AS (SELECT *, max(dist) OVER (PARTITION BY image_id) AS far FROM t),
l0 AS (SELECT image_id, r, g, b, n, dist, x / dist AS x, y / dist AS y, z / dist AS z, greatest(1, floor(sum(n) OVER (PARTITION BY image_id) * 0.01)) AS need FROM m WHERE dist > 0 AND dist >= 0.05 * far AND n >= 15)"""]
    for k in range(rounds):
        parts.append(f"""tip{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY dist DESC, r, g, b) AS q FROM l{k}) WHERE q = 1),
in{k} AS (SELECT l.*, t.dist AS top, l.x * t.x + l.y * t.y + l.z * t.z > 0.995 AS inside, l.r = t.r AND l.g = t.g AND l.b = t.b AS tip FROM l{k} l JOIN tip{k} t USING (image_id)),
mass{k} AS (SELECT image_id, sum(n) AS mass, sum(n) >= any_value(need) AS ok FROM in{k} WHERE inside GROUP BY 1),
ink{k} AS (SELECT image_id, r, g, b, mass, {k} AS round FROM (SELECT i.*, mass, ok, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS q FROM in{k} i JOIN mass{k} USING (image_id) WHERE inside AND dist >= 0.85 * top) WHERE q = 1 AND ok),
l{k + 1} AS (SELECT i.image_id, r, g, b, n, dist, x, y, z, need FROM in{k} i JOIN mass{k} USING (image_id) WHERE CASE WHEN ok THEN NOT inside ELSE NOT tip END)""")
    inks = " UNION ALL ".join(f"SELECT * FROM ink{k}" for k in range(rounds))
    return ",\n".join(parts) + f" SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY round) - 1 AS INT) AS ink, r, g, b, CAST(mass AS BIGINT) AS n FROM ({inks})"


@query("A7_detect_palette", "rgb", _cones(12))
def _(s, d):
    return C.detect_palette(V.px_evt(s, d))


@query("J17_dominant_colour", "rgb", FROM_WHITE + """, bx AS (SELECT DISTINCT image_id, y // 5 AS box, y // 5 * 5 AS y0, y // 5 * 5 + 5 AS y1 FROM rgb),
n AS (SELECT l.image_id, box, label, count(*) AS n FROM lab l JOIN bx ON bx.image_id = l.image_id AND y >= y0 AND y < y1 AND x >= 4 AND x < 30 WHERE label >= 0 AND round(cov, 6) >= 0.5 GROUP BY ALL)
SELECT image_id, box, label, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id, box ORDER BY n DESC, label) AS k FROM n) WHERE k = 1""")
def _(s, d):
    lab = _labelled(s, d).withColumn("cov", F.round("cov", 6))
    box = lab.select("image_id", F.expr("y div 5").alias("box")).distinct()
    box = box.select("image_id", "box", F.lit(4).alias("x0"), (F.col("box") * 5).alias("y0"), F.lit(30).alias("x1"), (F.col("box") * 5 + 5).alias("y1"))
    return C.dominant(lab, box)


@query("FN_hex_rgb", "rgb", "SELECT image_id, y, x, printf('#%02X%02X%02X', r, g, b) AS hex, r + g + b AS total FROM rgb")
def _(s, d):
    x = V.px_evt(s, d).withColumn("hex", C.rgb_hex(F.col("r"), F.col("g"), F.col("b"))).withColumn("c", C.hex_rgb(F.col("hex")))
    return x.select("image_id", "y", "x", "hex", F.expr("c.r + c.g + c.b").alias("total"))


# --- boxes ----------------------------------------------------------------------

_IW = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_IOU = f"({_IW}) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IW})"


@query("J1_box_overlap", "box", f"""SELECT a.image_id, a.seq AS a_seq, a.part AS a_part, b.seq AS b_seq, b.part AS b_part, round({_IOU}, 6) AS iou FROM box a JOIN box b ON a.image_id = b.image_id
AND (a.seq, a.part) < (b.seq, b.part) AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def _(s, d):
    b = V.box_li(s, d)
    pairs = B.overlaps(b, b, cell=32).where("a_seq < b_seq or (a_seq = b_seq and a_part < b_part)")
    return pairs.select("image_id", "a_seq", "a_part", "b_seq", "b_part", F.round("iou", 6).alias("iou"))


def _greedy(most: str) -> str:
    """Boxes in order of score, taken or not one after another: the kept ones of
    each image travel as a list."""
    hit = f"list_filter(kept, lambda k: greatest(0.0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0.0, least(k.y1, o.y1) - greatest(k.y0, o.y0)) > {most} * ((k.x1 - k.x0) * (k.y1 - k.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(0.0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0.0, least(k.y1, o.y1) - greatest(k.y0, o.y0))))"
    row = "struct_pack(seq := o.seq, part := o.part, x0 := o.x0, y0 := o.y0, x1 := o.x1, y1 := o.y1, score := o.score)"
    return f"""+ o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, seq, part) AS nth FROM box),
g AS (WITH RECURSIVE r(image_id, nth, kept, joined, into_nth) AS (
SELECT image_id, nth, [{row}], CAST(NULL AS INT), CAST(NULL AS INT) FROM o WHERE nth = 1
UNION ALL SELECT r.image_id, o.nth, CASE WHEN len({hit}) = 0 THEN list_append(kept, {row}) ELSE kept END, CASE WHEN len({hit}) > 0 THEN o.seq END, CASE WHEN len({hit}) > 0 THEN list_position(kept, {hit}[1]) END
FROM r JOIN o ON o.image_id = r.image_id AND o.nth = r.nth + 1) SELECT * FROM r),
last AS (SELECT image_id, kept FROM g QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY nth DESC) = 1),
flat AS (SELECT image_id, generate_subscripts(kept, 1) AS k, unnest(kept) AS b FROM last)"""


@query("J2_suppression", "box", _greedy("0.5") + " SELECT image_id, b.seq AS seq, b.part AS part, b.score AS score FROM flat")
def _(s, d):
    return B.merge_detections(V.box_li(s, d), 0.5).select("image_id", "seq", "part", "score")


@query("J3_merged_detections", "box", _greedy("0.3") + """, al AS (SELECT image_id, into_nth, list(joined ORDER BY nth) AS also FROM g WHERE joined IS NOT NULL GROUP BY ALL)
SELECT flat.image_id, b.seq AS seq, b.part AS part, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.score AS score, coalesce(also, []) AS also FROM flat LEFT JOIN al ON al.image_id = flat.image_id AND al.into_nth = flat.k""")
def _(s, d):
    return B.merge_detections(V.box_li(s, d), 0.3)


_OVER = "list_filter(kept, lambda k: greatest(0.0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0.0, least(k.y1, o.y1) - greatest(k.y0, o.y0)) > 0.3 * ((k.x1 - k.x0) * (k.y1 - k.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(0.0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0.0, least(k.y1, o.y1) - greatest(k.y0, o.y0))))"


@query("J4_rotated_hits", "box", f"""+ t AS (SELECT image_id, seq, part, 80 - x1 AS x0, 80 - y1 AS y0, 80 - x0 AS x1, 80 - y0 AS y1, score FROM box),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, seq, part) AS nth FROM t),
g AS (WITH RECURSIVE r(image_id, nth, kept, taken) AS (
SELECT image_id, 0, list(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1)), CAST([] AS BIGINT[]) FROM box GROUP BY 1
UNION ALL SELECT r.image_id, r.nth + 1, CASE WHEN len({_OVER}) = 0 THEN list_append(kept, struct_pack(x0 := o.x0, y0 := o.y0, x1 := o.x1, y1 := o.y1)) ELSE kept END, CASE WHEN len({_OVER}) = 0 THEN list_append(taken, o.nth) ELSE taken END
FROM r JOIN o ON o.image_id = r.image_id AND o.nth = r.nth + 1) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY nth DESC) = 1)
SELECT image_id, seq, part, x0, y0, x1, y1, score, 0 AS rot FROM box UNION ALL SELECT o.image_id, seq, part, x0, y0, x1, y1, score, 180 FROM o JOIN g ON g.image_id = o.image_id AND list_contains(taken, o.nth)""")
def _(s, d):
    b = V.box_li(s, d)
    turned = b.select("image_id", "seq", "part", *B.flip_box(F.lit(80), F.lit(80)), "score")
    return B.merge_rotated(b, turned)


@query("C25_flip_box", "box", "SELECT image_id, seq, part, 80 - x1 AS x0, 80 - y1 AS y0, 80 - x0 AS x1, 80 - y0 AS y1 FROM box")
def _(s, d):
    return V.box_li(s, d).select("image_id", "seq", "part", *B.flip_box(F.lit(80), F.lit(80)))


@query("C26_box_mm", "box", "SELECT image_id, seq, part, round(x0 * CAST(0.173 AS DOUBLE), 6) AS x0_mm, round(y0 * CAST(0.173 AS DOUBLE), 6) AS y0_mm, round(x1 * CAST(0.173 AS DOUBLE), 6) AS x1_mm, round(y1 * CAST(0.173 AS DOUBLE), 6) AS y1_mm FROM box")
def _(s, d):
    return R.box_mm(V.box_li(s, d), 0.173).select("image_id", "seq", "part", *[F.round(f"{c}_mm", 6).alias(f"{c}_mm") for c in B.BOX])


@query("C27_floor_filters", "box", "SELECT image_id, seq, part FROM box WHERE score >= 20000 AND (x1 - x0) * (y1 - y0) >= 240")
def _(s, d):
    b = V.box_li(s, d).withColumn("ink", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return B.floors(b, 20000, 240).select("image_id", "seq", "part")


@query("J5_centre_in_box", "box", """SELECT a.image_id, a.seq, a.part FROM box a WHERE score < 40000 AND EXISTS (SELECT 1 FROM box b WHERE b.image_id = a.image_id AND b.score >= 40000
AND (a.x0 + a.x1) / 2.0 BETWEEN b.x0 - 4 AND b.x1 + 4 AND (a.y0 + a.y1) / 2.0 BETWEEN b.y0 - 4 AND b.y1 + 4)""")
def _(s, d):
    b = V.box_li(s, d)
    return B.in_boxes(b.where("score < 40000"), b.where("score >= 40000")).select("image_id", "seq", "part")


@query("J15_erase_boxes", "px box", """+ tb AS (SELECT image_id, x0, y0, x1, y1 FROM box WHERE image_id < 1000000)
SELECT image_id, count(*) AS n_ink FROM px WHERE gray < 128 AND NOT EXISTS (SELECT 1 FROM tb WHERE tb.image_id = px.image_id AND x >= x0 - 2 AND x < x1 + 3 AND y >= y0 - 2 AND y < y1 + 3) GROUP BY 1""")
def _(s, d):
    left = B.erase(R.binarise(V.px_emb(s, d)), V.box_li(s, d))
    return left.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_ink"))


@query("A22_union_box", "box", "SELECT image_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM box GROUP BY 1")
def _(s, d):
    return B.union_box(V.box_li(s, d))


@query("C28_tolerance_flags", "cand", "SELECT seq, abs(iou - width_ratio) / 10000.0 < 0.02 AS ok, abs(iou - width_ratio) / 10000.0 <= 0.05 AS replace FROM cand")
def _(s, d):
    flags = B.off_target(F.abs(F.col("iou") - F.col("width_ratio")) / 10000)
    return V.cand_part(s, d).select("seq", *[c.alias(k) for k, c in flags.items()])


@query("C29_aspect_warning", "box", "SELECT image_id, seq, part, abs((x1 - x0) * 30 - (y1 - y0) * 40) > CAST(0.02 AS DOUBLE) * (y1 - y0) * 40 AS warn, abs(40 * (y1 - y0) / CAST(x1 - x0 AS DOUBLE) - 30) > 0.5 AS warn_mm FROM box")
def _(s, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    warn, warn_mm = B.aspect_warning(w, h, F.lit(40), F.lit(30)), B.aspect_warning_mm(w, h, F.lit(40), F.lit(30))
    return V.box_li(s, d).select("image_id", "seq", "part", warn.alias("warn"), warn_mm.alias("warn_mm"))


# --- candidates, votes, verdicts ------------------------------------------------


@query("T1_best_trial", "cand", "SELECT font, text, seq FROM (SELECT *, row_number() OVER (PARTITION BY font, text ORDER BY (iou > 300) DESC, width_ratio DESC, seq) AS k FROM cand) WHERE k = 1")
def _(s, d):
    t = V.cand_part(s, d).withColumn("has_curve", F.col("iou") > 300).withColumn("soft", F.col("width_ratio"))
    return S.best_trial(t, ["font", "text"]).select("font", "text", "seq")


@query("T2_top_trials", "cand", "SELECT text, seq, nth FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY width_ratio DESC, seq) AS nth FROM cand) WHERE nth <= 8")
def _(s, d):
    return S.top(V.cand_part(s, d), ["text"], [F.desc("width_ratio"), "seq"], 8, "nth").select("text", "seq", F.col("nth").cast("long").alias("nth"))


@query("T3_top_fonts", "cand", "+ sc AS (SELECT *, 7 * iou + 3 * greatest(0, 1000 - abs(width_ratio - 1000)) AS score FROM cand) SELECT text, font, seq, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, seq) AS k FROM sc) WHERE k <= 12")
def _(s, d):
    c = V.cand_part(s, d).withColumn("score", (7 * F.col("iou") + 3 * F.greatest(F.lit(0), 1000 - F.abs(F.col("width_ratio") - 1000))).cast("long"))
    return S.top(c, ["text"], [F.desc("score"), "seq"], 12).select("text", "font", "seq", "score")


@query("RAS12_font_score", "cand", "SELECT seq, round(0.7 * (iou / 1000.0) + 0.3 * greatest(0.0, 1 - abs(width_ratio / 1000.0 - 1)), 6) AS score FROM cand")
def _(s, d):
    score = S.shape_score(F.col("iou") / 1000, F.col("width_ratio") / 1000)
    return V.cand_part(s, d).select("seq", F.round(score, 6).alias("score"))


@query("RAS13_font_consensus", "cand", """+ c AS (SELECT seq % 3 AS grp, font, iou / 1000.0 AS iou, width_ratio / 1000.0 AS wr FROM cand), m AS (SELECT grp, font, avg(iou) AS mi, min(iou) AS lo, avg(wr) AS mw, count(*) AS n_members FROM c GROUP BY ALL)
SELECT grp, font, round(mi, 6) AS mean_iou, round(lo, 6) AS min_iou, n_members, round(0.7 * mi + 0.3 * greatest(0.0, 1 - abs(mw - 1)), 6) AS score FROM m""")
def _(s, d):
    c = V.cand_part(s, d).select((F.col("seq") % 3).alias("grp"), "font", (F.col("iou") / 1000).alias("iou"), (F.col("width_ratio") / 1000).alias("width_ratio"))
    m = S.font_consensus(c, ["grp"])
    return m.select("grp", "font", *[F.round(x, 6).alias(x) for x in ("mean_iou", "min_iou")], "n_members", F.round("score", 6).alias("score"))


@query("T4_adjudicate", "cand variant", """+ tx AS (SELECT region, CASE text WHEN 'click' THEN 'ECONOMY' WHEN 'error' THEN 'STANDARD' ELSE 'PROMO' END AS text, max(score) AS score, min(seq) AS f FROM variant GROUP BY ALL),
t6 AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, f) AS k FROM tx),
bf AS (SELECT text, font, iou, row_number() OVER (PARTITION BY text ORDER BY iou DESC, seq) AS q FROM cand)
SELECT region, t6.text, score, font, iou FROM t6 JOIN bf ON bf.text = t6.text AND q = 1 WHERE k <= 6""")
def _(s, d):
    v = V.variant_evt(s, d).withColumn("text", F.when(F.col("text") == "click", "ECONOMY").when(F.col("text") == "error", "STANDARD").otherwise("PROMO"))
    return S.adjudicate(v, V.cand_part(s, d), ["region"]).select("region", "text", "score", "font", "iou")


@query("T5_pick_variant", "variant", """+ v AS (SELECT *, max(score) OVER (PARTITION BY region) AS best, min(seq) OVER (PARTITION BY region) AS f FROM variant),
p AS (SELECT region, seq, chars, f, row_number() OVER (PARTITION BY region ORDER BY word_gap, score DESC, seq) AS k FROM v WHERE score >= best - 50),
mc AS (SELECT region, chars, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, min(seq)) AS k FROM variant GROUP BY region, chars),
ag AS (SELECT DISTINCT v.region FROM v JOIN p ON p.region = v.region AND p.k = 1 WHERE v.seq <> v.f AND v.chars = p.chars),
st AS (SELECT p.region, p.seq, mc.chars AS modal, ag.region IS NULL AND p.seq = p.f AS fallback FROM p JOIN mc ON mc.region = p.region AND mc.k = 1 LEFT JOIN ag ON ag.region = p.region WHERE p.k = 1),
c AS (SELECT v.region, v.seq, v.text, v.score, v.word_gap, fallback, row_number() OVER (PARTITION BY v.region ORDER BY v.word_gap, v.score DESC, v.seq) AS k FROM v JOIN st ON st.region = v.region WHERE CASE WHEN fallback THEN v.chars = modal ELSE v.seq = st.seq END)
SELECT region, seq, text, score, word_gap, fallback FROM c WHERE k = 1""")
def _(s, d):
    return S.pick_variant(V.variant_evt(s, d), ["region"], tolerance=50).select("region", "seq", "text", "score", "word_gap", "fallback")


@query("A15_vote_text", "variant", """+ g AS (SELECT *, region % 7 AS grp FROM variant), n AS (SELECT grp, count(DISTINCT region) AS n_regions FROM g GROUP BY 1),
t AS (SELECT grp, text, count(DISTINCT region) AS regions, count(*) AS votes, sum(score) AS conf, min(seq) AS f FROM g WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY regions DESC, votes DESC, conf DESC, f) AS k FROM t)
SELECT n.grp, n_regions, CASE WHEN regions >= greatest(1, floor(n_regions * 0.5 + 0.5)) THEN text END AS text, coalesce(regions, 0) AS regions, coalesce(votes, 0) AS votes FROM n LEFT JOIN b ON b.grp = n.grp AND k = 1""")
def _(s, d):
    return S.vote_text(V.variant_evt(s, d).withColumn("grp", F.col("region") % 7), ["grp"])


@query("T6_vote_order", "variant", "+ t AS (SELECT text, count(DISTINCT region) AS regions, count(*) AS votes, CAST(sum(score) AS BIGINT) AS conf, min(seq) AS f FROM variant GROUP BY 1) SELECT text, regions, votes, conf, row_number() OVER (ORDER BY regions DESC, votes DESC, conf DESC, f) AS nth FROM t")
def _(s, d):
    from pyspark.sql import Window

    t = V.variant_evt(s, d).groupBy("text").agg(F.count_distinct("region").alias("regions"), F.count(F.lit(1)).alias("votes"), F.sum("score").alias("conf"), F.min("seq").alias("f"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("regions"), F.desc("votes"), F.desc("conf"), "f")
    return t.withColumn("nth", F.row_number().over(w).cast("long")).drop("f")


@query("A16_reading_support", "variant", "+ m AS (SELECT region, arg_min(chars, seq) AS want FROM variant GROUP BY 1) SELECT region, count(*) FILTER (length(trim(text)) > 0) AS n_readable, count(*) FILTER (chars = want) AS n_agree FROM variant JOIN m USING (region) GROUP BY 1")
def _(s, d):
    v = V.variant_evt(s, d)
    return S.reading_support(v, ["region"], v.groupBy("region").agg(F.min_by("chars", "seq").alias("chars")))


@query("A17_candidate_stats", "cand", "SELECT font, count(*) AS n, round(median(iou), 6) AS median, round(quantile_cont(iou, 0.75), 6) AS p75, max(iou) AS max FROM cand GROUP BY 1")
def _(s, d):
    return S.candidate_stats(V.cand_part(s, d), ["font"], "iou").select("font", "n", F.round("median", 6).alias("median"), F.round("p75", 6).alias("p75"), "max")


VERDICT_ROWS = """+ vi AS (SELECT seq, font, iou / 1000.0 AS iou, 1 + (width_ratio % 100) / 100.0 AS lift, width_ratio / 1000.0 AS width_ratio, CAST(seq % 60 AS INT) AS n_cc, CAST(seq % 17 AS INT) AS n_char,
CASE WHEN seq % 5 = 0 THEN NULL ELSE CAST(seq % 9 AS INT) END AS n_ocr_readable, CASE WHEN seq % 7 = 0 THEN NULL ELSE CAST(seq % 3 AS INT) END AS n_ocr_agree FROM cand),
ck AS (SELECT *, n_cc / greatest(n_char, 1) >= 0.25 AND n_cc / greatest(n_char, 1) <= 4.0 AS a, width_ratio BETWEEN 0.65 AND 1.5 AS b,
n_ocr_readable IS NULL OR n_ocr_agree IS NULL OR (n_ocr_readable >= 4 AND n_ocr_agree >= 1) AS e, iou >= 0.72 AS c, lift >= 1.25 AND iou >= 0.35 AS d FROM vi),
ve AS (SELECT seq, font, a AND b AND e AND (c OR d) AS convert, CASE WHEN NOT (a AND b AND e) THEN 'not_text' WHEN NOT (c OR d) THEN 'weak_match' END AS reject_kind FROM ck)"""


def _verdicts(s, d):
    c = V.cand_part(s, d)
    n = lambda m: (F.col("seq") % m).cast("int")
    rows = c.select(
        "seq", "font", (F.col("iou") / 1000).alias("iou"), (1 + (F.col("width_ratio") % 100) / 100).alias("lift"), (F.col("width_ratio") / 1000).alias("width_ratio"), n(60).alias("n_cc"), n(17).alias("n_char"),
        F.when(F.col("seq") % 5 != 0, n(9)).alias("n_ocr_readable"), F.when(F.col("seq") % 7 != 0, n(3)).alias("n_ocr_agree"),
    )
    return S.verdict(rows)


@query("C22_verdict", "cand", VERDICT_ROWS + " SELECT seq, font, convert, reject_kind FROM ve")
def _(s, d):
    return _verdicts(s, d).select("seq", "font", "convert", "reject_kind")


@query("A20_group_majority", "cand", VERDICT_ROWS + " SELECT seq, CASE WHEN count(*) OVER w >= 2 THEN sum(CAST(convert AS INT)) OVER w * 2 > count(*) OVER w ELSE convert END AS convert, convert AS own FROM ve WINDOW w AS (PARTITION BY font)")
def _(s, d):
    return S.group_majority(_verdicts(s, d), ["font"]).select("seq", "convert", "own")


@query("J6_verdict_default", "cand variant", VERDICT_ROWS + ", rg AS (SELECT DISTINCT region FROM variant) SELECT region, coalesce(convert, false) AS convert FROM rg LEFT JOIN ve ON ve.seq = region")
def _(s, d):
    regions = V.variant_evt(s, d).select(F.col("region").alias("seq")).distinct()
    return S.with_default(regions, _verdicts(s, d), "seq").select(F.col("seq").alias("region"), "convert")


@query("C10_block_kind", "box", """+ f AS (SELECT *, (score % 100) / 100.0 AS fill, (x1 - x0) * (y1 - y0) * 4 AS area, CASE WHEN seq % 4 = 0 THEN NULL ELSE (score % 8) END AS thickness, seq * 5 AS n_comp, x1 - x0 AS w, y1 - y0 AS h FROM box)
SELECT image_id, seq, part, CASE WHEN fill >= 0.85 AND area >= 2000 THEN 'solid' WHEN coalesce(thickness, 0) <= 3.5 AND fill <= 0.35 AND greatest(w, h) >= 40 THEN 'line_art' WHEN area <= 9000 AND n_comp BETWEEN 1 AND 24 THEN 'icon' ELSE 'mixed' END AS kind FROM f""")
def _(s, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    f = V.box_li(s, d).withColumns({"fill": F.col("score") % 100 / 100, "area": w * h * 4, "thickness": F.when(F.col("seq") % 4 != 0, F.col("score") % 8), "n_comp": F.col("seq") * 5, "w": w, "h": h})
    return f.select("image_id", "seq", "part", S.block_kind().alias("kind"))


@query("C11_text_flag", "variant", "SELECT seq, regexp_matches(text, '[\\p{L}\\p{N}]') AS is_text FROM variant")
def _(s, d):
    return V.variant_evt(s, d).select("seq", S.has_text(F.col("text")).alias("is_text"))


@query("C12_suspect_flag", "cand", "SELECT seq, greatest(iou, width_ratio - 1000) < 300 AS suspect FROM cand")
def _(s, d):
    return V.cand_part(s, d).select("seq", S.suspect(F.col("iou"), F.col("width_ratio") - 1000, 300).alias("suspect"))


@query("C21_threshold_shortlist", "cand", "SELECT seq, CASE WHEN iou * 1000 > 200000 THEN [112, 128, 148] ELSE [112, 118, 128, 138, 148] END AS thresholds FROM cand")
def _(s, d):
    return V.cand_part(s, d).select("seq", S.threshold_shortlist(F.col("iou") * 1000, F.array(*map(F.lit, (112, 118, 128, 138, 148)))).alias("thresholds"))


@query("J10_region_thresholds", "cand", "SELECT seq, t.threshold FROM cand, unnest([112, 128, 139, 148, 160, 172, 184]) AS t(threshold)")
def _(s, d):
    return S.region_thresholds(V.cand_part(s, d).select("seq"))


@query("J11_trial_grid", "cand", "SELECT seq, upscale, turd, threshold, alpha, tolerance, turd * upscale * upscale AS turd_px FROM cand, unnest([4, 8]) a(upscale), unnest([2, 3]) b(turd), unnest([112, 128, 139, 148, 160, 172, 184]) c(threshold), unnest([CAST(0.8 AS DOUBLE), 1.0]) e(alpha), unnest([CAST(0.1 AS DOUBLE)]) f(tolerance)")
def _(s, d):
    return S.trial_grid(V.cand_part(s, d).select("seq"))


@query("T7_reading_order", "box", "SELECT image_id, seq, part, row_number() OVER (PARTITION BY image_id ORDER BY y0, x0, seq, part) AS nth FROM box")
def _(s, d):
    return S.top(V.box_li(s, d), ["image_id"], ["y0", "x0", "seq", "part"], 1 << 30, "nth").select("image_id", "seq", "part", F.col("nth").cast("long").alias("nth"))


@query("T8_capped_lists", "variant", "SELECT region, list(seq ORDER BY seq)[1:8] AS votes FROM variant GROUP BY 1")
def _(s, d):
    v = S.top(V.variant_evt(s, d), ["region"], ["seq"], 8)
    return v.groupBy("region").agg(F.array_sort(F.collect_list("seq")).alias("votes"))


@query("SET_distinct_texts", "variant", "SELECT text, min(seq) AS seq FROM variant GROUP BY 1")
def _(s, d):
    return V.variant_evt(s, d).groupBy("text").agg(F.min("seq").alias("seq"))


# --- document trees ---------------------------------------------------------------


@query("A18_layer_profile", "shape", """+ n AS (SELECT doc, page_no, layer_no, layer, count(*) AS total_all, count(*) FILTER (parent_no IS NULL) AS top_level, count(DISTINCT type) AS n_types, coalesce(list(text ORDER BY shape_no) FILTER (text IS NOT NULL), [])[1:50] AS first_texts FROM shape GROUP BY ALL) SELECT * FROM n""")
def _(s, d):
    p = D.layer_profile(V.doc_tree(s, d))
    return p.select("doc", "page_no", "layer_no", "layer", "total_all", "top_level", F.size("type_counts").cast("long").alias("n_types"), "first_texts")


@query("A19_document_rollup", "shape", "SELECT doc, page_no, layer_no, count(*) AS n_shapes, count(DISTINCT type) AS n_types FROM shape GROUP BY ROLLUP (doc, page_no, layer_no) HAVING doc IS NOT NULL")
def _(s, d):
    return D.profile(V.doc_tree(s, d))


def _docs(s, d):
    t = V.doc_tree(s, d)
    return t.where("doc = 'source'"), t.where("doc = 'target'")


@query("J7_page_pairs", "shape", "+ p AS (SELECT DISTINCT doc, page_no FROM shape), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_no) AS nth FROM p) SELECT a.nth, a.page_no AS source_page, b.page_no AS target_page FROM k a JOIN k b ON a.nth = b.nth AND a.doc = 'source' AND b.doc = 'target'")
def _(s, d):
    return D.pair_pages(*_docs(s, d)).withColumn("nth", F.col("nth").cast("long"))


@query("J8_layer_diff", "shape", """+ n AS (SELECT doc, page_no, layer, count(*) AS n, count(*) FILTER (parent_no IS NULL) AS top FROM shape GROUP BY ALL),
p AS (SELECT doc, page_no, dense_rank() OVER (PARTITION BY doc ORDER BY page_no) AS nth FROM (SELECT DISTINCT doc, page_no FROM shape)),
q AS (SELECT a.page_no AS sp, b.page_no AS tp FROM p a JOIN p b ON a.nth = b.nth AND a.doc = 'source' AND b.doc = 'target')
SELECT a.page_no, a.layer, a.n, b.n AS n_target, a.top, b.top AS top_target, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n <> b.n OR a.top <> b.top THEN 'differs' ELSE 'equal' END AS status
FROM n a JOIN q ON q.sp = a.page_no LEFT JOIN n b ON b.doc = 'target' AND b.page_no = q.tp AND a.layer = b.layer WHERE a.doc = 'source'""")
def _(s, d):
    return D.diff_layers(*_docs(s, d))


@query("J9_type_diff", "shape", """+ n AS (SELECT type, count(*) FILTER (doc = 'source') AS n_source, count(*) FILTER (doc = 'target') AS n_target FROM shape GROUP BY 1) SELECT *, n_target - n_source AS diff FROM n WHERE n_source <> n_target""")
def _(s, d):
    return D.diff_types(*_docs(s, d))


@query("J14_new_shapes", "shape", """+ a AS (SELECT page_no, shape_no, type || shape_no AS name FROM shape WHERE doc = 'source'), b AS (SELECT page_no, 'CURVE' || shape_no AS name FROM shape WHERE doc = 'target' UNION ALL SELECT page_no, 'MACHINERY' || shape_no FROM shape WHERE doc = 'target'),
c AS (SELECT page_no, count(*) AS n_new, max(name) AS nn FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page_no = a.page_no AND b.name = a.name) GROUP BY 1), l AS (SELECT page_no, arg_max(name, shape_no) AS ln FROM a GROUP BY 1)
SELECT page_no, coalesce(n_new, 0) AS n_new, CASE WHEN n_new = 1 THEN nn ELSE ln END AS found FROM l LEFT JOIN c USING (page_no)""")
def _(s, d):
    src, tgt = _docs(s, d)
    after = src.select("page_no", "shape_no", F.concat("type", F.col("shape_no").cast("string")).alias("name"))
    before = tgt.select("page_no", F.explode(F.array(*[F.concat(F.lit(k), F.col("shape_no").cast("string")) for k in ("CURVE", "MACHINERY")])).alias("name"))
    return D.new_shapes(before, after, ["page_no"], "name")


@query("J18_layer_lookup", "shape", "+ l AS (SELECT DISTINCT layer FROM shape WHERE doc = 'target'), k AS (SELECT shape_no, CASE WHEN shape_no % 2 = 0 THEN upper(lower(layer)) ELSE type END AS layer FROM shape WHERE doc = 'source') SELECT k.shape_no, upper(k.layer) AS layer, l.layer IS NOT NULL AS found FROM k LEFT JOIN l ON upper(k.layer) = l.layer")
def _(s, d):
    src, tgt = _docs(s, d)
    kind = F.when(F.col("shape_no") % 2 == 0, F.lower("layer")).otherwise(F.col("type"))
    return D.layers_for(src.select("shape_no", kind.alias("kind")), tgt).select("shape_no", "layer", "found")


@query("SNK17_clone", "shape", "+ c AS (SELECT doc, page_no, layer_no FROM shape UNION ALL SELECT 'copy', page_no, layer_no FROM shape WHERE doc = 'source') SELECT doc, page_no, layer_no, count(*) AS n FROM c GROUP BY ALL")
def _(s, d):
    return D.clone(V.doc_tree(s, d), "source", "copy").groupBy("doc", "page_no", "layer_no").agg(F.count(F.lit(1)).alias("n"))


@query("A25_clone_totals", "shape", "SELECT doc, count(*) AS attempted, count(*) FILTER (ok) AS copied FROM shape GROUP BY 1")
def _(s, d):
    return D.clone_totals(V.doc_tree(s, d), ["doc"])


@query("SNK13_markdown", "shape", """+ n AS (SELECT doc, page_no, layer, count(*) AS n FROM shape GROUP BY ALL)
SELECT doc, '| page_no | layer | n |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || page_no || ' | ' || layer || ' | ' || n || ' |', chr(10) ORDER BY page_no, layer) AS markdown FROM n GROUP BY 1""")
def _(s, d):
    n = V.doc_tree(s, d).groupBy("doc", "page_no", "layer").agg(F.count(F.lit(1)).alias("n"))
    return D.markdown_table(n, ["page_no", "layer", "n"], ["doc"], ["page_no", "layer"])


# --- kernels on whole images --------------------------------------------------------

def _labelled_ink(where: str, reach: str) -> str:
    """Ink pixels and their component's first pixel, by reachability."""
    return f"""+ px2 AS (SELECT image_id, y, x FROM px WHERE {where}), lab AS (
SELECT a.image_id, a.y, a.x, min(b.y * 64 + b.x) AS root FROM px2 a JOIN (
WITH RECURSIVE r(image_id, y0, x0, y, x) AS (SELECT image_id, y, x, y, x FROM px2 UNION SELECT r.image_id, r.y0, r.x0, p.y, p.x FROM r JOIN px2 p ON p.image_id = r.image_id AND {reach})
SELECT * FROM r) b ON a.image_id = b.image_id AND a.y = b.y0 AND a.x = b.x0 GROUP BY ALL),
comp AS (SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS n_px FROM lab GROUP BY image_id, root)"""


_EIGHT = "abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1"
_FOUR = "abs(p.y - r.y) + abs(p.x - r.x) <= 1"


@query("RAS6_components", "px", _labelled_ink("gray < 90", _EIGHT) + " SELECT * FROM comp")
def _(s, d):
    return K.components(R.binarise(V.px_emb(s, d), 90)).drop("component")


@query("A14_glyph_stats", "px", _labelled_ink("gray < 85", _EIGHT) + """, k AS (SELECT * FROM comp WHERE n_px >= 2)
SELECT image_id, count(*) AS n, median(n_px) AS median, max(n_px) AS max, round(sum(n_px) / CAST((max(x1) - min(x0)) * (max(y1) - min(y0)) AS DOUBLE), 6) AS fill, round(stddev_pop(n_px) / avg(n_px), 6) AS cv, round(max(n_px) / median(n_px), 6) AS max_ratio FROM k GROUP BY 1""")
def _(s, d):
    g = K.glyph_stats(K.components(R.binarise(V.px_emb(s, d), 85), least=2))
    return g.select("image_id", "n", "median", "max", *[F.round(c, 6).alias(c) for c in ("fill", "cv", "max_ratio")])


@query("C2_inner_ink", "px", _labelled_ink("gray > 170", _FOUR) + """, sz AS (SELECT image_id, max(x) AS w, max(y) AS h FROM px GROUP BY 1), bad AS (SELECT DISTINCT image_id, root FROM lab JOIN sz USING (image_id) WHERE y = 0 OR x = 0 OR y = h OR x = w)
SELECT lab.image_id, y, x FROM lab LEFT JOIN bad ON bad.image_id = lab.image_id AND bad.root = lab.root WHERE bad.root IS NULL""")
def _(s, d):
    return K.inner_ink(R.binarise(V.px_emb(s, d), 170, invert=True))


@query("RAS7_dilation", "px", "+ i AS (SELECT image_id, y, x FROM px WHERE gray < 80), sz AS (SELECT image_id, max(x) AS w, max(y) AS h FROM px GROUP BY 1) SELECT DISTINCT i.image_id, y + dy AS y, x + dx AS x FROM i JOIN sz USING (image_id), range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE y + dy BETWEEN 0 AND h AND x + dx BETWEEN 0 AND w")
def _(s, d):
    return K.dilate_rows(R.binarise(V.px_emb(s, d), 80), 2).select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


@query("A13_block_features")
def _(s, d):
    return K.blocks(R.binarise(V.px_emb(s, d), 70), gap=1, least_ink=4)


@query("J16_snapped_boxes", "px", """+ px2 AS (SELECT image_id, y, x FROM px WHERE gray < 90), bx AS (SELECT DISTINCT image_id, b AS box, b * 12 AS y0, b * 12 + 6 AS y1 FROM px, range(0, 4) t(b)),
near AS (SELECT p.image_id, box, y, x FROM px2 p JOIN bx USING (image_id) WHERE x >= 6 AND x < 48 AND y >= y0 - 14 AND y < y1 + 14),
lab AS (SELECT a.image_id, a.box, a.y, a.x, min(b.y * 64 + b.x) AS root FROM near a JOIN (
WITH RECURSIVE r(image_id, box, ya, xa, y, x) AS (SELECT image_id, box, y, x, y, x FROM near UNION SELECT r.image_id, r.box, r.ya, r.xa, p.y, p.x FROM r JOIN near p ON p.image_id = r.image_id AND p.box = r.box AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1)
SELECT * FROM r) b ON a.image_id = b.image_id AND a.box = b.box AND a.y = b.ya AND a.x = b.xa GROUP BY ALL),
comp AS (SELECT image_id, box, min(x) AS a0, min(y) AS b0, max(x) + 1 AS a1, max(y) + 1 AS b1 FROM lab GROUP BY image_id, box, root),
hit AS (SELECT comp.* FROM comp JOIN bx USING (image_id, box) WHERE a0 <= 34 AND 20 <= a1 AND b0 <= y1 AND y0 <= b1)
SELECT bx.image_id, bx.box, CAST(least(20, coalesce(min(a0), 20)) AS INT) AS x0, CAST(least(any_value(y0), coalesce(min(b0), 999)) AS INT) AS y0, CAST(greatest(34, coalesce(max(a1), 0)) AS INT) AS x1, CAST(greatest(any_value(y1), coalesce(max(b1), 0)) AS INT) AS y1 FROM bx LEFT JOIN hit ON hit.image_id = bx.image_id AND hit.box = bx.box GROUP BY ALL""")
def _(s, d):
    px = R.binarise(V.px_emb(s, d), 90)
    box = px.select("image_id").distinct().select("image_id", F.posexplode(F.array(*map(F.lit, (0, 12, 24, 36)))).alias("box", "y0"))
    return K.snap_boxes(px, box.select("image_id", "box", F.lit(20).alias("x0"), "y0", F.lit(34).alias("x1"), (F.col("y0") + 6).alias("y1")))


@query("RAS4_trace_and_render", "px", "SELECT image_id, y, x, CAST(1 AS DOUBLE) AS cov FROM px WHERE gray < 110")
def _(s, d):
    """Tracing the ink and filling the outline gives the ink again."""
    return K.render(K.trace(R.binarise(V.px_emb(s, d), 110)))


@query("SNK1_traced_svg")
def _(s, d):
    return KS.svg(K.trace(R.binarise(V.px_emb(s, d), 110)))


# --- remaining candidate and artefact relations ----------------------------------------


@query("C24_symbol", "box", """+ g AS (SELECT image_id, seq, part, 1 + score % 12 AS w, 1 + seq % 6 AS h, 1 + score % 9 AS ink FROM box)
SELECT image_id, seq, part, CASE WHEN h <= 2 AND w / h >= 2.5 THEN '-' WHEN h <= greatest(3.0, 14 * 0.28) AND w / h < 2.0 THEN chr(183) WHEN w / h >= 0.8 AND w / h <= 2.0 AND ink / (w * h) >= 0.60 THEN chr(8226) END AS symbol FROM g""")
def _(s, d):
    g = V.box_li(s, d).select("image_id", "seq", "part", (1 + F.col("score") % 12).alias("w"), (1 + F.col("seq") % 6).alias("h"), (1 + F.col("score") % 9).alias("ink"))
    return g.select("image_id", "seq", "part", S.symbol_of(F.col("w"), F.col("h"), F.col("ink"), F.lit(14)).alias("symbol"))


@query("J12_text_fonts", "cand", "+ t AS (SELECT DISTINCT text FROM cand), f AS (SELECT DISTINCT font FROM cand) SELECT text, font FROM t CROSS JOIN f")
def _(s, d):
    c = V.cand_part(s, d)
    return S.text_fonts(c.select("text").distinct(), c)


@query("J19_positional_zip", "variant", """+ w AS (SELECT seq, words, [text, 'x' || word_gap, 'y'][1:1 + words % 3] AS ws, [variant, seq][1:1 + word_gap % 2] AS ts FROM variant)
SELECT seq, unnest(ws) AS word, unnest(ts) AS token FROM w WHERE len(ws) = len(ts)""")
def _(s, d):
    v = V.variant_evt(s, d)
    ws = F.slice(F.array("text", F.concat(F.lit("x"), F.col("word_gap").cast("string")), F.lit("y")), F.lit(1), 1 + F.col("words") % 3)
    ts = F.slice(F.array("variant", "seq"), F.lit(1), 1 + F.col("word_gap") % 2)
    return S.zip_words(v.select("seq", ws.alias("ws"), ts.alias("ts")), "ws", "ts").select("seq", F.col("pair.ws").alias("word"), F.col("pair.ts").alias("token"))


@query("A21_letter_heights", "cand", """+ g AS (SELECT font, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'B' END AS letter, CASE WHEN seq % 2 = 0 THEN 5 + iou % 5 ELSE 9 + iou % 7 END AS height FROM cand),
m AS (SELECT font, count(*) FILTER (letter = 'a') AS nl, count(*) FILTER (letter = 'B') AS nh, median(height) FILTER (letter = 'a') AS x, median(height) FILTER (letter = 'B') AS c FROM g GROUP BY 1)
SELECT font, CASE WHEN nl >= 2 AND nh >= 2 AND c - x >= 2 THEN x END AS x_height, CASE WHEN nl >= 2 AND nh >= 2 AND c - x >= 2 THEN c END AS cap_height FROM m""")
def _(s, d):
    even = F.col("seq") % 2 == 0
    g = V.cand_part(s, d).select("font", F.when(even, "a").otherwise("B").alias("letter"), F.when(even, 5 + F.col("iou") % 5).otherwise(9 + F.col("iou") % 7).alias("height"))
    return S.letter_heights(g, ["font"], "aemnru", "ABDEFGHIKLMNPRTY")


@query("SNK4_placement", "box", "SELECT image_id || '-' || seq || '-' || part AS name, 'ART' AS layer, round(x0 * CAST(0.25 AS DOUBLE), 6) AS x, round(100 - y1 * CAST(0.25 AS DOUBLE), 6) AS y, round((x1 - x0) * CAST(0.25 AS DOUBLE), 6) AS w, round((y1 - y0) * CAST(0.25 AS DOUBLE), 6) AS h FROM box")
def _(s, d):
    b = V.box_li(s, d).select(F.concat_ws("-", "image_id", "seq", "part").alias("name"), F.lit("art").alias("kind"), *B.BOX)
    return KS.placement(b, 0.25, 100.0).select("name", "layer", *[F.round(c, 6).alias(c) for c in "xywh"])


@query("SNK9_region_lines", "box", "SELECT 'r' || image_id || '_' || seq || '_' || part || '=' || greatest(0, y0 - 2) || ',' || least(90, y1 + 2) || ',' || greatest(0, x0 - 2) || ',' || least(90, x1 + 2) AS line FROM box")
def _(s, d):
    name = F.concat(F.lit("r"), F.concat_ws("_", "image_id", "seq", "part"))
    t = V.box_li(s, d).select(name.alias("name"), *B.BOX, F.lit(None).cast("string").alias("color"), F.lit(0).alias("rot"), F.lit(False).alias("suspect"))
    return KS.live_region_lines(t, 90, 90)


@query("SNK16_actions", "cand", VERDICT_ROWS + """, ex AS (SELECT seq, (iou % 100) / 1000.0 AS max_error FROM cand WHERE width_ratio > 900)
SELECT 'n' || ve.seq AS name, CASE WHEN max_error IS NULL THEN 'create' WHEN max_error <= 0.05 THEN 'replace' ELSE 'skip_existing' END AS action FROM ve LEFT JOIN ex ON ex.seq = ve.seq WHERE convert""")
def _(s, d):
    name = F.concat(F.lit("n"), F.col("seq").cast("string"))
    there = V.cand_part(s, d).where("width_ratio > 900").select(name.alias("name"), (F.col("iou") % 100 / 1000).alias("max_error"))
    return KS.actions(_verdicts(s, d).withColumn("name", name), there)


# --- words, shapes, curves ------------------------------------------------------------


@query("RAS10_orientation", "cand", """+ v AS (SELECT text, max(iou / 1000.0) AS a, max((width_ratio - 500) / 1000.0) AS b FROM cand GROUP BY 1), w AS (SELECT text, round_even(a, 4) AS iou0, round_even(b, 4) AS iou180 FROM v)
SELECT text, iou0, iou180, CASE WHEN round(abs(iou0 - iou180), 4) >= 0.02 AND iou180 > iou0 THEN 180 ELSE 0 END AS rot FROM w""")
def _(s, d):
    v = V.cand_part(s, d).select("text", (F.col("iou") / 1000).alias("upright"), ((F.col("width_ratio") - 500) / 1000).alias("turned"))
    return S.orientation(v, ["text"])


@query("RAS11_word_iou")
def _(s, d):
    px = V.px_emb(s, d)
    return K.word_ious(R.binarise(px, 100), R.binarise(px, 104)).select("image_id", F.round("iou", 6).alias("iou"))


@query("RAS14_shape_groups")
def _(s, d):
    p = W.column_profile(R.binarise(V.px_emb(s, d))).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "profile"))), lambda x: x["profile"]).alias("profile"))
    n = R.binarise(V.px_emb(s, d)).groupBy("image_id").agg(F.count_if("ink").alias("ink"), (F.count_if("ink") / F.count(F.lit(1)) + 0.5).alias("aspect"))
    shapes = p.join(n, "image_id").select(F.lit(0).alias("grp_of"), F.col("image_id").alias("shape"), "ink", "aspect", "profile")
    return K.shape_groups(shapes, "grp_of")


@query("RAS16_word_edits")
def _(s, d):
    """Readings of the embedding lines, edited by their shapes."""
    px = R.binarise(V.px_emb(s, d), 100)
    words = W.words(px).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    texts = words.select("image_id", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(i % 3 == 0, "Vox").otherwise("x")), " ").alias("text"))
    return K.line_edits(px, texts)


@query("RAS17_accepted_edits", "variant", """+ v AS (SELECT seq, 'a b c' AS text, word_gap % 3 AS w, score % 2 AS ok, CASE WHEN words = 1 THEN 'symbol' ELSE 'case' END AS kind FROM variant),
e AS (SELECT *, kind = 'symbol' OR ok = 1 AS take FROM v)
SELECT seq, CASE WHEN take AND w = 0 THEN 'X b c' WHEN take AND w = 1 THEN 'a X c' WHEN take THEN 'a b X' ELSE text END AS final, CASE WHEN take THEN 1 ELSE 0 END AS n_taken FROM e""")
def _(s, d):
    v = V.variant_evt(s, d)
    kind = F.when(F.col("words") == 1, "symbol").otherwise("case")
    edit = F.struct((F.col("word_gap") % 3).alias("word"), F.lit("X").alias("new"), kind.alias("kind"))
    new = F.when(F.col("word_gap") % 3 == 0, "X b c").when(F.col("word_gap") % 3 == 1, "a X c").otherwise("a b X")
    scores = F.create_map(F.lit("a b c"), F.lit(0.5), new, F.when(F.col("score") % 2 == 1, 0.6).otherwise(0.4))
    out = S.accept_edits(v.select("seq", F.lit("a b c").alias("text"), F.array(edit).alias("edits"), scores.alias("scores")))
    return out.select("seq", "final", F.size("taken").alias("n_taken"))


@query("SET_overridden_edits", "variant", """+ e AS (SELECT region, word_gap AS word, max(seq) AS edit FROM variant GROUP BY ALL), g AS (SELECT region, word_gap AS word, min(seq) AS edit FROM variant WHERE words = 1 GROUP BY ALL)
SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.region = e.region AND g.word = e.word) UNION ALL SELECT * FROM g""")
def _(s, d):
    v = V.variant_evt(s, d)
    e = v.groupBy("region", F.col("word_gap").alias("word")).agg(F.max("seq").alias("edit"))
    g = v.where("words = 1").groupBy("region", F.col("word_gap").alias("word")).agg(F.min("seq").alias("edit"))
    return S.without_overridden(e, g, ["region", "word"])


@query("SET_union_of_passes", "box", "SELECT image_id, seq, part, CASE WHEN score >= 40000 THEN 1 ELSE 0 END AS pass FROM box UNION ALL SELECT image_id, seq, part, 2 FROM box WHERE seq = 1")
def _(s, d):
    b = V.box_li(s, d).select("image_id", "seq", "part", "score")
    return B.unite([b.where("score < 40000"), b.where("score >= 40000"), b.where("seq = 1")]).drop("score")


@query("SET_mask_union", "px", "SELECT image_id, y, x FROM px WHERE gray < 100 UNION SELECT image_id, y, x FROM px WHERE gray > 160")
def _(s, d):
    px = V.px_emb(s, d)
    return B.mask_union([px.where("gray < 100"), px.where("gray > 160"), px.where("gray < 80")])


@query("RAS1_resize")
def _(s, d):
    return K.resize(V.px_emb(s, d), 32, 25)


@query("RAS2_curves")
def _(s, d):
    return T.trace_curves(R.binarise(V.px_emb(s, d), 110)).select("image_id", "width", "height", "n_curves")


@query("RAS5_trace_all")
def _(s, d):
    px = V.px_emb(s, d)
    part = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    regions = px.select("image_id").distinct().select("image_id", part).select("image_id", F.concat(F.lit("r"), F.col("k").cast("string")).alias("region"), (F.col("k") * 32).alias("x0"), F.lit(0).alias("y0"), (F.col("k") * 32 + 32).alias("x1"), F.lit(24).alias("y1"), (F.col("k") == 1).alias("invert"))
    best = T.trace_all(px, regions, (112, 128, 148), upscale=2)
    return best.select("image_id", "region", "threshold", "n_paths", "n_curves", F.round("soft", 4).alias("soft"), F.round("iou", 4).alias("iou"))


@query("RAS19_page_paste", "px", """+ pg AS (SELECT DISTINCT image_id // 2 AS page FROM px), grid AS (SELECT page, CAST(a.y AS BIGINT) AS y, CAST(b.x AS BIGINT) AS x FROM pg, range(0, 90) a(y), range(0, 70) b(x)),
put AS (SELECT image_id // 2 AS page, y + (image_id % 2) * 37 AS y, x + 3 AS x, arg_max(gray, image_id) AS gray FROM px GROUP BY ALL)
SELECT page, y, x, coalesce(gray, 255) AS gray FROM grid LEFT JOIN put USING (page, y, x)""")
def _(s, d):
    px = V.px_emb(s, d)
    items = px.select("image_id").distinct().select(F.expr("image_id div 2").alias("page"), "image_id", F.lit(3).alias("left"), (F.col("image_id") % 2 * 37).cast("int").alias("top"))
    pages = items.select("page", F.lit(70).alias("w"), F.lit(90).alias("h")).distinct()
    return K.paste(px, pages, items).select("page", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "gray")


@query("SNK9_trace_lines", "box", "SELECT 'b' || image_id || '_' || seq || '_' || part || ':' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || CASE WHEN seq % 2 = 0 THEN ',invert' ELSE '' END || ',#102030' AS line FROM box")
def _(s, d):
    """Written, read back by the parser and written again."""
    name = F.concat(F.lit("b"), F.concat_ws("_", "image_id", "seq", "part"))
    b = V.box_li(s, d).select(name.alias("name"), *B.BOX, (F.col("seq") % 2 == 0).alias("invert"), F.lit("#102030").alias("color"))
    read = KS.trace_region_lines(b).select(P.trace_region(F.col("line")).alias("r")).select("r.*")
    return KS.trace_region_lines(read.withColumnRenamed("fill", "color"))


@query("SNK14_structural_report", "shape", """+ n AS (SELECT doc, page_no, layer, count(*) AS n, count(*) FILTER (parent_no IS NULL) AS t FROM shape GROUP BY ALL),
l AS (SELECT count(*) AS c FROM n a LEFT JOIN n b ON b.doc = 'target' AND a.page_no = b.page_no AND a.layer = b.layer WHERE a.doc = 'source' AND (b.n IS NULL OR a.n <> b.n OR a.t <> b.t)),
ty AS (SELECT count(*) AS c FROM (SELECT type, count(*) FILTER (doc = 'source') AS a, count(*) FILTER (doc = 'target') AS b FROM shape GROUP BY 1) WHERE a <> b)
SELECT CASE WHEN l.c = 0 AND ty.c = 0 THEN 'PASS' ELSE 'WARN' END AS status, l.c AS layers_off, ty.c AS types_off FROM l, ty""")
def _(s, d):
    docs = _docs(s, d)
    return KS.structural_report(D.diff_layers(*docs), D.diff_types(*docs))


@query("SNK10_convert_only", "cand", VERDICT_ROWS + " SELECT 'n' || c.seq AS name, text FROM cand c JOIN ve ON ve.seq = c.seq WHERE convert")
def _(s, d):
    name = F.concat(F.lit("n"), F.col("seq").cast("string")).alias("name")
    return KS.convert_only(V.cand_part(s, d).select(name, "text"), _verdicts(s, d).select(name, "convert"))
