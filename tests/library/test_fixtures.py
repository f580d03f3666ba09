"""Synthetic pages and records with known geometry and verdicts."""

import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inkframe.functions import parsers as P
from inkframe.functions.extras import register
from inkframe.operators import boxes as B
from inkframe.operators import colour as C
from inkframe.operators import doctree as D
from inkframe.operators import kernels as K
from inkframe.operators import raster as R
from inkframe.operators import runs as W
from inkframe.operators import select as S
from inkframe.operators import trace as T


def frame(spark, gray, image_id=0, column="gray"):
    h, w = gray.shape
    ys, xs = np.mgrid[:h, :w]
    import pandas as pd

    kind = bool if gray.dtype == bool else int
    return spark.createDataFrame(pd.DataFrame({"image_id": image_id, "y": ys.ravel().astype("int32"), "x": xs.ravel().astype("int32"), column: gray.ravel().astype(kind)}))


def page():
    g = np.full((800, 600), 255)
    g[:, :4], g[:3] = 16, 16
    g[100:200, 50:200] = 0
    g[100:200, 400:550] = 0
    g[500:580] = 18
    g[520:560, 250:350] = 255
    g[708:711, 195:405] = 180
    g[700:708, 200:400] = 0
    return g


def test_partition_of_the_page(spark):
    px = frame(spark, page()).cache()
    assert tuple(R.strip_residue(R.binarise(px)).first())[1:] == (4, 0, 3, 0)
    got = {(r.kind, r.x0, r.y0, r.x1, r.y1) for r in W.auto_partition(px).collect()}
    assert ("BAND", 0, 500, 600, 580) in got
    assert ("CONTENT", 50, 100, 200, 200) in got and ("CONTENT", 400, 100, 550, 200) in got
    assert ("CONTENT", 195, 700, 405, 711) in got
    assert len(got) == 4
    dark = px.where("y >= 500 and y < 580").groupBy("image_id").agg(F.median("gray")).first()[1]
    assert abs(dark - 18) <= 2
    px.unpersist()


def test_two_blocks_are_not_full_bleed(spark):
    px = R.binarise(frame(spark, page()[100:200]))
    assert R.row_medians(px).where("median_gray < 128").count() == 0 or not R.full_bleed(px).first().full_bleed


@pytest.mark.parametrize("width,ss,error", [(1, 8, 0.13), (3, 8, 0.13), (10, 8, 0.13)])
def test_rasterised_bars(width, ss, error):
    bar = [(5.03, 5.0), (5.03 + width, 5.0), (5.03 + width, 25.0), (5.03, 25.0)]
    assert abs(K.rasterise([bar], 30, 30, ss).sum() / 20 - width) <= error
    assert K.rasterise([bar], 30, 30, 1).dtype == bool and K.rasterise([bar], 30, 30, ss).dtype == float


@pytest.mark.parametrize("boxes,holes,n", [([(10, 5, 50, 35)], [], 1), ([(30, 5, 60, 35)], [], 1), ([(10, 5, 50, 35)], [(25, 15, 45, 25)], 2), ([(10, 5, 30, 35), (35, 10, 50, 30)], [], 2), ([(0, 0, 5, 5), (5, 5, 9, 9)], [], 2)])
def test_outline_round_trip(boxes, holes, n):
    m = np.zeros((40, 60), bool)
    for x0, y0, x1, y1 in boxes:
        m[y0:y1, x0:x1] = True
    for x0, y0, x1, y1 in holes:
        m[y0:y1, x0:x1] = False
    d = K.outline(m)
    assert d.count("M") == n and (K.rasterise(K.subpaths(d), 60, 40, 1) == m).all()
    rng = np.random.default_rng(0).random((20, 30)) < 0.5
    assert (K.rasterise(K.subpaths(K.outline(rng)), 30, 20, 1) == rng).all()


def test_cubic_is_flattened():
    (path,) = K.subpaths("M 0 0 C 0 1 1 1 1 0 L 2 0 Z")
    assert len(path) == 18 and path[8] == pytest.approx((0.5, 0.75)) and path[16] == (1, 0)


def test_threshold_shortlist(spark):
    row = spark.range(1).select(*[S.threshold_shortlist(F.lit(a), F.array(*map(F.lit, t))).alias(n) for n, a, t in (("a", 1000, (112, 118, 128, 138, 148)), ("b", 10**7, (112, 118, 128, 138, 148)), ("c", 10**7, (112, 128)))]).first()
    assert (row.a, row.b, row.c) == ([112, 118, 128, 138, 148], [112, 128, 148], [112, 128])


def test_components():
    m = np.zeros((20, 40), bool)
    assert K.component_boxes(m) == []
    m[2:5, 2:5] = m[2:5, 10:13] = True
    assert [c[4] for c in K.component_boxes(m)] == [9, 9]
    m[5:8, 5:8] = True
    assert [c[4] for c in K.component_boxes(m)] == [18, 9] and len(K.component_boxes(m, diagonal=False)) == 3
    u = np.zeros((4, 6), bool)
    u[:3, 1] = u[:3, 4] = u[3, 1:4] = u[2, 4] = True
    assert [c[4] for c in K.component_boxes(u)] == [9]
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert K.component_boxes(one, least=2) == [] and len(K.component_boxes(one, least=1)) == 1
    ring = np.zeros((9, 9), bool)
    ring[0, 2:5] = ring[4, 4] = True
    assert K.drop_edge_components(ring).sum() == 1


def test_glyph_stats(spark):
    bars = np.zeros((20, 120), bool)
    for k in range(20):
        bars[5:15, 5 * k : 5 * k + 3] = True
    s = K.glyph_stats(K.components(frame(spark, bars, column="ink"))).first()
    assert (s.n, s.max_ratio, s.cv) == (20, 1.0, 0.0)
    block = np.zeros((60, 120), bool)
    block[10:50, 40:110] = True
    for k in range(8):
        block[10 + 5 * k : 12 + 5 * k, 5:9] = True
    s = K.glyph_stats(K.components(frame(spark, block, column="ink"))).first()
    assert s.max_ratio > 20 and s.cv > 0.5


#: Measured regions with known outcomes.
CASES = [
    ("footer", 0.7235, 1.68, 0.992, 53, 48, None, 0), ("illustration", 0.3859, 1.531, 1.887, 66, 6, "not_text", 2), ("ratio in", 0.9, 2.0, 1.0, 40, 10, None, 0), ("ratio out", 0.9, 2.0, 1.0, 41, 10, "not_text", 1),
    ("wide in", 0.9, 2.0, 1.50, 40, 20, None, 0), ("wide out", 0.9, 2.0, 1.51, 40, 20, "not_text", 1), ("narrow in", 0.9, 2.0, 0.65, 40, 20, None, 0), ("narrow out", 0.9, 2.0, 0.64, 40, 20, "not_text", 1),
    ("weak", 0.30, 1.05, 1.0, 20, 12, "weak_match", 1), ("large", 0.95, 1.02, 1.0, 30, 25, None, 0), ("zero", 0.9, 2.0, 1.0, 0, 0, "not_text", 1),
]


def test_verdicts(spark):
    rows = spark.createDataFrame([c[:6] for c in CASES], "name string, iou double, lift double, width_ratio double, n_cc int, n_char int")
    rows = rows.withColumns({"n_ocr_readable": F.lit(None).cast("int"), "n_ocr_agree": F.lit(None).cast("int")})
    got = {r.name: (r.reject_kind, len(r.reasons)) for r in S.verdict(rows).collect()}
    assert got == {c[0]: c[6:] for c in CASES}
    opened = S.verdict(rows.where("name = 'illustration'"), most_width=9, most_glyph_share=99).first()
    assert opened.convert and not opened.checks.alike and opened.checks.lifted
    few = S.verdict(rows.where("name = 'footer'").withColumns({"n_ocr_readable": F.lit(3), "n_ocr_agree": F.lit(1)})).first()
    assert few.reject_kind == "not_text" and few.reasons == ["readings"]


def test_otsu(spark):
    def cut(*parts):
        return R.otsu(frame(spark, np.concatenate([np.full((n // 10, 10), v) for n, v in parts]))).first().threshold

    assert cut((500, 40), (500, 220)) == 130 or cut((500, 40), (500, 220)) == 129
    assert 30 < cut((300, 30), (400, 128), (300, 240)) < 240
    assert cut((100, 200)) == 128


def test_polarity(spark):
    g = np.full((20, 60), 230)
    g[5:15, 5:15] = 20
    a = {(r.y, r.x) for r in R.polarity_ink(frame(spark, g), 128).where("ink").collect()}
    b = {(r.y, r.x) for r in R.polarity_ink(frame(spark, 255 - g), 128).where("ink").collect()}
    assert a == b and len(a) == 100


#: Measured readings of one line with a known best one.
VARIANTS = [(0.893, 1, 48, 8), (0.885, 3, 47, 6), (0.897, 7, 48, 2), (0.894, 5, 47, 4), (0.921, 7, 48, 2), (0.918, 9, 48, 0), (0.918, 9, 48, 0), (0.908, 9, 48, 0), (0.917, 9, 48, 0), (0.907, 9, 48, 0), (0.894, 9, 48, 0)]


def test_variants(spark):
    def pick(rows):
        df = spark.createDataFrame([(0, i, *r, "t") for i, r in enumerate(rows)], "region int, seq int, score double, words int, chars int, word_gap int, text string")
        return S.pick_variant(df, ["region"]).first()

    best = pick(VARIANTS)
    assert (best.word_gap, best.score, best.seq) == (0, 0.918, 5)
    assert pick([(*v[:3], 0) for v in VARIANTS]).score == 0.921
    odd = pick([(0.9, 1, 48, 3), (0.8, 1, 47, 2), (0.7, 1, 47, 1), (0.6, 1, 47, 4)])
    assert odd.chars == 47 and odd.fallback  # the pick is the first report and no later one agrees
    assert pick([(0.5, 1, 9, 1)]).seq == 0


def test_region_literals(spark):
    def parse(t):
        return spark.createDataFrame([(t,)], "t string").select(P.live_region(F.col("t")).alias("r")).first().r

    r = parse("web.title=10,30,200,420")
    assert (r.name, r.y0, r.y1, r.x0, r.x1, r.color, r.rot) == ("web.title", 10, 30, 200, 420, None, 0)
    assert parse("t=1,9,40,70,#0A1B2C,rot=180")[5:] == ("#0A1B2C", 180)
    assert parse("t=1,9,40,70,rotate=90").rot == 90 and parse("t=1,9,40,70, Rotation = -90").rot == -90
    assert parse("a=120,450,120,450")[1:5] == (120, 450, 120, 450)
    assert parse("X=1,2,3,4,#abc").color == "#abc" and parse("X=1,2,3,4,abc").color == "#abc"
    for bad in ("W=1,2,3", "V=1,2,3,4,zzz", "U=1,2,3,4,size=3"):
        with pytest.raises(PySparkException):
            parse(bad)

    def traced(t):
        return tuple(spark.createDataFrame([(t,)], "t string").select(P.trace_region(F.col("t")).alias("r")).first().r)

    assert traced("logo:1,2,30,40") == ("logo", 1, 2, 30, 40, False, None)
    assert traced("logo: 1, 2,30,40,invert,#fa0") == ("logo", 1, 2, 30, 40, True, "#fa0")
    assert traced("a:1,2,30,40,#102030,,yes") == ("a", 1, 2, 30, 40, True, "#102030")
    for bad in ("logo:1,2,30", "1,2,30,40", "logo:1,2,30,40,128", "logo:1,2,30,40,mark", "logo:1,2,30,40,#12"):
        with pytest.raises(PySparkException):
            traced(bad)
    s = spark.createDataFrame([("a4",), ("100 x 50.5mm",), (None,)], "t string").select(P.page_size(F.col("t")).alias("r")).collect()
    assert [x.r and tuple(x.r) for x in s] == [(210.0, 297.0), (100.0, 50.5), None]
    assert spark.range(1).select(P.page_size(F.lit("legal")).alias("r")).first().r.h == 355.6
    c = spark.range(1).select(C.hex_rgb(F.lit("#1A2")).alias("a"), C.hex_rgb(F.lit("0102ff")).alias("b")).first()
    assert tuple(c.a) == (17, 170, 34) and tuple(c.b) == (1, 2, 255)
    p = spark.range(1).select(P.palette(F.lit("#fff, 010203,")).alias("p"), P.palette(F.lit(None).cast("string")).alias("q"), P.rectangle(F.lit("bar:1,2.5,30,4,#0a0b0c")).alias("r"), P.mapping(F.array(F.lit("a = X"), F.lit("b=white"), F.lit("a=Y=Z"))).alias("m")).first()
    assert [tuple(x) for x in p.p] == [(255, 255, 255), (1, 2, 3)] and p.q == [] and p.m == {"a": "Y=Z", "b": "white"}
    assert (p.r.name, p.r.x, p.r.y, p.r.w, p.r.h, tuple(p.r.rgb)) == ("bar", 1.0, 2.5, 30.0, 4.0, (10, 11, 12))
    for bad in (P.rectangle(F.lit("bar:1,2,3,#0a0b0c")), P.mapping(F.array(F.lit("a"))), C.hex_rgb(F.lit("red"))):
        with pytest.raises(PySparkException):
            spark.range(1).select(bad).collect()


def line(starts, height=12, bar=3):
    m = np.zeros((height, 110), bool)
    for s in starts:
        for k in range(3):
            m[:, s + 8 * k : s + 8 * k + bar] = True
    return m


def test_words(spark):
    m = np.zeros((16, 30), bool)
    m[2:14, 0:6] = m[2:14, 10:16] = True
    assert K.column_runs(m) == [(0, 6), (10, 16)]
    a, b = line((0, 30, 60)), line((0, 32, 64))
    assert len(K.word_boxes(a)) == 3 and [tuple(r)[2:4] for r in W.words(frame(spark, a, column="ink")).orderBy("word").collect()] == K.word_boxes(a)
    aligned = K.word_aligned_iou(a, b)
    assert aligned == pytest.approx(1.0) and (a & b).sum() / (a | b).sum() <= aligned - 0.10
    assert K.word_aligned_iou(a, np.ones((12, 9), bool)) is None and K.word_aligned_iou(a, np.zeros((12, 9), bool)) is None


def cased(heights):
    """A line of bars, and its words' columns; a height of None leaves no ink."""
    m, spans, x = np.zeros((20, 200), bool), [], 0
    for word in heights:
        x0 = x
        for h in word:
            if h:
                m[18 - h : 18, x : x + 3] = True
                x += 5
        spans.append((x0, x - 2))
        x += 8
    return m, spans


def test_case_by_height():
    # The stop after the third letter left no ink: five runs for six characters.
    m, spans = cased([[13, 2, 12, 12, 2], [9, 9, 9]])
    assert len(K.column_runs(m[:, spans[0][0] : spans[0][1]])) == 5
    assert K.case_by_height(m, spans, ["S.x.P.", "rue"]) == [(0, "S.X.P.", "case-height")]
    gray = np.where(m, 0, 240).astype(np.uint8)
    assert K.case_by_height(gray, spans, ["S.x.P.", "rue"]) == [(0, "S.X.P.", "case-height")]
    assert K.case_by_height(m, spans, ["S.X.P.", "rue"]) == []
    low, spans2 = cased([[13, 2, 9, 13, 2], [9, 9, 9]])
    assert K.case_by_height(low, spans2, ["S.X.P.", "rue"]) == [(0, "S.x.P.", "case-height")]
    # A letter halfway between both heights proves nothing, nor one nearer by the least gap alone.
    for h in (11, 12):
        mid, spans3 = cased([[13, h, 13], [9, 9, 9]])
        assert bool(K.case_by_height(mid, spans3, ["PxB", "rue"])) == (h == 12)
    near, spans4 = cased([[14, 12, 14], [9, 9, 9]])
    assert K.case_by_height(near, spans4, ["PxB", "rue"], least_gap=1) == [] and K.case_by_height(near, spans4, ["PxB", "rue"], least_gap=0.5) == [(0, "PXB", "case-height")]
    flat, spans5 = cased([[10, 10, 10], [9, 9, 9]])
    assert K.case_by_height(flat, spans5, ["PxB", "rue"]) == []
    assert K.case_by_height(m, spans, ["S.x.P.", "sxo"]) == []  # letters that are judged are no anchors
    assert K.case_by_height(m, spans[:1], ["S.x.P.", "rue"]) == []
    assert K.case_by_height(m, spans, ["S.x.PP.", "rue"]) == []
    with pytest.raises(TypeError):
        K.case_by_height(m, spans, "S.x.P. rue")


def test_line_edits(spark):
    m, _ = cased([[13, 2, 12, 12, 2], [9, 9, 9]])
    ink = frame(spark, m[:, :100], column="ink")
    texts = spark.createDataFrame([(0, "S.x.P. rue"), (5, "no ink")], "image_id long, text string")
    got = [tuple(r) for r in K.line_edits(ink, texts).collect()]
    assert got == [(0, 0, 0, "S.X.P.", "case-height")]
    tall, wide = np.ones((12, 6), bool), np.ones((12, 20), bool)
    tall[:6] = False
    line = np.zeros((12, 60), bool)
    line[:, :20] = True
    line[5:8, 40:43] = True
    edits = K.word_proposals(line, [(0, 20), (40, 43)], ["ab", "x"], {"ab": tall, "AB": wide})
    assert edits == [(0, "AB", "case"), (1, "·", "symbol")] or edits == [(0, "AB", "case"), (1, "•", "symbol")]
    assert K.word_proposals(line, [(0, 20), (40, 43)], ["AB", "x"], {"ab": tall, "AB": wide})[0][2] == "symbol"
    glyphs = spark.createDataFrame([("ab", 6, 12, "M 0 6 L 6 6 L 6 12 L 0 12 Z"), ("AB", 20, 12, "M 0 0 L 20 0 L 20 12 L 0 12 Z")], "text string, width int, height int, path string")
    rows = K.line_edits(frame(spark, line[:, :30], column="ink"), spark.createDataFrame([(0, "ab")], "image_id long, text string"), glyphs).collect()
    assert [(r.word, r.new, r.kind) for r in rows] == [(0, "AB", "case")]


def test_accepted_edits(spark):
    edit = "array<struct<word:int,new:string,kind:string>>"
    rows = [
        (1, "a b", [(0, "x", "case"), (1, "B", "case-height"), (7, "z", "symbol")], {"a b": 0.5, "x b": 0.4}, "a B", [1]),
        (2, "a b", [(0, "x", "case"), (1, "y", "case")], {"a b": 0.5, "x b": 0.6, "x y": 0.6}, "x b", [0]),
        (3, "a", [], {}, "a", []),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], f"i int, text string, edits {edit}, scores map<string,double>")
    assert {r.i: (r.final, r.taken) for r in S.accept_edits(df).collect()} == {r[0]: r[4:] for r in rows}


def test_palette(spark):
    g = np.full((60, 120, 3), 255)
    for (y, ink), x in zip(((6, (190, 60, 110)), (35, (30, 28, 35))), (11, 11), strict=True):
        for cov, pad in ((0.25, 3), (0.5, 1), (1, 0)):
            blend = np.rint(255 + (np.array(ink) - 255) * cov).astype(int)
            g[y - pad : y + 20 + pad, x - pad : x + 40 + pad] = blend
    px = frame(spark, g[..., 0], column="r").join(frame(spark, g[..., 1], column="g"), ["image_id", "y", "x"]).join(frame(spark, g[..., 2], column="b"), ["image_id", "y", "x"]).cache()
    ground = C.background(px).first()
    assert (ground.r, ground.g, ground.b) == (255, 255, 255)
    inks = sorted((r.r, r.g, r.b) for r in C.detect_palette(px).collect())
    assert np.abs(np.array(inks) - [(30, 28, 35), (190, 60, 110)]).max() <= 2
    lab = C.labels(px, [(190, 60, 110), (30, 28, 35)])
    assert lab.where("y between 4 and 27 and x between 9 and 52 and label = 1").count() == 0
    assert lab.where("y between 33 and 56 and x between 9 and 52 and label = 0").count() == 0
    assert C.palette_check(lab, [(190, 60, 110), (30, 28, 35)]).where("ok").count() == 2
    px.unpersist()


def test_blocks_and_snapping(spark):
    m = np.zeros((60, 100), bool)
    m[10:50, 10:90] = True
    m[11:49, 11:89] = False
    f = K.blocks(frame(spark, m, column="ink"))
    r = f.withColumn("kind", S.block_kind()).first()
    assert (r.x0, r.y0, r.x1, r.y1, r.kind) == (10, 10, 90, 50, "line_art") and r.fill < 0.15
    m[10:50, 10:90] = True
    r = K.blocks(frame(spark, m, column="ink")).withColumn("kind", S.block_kind()).first()
    assert r.kind == "solid" and r.thickness > 20
    s = np.zeros((80, 80), bool)
    s[20:50, 30:34] = s[16:20, 20:44] = s[16:22, 60:66] = True
    assert K.snap_box(s, (30, 24, 34, 50)) == (20, 16, 44, 50)
    assert K.snap_box(s, (60, 19, 66, 40)) == (60, 16, 66, 40)
    assert K.snap_box(np.zeros((80, 80), bool), (1, 2, 3, 4)) == (1, 2, 3, 4)
    far = np.zeros((200, 80), bool)
    far[10:12, 10:12] = True
    assert K.snap_box(far, (10, 60, 12, 70), reach=5) == (10, 60, 12, 70)


def test_greedy_boxes(spark):
    rows = [(0, 1, 0, 0, 0, 10, 10, 90), (0, 2, 0, 1, 1, 11, 11, 80), (0, 3, 0, 0, 20, 10, 30, 70), (0, 4, 0, 0, 5, 10, 15, 60)]
    df = spark.createDataFrame(rows, "image_id long, seq int, part long, x0 int, y0 int, x1 int, y1 int, score long")
    got = {r.seq: r.also for r in B.merge_detections(df, 0.5).collect()}
    assert got == {1: [2], 3: [], 4: []}
    turned = spark.createDataFrame([(0, 5, 0, 0, 21, 10, 31, 9), (0, 6, 0, 40, 40, 50, 50, 8), (0, 7, 0, 41, 41, 51, 51, 7)], df.schema)
    assert {(r.seq, r.rot) for r in B.merge_rotated(df, turned).collect()} == {(1, 0), (2, 0), (3, 0), (4, 0), (6, 180)}


def test_profiles(spark):
    shapes = [("source", 1, k, name, i, "curve") for k, (name, n) in enumerate((("A", 5), ("B", 18), ("C", 2))) for i in range(n)]
    shapes += [("source", 2, 0, "D", i, "text") for i in range(12)]
    cols = "doc string, page_no int, layer_no int, layer string, shape_no int, type string"
    src = spark.createDataFrame(shapes, cols).withColumns({"parent_no": F.when(F.col("shape_no") == 4, 0), "text": F.when(F.col("type") == "text", F.concat(F.lit("t"), F.col("shape_no").cast("string")))})
    same = src.withColumn("doc", F.lit("target"))
    assert D.diff_types(src, same).count() == 0 and D.diff_layers(src, same).where("status <> 'equal'").count() == 0
    moved = same.withColumn("page_no", F.col("page_no") + 3)  # pages are paired by their place
    assert D.diff_layers(src, moved).where("status = 'equal'").count() == 4
    flat = same.withColumn("parent_no", F.lit(None).cast("int"))
    assert {(r.layer, r.status) for r in D.diff_layers(src, flat).where("status <> 'equal'").collect()} == {("A", "differs"), ("B", "differs"), ("D", "differs")}
    less = same.where("not (layer = 'B' and shape_no >= 15)").where("page_no = 1")
    assert {(r.layer, r.status) for r in D.diff_layers(src, less).where("status <> 'equal'").collect()} == {("B", "differs")}
    assert D.pair_pages(src, less).count() == 1
    top = {tuple(r)[:3]: r.n_shapes for r in D.profile(src).collect()}
    assert top[("source", None, None)] == 37 and top[("source", 1, 1)] == 18
    d = D.layer_profile(src, most=3).where("layer = 'D'").first()
    assert (d.total_all, d.top_level, d.first_texts, d.type_counts) == (12, 11, ["t0", "t1", "t2"], {"text": 12})
    found = D.layers_for(spark.createDataFrame([("a",), ("z",)], "kind string"), src)
    assert {(r.layer, r.found) for r in found.collect()} == {("A", True), ("Z", False)}


def test_grouping_and_votes(spark):
    prof = np.ones(64)
    assert K.group_shapes([(10, 1.0, prof), (30, 1.1, prof), (20, 3.0, prof), (5, 1.0, prof * 0.5)]) == [0, 0, 1, 2]
    o = spark.createDataFrame([(1, 0.5, 0.51), (2, 0.5, 0.6), (2, 0.4, 0.3), (3, 0.6, 0.5), (4, 0.5, 0.52)], "i int, upright double, turned double")
    assert {r.i: r.rot for r in S.orientation(o, ["i"]).collect()} == {1: 0, 2: 180, 3: 0, 4: 180}
    v = spark.createDataFrame([("g", 1, 1, "A", 0.9), ("g", 1, 2, None, 0.0), ("g", 2, 3, " ", 0.1), ("g", 3, 4, "A", 0.5), ("g", 4, 5, "B", 0.9), ("h", 1, 6, None, 0.0)], "grp string, region int, seq int, text string, score double")
    got = {r.grp: (r.text, r.regions, r.n_regions) for r in S.vote_text(v, ["grp"]).collect()}
    assert got == {"g": ("A", 2, 4), "h": (None, 0, 1)}
    m = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "a", False), (4, "b", False), (5, "c", True), (6, "c", False)], "i int, grp string, convert boolean")
    assert {r.i: r.convert for r in S.group_majority(m, ["grp"]).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_lanczos():
    flat = np.full((7, 9), 77)
    assert (K.lanczos(flat, 20, 3) == 77).all() and K.lanczos(np.tile([0, 255], (4, 4)), 8, 4).shape == (4, 8)


def test_registered_functions(spark):
    register(spark)
    assert [tuple(r) for r in spark.sql("select * from true_runs(array(true, true, false, true))").collect()] == [(0, 2), (3, 4)]
    assert spark.sql("select variation(id) v from values (1.0D), (3.0D) t(id)").first().v == 0.5


def test_unique_names_cascade(spark):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(["x", "x_2", "x", "x", "y", "x_2", "x_2_2"])], "seq int, base string")
    assert [r.name for r in W.unique_names(rows, [], ["seq"]).orderBy("seq").collect()] == ["x", "x_2", "x_3", "x_4", "y", "x_2_2", "x_2_2_2"]


def test_unique_names_of_many_repeats(spark):
    n = 30_000  # quadratic: minutes
    rows = spark.range(2 * n).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "x").when(F.col("id") == 3, "x_5").when(F.col("id") % 4 == 1, "y").alias("base"))
    start = time.monotonic()
    got = {r.seq: r.name for r in W.unique_names(rows, [], ["seq"]).collect()}
    assert time.monotonic() - start < 30
    x = [got[i] for i in range(0, 2 * n, 2)]
    assert x[:5] == ["x", "x_2", "x_3", "x_4", "x_6"] and x[-1] == f"x_{n + 1}" and got[3] == "x_5"
    assert [got[i] for i in (1, 5, 9)] == ["y", "y_2", "y_3"] and got[7] is None
    assert len({v for v in got.values() if v}) == sum(v is not None for v in got.values())


def test_band_colour_of_bands_without_dark_pixels(spark):
    rows = [(0, 0, 0, 10, 20, 30), (0, 0, 1, 11, 20, 30), (0, 0, 2, 250, 250, 250), (1, 0, 0, 200, 210, 220), (1, 0, 1, 240, 210, 220)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    assert {tuple(r) for r in C.band_colour(px).collect()} == {(0, 10, 20, 30), (1, 220, 210, 220)}


def test_rare_colours_are_no_inks(spark):
    counts = {(255, 255, 255): 900, (0, 0, 0): 60, (0, 0, 8): 14, (250, 0, 0): 14, (0, 0, 250): 40}
    rows = [(0, i, 0, *c) for i, c in enumerate(c for c, n in counts.items() for _ in range(n))]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    got = {(r.r, r.g, r.b): r.n for r in C.detect_palette(px).collect()}
    assert got == {(0, 0, 0): 60, (0, 0, 250): 40}  # 14 pixels of a colour count for nothing, not even in its neighbour's mass
    assert len(C.detect_palette(px, most=1).collect()) == 1
    assert {(r.r, r.g, r.b) for r in C.detect_palette(px, least_share=0.5).collect()} == {(0, 0, 0)}


MASKS = [([(10, 5, 50, 35)], [], 1, 0.99), ([(30, 5, 60, 35)], [], 1, 0.99), ([(10, 5, 50, 35)], [(25, 15, 45, 25)], 2, 0.98), ([(10, 5, 30, 35), (35, 10, 50, 30)], [], 2, 0.99)]


@pytest.mark.parametrize("boxes,holes,n,least", MASKS)
def test_curves_cover_their_mask(boxes, holes, n, least):
    m = np.zeros((40, 60), bool)
    for x0, y0, x1, y1 in boxes:
        m[y0:y1, x0:x1] = True
    for x0, y0, x1, y1 in holes:
        m[y0:y1, x0:x1] = False
    path = T.curves(m)
    got = K.rasterise(K.subpaths(path), 60, 40, 8) >= 0.5
    assert path.count("M") == n and (got & m).sum() / (got | m).sum() >= least
    if len(boxes) == 1 and not holes:
        x0, y0, x1, y1 = boxes[0]
        assert all(f"{x}.0000 {y}.0000" in path for x in (x0, x1) for y in (y0, y1))
    for x0, y0, x1, y1 in holes:
        assert not got[y0 + 1 : y1 - 1, x0 + 1 : x1 - 1].any()


def test_curves_of_a_disc_are_round():
    ys, xs = np.mgrid[:80, :80]
    disc = (ys - 39.5) ** 2 + (xs - 39.5) ** 2 < 30**2
    path = T.curves(disc)
    got = K.rasterise(K.subpaths(path), 80, 80, 8)
    want = np.clip(30.5 - np.hypot(ys - 39.5, xs - 39.5), 0, 1)
    assert path.count("C") >= 6 and path.count("L") <= 2 and np.minimum(got, want).sum() / np.maximum(got, want).sum() > 0.98
    speck = np.zeros((20, 20), bool)
    speck[3, 3:5] = speck[10:15, 10:15] = True
    assert T.curves(speck, turd=2).count("M") == 1 and T.curves(speck, turd=1).count("M") == 2
    assert "C" not in T.curves(disc, alpha_max=0.0) and T.curves(np.zeros((4, 4), bool)) == ""
    noise = np.random.default_rng(1).random((40, 40)) < 0.5
    assert T.curves(noise, turd=0).count("M") == len(K.outline_loops(noise))


def test_straight_sides_stay_within_half_a_pixel():
    rng = np.random.default_rng(2)
    m = np.zeros((50, 50), bool)
    for _ in range(6):
        y, x, r = rng.integers(10, 40, 2).tolist() + [int(rng.integers(4, 10))]
        ys, xs = np.mgrid[:50, :50]
        m |= (ys - y) ** 2 + (xs - x) ** 2 < r * r
    for loop in K.outline_loops(m):
        loop = np.array(loop)
        n = len(loop)
        for i, k in enumerate(T.straight_reach(loop)):
            d = (loop[(i + k) % n] - loop[i]).astype(float)
            for j in range(1, k):
                p = loop[(i + j) % n] - loop[i]
                assert abs(d[0] * p[1] - d[1] * p[0]) <= 0.5 * np.abs(d).sum() + 1e-9


def test_trace_all_picks_the_best_threshold(spark):
    ys, xs = np.mgrid[:40, :40]
    soft = np.clip((np.hypot(ys - 20, xs - 20) - 11) * 120 + 128, 0, 255).astype(int)
    regions = spark.createDataFrame([(0, "disc", 2, 2, 38, 38, False)], "image_id long, region string, x0 int, y0 int, x1 int, y1 int, invert boolean")
    px = frame(spark, soft)
    every = T.trials(px, regions, (20, 128, 235), upscale=2).collect()
    assert len(every) == 3 and all(r.has_curve for r in every)
    best = T.trace_all(px, regions, (20, 128, 235), upscale=2).first()
    assert best.soft == max(r.soft for r in every) and best.soft > 95 and best.iou > 95 and best.n_paths == 1
    dark = px.withColumn("gray", 255 - F.col("gray"))
    turned = T.trace_all(dark, regions.withColumn("invert", F.lit(True)), (128,), upscale=2).first()
    assert turned.n_paths == 1 and turned.iou > 95


def test_registration_and_pages(spark):
    a = np.zeros((30, 40), bool)
    a[5:12, 8:20] = a[20:25, 30:33] = True
    moved = np.roll(a, (4, -7), (0, 1))
    pairs = frame(spark, a, column="a").join(frame(spark, moved, column="b"), ["image_id", "y", "x"])
    assert tuple(K.best_shift(pairs).first()) == (0, -4, 7, 100.0)
    blank = pairs.withColumns({"a": F.lit(False), "b": F.lit(False)})
    assert tuple(K.best_shift(blank).first()) == (0, -15, -15, 100.0)  # all shifts are equal: the first wins
    px = spark.createDataFrame([(1, 0, 0, 7), (2, 0, 0, 9), (2, 0, 1, 8)], "image_id long, y int, x int, gray int")
    items = spark.createDataFrame([(0, 1, 1, 1), (0, 2, 1, 1)], "page int, image_id long, left int, top int")
    page = K.paste(px, spark.createDataFrame([(0, 3, 2)], "page int, w int, h int"), items)
    assert sorted((r.y, r.x, r.gray) for r in page.collect()) == [(0, 0, 255), (0, 1, 255), (0, 2, 255), (1, 0, 255), (1, 1, 9), (1, 2, 8)]
    assert K.resize(frame(spark, np.full((6, 8), 50)), 4, 3).where("gray = 50").count() == 12


def test_boxes_by_cells(spark):
    rng = np.random.default_rng(3)
    rows = [(0, k, *(int(v) for v in rng.integers(0, 150, 2)), *(int(v) for v in rng.integers(1, 60, 2))) for k in range(40)]
    b = spark.createDataFrame([(i, k, x, y, x + w, y + h) for i, k, x, y, w, h in rows], "image_id long, box int, x0 int, y0 int, x1 int, y1 int")
    half = b.where("box < 20")
    got = {r.box for r in B.in_boxes(half, b.where("box >= 20"), slack=4).collect()}
    boxes = [(k, x, y, x + w, y + h) for _, k, x, y, w, h in rows]
    want = {k for k, x0, y0, x1, y1 in boxes[:20] if any(a0 - 4 <= (x0 + x1) / 2 <= a1 + 4 and b0 - 4 <= (y0 + y1) / 2 <= b1 + 4 for _, a0, b0, a1, b1 in boxes[20:])}
    assert got == want and 0 < len(want) < 20
    ink = frame(spark, np.ones((100, 100), bool), column="ink")
    left = {(r.y, r.x) for r in B.erase(ink, b.where("box < 5")).collect()}
    gone = [(y, x) for y in range(100) for x in range(100) if any(x0 - 2 <= x < x1 + 3 and y0 - 2 <= y < y1 + 3 for _, x0, y0, x1, y1 in boxes[:5])]
    assert len(left) == 10000 - len(gone) and not left & set(gone)
