"""Registered queries over the supplied tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkframe.operators import boxes as B
from inkframe.operators import kernels as K
from inkframe.operators import raster as R
from inkframe.operators import runs as W
from inkframe.sources import views as V

QUERIES, SQL = {}, {}


def query(name: str, views: str = "", sql: str | None = None):
    """Registers a query, and its SQL over the named views."""

    def add(f):
        QUERIES[name] = f
        if sql:
            body = ",\n".join(V.SQL[v] for v in views.split())
            SQL[name] = (f"WITH {body}" + (",\n" if sql.lstrip().startswith(("+",)) else "\n") if body else "") + sql.lstrip().removeprefix("+")
        return f

    return add


def _ink(s, d):
    return R.binarise(V.px_emb(s, d))


INK = "+ ink AS (SELECT *, gray < 128 AS ink FROM px)"

# --- predicates and aggregates over pixels ---------------------------------


@query("C1_binarise", "px", INK + " SELECT image_id, y, x, ink FROM ink")
def _(s, d):
    return _ink(s, d).select("image_id", "y", "x", "ink")


@query("C2_inverted_ink", "px", "SELECT image_id, y, x, gray > 128 AS ink FROM px")
def _(s, d):
    return R.binarise(V.px_emb(s, d), invert=True).select("image_id", "y", "x", "ink")


@query("C3_region_slice", "px", "SELECT image_id, y - 10 AS y, x - 16 AS x, gray FROM px WHERE y >= 10 AND y < 40 AND x >= 16 AND x < 48")
def _(s, d):
    return R.region_slice(V.px_emb(s, d), 16, 10, 48, 40).select("image_id", "y", "x", "gray")


@query("C5_coverage", "px", "SELECT image_id, y, round(avg(greatest(0.0, least(1.0, (255 - gray) / CAST(175 AS DOUBLE)))), 6) AS coverage FROM px GROUP BY ALL")
def _(s, d):
    return V.px_emb(s, d).groupBy("image_id", "y").agg(F.round(F.avg(R.coverage(F.col("gray"), 80)), 6).alias("coverage"))


_STRIP = """+ ink AS (SELECT *, gray < 120 AS ink FROM px),
c AS (SELECT image_id, x, avg(CAST(ink AS INT)) AS m FROM ink GROUP BY ALL),
cut AS (SELECT image_id, max(x) + 1 AS w, coalesce(min(x) FILTER (m <= 0.45), max(x) + 1) AS l, coalesce(max(x) FILTER (m <= 0.45) + 1, min(x)) AS ra FROM c GROUP BY 1),
k AS (SELECT image_id, w, l, greatest(l, ra) AS ra FROM cut),
rw AS (SELECT i.image_id, y, avg(CAST(ink AS INT)) AS m FROM ink i JOIN k USING (image_id) WHERE x >= l AND x < ra GROUP BY ALL),
rc AS (SELECT image_id, max(y) + 1 AS h, coalesce(min(y) FILTER (m <= 0.45), max(y) + 1) AS t, coalesce(max(y) FILTER (m <= 0.45) + 1, min(y)) AS ba FROM rw GROUP BY 1)
SELECT image_id, l AS "left", w - ra AS "right", coalesce(t, 0) AS "top", coalesce(h - greatest(t, ba), 0) AS bottom FROM k LEFT JOIN rc USING (image_id)"""


@query("C13_strip_residue", "px", _STRIP)
def _(s, d):
    return R.strip_residue(R.binarise(V.px_emb(s, d), 120), least=0.45)


@query("C14_compact_columns", "px", INK + """, c AS (SELECT image_id, x, avg(CAST(ink AS INT)) AS m FROM ink GROUP BY ALL),
k AS (SELECT image_id, x, m, min(m) OVER (PARTITION BY image_id) AS lo FROM c),
n AS (SELECT image_id, x, row_number() OVER (PARTITION BY image_id ORDER BY x) - 1 AS nx FROM k WHERE m < 0.55 OR lo >= 0.55)
SELECT image_id, nx AS x, count(*) FILTER (ink) AS n_ink FROM ink JOIN n USING (image_id, x) GROUP BY ALL""")
def _(s, d):
    return R.compact_columns(_ink(s, d), 0.55).groupBy("image_id", "x").agg(F.count_if("ink").alias("n_ink"))


_BOUNDS = INK + " SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px WHERE gray < 60 GROUP BY 1"


@query("C15_tight_box", "px", _BOUNDS)
def _(s, d):
    return R.bounds(R.binarise(V.px_emb(s, d), 60))


@query("A23_bounds_mm", "px", "SELECT image_id, round(min(x) * CAST(0.25 AS DOUBLE), 6) AS x0_mm, round(min(y) * CAST(0.25 AS DOUBLE), 6) AS y0_mm, round((max(x) + 1) * CAST(0.25 AS DOUBLE), 6) AS x1_mm, round((max(y) + 1) * CAST(0.25 AS DOUBLE), 6) AS y1_mm FROM px WHERE gray < 60 GROUP BY 1")
def _(s, d):
    return R.box_mm(R.bounds(R.binarise(V.px_emb(s, d), 60)), 0.25).select("image_id", *[F.round(f"{c}_mm", 6).alias(f"{c}_mm") for c in B.BOX])


@query("C17_full_bleed", "px", "SELECT image_id, count(DISTINCT x) FILTER (gray < 70) = count(DISTINCT x) AS full_bleed FROM px GROUP BY 1")
def _(s, d):
    return R.full_bleed(R.binarise(V.px_emb(s, d), 70))


@query("C18_edge_probe", "px", """+ m AS (SELECT image_id, max(x) AS w, max(y) AS h FROM px GROUP BY 1),
c AS (SELECT image_id, x, avg(gray) AS m FROM px GROUP BY ALL),
l AS (SELECT image_id, coalesce(min(x) FILTER (NOT m < 128), max(x) + 1) AS dark_columns FROM c GROUP BY 1)
SELECT image_id, CAST(trunc(avg(gray) FILTER (x = 0)) AS BIGINT) AS "left", CAST(trunc(avg(gray) FILTER (x = w)) AS BIGINT) AS "right",
CAST(trunc(avg(gray) FILTER (y = 0)) AS BIGINT) AS "top", CAST(trunc(avg(gray) FILTER (y = h)) AS BIGINT) AS bottom, CAST(any_value(dark_columns) AS BIGINT) AS dark_columns
FROM px JOIN m USING (image_id) JOIN l USING (image_id) GROUP BY 1""")
def _(s, d):
    return R.edge_probe(V.px_emb(s, d))


@query("C19_polarity", "px", """+ s AS (SELECT image_id, avg(CAST(gray < 128 AS INT)) AS share FROM px GROUP BY 1)
SELECT image_id, count(*) FILTER (CASE WHEN share > 0.5 THEN NOT gray < 128 ELSE gray < 128 END) AS n_ink FROM px JOIN s USING (image_id) GROUP BY 1""")
def _(s, d):
    return R.polarity_ink(V.px_emb(s, d)).groupBy("image_id").agg(F.count_if("ink").alias("n_ink"))


def _pairs(s, d):
    px = V.px_emb(s, d)
    return px.select("image_id", "y", "x", (F.col("gray") < 128).alias("a"), (F.col("gray") < 140).alias("b"))


PAIRS = "+ p AS (SELECT image_id, y, x, gray < 128 AS a, gray < 140 AS b FROM px)"


@query("C20_overlay", "px", PAIRS + " SELECT image_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'source' WHEN b THEN 'render' ELSE 'none' END AS overlay, count(*) AS n FROM p GROUP BY ALL")
def _(s, d):
    return R.overlay(_pairs(s, d)).groupBy("image_id", "overlay").agg(F.count(F.lit(1)).alias("n"))


@query("A1_row_sums", "px", "SELECT image_id, y, count(*) FILTER (gray < 128) AS n_ink, count(*) AS n FROM px GROUP BY ALL")
def _(s, d):
    return R.line_sums(_ink(s, d), "y")


@query("A1_column_sums", "px", "SELECT image_id, x, count(*) FILTER (gray < 128) AS n_ink, count(*) AS n FROM px GROUP BY ALL")
def _(s, d):
    return R.line_sums(_ink(s, d), "x")


@query("A2_row_median", "px", "SELECT image_id, y, median(gray) AS median_gray FROM px GROUP BY ALL")
def _(s, d):
    return R.row_medians(V.px_emb(s, d))


@query("A4_ink_level", "px", "SELECT image_id, round(coalesce(quantile_cont(gray, 0.01) FILTER (gray < 250), 0), 6) AS ink_level FROM px GROUP BY 1")
def _(s, d):
    return R.ink_level(V.px_emb(s, d)).select("image_id", F.round("ink_level", 6).alias("ink_level"))


HIST = """+ h AS (SELECT i.image_id, CAST(g AS INT) AS gray, count(px.gray) AS n FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN range(0, 256) AS t(g)
LEFT JOIN px ON px.image_id = i.image_id AND px.gray = g GROUP BY ALL)"""


@query("A8_histogram", "px", HIST + " SELECT image_id, gray, n FROM h")
def _(s, d):
    return R.histogram(V.px_emb(s, d))


CUMULATIVE = HIST + ", c AS (SELECT image_id, gray, n, CAST(sum(n) OVER w AS BIGINT) AS n_upto, CAST(sum(n * gray) OVER w AS BIGINT) AS sum_upto FROM h WINDOW w AS (PARTITION BY image_id ORDER BY gray))"


@query("W9_cumulative_histogram", "px", CUMULATIVE + " SELECT * FROM c")
def _(s, d):
    return R.cumulative(R.histogram(V.px_emb(s, d)))


@query("A9_otsu", "px", CUMULATIVE + """, t AS (SELECT *, max(n_upto) OVER (PARTITION BY image_id) AS tn, max(sum_upto) OVER (PARTITION BY image_id) AS ts FROM c),
v AS (SELECT image_id, gray, CASE WHEN n_upto > 0 AND tn > n_upto THEN CAST(n_upto AS DOUBLE) * (tn - n_upto) * (CAST(sum_upto AS DOUBLE) / n_upto - (ts - CAST(sum_upto AS DOUBLE)) / (tn - n_upto)) * (CAST(sum_upto AS DOUBLE) / n_upto - (ts - CAST(sum_upto AS DOUBLE)) / (tn - n_upto)) END AS b FROM t),
m AS (SELECT image_id, max(b) AS best FROM v GROUP BY 1)
SELECT image_id, coalesce((min(gray) FILTER (best > 0 AND b >= best * (1 - 1e-12)) + max(gray) FILTER (best > 0 AND b >= best * (1 - 1e-12)) + 2) // 2, 128) AS threshold FROM v JOIN m USING (image_id) GROUP BY 1""")
def _(s, d):
    return R.otsu(V.px_emb(s, d))


@query("A11_fidelity", "px", PAIRS + """, n AS (SELECT image_id, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b FROM p GROUP BY 1)
SELECT *, round(CASE WHEN n_a = 0 THEN 100.0 ELSE n_both * 100.0 / CAST(n_a AS DOUBLE) END, 6) AS recall, round(CASE WHEN n_b = 0 THEN 100.0 ELSE n_both * 100.0 / CAST(n_b AS DOUBLE) END, 6) AS precision,
round(CASE WHEN n_a + n_b - n_both = 0 THEN 100.0 ELSE n_both * 100.0 / CAST(n_a + n_b - n_both AS DOUBLE) END, 6) AS iou FROM n""")
def _(s, d):
    return R.fidelity(_pairs(s, d)).select("image_id", "n_both", "n_a", "n_b", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "iou")])


@query("A12_soft_fidelity", "px", """+ p AS (SELECT image_id, greatest(0.0, least(1.0, (255 - gray) / CAST(175 AS DOUBLE))) AS a, greatest(0.0, least(1.0, (255 - gray) / CAST(155 AS DOUBLE))) AS b FROM px)
SELECT image_id, round(CASE WHEN sum(greatest(a, b)) = 0 THEN 100.0 ELSE sum(least(a, b)) * 100.0 / sum(greatest(a, b)) END, 6) AS soft, round(CASE WHEN sum(a) = 0 THEN 1.0 ELSE sum(b) / sum(a) END, 6) AS ink_ratio FROM p GROUP BY 1""")
def _(s, d):
    px = V.px_emb(s, d).select("image_id", R.coverage(F.col("gray"), 80).alias("a"), R.coverage(F.col("gray"), 100).alias("b"))
    return R.soft_fidelity(px).select("image_id", F.round("soft", 6).alias("soft"), F.round("ink_ratio", 6).alias("ink_ratio"))


@query("A24_box_filter", "px", "SELECT image_id, y // 8 AS y, x // 8 AS x, round(avg(gray), 6) AS gray FROM px GROUP BY ALL")
def _(s, d):
    return R.box_filter(V.px_emb(s, d), 8).select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("gray", 6).alias("gray"))


@query("J13_pixel_join", "px", "+ a AS (SELECT image_id, y, x FROM px WHERE gray < 128), b AS (SELECT image_id, y, x FROM px WHERE gray > 100) SELECT image_id, count(*) AS n_both FROM a JOIN b USING (image_id, y, x) GROUP BY 1")
def _(s, d):
    px = V.px_emb(s, d)
    return R.pixel_overlap(px.where("gray < 128"), px.where("gray > 100"))


@query("T9_registration", "px", """+ a AS (SELECT image_id, y, x FROM px WHERE gray < 100), b AS (SELECT image_id, (y + 2) % h AS y, (x + 5) % w AS x FROM a JOIN (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY 1) USING (image_id)),
sz AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, count(*) FILTER (gray < 100) AS n FROM px GROUP BY 1),
g1 AS (SELECT image_id, w, h, n, i AS dy, j AS dx FROM sz, range(-12, 13, 3) t(i), range(-12, 13, 3) u(j)),
o1 AS (SELECT g1.image_id, dy, dx, count(*) AS nb FROM g1 JOIN b USING (image_id) JOIN a ON a.image_id = b.image_id AND a.y = ((b.y + dy) % h + h) % h AND a.x = ((b.x + dx) % w + w) % w GROUP BY ALL),
r1 AS (SELECT image_id, w, h, n, dy, dx, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN 2 * n - coalesce(nb, 0) = 0 THEN 100.0 ELSE coalesce(nb, 0) * 100.0 / CAST(2 * n - coalesce(nb, 0) AS DOUBLE) END DESC, dy, dx) AS k FROM g1 LEFT JOIN o1 USING (image_id, dy, dx)),
g2 AS (SELECT image_id, w, h, n, dy + i AS dy, dx + j AS dx FROM r1, range(-3, 4) t(i), range(-3, 4) u(j) WHERE k = 1),
o2 AS (SELECT g2.image_id, dy, dx, count(*) AS nb FROM g2 JOIN b USING (image_id) JOIN a ON a.image_id = b.image_id AND a.y = ((b.y + dy) % h + h) % h AND a.x = ((b.x + dx) % w + w) % w GROUP BY ALL),
r2 AS (SELECT image_id, dy, dx, CASE WHEN 2 * n - coalesce(nb, 0) = 0 THEN 100.0 ELSE coalesce(nb, 0) * 100.0 / CAST(2 * n - coalesce(nb, 0) AS DOUBLE) END AS iou FROM g2 LEFT JOIN o2 USING (image_id, dy, dx))
SELECT image_id, dy, dx, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, dy, dx) AS k FROM r2) WHERE k = 1""")
def _(s, d):
    px = V.px_emb(s, d)
    size = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    moved = px.join(size, "image_id").select("image_id", ((F.col("y") + 2) % F.col("h")).alias("y"), ((F.col("x") + 5) % F.col("w")).alias("x"), (F.col("gray") < 100).alias("b"))
    pairs = px.select("image_id", "y", "x", (F.col("gray") < 100).alias("a")).join(moved, ["image_id", "y", "x"])
    return K.best_shift(pairs).select("image_id", F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"), F.round("iou", 6).alias("iou"))


# --- runs and segments --------------------------------------------------------

RUNS = """+ l AS (SELECT image_id, y AS i, count(*) FILTER (gray < 128) AS n_ink FROM px GROUP BY ALL),
k AS (SELECT image_id, i, i - row_number() OVER (PARTITION BY image_id ORDER BY i) AS g FROM l WHERE n_ink >= 30),
r AS (SELECT image_id, min(i) AS s, max(i) + 1 AS e FROM k GROUP BY image_id, g)"""


@query("W1_runs", "px", RUNS + ' SELECT image_id, s AS "start", e AS "end" FROM r')
def _(s, d):
    return W.runs(R.line_sums(_ink(s, d), "y"), "y", F.col("n_ink") >= 30)


MERGED = RUNS + """, f AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY image_id ORDER BY s) >= 2 THEN 1 ELSE 0 END AS far FROM r),
m AS (SELECT *, sum(far) OVER (PARTITION BY image_id ORDER BY s) AS n FROM f),
b AS (SELECT image_id, min(s) AS s, max(e) AS e FROM m GROUP BY image_id, n)"""


@query("W2_merge_runs", "px", MERGED + ' SELECT image_id, s AS "start", e AS "end" FROM b WHERE e - s >= 3')
def _(s, d):
    return W.merge_runs(W.runs(R.line_sums(_ink(s, d), "y"), "y", F.col("n_ink") >= 30), 2, 3)


@query("W3_row_bands", "px", MERGED.replace(">= 2 THEN", ">= 6 THEN").replace(">= 30", ">= 4").replace("gray < 128", "gray < 100") + ' SELECT image_id, s AS "start", e AS "end" FROM b WHERE e - s >= 6')
def _(s, d):
    return W.row_bands(R.binarise(V.px_emb(s, d), 100))


@query("W4_column_segments", "px", MERGED.replace("y AS i", "x AS i").replace(">= 2 THEN", ">= 3 THEN").replace(">= 30", ">= 20") + ' SELECT image_id, s AS "start", e AS "end" FROM b WHERE e - s >= 1')
def _(s, d):
    return W.column_segments(_ink(s, d), min_ink=20)


@query("W5_plain_bands", "px", RUNS.replace(">= 30", ">= 28") + ' SELECT image_id, s AS "start", e AS "end" FROM r WHERE e - s >= 4')
def _(s, d):
    return W.plain_bands(_ink(s, d), min_ink=28, least=4)


@query("W10_leading_prefix", "px", "+ l AS (SELECT image_id, y, count(*) FILTER (gray < 128) AS n_ink FROM px GROUP BY ALL) SELECT image_id, CAST(coalesce(min(y) FILTER (NOT n_ink < 34), max(y) + 1) AS BIGINT) AS n_leading FROM l GROUP BY 1")
def _(s, d):
    return R.leading(R.line_sums(_ink(s, d), "y"), "y", F.col("n_ink") < 34)


OTSU_1D = """, st AS (SELECT image_id, count(*) AS n, CAST(min(gap) AS DOUBLE) AS lo, CAST(max(gap) AS DOUBLE) AS hi FROM gp GROUP BY 1),
tr AS (SELECT image_id, k, CASE WHEN k = 63 THEN hi ELSE lo + k * ((hi - lo) / 63) END AS cut FROM st, range(0, 64) t(k) WHERE n >= 3 AND hi > lo),
pt AS (SELECT image_id, k, cut, count(*) FILTER (gap <= cut) AS n0, count(*) FILTER (gap > cut) AS n1, avg(gap) FILTER (gap <= cut) AS m0, avg(gap) FILTER (gap > cut) AS m1 FROM tr JOIN gp USING (image_id) GROUP BY ALL),
bs AS (SELECT image_id, cut, row_number() OVER (PARTITION BY image_id ORDER BY round(n0 * n1 * (m0 - m1) * (m0 - m1), 6) DESC, k) AS q FROM pt WHERE n0 > 0 AND n1 > 0),
th AS (SELECT st.image_id, CASE WHEN n < 3 THEN hi / 2 WHEN lo = hi THEN hi ELSE cut END AS threshold FROM st LEFT JOIN bs ON bs.image_id = st.image_id AND q = 1)"""
COLS = """+ l AS (SELECT vid AS image_id, x, count(*) FILTER (gray < 100) AS n_ink FROM (SELECT image_id * 50 + y AS vid, x, gray FROM px) GROUP BY ALL),
k AS (SELECT image_id, x, x - row_number() OVER (PARTITION BY image_id ORDER BY x) AS g FROM l WHERE n_ink > 0),
r AS (SELECT image_id, min(x) AS s, max(x) + 1 AS e FROM k GROUP BY image_id, g),
ga AS (SELECT *, s - lag(e) OVER (PARTITION BY image_id ORDER BY s) AS gap FROM r), gp AS (SELECT image_id, gap FROM ga WHERE gap IS NOT NULL)"""


def _lines(s, d):
    """Each embedding as an image of one row."""
    px = R.binarise(V.px_emb(s, d), 100)
    return px.withColumn("image_id", F.col("image_id") * V.TILE_ROWS + F.col("y")).withColumn("y", F.lit(0))


@query("A10_otsu_gaps", "px", COLS + OTSU_1D + " SELECT image_id, round(threshold, 6) AS threshold FROM th")
def _(s, d):
    from pyspark.sql import Window

    cols = W.runs(R.line_sums(_lines(s, d), "x"), "x", F.col("n_ink") > 0)
    gaps = cols.withColumn("gap", F.col("start") - F.lag("end").over(Window.partitionBy("image_id").orderBy("start"))).where("gap is not null")
    return W.otsu_gaps(gaps, ("image_id",)).select("image_id", F.round("threshold", 6).alias("threshold"))


@query("W8_words", "px", COLS + OTSU_1D + """, wd AS (SELECT ga.image_id, s, e, sum(CASE WHEN gap > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY ga.image_id ORDER BY s) AS word FROM ga LEFT JOIN th USING (image_id))
SELECT image_id, CAST(word AS BIGINT) AS word, min(s) AS "start", max(e) AS "end", count(*) AS n_runs FROM wd GROUP BY image_id, word""")
def _(s, d):
    return W.words(_lines(s, d))


@query("W11_column_profile", "px", """+ l AS (SELECT image_id, x, CAST(count(*) FILTER (gray < 128) AS DOUBLE) AS v FROM px GROUP BY ALL),
g AS (SELECT image_id, k, k * mx / CAST(31 AS DOUBLE) AS pos, floor(k * mx / CAST(31 AS DOUBLE)) AS lo, least(ceil(k * mx / CAST(31 AS DOUBLE)), mx) AS hi FROM (SELECT image_id, max(x) AS mx FROM l GROUP BY 1), range(0, 32) t(k)),
v AS (SELECT g.image_id, k, a.v + (b.v - a.v) * (pos - lo) AS v FROM g JOIN l a ON a.image_id = g.image_id AND a.x = lo JOIN l b ON b.image_id = g.image_id AND b.x = hi)
SELECT image_id, k, round(CASE WHEN max(v) OVER (PARTITION BY image_id) > 0 THEN v / max(v) OVER (PARTITION BY image_id) ELSE 0 END, 6) AS profile FROM v""")
def _(s, d):
    return W.column_profile(_ink(s, d), 32).select("image_id", F.col("k").cast("long").alias("k"), F.round("profile", 6).alias("profile"))


@query("W14_glyph_height", "px", COLS.split("ga AS")[0].rstrip().rstrip(",").replace("vid AS image_id", "image_id").replace("SELECT image_id * 50 + y AS vid, x, gray FROM px", "SELECT * FROM px").replace("n_ink > 0", "n_ink >= 10") + """
SELECT r.image_id, s AS "start", e AS "end", max(y) - min(y) + 1 AS height FROM r JOIN px ON px.image_id = r.image_id AND x >= s AND x < e AND gray < 100 GROUP BY ALL""")
def _(s, d):
    ink = R.binarise(V.px_emb(s, d), 100)
    return W.glyph_heights(ink, W.runs(R.line_sums(ink, "x"), "x", F.col("n_ink") >= 10))


def _grown(src: str, pos: str, lo: str, hi: str, across: str, a0: str, a1: str, extent: str, out: str) -> str:
    """Boxes of ``src`` grown along ``pos`` to the first line without loose ink."""
    return f""", {out}_ink AS (SELECT DISTINCT b.image_id, b.c0, b.s0, l.{pos} AS i FROM {src} b JOIN loose l ON l.image_id = b.image_id AND l.{across} >= b.{a0} AND l.{across} < b.{a1}),
{out}_end AS (SELECT b.image_id, b.c0, b.s0, max(t.i) FILTER (t.i < b.{lo}) + 1 AS n0, min(t.i) FILTER (t.i >= b.{hi}) AS n1 FROM {src} b JOIN size z USING (image_id) JOIN range(0, 100) t(i) ON t.i < z.{extent}
  WHERE NOT EXISTS (SELECT 1 FROM {out}_ink k WHERE k.image_id = b.image_id AND k.c0 = b.c0 AND k.s0 = b.s0 AND k.i = t.i) GROUP BY ALL),
{out} AS (SELECT b.* REPLACE (greatest(0, coalesce(n0, 0)) AS {lo}, least(z.{extent}, coalesce(n1, z.{extent})) AS {hi}) FROM {src} b JOIN size z USING (image_id) LEFT JOIN {out}_end e ON e.image_id = b.image_id AND e.c0 = b.c0 AND e.s0 = b.s0)"""


_PARTITION = (
    _STRIP.split("\nSELECT image_id, l AS")[0].replace("gray < 120", "gray < 90").replace("0.45", "0.9")
    + """, size AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY 1),
keep AS (SELECT k.image_id, l AS x0, ra AS x1, coalesce(t, 0) AS y0, z.h - coalesce(rc.h - greatest(t, ba), 0) AS y1 FROM k JOIN size z USING (image_id) LEFT JOIN rc USING (image_id)),
inner_px AS (SELECT px.* FROM px JOIN keep USING (image_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1),
mask AS (SELECT image_id, y, x FROM inner_px WHERE gray < 90), loose AS (SELECT image_id, y, x FROM inner_px WHERE gray < 110),
ln AS (SELECT image_id, y, count(*) AS n FROM mask GROUP BY ALL HAVING count(*) >= 2),
lr AS (SELECT image_id, min(y) AS s, max(y) + 1 AS e FROM (SELECT *, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS g FROM ln) GROUP BY image_id, g),
lb AS (SELECT image_id, min(s) AS b0, max(e) AS b1 FROM (SELECT *, sum(far) OVER (PARTITION BY image_id ORDER BY s) AS g FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY image_id ORDER BY s) >= 2 THEN 1 ELSE 0 END AS far FROM lr)) GROUP BY image_id, g HAVING max(e) - min(s) >= 2),
md AS (SELECT image_id, y, median(gray) < 128 AS dark FROM px GROUP BY ALL),
st AS (SELECT image_id, b0, dark, min(y) AS s, max(y) + 1 AS e FROM (SELECT image_id, b0, dark, y, y - row_number() OVER (PARTITION BY image_id, b0, dark ORDER BY y) AS g FROM md JOIN lb USING (image_id) WHERE y >= b0 AND y < b1) GROUP BY image_id, b0, dark, g),
ac AS (SELECT st.image_id, s, e, count(DISTINCT x) AS n, min(x) AS r0, max(x) + 1 AS r1 FROM st JOIN px ON px.image_id = st.image_id AND y >= s AND y < e AND gray < 90 GROUP BY ALL),
sb AS (SELECT st.*, w, r0, r1, dark AND st.e - st.s >= 10 AND coalesce(n = w, false) AS band FROM st JOIN size USING (image_id) LEFT JOIN ac ON ac.image_id = st.image_id AND ac.s = st.s AND ac.e = st.e),
cs AS (SELECT image_id, s AS c0, e AS c1, w FROM sb WHERE NOT band AND e - s >= 2),
cc AS (SELECT cs.image_id, c0, c1, w, x FROM cs JOIN mask ON mask.image_id = cs.image_id AND y >= c0 AND y < c1 GROUP BY ALL HAVING count(*) >= 2),
cr AS (SELECT image_id, c0, c1, w, min(x) AS s, max(x) + 1 AS e FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, c0, c1 ORDER BY x) AS g FROM cc) GROUP BY image_id, c0, c1, w, g),
cb AS (SELECT image_id, c0, min(s) AS s0, min(s) AS x0, c0 AS y0, max(e) AS x1, c1 AS y1 FROM (SELECT *, sum(far) OVER (PARTITION BY image_id, c0 ORDER BY s) AS g FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY image_id, c0 ORDER BY s) >= greatest(3, CAST(round_even(w * 0.05, 0) AS INT)) THEN 1 ELSE 0 END AS far FROM cr)) GROUP BY image_id, c0, c1, g HAVING max(e) - min(s) >= 2)"""
    + _grown("cb", "y", "y0", "y1", "x", "x0", "x1", "h", "gy")
    + _grown("gy", "x", "x0", "x1", "y", "y0", "y1", "w", "gx")
    + """ SELECT image_id, 'BAND' AS kind, true AS inverted, r0 AS x0, s AS y0, r1 AS x1, e AS y1 FROM sb WHERE band UNION ALL SELECT image_id, 'CONTENT', false, x0, y0, x1, y1 FROM gx"""
)


@query("W6_auto_partition", "px", _PARTITION)
def _(s, d):
    return W.auto_partition(V.px_emb(s, d), edge_gray=110, threshold=90, min_ink=2, gap=2, least=2)


def _regions(s, d):
    b, mm = V.box_li(s, d), {"w": (F.col("x1") - F.col("x0")) * 3.0, "h": (F.col("y1") - F.col("y0")) * 0.45}
    kind = W.region_kind(mm["w"], mm["h"], band=F.col("part") % 9 == 0, invert=F.col("part") % 5 == 0)
    return b.select("image_id", "seq", "part", *B.BOX, kind.alias("kind"))


KIND = "CASE WHEN part % 9 = 0 THEN 'BAND' WHEN part % 5 = 0 THEN 'INK' WHEN (y1 - y0) * 0.45 < 6 THEN 'TEXT' WHEN (x1 - x0) * 3.0 < 60 AND (y1 - y0) * 0.45 < 40 THEN 'MARK' ELSE 'ART' END"


@query("C9_region_kind", "box", f"SELECT image_id, seq, part, {KIND} AS kind FROM box")
def _(s, d):
    return _regions(s, d).select("image_id", "seq", "part", "kind")


@query("W7_region_names", "box", f"""+ k AS (SELECT *, {KIND} AS kind FROM box), n AS (SELECT *, row_number() OVER (PARTITION BY image_id, kind ORDER BY y0, x0, x1, y1) AS n FROM k),
m AS (SELECT *, lower(kind) || lpad(CAST(n AS VARCHAR), 2, '0') AS name FROM n)
SELECT image_id, name, x0, y0, x1, y1, CASE WHEN kind = 'BAND' THEN name || '_ink' ELSE name END AS trace_name, CASE WHEN kind = 'BAND' THEN 'INK' ELSE kind END AS trace_kind FROM m""")
def _(s, d):
    return W.name_regions(_regions(s, d)).select("image_id", "name", *B.BOX, "trace_name", "trace_kind")


@query("W12_layer_index", "shape", """+ l AS (SELECT DISTINCT doc, page_no, layer_no, layer FROM shape WHERE doc = 'source')
SELECT page_no, layer, lpad(CAST(row_number() OVER (PARTITION BY page_no ORDER BY layer_no) AS VARCHAR), 2, '0') || '_' || layer AS name FROM l""")
def _(s, d):
    layers = V.doc_tree(s, d).where("doc = 'source'").select("page_no", "layer_no", "layer").distinct()
    return W.layer_index(layers, ["layer_no"]).select("page_no", "layer", "name")


@query("W13_unique_names", "cand", "SELECT seq, font || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS name FROM (SELECT seq, font, row_number() OVER (PARTITION BY font ORDER BY seq) AS n FROM cand)")
def _(s, d):
    c = V.cand_part(s, d).select("seq", F.col("font").alias("base"))
    return W.unique_names(c, [], ["seq"]).select("seq", "name")
