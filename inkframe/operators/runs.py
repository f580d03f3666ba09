"""Gaps and islands over lines of pixels: runs, bands, words, regions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.operators.raster import IMG, binarise, line_sums


def runs(lines: DataFrame, pos: str, ok: Column, by: tuple[str, ...] = (IMG,)) -> DataFrame:
    """Half-open runs [start, end) of consecutive positions where ``ok`` holds."""
    w = Window.partitionBy(*by).orderBy(pos)
    kept = lines.where(ok).withColumn("__island", F.col(pos) - F.row_number().over(w))
    return kept.groupBy(*by, "__island").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("__island")


def merge_runs(segments: DataFrame, gap: int | Column, least: int, by: tuple[str, ...] = (IMG,)) -> DataFrame:
    """Joins runs less than ``gap`` apart, then drops those shorter than ``least``."""
    w = Window.partitionBy(*by).orderBy("start")
    far = F.coalesce((F.col("start") - F.lag("end").over(w) >= gap).cast("int"), F.lit(0))
    parts = segments.withColumn("__far", far).withColumn("__n", F.sum("__far").over(w))
    joined = parts.groupBy(*by, "__n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.where(F.col("end") - F.col("start") >= least).drop("__n")


def row_bands(ink: DataFrame, min_ink: int = 4, gap: int = 6, least: int = 6) -> DataFrame:
    """Bands of rows with ink enough."""
    return merge_runs(runs(line_sums(ink, "y"), "y", F.col("n_ink") >= min_ink), gap, least)


def column_segments(ink: DataFrame, min_ink: int = 1, gap: int = 3, least: int = 1) -> DataFrame:
    return merge_runs(runs(line_sums(ink, "x"), "x", F.col("n_ink") >= min_ink), gap, least)


def plain_bands(ink: DataFrame, min_ink: int = 6, least: int = 12) -> DataFrame:
    """Bands without merging."""
    return runs(line_sums(ink, "y"), "y", F.col("n_ink") >= min_ink).where(F.col("end") - F.col("start") >= least)


def otsu_gaps(gaps: DataFrame, by: tuple[str, ...], value: str = "gap", cuts: int = 64) -> DataFrame:
    """The cut that parts each group's gaps best, of ``cuts`` evenly spaced ones,
    the first of equals; under three gaps half the largest, of equal ones their
    value."""
    v = F.col(value).cast("double")
    stats = gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (cuts - 1)
    trial = stats.where("n >= 3 and hi > lo").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))).withColumn("cut", F.when(F.col("k") == cuts - 1, F.col("hi")).otherwise(F.col("lo") + F.col("k") * step))
    low = v <= F.col("cut")
    parted = trial.join(gaps.select(*by, value), list(by)).groupBy(*by, "k", "cut").agg(
        F.count_if(low).alias("n0"), F.count_if(~low).alias("n1"), F.avg(F.when(low, v)).alias("m0"), F.avg(F.when(~low, v)).alias("m1")
    )
    parted = parted.where("n0 > 0 and n1 > 0").withColumn("between", F.round(F.col("n0") * F.col("n1") * (F.col("m0") - F.col("m1")) ** 2, 6))
    best = parted.groupBy(*by).agg(F.max_by("cut", F.struct("between", -F.col("k"))).alias("best"))
    cut = F.when(F.col("n") < 3, F.col("hi") / 2).when(F.col("lo") == F.col("hi"), F.col("hi")).otherwise(F.col("best"))
    return stats.join(best, list(by), "left").select(*by, cut.alias("threshold"))


def words(ink: DataFrame) -> DataFrame:
    """Words of each one-line image: column runs parted at gaps over the image's
    own threshold."""
    cols = runs(line_sums(ink, "x"), "x", F.col("n_ink") > 0)
    w = Window.partitionBy(IMG).orderBy("start")
    cols = cols.withColumn("gap", F.col("start") - F.lag("end").over(w))
    cut = otsu_gaps(cols.where("gap is not null"), (IMG,))
    cols = cols.join(cut, IMG, "left").withColumn("__new", F.coalesce((F.col("gap") > F.col("threshold")).cast("int"), F.lit(0)))
    cols = cols.withColumn("word", F.sum("__new").over(w))
    return cols.groupBy(IMG, "word").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_runs"))


def column_profile(ink: DataFrame, n: int = 64) -> DataFrame:
    """Column sums resampled linearly to ``n`` places, divided by their peak."""
    sums = line_sums(ink, "x").select(IMG, "x", F.col("n_ink").cast("double").alias("v"))
    grid = sums.groupBy(IMG).agg(F.max("x").alias("last")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    grid = grid.withColumn("at", F.col("k") * F.col("last") / (n - 1)).withColumn("lo", F.floor("at")).withColumn("hi", F.least(F.ceil("at"), "last"))
    out = grid.join(sums.select(IMG, F.col("x").alias("lo"), F.col("v").alias("v0")), [IMG, "lo"]).join(sums.select(IMG, F.col("x").alias("hi"), F.col("v").alias("v1")), [IMG, "hi"])
    out = out.withColumn("v", F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("lo")))
    peak = F.max("v").over(Window.partitionBy(IMG))
    return out.select(IMG, "k", F.when(peak > 0, F.col("v") / peak).otherwise(0.0).alias("profile"))


def grow_to_blank(loose: DataFrame, boxes: DataFrame, pad: int = 0) -> DataFrame:
    """Grows each box to the first blank line of the loose mask: up and down
    within its columns, then left and right within its new rows. A box meets the
    ink by equal lines."""
    key = [IMG, "region"]
    size = loose.groupBy(IMG).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    b = boxes.select(*key, "x0", "y0", "x1", "y1").join(size, IMG)
    ink = loose.where("ink").select(IMG, "y", "x")

    def side(b, pos, lo, hi, across, a0, a1, extent):
        over = b.select(*key, F.explode(F.sequence(F.col(a0), F.col(a1) - 1)).alias(across))
        inked = over.join(ink, [IMG, across]).select(*key, pos).distinct()
        blank = b.select(*key, lo, hi, F.explode(F.sequence(F.lit(0), F.col(extent) - 1)).alias(pos)).join(inked, [*key, pos], "left_anti")
        ends = blank.groupBy(*key).agg((F.max(F.when(F.col(pos) < F.col(lo), F.col(pos))) + 1).alias("n0"), F.min(F.when(F.col(pos) >= F.col(hi), F.col(pos))).alias("n1"))
        b = b.join(ends, key, "left").withColumn(lo, F.greatest(F.lit(0), F.coalesce("n0", F.lit(0)) - pad))
        return b.withColumn(hi, F.least(extent, F.coalesce("n1", F.col(extent)) + pad)).drop("n0", "n1")

    b = side(b, "y", "y0", "y1", "x", "x0", "x1", "h")
    b = side(b, "x", "x0", "x1", "y", "y0", "y1", "w")
    return b.select(*key, "x0", "y0", "x1", "y1")


def region_kind(w_mm: Column, h_mm: Column, band: Column | None = None, invert: Column | None = None) -> Column:
    """BAND for bands, INK for inverted regions, then TEXT under 6 mm high, MARK
    under 60 by 40 mm, else ART."""
    kind = F.when(h_mm < 6, "TEXT").when((w_mm < 60) & (h_mm < 40), "MARK").otherwise("ART")
    none = F.lit(False)
    return F.when(none if band is None else band, "BAND").when(none if invert is None else invert, "INK").otherwise(kind)


def name_regions(regions: DataFrame) -> DataFrame:
    """Names of a two-digit counter to each kind, from the top and left; what is
    traced of a band has a name and kind of its own."""
    w = Window.partitionBy(IMG, "kind").orderBy("y0", "x0", "x1", "y1")
    out = regions.withColumn("name", F.format_string("%s%02d", F.lower("kind"), F.row_number().over(w)))
    band = F.col("kind") == "BAND"
    return out.withColumn("trace_name", F.when(band, F.concat("name", F.lit("_ink"))).otherwise(F.col("name"))).withColumn("trace_kind", F.when(band, "INK").otherwise(F.col("kind")))


def auto_partition(
    px: DataFrame,
    edge_gray: int = 200,
    threshold: int = 128,
    min_ink: int = 4,
    gap: int = 6,
    least: int = 6,
    band_median: int = 128,
    band_rows: int = 10,
    column_gap: float = 0.05,
    split: bool = True,
    stripped: bool = True,
) -> DataFrame:
    """Regions of a page: (image_id, region, kind, inverted, x0, y0, x1, y1).

    Row bands of the stripped ink are parted where the row median turns dark. A
    dark stretch of ``band_rows`` rows that bleeds over every column is a band;
    other stretches of ``least`` rows are content, one region to each column
    segment, grown to the first blank lines of the loose mask.
    """
    from inkframe.operators.raster import row_medians, strip_residue

    raw = binarise(px, threshold)
    size = px.groupBy(IMG).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    loose = binarise(px, edge_gray)
    ink = raw
    if stripped:
        cut = strip_residue(raw).join(size, IMG)
        inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("w") - F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("h") - F.col("bottom"))
        ink, loose = (m.join(cut, IMG).withColumn("ink", F.col("ink") & inside).select(px.columns + ["ink"]) for m in (raw, loose))
    bands = row_bands(ink, min_ink, gap, least).withColumnRenamed("start", "b0").withColumnRenamed("end", "b1")
    rows = row_medians(px).join(bands, IMG).where((F.col("y") >= F.col("b0")) & (F.col("y") < F.col("b1")))
    rows = rows.withColumn("dark", F.col("median_gray") < band_median)
    stretches = runs(rows, "y", F.lit(True), (IMG, "b0", "dark"))
    by_row = lambda s: s.withColumn("y", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    across = by_row(stretches).join(raw.where("ink").select(IMG, "y", "x"), [IMG, "y"])
    across = across.groupBy(IMG, "start", "end").agg(F.count_distinct("x").alias("n_cols"), F.min("x").alias("r0"), (F.max("x") + 1).alias("r1"))
    stretches = stretches.join(size, IMG).join(across, [IMG, "start", "end"], "left").withColumn("len", F.col("end") - F.col("start"))
    is_band = F.col("dark") & (F.col("len") >= band_rows) & F.coalesce(F.col("n_cols") == F.col("w"), F.lit(False))
    stretches = stretches.withColumn("is_band", is_band)
    solid = stretches.where("is_band").select(IMG, F.lit("BAND").alias("kind"), F.lit(True).alias("inverted"), F.col("r0").cast("int").alias("x0"), F.col("start").alias("y0"), F.col("r1").cast("int").alias("x1"), F.col("end").alias("y1"))

    content = stretches.where((~F.col("is_band")) & (F.col("len") >= least)).select(IMG, "start", "end", "w")
    inked = by_row(content).join(ink.where("ink").select(IMG, "y", "x"), [IMG, "y"])
    sums = inked.groupBy(IMG, "start", "end", "w", "x").agg(F.count(F.lit(1)).alias("n_ink")).where(F.col("n_ink") >= min_ink)
    sums = sums.select(IMG, F.col("start").alias("c0"), F.col("end").alias("c1"), "w", "x")
    by = (IMG, "c0", "c1", "w")
    segs = runs(sums, "x", F.lit(True), by)
    if split:
        segs = merge_runs(segs, F.greatest(F.lit(3), F.bround(F.col("w") * column_gap).cast("int")), least, by)
    else:
        segs = segs.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    boxes = segs.select(IMG, F.concat_ws(",", "c0", "start").alias("region"), F.col("start").alias("x0"), F.col("c0").alias("y0"), F.col("end").alias("x1"), F.col("c1").alias("y1"))
    grown = grow_to_blank(loose, boxes).select(IMG, F.lit("CONTENT").alias("kind"), F.lit(False).alias("inverted"), "x0", "y0", "x1", "y1")
    return solid.unionByName(grown)


def layer_index(layers: DataFrame, order: list) -> DataFrame:
    """``name`` with a two-digit index in front unless it has one."""
    n = F.row_number().over(Window.partitionBy("page_no").orderBy(*order))
    has = F.col("layer").rlike(r"^\d+_")
    return layers.withColumn("name", F.when(has, F.col("layer")).otherwise(F.format_string("%02d_%s", n, F.col("layer"))))


def unique_names(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Repeats of a name get _2, _3 and so on, the first that is still free; a
    null stays null. Names can collide only within a stem (the name without
    numbers at its end): a stem of one name is numbered by a window alone, one of
    several has its names given in turn, where each name goes on from its last number."""
    key, columns = [*by, "__stem"], rows.columns
    stem = Window.partitionBy(*key)
    numbered = rows.withColumn("__stem", F.regexp_replace("base", r"(_\d+)+$", ""))
    numbered = numbered.withColumn("__n", F.row_number().over(stem.orderBy(*[F.col(c).asc_nulls_last() for c in order])))
    numbered = numbered.withColumn("__mixed", F.coalesce(F.min("base").over(stem) < F.max("base").over(stem), F.lit(False)))
    name = F.when(F.col("__n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), "__n"))
    plain = numbered.where(~F.col("__mixed")).select(*columns, name.alias("name"))

    def run(table):
        table = table.sort_by("__n")
        used, after, names = set(), {}, []
        for base in table["base"].to_pylist():
            name, n = base, after.get(base, 2)
            while name in used:
                name, n = f"{base}_{n}", n + 1
            used.add(name)
            after[base] = n
            names.append(name)
        return table.select(columns).append_column("name", pa.array(names, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", name string"
    return plain.unionByName(numbered.where("__mixed").groupBy(*key).applyInArrow(run, schema))


def glyph_heights(ink: DataFrame, segments: DataFrame) -> DataFrame:
    """Height of the ink within each column run: columns are summed up first and
    meet the runs by equal columns."""
    cols = ink.where("ink").groupBy(IMG, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    s = segments.select(IMG, "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("x")).join(cols, [IMG, "x"])
    return s.groupBy(IMG, "start", "end").agg((F.max("hi") - F.min("lo") + 1).alias("height"))
