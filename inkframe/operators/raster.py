"""Pixel relations: predicates, aggregates and thresholds per image.

Inputs are pixel(image_id, y, x, gray); all groupings start with ``image_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMG = "image_id"


def binarise(px: DataFrame, threshold: int = 128, invert: bool = False) -> DataFrame:
    """Appends ``ink``: strictly darker (inverted: strictly lighter) than the threshold."""
    gray = F.col("gray")
    return px.withColumn("ink", gray > threshold if invert else gray < threshold)


def region_slice(px: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The pixels of a half-open box, counted from its corner."""
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    return px.where(inside).withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def pixel_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many pixels of each image are in both relations."""
    both = a.select(IMG, "y", "x").join(b.select(IMG, "y", "x"), [IMG, "y", "x"])
    return both.groupBy(IMG).agg(F.count(F.lit(1)).alias("n_both"))


def polarity_ink(px: DataFrame, threshold: int = 128) -> DataFrame:
    """Dark ink, turned round in images where it covers over half."""
    dark = F.col("gray") < threshold
    share = F.avg(dark.cast("int")).over(Window.partitionBy(IMG))
    return px.withColumn("ink", F.when(share > 0.5, ~dark).otherwise(dark))


def coverage(gray: Column, level: Column | int) -> Column:
    """Share of ink in a pixel: white 0, ``level`` 1; all 0 for levels from 254."""
    level = F.lit(level) if isinstance(level, int) else level
    part = (255 - gray) / F.nullif(255 - level, F.lit(0))
    return F.when(level >= 254, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))


def ink_level(px: DataFrame, by: tuple[str, ...] = (IMG,), near_white: int = 250) -> DataFrame:
    """The first percentile of the grays below near white; 0 where there are none."""
    level = F.percentile(F.when(F.col("gray") < near_white, F.col("gray")), F.lit(0.01))
    return px.groupBy(*by).agg(F.coalesce(level, F.lit(0.0)).alias("ink_level"))


def line_sums(ink: DataFrame, axis: str) -> DataFrame:
    """Ink pixels of every row (axis "y") or column ("x"), empty lines included."""
    return ink.groupBy(IMG, axis).agg(F.count_if("ink").alias("n_ink"), F.count(F.lit(1)).alias("n"))


def row_medians(px: DataFrame) -> DataFrame:
    return px.groupBy(IMG, "y").agg(F.median("gray").alias("median_gray"))


def histogram(px: DataFrame) -> DataFrame:
    """All 256 bins of every image: empty ones too."""
    bins = px.select(IMG).distinct().withColumn("gray", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return bins.join(px.groupBy(IMG, "gray").agg(F.count(F.lit(1)).alias("n")), [IMG, "gray"], "left").na.fill(0, ["n"])


def cumulative(hist: DataFrame) -> DataFrame:
    upto = Window.partitionBy(IMG).orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("n_upto", F.sum("n").over(upto)).withColumn("sum_upto", F.sum(F.col("n") * F.col("gray")).over(upto))


def otsu(px: DataFrame, degenerate: int = 128) -> DataFrame:
    """The gray that parts each image best (greatest between-class variance),
    the middle of the plateau of equally good ones; ink is strictly below."""
    c = cumulative(histogram(px))
    every = Window.partitionBy(IMG)
    n, s = F.max("n_upto").over(every), F.max("sum_upto").over(every)
    w0, s0 = F.col("n_upto").cast("double"), F.col("sum_upto").cast("double")
    gap = F.try_divide(s0, w0) - F.try_divide(s - s0, n - w0)
    c = c.withColumn("between", F.when((w0 > 0) & (n - w0 > 0), w0 * (n - w0) * gap * gap))
    c = c.withColumn("best", F.max("between").over(every))
    top = c.where((F.col("best") > 0) & (F.col("between") >= F.col("best") * (1 - 1e-12)))
    cut = top.groupBy(IMG).agg(F.expr("(min(gray) + max(gray) + 2) div 2").alias("cut"))
    return px.select(IMG).distinct().join(cut, IMG, "left").select(IMG, F.coalesce("cut", F.lit(degenerate)).cast("long").alias("threshold"))


def bounds(ink: DataFrame, by: tuple[str, ...] = (IMG,)) -> DataFrame:
    """Half-open tight box of the ink; groups without any give no row."""
    return ink.where("ink").groupBy(*by).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")
    )


def box_mm(boxes: DataFrame, mm_per_px: float) -> DataFrame:
    return boxes.select("*", *[(F.col(c) * mm_per_px).alias(f"{c}_mm") for c in ("x0", "y0", "x1", "y1")])


def leading(lines: DataFrame, axis: str, ok: Column) -> DataFrame:
    """How many leading lines satisfy ``ok``: the index of the first that doesn't."""
    return lines.groupBy(IMG).agg(F.coalesce(F.min(F.when(~ok, F.col(axis))), F.max(axis) + 1).cast("long").alias("n_leading"))


def strip_residue(ink: DataFrame, least: float = 0.9) -> DataFrame:
    """Lines taken off each side while their mean ink exceeds ``least``: left
    and right over whole columns, then top and bottom over what is left."""
    cols = ink.groupBy(IMG, "x").agg(F.avg(F.col("ink").cast("int")).alias("m"))
    free_x = F.when(F.col("m") <= least, F.col("x"))
    cut = cols.groupBy(IMG).agg(
        (F.max("x") + 1).alias("w"), F.coalesce(F.min(free_x), F.max("x") + 1).alias("left"), F.coalesce(F.max(free_x) + 1, F.min("x")).alias("right_at")
    )
    cut = cut.select(IMG, "left", F.greatest(F.col("left"), F.col("right_at")).alias("right_at"), "w")
    kept = ink.join(cut, IMG).where((F.col("x") >= F.col("left")) & (F.col("x") < F.col("right_at")))
    rows = kept.groupBy(IMG, "y").agg(F.avg(F.col("ink").cast("int")).alias("m"))
    free_y = F.when(F.col("m") <= least, F.col("y"))
    rows = rows.groupBy(IMG).agg(
        (F.max("y") + 1).alias("h"), F.coalesce(F.min(free_y), F.max("y") + 1).alias("top"), F.coalesce(F.max(free_y) + 1, F.min("y")).alias("bottom_at")
    )
    rows = rows.select(IMG, "top", (F.col("h") - F.greatest("top", "bottom_at")).alias("bottom"))
    return cut.join(rows, IMG, "left").select(
        IMG, "left", (F.col("w") - F.col("right_at")).alias("right"), F.coalesce("top", F.lit(0)).alias("top"), F.coalesce("bottom", F.lit(0)).alias("bottom")
    )


def compact_columns(ink: DataFrame, share: float = 0.9) -> DataFrame:
    """Drops columns inked over ``share`` of the height and closes the gaps;
    images of such columns alone stay whole."""
    cols = ink.groupBy(IMG, "x").agg(F.avg(F.col("ink").cast("int")).alias("m"))
    w = Window.partitionBy(IMG)
    cols = cols.withColumn("keep", (F.col("m") < share) | (F.min("m").over(w) >= share)).where("keep")
    cols = cols.select(IMG, "x", (F.row_number().over(w.orderBy("x")) - 1).alias("new_x"))
    return ink.join(cols, [IMG, "x"]).drop("x").withColumnRenamed("new_x", "x")


def full_bleed(ink: DataFrame) -> DataFrame:
    """Whether every column has ink."""
    return ink.groupBy(IMG).agg((F.count_distinct(F.when(F.col("ink"), F.col("x"))) == F.count_distinct("x")).alias("full_bleed"))


def edge_probe(px: DataFrame, dark: int = 128) -> DataFrame:
    """Mean gray of the four sides (truncated) and the leading dark columns."""
    w = Window.partitionBy(IMG)
    p = px.withColumn("w", F.max("x").over(w)).withColumn("h", F.max("y").over(w))
    side = lambda cond: F.avg(F.when(cond, F.col("gray"))).cast("long")
    sides = p.groupBy(IMG).agg(
        side(F.col("x") == 0).alias("left"), side(F.col("x") == F.col("w")).alias("right"), side(F.col("y") == 0).alias("top"), side(F.col("y") == F.col("h")).alias("bottom")
    )
    cols = px.groupBy(IMG, "x").agg(F.avg("gray").alias("m"))
    return sides.join(leading(cols, "x", F.col("m") < dark).withColumnRenamed("n_leading", "dark_columns"), IMG)


def box_filter(px: DataFrame, ss: int) -> DataFrame:
    """Means over blocks of ``ss`` by ``ss`` pixels."""
    return px.groupBy(IMG, F.expr(f"y div {ss}").alias("y"), F.expr(f"x div {ss}").alias("x")).agg(F.avg("gray").alias("gray"))


def percent(part: Column, whole: Column) -> Column:
    """Hundredfold ratio; of nothing, 100."""
    return F.when(whole == 0, 100.0).otherwise(part * 100.0 / whole)


def fidelity(pairs: DataFrame) -> DataFrame:
    """recall, precision and IoU of pixel masks ``a`` (source) and ``b``."""
    both, a, b = F.count_if(F.col("a") & F.col("b")), F.count_if("a"), F.count_if("b")
    sums = pairs.groupBy(IMG).agg(both.alias("n_both"), a.alias("n_a"), b.alias("n_b"))
    either = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return sums.select(
        "*", percent(F.col("n_both"), F.col("n_a")).alias("recall"), percent(F.col("n_both"), F.col("n_b")).alias("precision"), percent(F.col("n_both"), either).alias("iou")
    )


def soft_fidelity(pairs: DataFrame) -> DataFrame:
    """Soft IoU and ink ratio of two coverages ``a`` (source) and ``b``."""
    sums = pairs.groupBy(IMG).agg(F.sum(F.least("a", "b")).alias("low"), F.sum(F.greatest("a", "b")).alias("high"), F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    return sums.select(IMG, percent(F.col("low"), F.col("high")).alias("soft"), F.when(F.col("sa") == 0, 1.0).otherwise(F.col("sb") / F.col("sa")).alias("ink_ratio"))


def overlay(pairs: DataFrame) -> DataFrame:
    """Class of each pixel of two masks: both, source, render or none."""
    kind = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "source").when(F.col("b"), "render").otherwise("none")
    return pairs.withColumn("overlay", kind)
