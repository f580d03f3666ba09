"""Inks of colour rasters: pixel(image_id, y, x, r, g, b)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.operators.boxes import BOX, pixels_in_boxes
from inkframe.operators.raster import IMG

WHITE = (255, 255, 255)


def hex_rgb(text: Column) -> Column:
    """STRUCT<r,g,b> of rgb or rrggbb, with or without ``#``; other texts raise."""
    body = F.regexp_extract(F.trim(text), "^#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})$", 1)
    full = F.when(F.length(body) == 3, F.regexp_replace(body, "(.)", "$1$1")).otherwise(body)
    part = lambda i: F.conv(F.substring(full, 1 + 2 * i, 2), 16, 10).cast("int")
    value = F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))
    return F.when(F.length(body) > 0, value).otherwise(F.raise_error(F.concat(F.lit("no colour: "), text)))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def luma(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601 gray, in whole numbers."""
    return F.shiftright((r * 19595 + g * 38470 + b * 7471 + 32768).cast("long"), 16).cast("int")


def background(px: DataFrame) -> DataFrame:
    """The most frequent exact colour; of equals the smallest."""
    n = px.groupBy(IMG, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(IMG).orderBy(F.desc("n"), "r", "g", "b")
    return n.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def labels(px: DataFrame, palette: list[tuple[int, int, int]], origin: tuple[int, int, int] = WHITE, cut: float | None = 0.5**0.5) -> DataFrame:
    """``label``, the palette colour whose direction from ``origin`` is nearest
    (the first of equals), and ``cov``, how far along it the pixel lies. A pixel
    at the origin, or with a cosine under ``cut``, is background: label -1 (with
    no cut: label 0), coverage 0."""
    d = [F.col(c).cast("double") - o for c, o in zip("rgb", origin, strict=True)]
    size2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    toward, along = [], []  # length of the pixel's shadow on each ink's direction; the same by the ink's own length
    for ink in palette:
        v = np.array(ink, float) - origin
        n = float(np.linalg.norm(v))
        dot = d[0] * float(v[0]) + d[1] * float(v[1]) + d[2] * float(v[2])
        toward.append(F.round(dot / n, 6))
        along.append(dot / (n * n))
    px = px.withColumns({"__size2": size2, **{f"__t{i}": t for i, t in enumerate(toward)}, **{f"__a{i}": a for i, a in enumerate(along)}})
    toward, along = ([F.col(f"__{k}{i}") for i in range(len(palette))] for k in "ta")
    best = F.greatest(*toward) if len(toward) > 1 else toward[0]
    label, cov = F.lit(None).cast("int"), F.lit(None).cast("double")
    for i in reversed(range(len(palette))):
        here = toward[i] == best
        label, cov = F.when(here, i).otherwise(label), F.when(here, along[i]).otherwise(cov)
    ground = F.col("__size2") == 0
    if cut is not None:
        ground = ground | (best < cut * F.sqrt("__size2"))
    cov = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cov))
    return px.withColumn("label", F.when(ground, 0 if cut is None else -1).otherwise(label)).withColumn("cov", F.when(ground, 0.0).otherwise(cov)).drop("__size2", *[f"__{k}{i}" for k in "ta" for i in range(len(palette))])


def ink_gray(labelled: DataFrame, label: int, gray: Column) -> DataFrame:
    """The gray of one ink's pixels; others white."""
    return labelled.withColumn("gray", F.when(F.col("label") == label, gray).otherwise(255))


def ink_mask(label: int, least: float = 0.5) -> Column:
    return (F.col("label") == label) & (F.col("cov") >= least)


def palette_check(labelled: DataFrame, palette: list[tuple[int, int, int]], tolerance: int = 12) -> DataFrame:
    """The most frequent colour of each ink, and whether its channels lie within
    ``tolerance`` of the palette's."""
    n = labelled.where("label >= 0").groupBy(IMG, "label", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(IMG, "label").orderBy(F.desc("n"), "r", "g", "b")
    top = n.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    want = F.array(*[F.array(*map(F.lit, ink)) for ink in palette])
    off = [F.abs(F.col(c) - F.element_at(F.element_at(want, F.col("label") + 1), i + 1)) for i, c in enumerate("rgb")]
    return top.withColumn("max_diff", F.greatest(*off)).withColumn("ok", F.col("max_diff") <= tolerance)


def band_colour(px: DataFrame, by: tuple[str, ...] = (IMG,), dark: int = 128) -> DataFrame:
    """Median of each channel over the pixels whose mean is under ``dark``, or
    over all of them where none is; halves round to even."""
    low = F.col("r") + F.col("g") + F.col("b") < 3 * dark
    mid = px.groupBy(*by).agg(*[F.coalesce(F.median(F.when(low, F.col(c))), F.median(c)).alias(c) for c in "rgb"])
    return mid.select(*by, *[F.bround(c).cast("long").alias(c) for c in "rgb"])


def dominant(labelled: DataFrame, boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """The ink with most half-covered pixels in each box; of equals the first.
    Pixels meet boxes by grid cells."""
    ink = labelled.where((F.col("label") >= 0) & (F.col("cov") >= least)).select(IMG, "y", "x", "label")
    n = pixels_in_boxes(ink, boxes.select(IMG, "box", *BOX)).groupBy(IMG, "box", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(IMG, "box").orderBy(F.desc("n"), "label")
    return n.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def direction_table(px: DataFrame, least_share: float, least_distance: float, least_count: int) -> DataFrame:
    """The colours that may be inks: at least ``least_count`` pixels and
    ``least_distance`` of the farthest colour's distance from the background, each
    with that distance, its unit direction and the pixels that an ink needs."""
    hist = px.groupBy(IMG, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    ground = background(px).select(IMG, *[F.col(c).alias(f"b{c}") for c in "rgb"])
    d = [F.col(c) - F.col(f"b{c}") for c in "rgb"]
    far = hist.join(ground, IMG).withColumn("dist", F.sqrt(sum((x * x for x in d), F.lit(0)).cast("double")))
    far = far.withColumn("farthest", F.max("dist").over(Window.partitionBy(IMG)))
    live = far.where((F.col("dist") > 0) & (F.col("dist") >= least_distance * F.col("farthest")) & (F.col("n") >= least_count))
    need = F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy(IMG)) * least_share))
    return live.select(IMG, "r", "g", "b", "n", "dist", *[(x / F.col("dist")).alias(f"d{c}") for c, x in zip("rgb", d, strict=True)], need.alias("need"))


def cones(table, most: int, cosine: float):
    """Inks of one image's ``direction_table``: the farthest colour left spans a
    cone. One with enough pixels is an ink (its most frequent colour among those
    in the outer 15 % of its distances) and leaves the table; else only its tip
    leaves. Ties go to the smaller colour."""
    left = table.sort_values(["dist", "r", "g", "b"], ascending=[False, True, True, True])
    found = 0
    while len(left) and found < most:
        tip = left.iloc[0]
        inside = sum(left[f"d{c}"] * tip[f"d{c}"] for c in "rgb") > cosine
        cone = left[inside]
        if cone["n"].sum() < tip["need"]:
            left = left.iloc[1:]
            continue
        outer = cone[cone["dist"] >= 0.85 * tip["dist"]].sort_values(["n", "r", "g", "b"], ascending=[False, True, True, True])
        yield (found, *(int(outer.iloc[0][c]) for c in "rgb"), int(cone["n"].sum()))
        found, left = found + 1, left[~inside]


def detect_palette(px: DataFrame, most: int = 6, least_share: float = 0.01, cosine: float = 0.995, least_distance: float = 0.05, least_count: int = 15) -> DataFrame:
    """Inks of each image: cones of directions from its background. What may be
    an ink is a DataFrame aggregate; the cones, whose order matters, are formed
    on each image's few colours."""

    def run(table):
        import pandas as pd

        return pd.DataFrame([(int(table[IMG].iloc[0]), *ink) for ink in cones(table, most, cosine)], columns=[IMG, "ink", "r", "g", "b", "n"])

    table = direction_table(px, least_share, least_distance, least_count)
    return table.groupBy(IMG).applyInPandas(run, f"{IMG} long, ink int, r int, g int, b int, n long")
