"""Box relations: overlap joins, suppression, erasing, snapping.

Boxes are half-open: box(image_id, ..., x0, y0, x1, y1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.operators.raster import IMG

BOX = ("x0", "y0", "x1", "y1")


def quad_box(quad: Column) -> Column:
    """The box around a quad, an array of STRUCT<x,y>."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def flip_box(w: Column, h: Column) -> list[Column]:
    """The box in the image turned by 180 degrees."""
    return [(w - F.col("x1")).alias("x0"), (h - F.col("y1")).alias("y0"), (w - F.col("x0")).alias("x1"), (h - F.col("y0")).alias("y1")]


def iou(a: str, b: str) -> Column:
    """IoU of two boxes with column prefixes; 0 for disjoint or empty ones."""
    c = lambda p, n: F.col(f"{p}{n}").cast("double")
    iw = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    ih = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "y1") - c(p, "y0"))
    return F.coalesce(F.try_divide(iw * ih, area(a) + area(b) - iw * ih), F.lit(0.0))


def _cells(boxes: DataFrame, cell: int) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.greatest(F.col(hi), F.col(lo) + 1) - 1) / cell))
    return boxes.withColumn("__cx", F.explode(span("x0", "x1"))).withColumn("__cy", F.explode(span("y0", "y1")))


def overlaps(left: DataFrame, right: DataFrame, cell: int = 64) -> DataFrame:
    """Overlapping pairs of boxes with their IoU; the sides' columns get the
    prefixes ``a_`` and ``b_``. Boxes are dealt to grid cells and joined by equal
    cells; a pair is taken in the cell of its intersection's corner alone."""
    a = _cells(left.select(IMG, *[F.col(c).alias(f"a_{c}") for c in left.columns if c != IMG], *BOX), cell).drop(*BOX)
    b = _cells(right.select(IMG, *[F.col(c).alias(f"b_{c}") for c in right.columns if c != IMG], *BOX), cell).drop(*BOX)
    met = a.join(b, [IMG, "__cx", "__cy"])
    corner = (F.col("__cx") == F.floor(F.greatest("a_x0", "b_x0") / cell)) & (F.col("__cy") == F.floor(F.greatest("a_y0", "b_y0") / cell))
    meet = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    return met.where(corner & meet).drop("__cx", "__cy").withColumn("iou", iou("a_", "b_"))


def _in_turn(boxes: DataFrame, schema: str, judge) -> DataFrame:
    """Hands ``judge`` each image's rows in order (``rot``, if there, then by
    falling score, seq and part) and takes the rows that it gives for them. An
    image's rows are side by side in one task, which holds one image at a time."""
    order = [*(["rot"] if "rot" in boxes.columns else []), F.desc("score"), "seq", "part"]
    dealt = boxes.repartition(IMG).sortWithinPartitions(IMG, *order)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pandas as pd

        held, image = [], None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if row[0] != image:
                    out += judge(held)
                    held, image = [], row[0]
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(judge(held), columns=names)

    return dealt.mapInPandas(run, schema)


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    either = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / either if either > 0 else 0.0


def merge_detections(boxes: DataFrame, most: float = 0.5) -> DataFrame:
    """Greedy suppression: by falling score a box stays if its IoU with all kept
    ones is ``most`` or less; else it joins the ``also`` of the first kept box
    that it overlaps so. One row a kept box. The order decides, so each image's
    boxes are taken in turn."""

    def judge(rows):
        kept = []
        for image, seq, part, *box, score in rows:
            over = next((k for k in kept if _iou(k[3:7], box) > most), None)
            if over:
                over[-1].append(seq)
            else:
                kept.append((image, seq, part, *box, score, []))
        return kept

    schema = f"{IMG} long, seq int, part long, x0 int, y0 int, x1 int, y1 int, score long, also array<int>"
    return _in_turn(boxes.select(IMG, "seq", "part", *BOX, "score"), schema, judge)


def merge_rotated(upright: DataFrame, rotated: DataFrame, most: float = 0.3) -> DataFrame:
    """Upright hits, and by falling score those rotated ones that overlap no kept
    hit by more than ``most``; the kept set grows."""
    cols = [IMG, "seq", "part", *BOX, "score"]
    both = upright.select(*cols, F.lit(0).alias("rot")).unionByName(rotated.select(*cols, F.lit(180).alias("rot")))

    def judge(rows):
        kept = []
        for row in rows:
            if not row[-1] or all(_iou(k[3:7], row[3:7]) <= most for k in kept):
                kept.append(row)
        return kept

    return _in_turn(both, f"{IMG} long, seq int, part long, x0 int, y0 int, x1 int, y1 int, score long, rot int", judge)


def pixels_in_boxes(px: DataFrame, boxes: DataFrame, cell: int = 32) -> DataFrame:
    """Every pixel in every box it lies in: a pixel has one grid cell, a box all
    that it touches, and the two meet by equal cells. Ends are not in a box."""
    at = px.withColumn("__cx", F.floor(F.col("x") / cell)).withColumn("__cy", F.floor(F.col("y") / cell))
    met = at.join(_cells(boxes, cell), [IMG, "__cx", "__cy"])
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return met.where(inside).drop("__cx", "__cy")


def _semi(points: DataFrame, boxes: DataFrame, x: Column, y: Column, grown: dict[str, Column], inside, how: str, cell: int = 32) -> DataFrame:
    """Points that lie in some box (left_semi) or in none (left_anti), by cells."""
    p = points.withColumn("__x", x).withColumn("__y", y)
    p = p.withColumn("__pcx", F.floor(F.col("__x") / cell)).withColumn("__pcy", F.floor(F.col("__y") / cell))
    b = _cells(boxes.select(F.col(IMG).alias("__img"), *[grown[c].alias(c) for c in BOX]), cell).select("__img", "__cx", "__cy", *[F.col(c).alias(f"__{c}") for c in BOX])
    on = (F.col(IMG) == F.col("__img")) & (F.col("__pcx") == F.col("__cx")) & (F.col("__pcy") == F.col("__cy")) & inside
    return p.join(b, on, how).drop("__x", "__y", "__pcx", "__pcy")


def in_boxes(points: DataFrame, boxes: DataFrame, slack: int = 4) -> DataFrame:
    """Boxes whose centre lies within ``slack`` of some box of the other table,
    on its grown edges too."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    grown = {"x0": F.col("x0") - slack, "y0": F.col("y0") - slack, "x1": F.col("x1") + slack + 1, "y1": F.col("y1") + slack + 1}
    inside = (F.col("__x") >= F.col("__x0")) & (F.col("__x") <= F.col("__x1") - 1) & (F.col("__y") >= F.col("__y0")) & (F.col("__y") <= F.col("__y1") - 1)
    return _semi(points, boxes, cx, cy, grown, inside, "left_semi")


def erase(ink: DataFrame, boxes: DataFrame, pad: int = 2) -> DataFrame:
    """Ink pixels outside all boxes grown by ``pad`` (and one more at their ends)."""
    grown = {"x0": F.col("x0") - pad, "y0": F.col("y0") - pad, "x1": F.col("x1") + pad + 1, "y1": F.col("y1") + pad + 1}
    inside = (F.col("__x") >= F.col("__x0")) & (F.col("__x") < F.col("__x1")) & (F.col("__y") >= F.col("__y0")) & (F.col("__y") < F.col("__y1"))
    return _semi(ink.where("ink"), boxes, F.col("x"), F.col("y"), grown, inside, "left_anti")


def union_box(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy(IMG).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def unite(passes: list[DataFrame]) -> DataFrame:
    """Detections of several passes, each with the number of its pass."""
    out = None
    for k, rows in enumerate(passes):
        rows = rows.withColumn("pass", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def mask_union(masks: list[DataFrame]) -> DataFrame:
    """Pixels (image_id, y, x) that are in one mask at least."""
    out = None
    for m in masks:
        m = m.select(IMG, "y", "x")
        out = m if out is None else out.union(m)
    return out.distinct()


def floors(boxes: DataFrame, least_score: float = 0, least_ink: int = 24) -> DataFrame:
    """Detections with score and ink enough."""
    return boxes.where((F.col("score") >= least_score) & (F.col("ink") >= least_ink))


def off_target(max_error: Column, fine: float = 0.02, near: float = 0.05) -> dict[str, Column]:
    """Whether a placed box is right, and whether what stands there is the same
    box and may be replaced (millimetres)."""
    return {"ok": max_error < fine, "replace": max_error <= near}


def aspect_warning(w: Column, h: Column, page_w: Column, page_h: Column, most: float = 0.02) -> Column:
    """Whether the heights that the two aspects give a page differ by over ``most``."""
    return F.abs(w * page_h - h * page_w) > most * h * page_w


def aspect_warning_mm(w: Column, h: Column, page_w: Column, page_h: Column, most: float = 0.5) -> Column:
    """The same in millimetres of page height."""
    return F.abs(page_w * h / w - page_h) > most
