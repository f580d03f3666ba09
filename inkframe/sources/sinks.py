"""Artefacts that are written: paths, manifests, region lists, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def svg(paths: DataFrame) -> DataFrame:
    """One even-odd SVG for each traced path."""
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %d %d">', F.col("width"), F.col("height"))
    return paths.select("image_id", F.concat(head, F.lit('<path fill-rule="evenodd" d="'), F.col("path"), F.lit('"/></svg>')).alias("svg"))


def write_svgs(paths: DataFrame, folder: str) -> None:
    """A text file to each image, in folders by id."""
    svg(paths).repartition("image_id").write.partitionBy("image_id").text(folder)


def write_json(rows: DataFrame, folder: str, by: list[str] | None = None) -> None:
    """Committed as a whole, never over an earlier result."""
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).json(folder)


def manifest(regions: DataFrame, page: dict, params: dict) -> DataFrame:
    """One JSON record: the page, the parameters and the regions by name."""
    names = [c for c in regions.columns if c != "name"]
    # The regions of one page: some hundreds at most.
    entries = regions.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct(*names))))).alias("regions"))
    return entries.select(*[F.lit(v).alias(k) for k, v in page.items()], F.struct(*[F.lit(v).alias(k) for k, v in params.items()]).alias("params"), "regions")


def placement(items: DataFrame, mm_per_px: float, page_h_mm: float) -> DataFrame:
    """Where each region goes: millimetres, y upwards from the page's foot."""
    mm = lambda c: F.col(c) * mm_per_px
    return items.select(
        "name", F.upper("kind").alias("layer"), mm("x0").alias("x"), (page_h_mm - mm("y1")).alias("y"), ((F.col("x1") - F.col("x0")) * mm_per_px).alias("w"), ((F.col("y1") - F.col("y0")) * mm_per_px).alias("h")
    )


def actions(verdicts: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with each converted region: create its live text, skip it, or
    replace what stands there if it is off by no more than 0.05 mm."""
    both = verdicts.where("convert").join(existing.select("name", "max_error"), "name", "left")
    what = F.when(F.col("max_error").isNull(), "create").when(F.col("max_error") <= 0.05, "replace").otherwise("skip_existing")
    return both.select("name", what.alias("action"))


def live_region_lines(texts: DataFrame, w: int, h: int, pad: int = 2, include_suspect: bool = False) -> DataFrame:
    """``name=y0,y1,x0,x1[,colour][,rot=180]``, padded within the image."""
    t = texts if include_suspect else texts.where(~F.col("suspect"))
    box = F.concat_ws(",", F.greatest(F.lit(0), F.col("y0") - pad), F.least(F.lit(h), F.col("y1") + pad), F.greatest(F.lit(0), F.col("x0") - pad), F.least(F.lit(w), F.col("x1") + pad))
    rot = F.when(F.col("rot") != 0, F.concat(F.lit("rot="), F.col("rot").cast("string")))
    return t.select(F.concat(F.col("name"), F.lit("="), F.concat_ws(",", box, F.col("color"), rot)).alias("line"))


def trace_region_lines(blocks: DataFrame) -> DataFrame:
    """``name:x0,y0,x1,y1[,invert][,colour]``."""
    box = F.concat_ws(",", "x0", "y0", "x1", "y1", F.when(F.col("invert"), "invert"), "color")
    return blocks.select(F.concat(F.col("name"), F.lit(":"), box).alias("line"))


def metrics(scores: DataFrame, overall: DataFrame) -> DataFrame:
    """One JSON record of overall and per-region metrics; no row where no region
    has any, so that nothing is written over an earlier result."""
    names = [c for c in scores.columns if c != "name"]
    # The regions of one page: some hundreds at most.
    by_name = scores.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct(*names))))).alias("regions"), F.count(F.lit(1)).alias("n"))
    return overall.select(F.struct(*overall.columns).alias("overall")).join(by_name.where("n > 0").drop("n"))


def convert_only(scan: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The texts of a scan whose regions are converted to live text."""
    return scan.join(verdicts.where("convert").select("name"), "name", "left_semi")


def structural_report(diff: DataFrame, types: DataFrame) -> DataFrame:
    """PASS, or WARN and how many layers and types differ between two documents."""
    layers = diff.agg(F.count_if(F.col("status") != "equal").alias("layers_off"))
    both = layers.join(types.agg(F.count(F.lit(1)).alias("types_off")))
    return both.select(F.when((F.col("layers_off") == 0) & (F.col("types_off") == 0), "PASS").otherwise("WARN").alias("status"), "layers_off", "types_off")


def run_log(steps: list[tuple[str, float, str]]) -> str:
    """One line a step: its name, seconds and what came of it."""
    return "\n".join(f"{name}\t{seconds:.1f}\t{outcome}" for name, seconds, outcome in steps)


def report(metrics: DataFrame) -> str:
    """A markdown report of a small table of metrics by region."""
    rows = metrics.orderBy("name").collect()
    head = ["name", *[c for c in metrics.columns if c != "name"]]
    line = lambda xs: "| " + " | ".join("unknown" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([line(head), "|" + " --- |" * len(head), *[line([r[c] for c in head]) for r in rows]])


def report_json(metrics: DataFrame) -> str:
    """The same as JSON; what is not known is null."""
    return json.dumps([r.asDict(recursive=True) for r in metrics.orderBy("name").collect()], ensure_ascii=False, indent=2)
