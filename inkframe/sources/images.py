"""Images and artefacts as relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.operators.colour import luma
from inkframe.operators.raster import IMG


def open_images(spark: SparkSession, path: str, page_w_mm: float | None = None, page_h_mm: float | None = None) -> DataFrame:
    """image(image_id, origin, width, height, n_channels, data, page_w_mm,
    page_h_mm, mm_per_px) of files that the built-in image source decodes. The
    id is a hash of the origin; a missing page height follows from the width."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    w = F.lit(page_w_mm).cast("double")
    scale = w / F.col("width")
    return raw.select(
        F.xxhash64("origin").alias(IMG), "origin", "width", "height", F.col("nChannels").alias("n_channels"), "data",
        w.alias("page_w_mm"), F.coalesce(F.lit(page_h_mm).cast("double"), F.col("height") * scale).alias("page_h_mm"), scale.alias("mm_per_px"),
    )


def pixels(images: DataFrame) -> DataFrame:
    """pixel(image_id, y, x, r, g, b, gray): rows of an image are exploded one by
    one, so a task holds a line of pixels at a time. Data is in BGR order."""
    rows = images.select(IMG, "width", "n_channels", F.posexplode(_lines("data", "height", "width", "n_channels")).alias("y", "line"))
    at = rows.select(IMG, "y", "n_channels", "line", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    c = lambda k: F.element_at("line", (F.col("x") * F.col("n_channels") + F.least(F.lit(k), F.col("n_channels") - 1) + 1).cast("int")).cast("int")
    out = at.select(IMG, "y", "x", c(2).alias("r"), c(1).alias("g"), c(0).alias("b"))
    return out.withColumn("gray", luma(F.col("r"), F.col("g"), F.col("b")))


def _lines(data: str, height: str, width: str, channels: str):
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for b, h, w, c in batches:
            out = []
            for x, n, m, k in zip(b.to_pylist(), h.to_pylist(), w.to_pylist(), c.to_pylist(), strict=True):
                out.append(list(np.frombuffer(x, np.uint8).reshape(n, m * k).astype(np.int16)))
            yield pa.array(out, pa.list_(pa.list_(pa.int16())))

    return F.arrow_udf(run, "array<array<smallint>>")(data, height, width, channels)


def crop_left(px: DataFrame, n: int, keep_last: bool = False) -> DataFrame:
    """Without the first ``n`` columns; the page keeps its scale. With
    ``keep_last`` an image's last column stays, however few it has."""
    if keep_last:
        last = px.groupBy(IMG).agg(F.least(F.lit(n), F.max("x")).alias("__cut"))
        return px.join(last, IMG).where("x >= __cut").withColumn("x", F.col("x") - F.col("__cut")).drop("__cut")
    return px.where(F.col("x") >= n).withColumn("x", F.col("x") - n)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artefact; fields that are missing are null, a bad or missing file
    gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


TEXT = "struct<text:string,score:double,box:array<int>,rot:int,suspect:boolean,color:string>"


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """detection(text, score, x0, y0, x1, y1, rot, suspect, color) of a scan; a
    scan without the field ``texts`` is an error."""
    scan = spark.read.schema(f"texts array<{TEXT}>").option("multiLine", True).json(path)
    texts = F.when(F.col("texts").isNull(), F.raise_error(F.lit("the scan has no field texts"))).otherwise(F.col("texts"))
    t = scan.select(F.explode(texts).alias("t"))
    box = [F.element_at("t.box", i + 1).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return t.select("t.text", "t.score", *box, F.coalesce("t.rot", F.lit(0)).alias("rot"), F.coalesce("t.suspect", F.lit(False)).alias("suspect"), "t.color")


def image_widths(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width) of PNG files, from their headers alone: nothing is decoded."""
    files = spark.read.format("binaryFile").load(path)
    number = F.conv(F.hex(F.expr("substring(content, 17, 4)")), 16, 10).cast("int")
    return files.where(F.hex(F.expr("substring(content, 2, 3)")) == "504E47").select(F.col("path").alias("origin"), number.alias("width"))


def find_first(spark: SparkSession, folders: list[str], pattern: str) -> DataFrame:
    """The first file by name of those that match, in the first folder with any;
    folders that are missing are passed over."""
    from pyspark.errors import AnalysisException

    found = spark.createDataFrame([], "rank int, path string")
    for rank, folder in enumerate(folders):
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        except AnalysisException:
            continue
        found = found.unionByName(files.select(F.lit(rank).alias("rank"), "path"))
    return found.agg(F.min(F.struct("rank", "path")).alias("f")).select("f.path").where("path is not null")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text without blank ones and those that start with ``#``."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.where((F.length("line") > 0) & ~F.startswith("line", F.lit("#")))


def font_files(spark: SparkSession, path: str) -> DataFrame:
    """font_file(path, file, family) of font files, their family by file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ttf,otf,ttc,TTF,OTF,TTC}").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file"), F.regexp_replace(name, r"(?i)[-_ ]?(regular|bold|italic|light|medium)*\.[^.]+$", "").alias("family"))
