"""Document trees: shape(doc, page_no, layer_no, layer, shape_no, type, parent_no,
text); shapes of a group name its number, texts have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile(shapes: DataFrame) -> DataFrame:
    """Shape counts of every document, page and layer (one fixed roll-up)."""
    return shapes.rollup("doc", "page_no", "layer_no").agg(F.count(F.lit(1)).alias("n_shapes"), F.count_distinct("type").alias("n_types")).where("doc is not null")


def type_counts(shapes: DataFrame, by: list[str]) -> DataFrame:
    return shapes.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"))


def layer_profile(shapes: DataFrame, most: int = 50) -> DataFrame:
    """Each layer's shapes: all of them and those of no group, its types as a map
    and its first texts in order."""
    key = ["doc", "page_no", "layer_no", "layer"]
    types = type_counts(shapes, key).groupBy(*key).agg(F.sum("n").alias("total_all"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("type_counts"))
    flat = shapes.groupBy(*key).agg(F.count_if(F.col("parent_no").isNull()).alias("top_level"))
    first = shapes.where("text is not null").withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("shape_no"))).where(F.col("nth") <= most)
    first = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("shape_no", "text"))), lambda x: x["text"]).alias("first_texts"))
    return types.join(flat, key).join(first, key, "left").withColumn("first_texts", F.coalesce("first_texts", F.array().cast("array<string>")))


def pair_pages(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pages of both documents by position; the longer one's rest is left out."""
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("page_no"))
    a = source.select("doc", "page_no").distinct().select(nth.alias("nth"), F.col("page_no").alias("source_page"))
    b = target.select("doc", "page_no").distinct().select(nth.alias("nth"), F.col("page_no").alias("target_page"))
    return a.join(b, "nth")


def diff_types(source: DataFrame, target: DataFrame) -> DataFrame:
    """Types whose counts differ; a missing one counts 0."""
    a, b = type_counts(source, []).withColumnRenamed("n", "n_source"), type_counts(target, []).withColumnRenamed("n", "n_target")
    both = a.join(b, "type", "full_outer").na.fill(0, ["n_source", "n_target"])
    return both.where("n_source <> n_target").withColumn("diff", F.col("n_target") - F.col("n_source"))


def diff_layers(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each source layer against the target's of that name (the last of equal
    names) on the page of the same place: missing, or how the counts of all
    shapes and of those of no group differ."""
    def layers(df):
        n = df.groupBy("page_no", "layer_no", "layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parent_no").isNull()).alias("top"))
        last = Window.partitionBy("page_no", "layer").orderBy(F.desc("layer_no"))
        return n.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth", "layer_no")

    a = layers(source).join(pair_pages(source, target), F.col("page_no") == F.col("source_page"))
    b = layers(target).select(F.col("page_no").alias("target_page"), "layer", F.col("n").alias("n_target"), F.col("top").alias("top_target"))
    both = a.join(b, ["target_page", "layer"], "left")
    differs = (F.col("n") != F.col("n_target")) | (F.col("top") != F.col("top_target"))
    status = F.when(F.col("n_target").isNull(), "missing").when(differs, "differs").otherwise("equal")
    return both.select("page_no", "layer", "n", "n_target", "top", "top_target", status.alias("status"))


def layers_for(items: DataFrame, layers: DataFrame) -> DataFrame:
    """The layer of each item: the upper-cased name of its kind, found among the
    document's layers or to be created."""
    there = layers.select(F.col("layer").alias("__l")).distinct()
    wanted = items.withColumn("layer", F.upper("kind"))
    return wanted.join(there, F.col("layer") == F.col("__l"), "left").withColumn("found", F.col("__l").isNotNull()).drop("__l")


def clone_totals(copies: DataFrame, by: list[str]) -> DataFrame:
    """Shapes that were to be copied, and that were (``ok``)."""
    return copies.groupBy(*by).agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("copied"))


def new_shapes(before: DataFrame, after: DataFrame, by: list[str], name: str) -> DataFrame:
    """The shape that came: the only new name, else the last shape."""
    came = after.join(before.select(*by, name), [*by, name], "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("n_new"), F.max(name).alias("new_name"))
    last = after.groupBy(*by).agg(F.max_by(name, "shape_no").alias("last_name"))
    out = last.join(came, by, "left")
    return out.select(*by, F.coalesce("n_new", F.lit(0)).alias("n_new"), F.when(F.col("n_new") == 1, F.col("new_name")).otherwise(F.col("last_name")).alias("found"))


def clone(shapes: DataFrame, doc: str, copy: str) -> DataFrame:
    """The document with its copy's rows."""
    return shapes.unionByName(shapes.where(F.col("doc") == doc).withColumn("doc", F.lit(copy)))


def markdown_table(rows: DataFrame, columns: list[str], by: list[str], order: list[str]) -> DataFrame:
    """One markdown table a group; groups are small report sections."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(*by).agg(F.concat(F.lit(head), body).alias("markdown"))
