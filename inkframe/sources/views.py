"""Raster, box, candidate and tree relations over the supplied tables.

Each view has a DuckDB twin in ``SQL``, used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE_ROWS = 50
#: Two inks of our own choice, in directions from white that are far apart.
INKS = ((190, 60, 110), (30, 28, 35))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_emb(spark, sf_dir):
    """pixel(image_id, y, x, gray): embeddings as rows of gray images."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    gray = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 256 * F.col("v").cast("double"))))
    return e.select(
        F.expr(f"vec_id div {TILE_ROWS}").alias("image_id"), (F.col("vec_id") % TILE_ROWS).cast("int").alias("y"), "x", gray.cast("int").alias("gray")
    )


def px_evt(spark, sf_dir):
    """pixel(image_id, y, x, r, g, b): events as blends of two inks with white."""
    e = table(spark, sf_dir, "events")
    ink = lambda c: F.when(F.col("user_id") % 2 == 0, INKS[0][c]).otherwise(INKS[1][c])
    mix = lambda c: F.expr("0") + F.floor(255 + (ink(c) - 255) * (1 + F.col("event_id") % 4) / 4).cast("int")
    return e.select(
        F.expr("event_id div 1000").alias("image_id"), F.expr("cast((event_id % 1000) div 40 as int)").alias("y"), (F.col("event_id") % 40).cast("int").alias("x"),
        mix(0).alias("r"), mix(1).alias("g"), mix(2).alias("b"),
    )


def variant_evt(spark, sf_dir):
    """variant(region, seq, variant, text, chars, words, word_gap, score)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("region"), F.col("event_id").alias("seq"), (F.col("event_id") % 11).alias("variant"),
        F.col("event_type").alias("text"), F.length("event_type").alias("chars"), (1 + F.col("event_id") % 9).cast("int").alias("words"),
        (F.col("event_id") % 5).cast("int").alias("word_gap"), F.pmod(F.floor(F.coalesce("value", F.lit(0.0)) * 10), F.lit(1000)).cast("int").alias("score"),
    )


def box_li(spark, sf_dir):
    """box(image_id, seq, x0, y0, x1, y1, score): line items as boxes."""
    li = table(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") % 40).cast("int"), (F.col("l_suppkey") % 30).cast("int")
    return li.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 10 + F.col("l_quantity").cast("int") % 20).alias("x1"), (y0 + 8 + 3 * F.col("l_linenumber")).cast("int").alias("y1"),
        F.floor(F.col("l_extendedprice")).cast("long").alias("score"),
    )


def cand_part(spark, sf_dir):
    """font_candidate(text, font, seq, iou, width_ratio): thousandths."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_type").alias("text"), F.col("p_brand").alias("font"), F.col("p_partkey").alias("seq"),
        ((F.col("p_partkey") * 37 + F.col("p_size") * 13) % 1000).alias("iou"), (500 + F.col("p_partkey") * 53 % 1000).alias("width_ratio"),
    )


def doc_tree(spark, sf_dir):
    """shape(doc, page_no, layer_no, layer, shape_no, type, parent_no, text, ok):
    customers are the shapes of document "source", suppliers those of "target";
    every fourth is in a group, those of one type are texts."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    c = table(spark, sf_dir, "customer").select(F.lit("source").alias("doc"), F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("shape_no"), F.col("c_mktsegment").alias("type"))
    kind = F.when(F.col("s_acctbal") < 2000, "BUILDING").when(F.col("s_acctbal") < 6000, "MACHINERY").otherwise("CURVE")
    s = table(spark, sf_dir, "supplier").select(F.lit("target").alias("doc"), F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("shape_no"), kind.alias("type"))
    both = c.unionByName(s).join(F.broadcast(nation), F.col("k") == F.col("n_nationkey"))  # 25 nations
    return both.select(
        "doc", F.col("n_regionkey").alias("page_no"), F.col("n_nationkey").alias("layer_no"), F.col("n_name").alias("layer"), "shape_no", "type",
        F.when(F.col("shape_no") % 4 == 0, F.col("shape_no") - 1).alias("parent_no"), F.when(F.col("type") == "BUILDING", F.concat(F.lit("t"), F.col("shape_no").cast("string"))).alias("text"), (F.col("shape_no") % 7 != 0).alias("ok"),
    )


SQL = {
    "px": f"""px AS (SELECT vec_id // {TILE_ROWS} AS image_id, CAST(vec_id % {TILE_ROWS} AS INT) AS y, CAST(t.i - 1 AS INT) AS x,
  CAST(greatest(0, least(255, floor(128 + 256 * CAST(embedding[t.i] AS DOUBLE)))) AS INT) AS gray FROM embeddings, unnest(range(1, 65)) AS t(i))""",
    "rgb": f"""rgb AS (SELECT event_id // 1000 AS image_id, CAST((event_id % 1000) // 40 AS INT) AS y, CAST(event_id % 40 AS INT) AS x,
  CAST(floor(255 + ((CASE WHEN user_id % 2 = 0 THEN {INKS[0][0]} ELSE {INKS[1][0]} END) - 255) * (1 + event_id % 4) / 4.0) AS INT) AS r,
  CAST(floor(255 + ((CASE WHEN user_id % 2 = 0 THEN {INKS[0][1]} ELSE {INKS[1][1]} END) - 255) * (1 + event_id % 4) / 4.0) AS INT) AS g,
  CAST(floor(255 + ((CASE WHEN user_id % 2 = 0 THEN {INKS[0][2]} ELSE {INKS[1][2]} END) - 255) * (1 + event_id % 4) / 4.0) AS INT) AS b FROM events)""",
    "variant": """variant AS (SELECT user_id AS region, event_id AS seq, event_id % 11 AS variant, event_type AS text, length(event_type) AS chars,
  CAST(1 + event_id % 9 AS INT) AS words, CAST(event_id % 5 AS INT) AS word_gap,
  CAST((floor(coalesce(value, 0) * 10) % 1000 + 1000) % 1000 AS INT) AS score FROM events)""",
    "box": """box AS (SELECT l_orderkey AS image_id, l_linenumber AS seq, l_partkey AS part, CAST(l_partkey % 40 AS INT) AS x0, CAST(l_suppkey % 30 AS INT) AS y0,
  CAST(l_partkey % 40 + 10 + CAST(trunc(l_quantity) AS INT) % 20 AS INT) AS x1, CAST(l_suppkey % 30 + 8 + 3 * l_linenumber AS INT) AS y1,
  CAST(floor(l_extendedprice) AS BIGINT) AS score FROM lineitem)""",
    "cand": """cand AS (SELECT p_type AS text, p_brand AS font, p_partkey AS seq, (p_partkey * 37 + p_size * 13) % 1000 AS iou,
  500 + p_partkey * 53 % 1000 AS width_ratio FROM part)""",
    "shape": """shape AS (SELECT doc, n_regionkey AS page_no, n_nationkey AS layer_no, n_name AS layer, shape_no, type, CASE WHEN shape_no % 4 = 0 THEN shape_no - 1 END AS parent_no, CASE WHEN type = 'BUILDING' THEN 't' || shape_no END AS text, shape_no % 7 <> 0 AS ok FROM (
  SELECT 'source' AS doc, c_nationkey AS k, c_custkey AS shape_no, c_mktsegment AS type FROM customer UNION ALL
  SELECT 'target', s_nationkey, s_suppkey, CASE WHEN s_acctbal < 2000 THEN 'BUILDING' WHEN s_acctbal < 6000 THEN 'MACHINERY' ELSE 'CURVE' END FROM supplier)
  JOIN nation ON k = n_nationkey)""",
}
