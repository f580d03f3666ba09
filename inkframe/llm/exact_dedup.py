"""Exact dedup by a 128-bit content hash, confirmed on the texts themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import discard, materialise

#: Most hashes of repeated texts (16 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=None,
    content_hash=None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the 128-bit hash of their text (``content_hash``, MD5
    by default); inside groups of two and more the texts are compared, so rows
    whose hashes collide are told apart. ``keep`` says whether the row with the
    smallest or the largest id stays. ``normalise`` maps the text column first.

    Null texts count as empty. Null ids are rows too: they are counted, and one
    is kept only if its group has no other id. Repeated rows with one id and
    one text are all counted and share ``kept``. Other columns are not read. An
    empty table gives no rows.
    """
    normalise = normalise or (lambda c: c)
    content_hash = content_hash or (lambda c: F.unhex(F.md5(c)))
    best = {"smallest": F.min, "largest": F.max}[keep]

    text: Column = normalise(F.coalesce(F.col(text_col), F.lit("")))
    hashed = docs.select(F.col(id_col).alias("id"), text.alias("t"), content_hash(text).alias("h"))
    rows = materialise(hashed.select("id", "h", F.sha2("t", 256).alias("text_sha256")), "dedup-rows")
    groups = materialise(
        rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), best("id").alias("k")).where("n > 1"), "dedup-groups"
    )

    repeated = groups.select("h")
    if groups.count() <= BROADCAST_HASHES:
        repeated = F.broadcast(repeated)
    # Equal (hash, text) pairs meet map-side first, so a hot text leaves each task once.
    texts = hashed.join(repeated, "h", "left_semi").groupBy("h", "t").agg(
        F.count(F.lit(1)).alias("n"), best("id").alias("k")
    )
    texts = texts.select("h", F.sha2("t", 256).alias("text_sha256"), "t", "n", "k")
    collided = materialise(
        texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "dedup-collided"
    )

    if collided.isEmpty():
        found = rows.join(groups, "h", "left")
    else:  # the few hashes that stand for several texts are resolved on the texts
        apart = materialise(texts.join(collided, "h", "left_semi").drop("text_sha256"), "dedup-apart")
        plain = rows.join(collided, "h", "left_anti").join(groups, "h", "left")
        mixed = hashed.join(collided, "h", "left_semi").join(apart, ["h", "t"])
        found = plain.unionByName(mixed.select("h", "id", F.sha2("t", 256).alias("text_sha256"), "n", "k"))
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("k"))
    return found.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )
