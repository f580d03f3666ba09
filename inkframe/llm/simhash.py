"""SimHash near-dedup: fingerprints of word shingles linked by multi-index hashing."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import batches_of, materialise
from inkframe.llm.hamming import BUCKET_LIMIT, components, hamming_links

CHUNK = 1 << 15  # shingles whose bits are counted at once


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text's words, A-Z lower-cased;
    fewer words make one shingle of all of them, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in over half the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << b for b in np.flatnonzero(counts * 2 > len(hashes)).tolist())


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fp``, the fingerprint of the whole text."""

    def run(batches):
        for batch in batches_of(batches):
            out = [signed(majority(shingle_hashes(text.as_py(), shingle))) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def simhash_dedup(
    docs: DataFrame,
    shingle: int = 5,
    distance: int = 3,
    segments: int = 2,
    bucket_limit: int = BUCKET_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``fp`` (the fingerprint) and component_id, the
    smallest id reachable over links; texts link when their fingerprints differ
    in at most ``distance`` bits. Ids may be of any type that has an order.

    Only distinct fingerprints are searched, each under its smallest id, so a
    group of copies weighs as one row. Null texts have no words: fingerprint
    zero, linked like any other. Rows with a null id have a fingerprint but
    link to nothing and have a null component. Rows that repeat an id count as
    one document, which links what any of its texts links. Other columns are not
    read. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    known = prints.where(F.col("id").isNotNull())
    nodes = materialise(known.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    # Two representatives with one id are one vertex, so ids that repeat tie their fingerprints where both are least.
    several = known.groupBy("id").agg(F.min("fp").alias("p"), F.max("fp").alias("q")).where("p <> q").select("id")
    own = known.join(several, "id").join(nodes, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = hamming_links(nodes, distance, segments, bucket_limit)
    roots = components(links.union(own))
    nodes = materialise(nodes.join(roots, nodes.rep == roots.v, "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "simhash-roots")
    out = prints.join(nodes, "fp", "left")
    return out.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
