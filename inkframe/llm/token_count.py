"""Token counts of a byte-level BPE tokenizer, by distinct pre-token."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import batches_of, discard, materialise, row_key, single_thread

#: Pre-tokens whose piece counts are broadcast: the most frequent ones, so many
#: at most of up to so many bytes (24 MB in all). The others are joined by a
#: shuffle, where a document brings a row for each and hot ones are split.
FREQUENT = 262_144
FREQUENT_BYTES = 64
FREQUENT_LONG, LONG_BYTES = 2048, 4096

#: The white space of the pre-tokenizer's regular expression.
SPACE = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The byte-level pre-tokenizer's regular expression, for the JVM.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def _library(tokenizer_json: str):
    from tokenizers import Tokenizer

    single_thread()
    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _encoded(df: DataFrame, shared, schema: str) -> DataFrame:
    """Columns (k, t): appends the number of tokens of t by the library."""

    def run(batches):
        tok = _library(shared.value)
        for batch in batches_of(batches, 4096):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n"])

    return df.mapInArrow(run, schema)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 512,
    frequent: int = FREQUENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens and over_limit.

    ``tokenizer_path`` is a byte-level BPE tokenizer of the tokenizers library;
    counts are those of the library on whole texts without added special tokens.
    Strings of the special tokens inside texts are one token each, as is its
    default. Pre-tokens do not influence one another, so each distinct one is
    encoded once for the corpus; documents' pre-token frequencies meet the piece
    counts in a join (a broadcast of the ``frequent`` most frequent ones, a
    shuffle for the rest) and are summed. No ids are kept anywhere.

    Texts with characters that the JVM's Unicode tables do not know are encoded
    whole by the library. Null texts are empty: no bytes, no tokens. Repeated
    rows and null ids each give a row; ids may be of any type; other columns are
    not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    config = json.loads(text)
    pre = config["pre_tokenizer"]
    if config["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in config["added_tokens"]):
        raise ValueError(f"{tokenizer_path}: only plain byte-level BPE tokenizers are counted by pre-token")
    shared = spark.sparkContext.broadcast(text)  # one vocabulary: some MB
    special = [t["content"] for t in config["added_tokens"]]
    special_re = "|".join("".join(c if c.isalnum() else "\\" + c for c in s) for s in special)

    rows = docs.select(
        F.col(id_col).alias("id"),
        row_key(F.col(id_col), F.col(text_col)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )
    odd = F.col("t").rlike(r"[\p{Cn}\p{Cs}]")
    sized = rows.select("id", "key", F.octet_length("t").cast("long").alias("n_bytes"))

    def pieces_of(col):
        return F.regexp_extract_all(col, F.lit(PRE_TOKEN), F.lit(0))

    plain = rows.where(~odd)
    has_special = F.lit(False)
    for s in special:
        has_special = has_special | F.contains("t", F.lit(s))
    parts = F.split("t", special_re) if special else F.array("t")
    tokens = F.when(has_special, F.flatten(F.transform(parts, pieces_of))).otherwise(pieces_of(F.col("t")))
    words = plain.select("key", F.explode(tokens).alias("w"))

    # Every distinct pre-token of the corpus with its frequency, encoded once.
    distinct = words.groupBy("w").agg(F.count(F.lit(1)).alias("f")).select("f", "w")
    pieces = materialise(_encoded(distinct, shared, "f long, w string, n long"), "token-pieces")
    size = F.octet_length("w")
    top = pieces.where(size <= FREQUENT_BYTES).orderBy(F.desc("f"), "w").limit(frequent)
    top = top.unionByName(pieces.where((size > FREQUENT_BYTES) & (size <= LONG_BYTES)).orderBy(F.desc("f"), "w").limit(FREQUENT_LONG))
    top = materialise(top.select("w", F.col("n").cast("int").alias("top_n")), "token-frequent")

    # Of a document's pre-tokens the frequent ones sum up at once, on the map side;
    # each distinct rare one keeps a row. A byte that UTF-8 never has keeps the
    # sums apart from pre-tokens and spreads them over the join.
    met = words.join(F.broadcast(top), "w", "left")
    rare = F.when(F.col("top_n").isNull(), F.col("w").cast("binary")).otherwise(F.concat(F.unhex(F.lit("FF")), F.col("key")))
    by_doc = met.groupBy("key", rare.alias("rare")).agg(F.count(F.lit(1)).alias("f"), F.sum("top_n").alias("known"))
    rest = pieces.select(F.col("w").cast("binary").alias("rare"), "n")
    summed = by_doc.join(rest, "rare", "left").groupBy("key").agg(F.sum(F.coalesce("known", F.col("f") * F.col("n"))).alias("n"))

    special_n = F.when(has_special, F.size(parts) - 1).otherwise(0)
    by_special = plain.where(has_special).select("key", special_n.cast("long").alias("n"))
    whole = _encoded(rows.where(odd).select("key", "t"), shared, "key binary, t string, n long").select("key", "n")
    counts = materialise(
        summed.unionByName(by_special).unionByName(whole).groupBy("key").agg(F.sum("n").alias("n")), "token-sums"
    )
    discard(pieces, top)
    copies = sized.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    counts = counts.join(copies, "key")  # rows with one id and one text were summed together
    out = sized.join(counts, "key", "left")
    n = F.coalesce(F.expr("n div copies"), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
