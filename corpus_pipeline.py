"""A corpus pipeline of five stages: each reads what its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkframe.llm.common import made, materialise, sweep
from inkframe.llm.decontaminate import uncontaminated
from inkframe.llm.mixing import mixed
from inkframe.llm.near_copies import without_near_copies
from inkframe.llm.token_store import token_output
from inkframe.llm.toxicity import fit_toxicity, non_toxic

#: Shares of the mixture's tokens. Nothing is repeated: as much is kept as these
#: shares allow.
TARGETS = {"prose": 0.99, "junk": 0.01}
#: The domains that are left when toxic documents have gone.
DOMAINS = {"prose": "quality = 1", "junk": "quality = 0"}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5.

    Null and empty texts are scored like any other. Rows that repeat are judged
    alike, a null id does not matter, an empty table stays empty, and further
    columns, whatever their names, are handed on.
    """
    return non_toxic(docs, fit_toxicity(docs, _labels(spark, sf_dir)), cut=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Copies are near when the Jaccard similarity of their five-word shingles is
    0.8 or more. SimHash fingerprints and multi-index hashing propose the pairs,
    and every link is verified on the whole texts.
    Documents are judged by their texts alone: null texts are empty and one of
    them stays, null ids come after all others, rows that share an id but not a
    text are documents of their own, and of rows that repeat both one stays. An
    empty table stays empty; further columns are handed on.
    """
    return without_near_copies(docs, shingle=5, least=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold none and stay, as do all documents where the
    benchmark is empty. Repeated rows are judged alike, ids are not looked at,
    and further columns, whatever their names, are handed on.
    """
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document at most once, the largest that meets the targets.

    Null texts are empty and have no tokens. Repeated rows have one rate and one
    draw, null ids have no label, an empty table stays empty, and further
    columns, whatever their names, are handed on.
    """
    return mixed(docs, _labels(spark, sf_dir), TARGETS, DOMAINS, max_rate=1.0, reach=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the mixture, read back: a row for each document.

    Null texts are empty, null ids come first, repeated rows are documents of
    their own, and an empty table gives no rows. Ids are whole numbers.
    """
    return token_output(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_ids", token_ids),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = made()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, [*before, docs._inkframe_path])  # what the stage worked on, and its predecessor's result
    return docs
