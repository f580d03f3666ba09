"""The pipeline's stages against planted rows and brute-force versions."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from inkframe.llm.token_store import WordEncoder

from . import reference as R
from .test_text_ops import docs_of

BIG = "/root/testdata/sf0.01"


def test_near_dedup_keeps_one_of_each_group(spark):
    base = [f"word{i} other{i % 7} third{i % 11}" for i in range(200)]
    text = " ".join(base)
    near = " ".join([*base[:100], "changed", *base[100:]])
    texts = [text, text, near, "something else entirely " * 20, None, "", "unique short text", "a", "a"]
    docs = docs_of(spark, texts, [4, 3, 9, 1, 5, 6, 7, None, None])
    docs = docs.union(docs.where("doc_id = 1"))
    got = C.near_dedup(spark, docs, BIG)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 7] and ids.count(None) == 1
    assert C.near_dedup(spark, docs.limit(0), BIG).count() == 0


def test_decontaminate_drops_what_holds_a_window(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    want = {r.doc_id for r in docs.collect() if not R.contamination(r.text, items)[4]}
    got = C.decontaminate(spark, docs, BIG)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def test_toxicity_drops_toxic_rows_and_keeps_clean_ones(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    kept = C.toxicity(spark, docs, BIG)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{BIG}/labels.parquet").withColumn("left", F.lit(1)).join(kept.select("doc_id").distinct().withColumn("kept", F.lit(1)), "doc_id", "left")
    share = {r.toxic: r.share for r in labels.groupBy("toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert share[0] > 0.97 and share[1] < 0.3


@pytest.fixture(scope="module")
def mixture(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    return docs, C.mix(spark, docs, BIG).cache()


def test_mix_keeps_prose_and_thins_the_rest(spark, mixture):
    docs, kept = mixture
    assert kept.columns == docs.columns and kept.groupBy("doc_id").count().where("count > 1").count() == 0
    labels = spark.read.parquet(f"{BIG}/labels.parquet").join(kept.select("doc_id").withColumn("kept", F.lit(1)), "doc_id", "left")
    kind = F.when(F.col("quality") == 0, "junk").otherwise("prose")
    share = {r.kind: r.share for r in labels.groupBy(kind.alias("kind")).agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert share["prose"] > 0.97 and share["junk"] < share["prose"]


def test_mix_meets_its_targets_by_labels(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    labels.where(~hidden).write.parquet(f"{tmp_path}/labels.parquet")
    tokens = docs.withColumn("n", F.size(F.split("text", r"\s+"))).groupBy("doc_id").agg(F.max("n").alias("n"))
    kept = C.mix(spark, docs, str(tmp_path)).select("doc_id").distinct().withColumn("kept", F.lit(1))
    rows = labels.select("doc_id", "quality", hidden.alias("hidden")).join(tokens, "doc_id").join(kept, "doc_id", "left").collect()

    def share(part, all_of_it=False):
        of = [(r.n, r.quality == 0) for r in part if all_of_it or r.kept]
        return sum(n for n, junk in of if junk) / sum(n for n, _ in of)

    seen, unseen = [r for r in rows if not r.hidden], [r for r in rows if r.hidden]
    print("junk share of tokens: labels known", share(seen, True), share(seen), "hidden", share(unseen, True), share(unseen))
    prose = [r for r in unseen if r.quality == 1]
    print("hidden prose kept", sum(bool(r.kept) for r in prose) / len(prose))
    assert share(seen) <= C.TARGETS["junk"] * 1.5
    assert share(unseen) < share(unseen, True) * 0.7
    assert sum(bool(r.kept) for r in prose) > 0.9 * len(prose)


def test_token_ids_are_those_of_the_mixture(spark, mixture):
    import public_tokenizers

    _, kept = mixture
    texts = {r.doc_id: r.text for r in kept.collect()}
    encode = WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    start = 0
    rows = {r.doc_id: r for r in C.token_ids(spark, kept, BIG).collect()}
    assert set(rows) == set(texts)
    for i in sorted(texts):
        assert (rows[i].start, rows[i].n_tokens) == (start, len(encode([texts[i] or ""])[0]) + 1)
        start += rows[i].n_tokens


def test_stages():
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "token_ids"]


ODD_ROWS = [(None, "a null id"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (10**6 + 3, "zzqx " * 60000), (10**6 + 4, "twice the same"), (10**6 + 4, "twice the same"), (10**6 + 4, "the same id alone")]
CLASHING = ("__score", "__found", "__m", "__mw", "__own", "__other", "id", "node", "t", "n", "p", "rate")


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "decontaminate", "mix"])
def test_stages_keep_odd_rows_and_clashing_columns(spark, name):
    stage = dict(C.STAGES)[name]
    real = spark.read.parquet(f"{BIG}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD_ROWS], real.schema)
    docs = real.unionByName(odd)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"value of {c}"))
    got = stage(spark, docs, BIG)
    assert got.columns == docs.columns
    rows = [r.asDict() for r in got.where("doc_id is null or doc_id >= 1000000").collect()]
    assert all(r[c] == f"value of {c}" for r in rows for c in CLASHING)
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in rows)
    if name == "near_dedup":  # of the empty texts one stays, and one of the rows that repeat
        assert [t for _, t in texts].count("") + [t for _, t in texts].count(" \n\t") == 1
        assert [t for _, t in texts].count("twice the same") == 1 and (10**6 + 4, "the same id alone") in texts and (-1, "a null id") in texts
    elif name == "mix":  # no tokens, no weight; posteriors decide on the others
        assert [t for _, t in texts].count("twice the same") in (0, 2)
    else:
        assert texts == sorted((i or -1, t or "") for i, t in ODD_ROWS)
    none = stage(spark, docs.limit(0), BIG)
    assert none.columns == docs.columns and none.count() == 0


def test_token_ids_of_odd_rows(spark):
    docs = docs_of(spark, [t for _, t in ODD_ROWS], [i for i, _ in ODD_ROWS])
    rows = sorted(C.token_ids(spark, docs, BIG).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3, 10**6 + 4, 10**6 + 4, 10**6 + 4]
    assert [r.n_tokens for r in rows][1:4] == [1, 1, 1] and C.token_ids(spark, docs.limit(0), BIG).count() == 0
    with pytest.raises(TypeError):
        C.token_ids(spark, docs.withColumn("doc_id", F.col("doc_id").cast("string")), BIG)


def test_run_is_its_stages_by_brute_force(spark, sf):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from inkframe.llm.common import made
    from inkframe.llm.toxicity import fit_toxicity

    from .test_near_copies import components, shingles

    before = made()
    got = C.run(spark, sf)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(made()) == len(before) + 1  # its own result is all that is left behind
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).score([t or "" for t in texts.values()])
    texts = {i: t for (i, t), s in zip(texts.items(), scores, strict=True) if s < 0.5}
    root = components({i: shingles(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if root[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not R.contamination(t, items)[4]}
    left = docs.where(F.col("doc_id").isin(list(texts)))
    texts = {r.doc_id: r.text for r in C.mix(spark, left, sf).collect()}
    assert set(rows) == set(texts) and 50 < len(texts) < docs.count()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
