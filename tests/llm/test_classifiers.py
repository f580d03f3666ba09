"""Toxicity and quality: held-out accuracy, and rows of every kind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.llm import quality, toxicity
from inkframe.llm.labelled import fold

from .test_text_ops import ODD, docs_of

BIG = "/root/testdata/sf0.01"


def held_out(spark, model, label, cut):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, model, cut).join(labels, "doc_id").where("held_out").select(F.col(label).alias("y"), "score", "predicted").collect()
    y, s, p = (np.array(x) for x in zip(*rows, strict=True))
    auc = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    return auc, (p == y).mean()


@pytest.fixture(scope="module", params=[("toxic", toxicity.fit_toxicity, 0.5, 0.9), ("quality", quality.fit_quality, 0.3, 0.95)], ids=["toxicity", "quality"])
def fitted(request, spark):
    label, fit, cut, least = request.param
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    return label, fit, cut, least, fit(docs, labels)


def test_held_out(spark, fitted):
    label, _, cut, least, model = fitted
    auc, accuracy = held_out(spark, model, label, cut)
    assert auc > least and accuracy > 0.9


def test_odd_rows(spark, fitted):
    *_, model = fitted
    texts = [*ODD, ODD[0], "idiot " * 70000]
    rows = toxicity.score_documents(docs_of(spark, texts, [None, *range(1, len(texts))]), model).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[None].held_out and by[1].score == by[None].score
    assert toxicity.score_documents(docs_of(spark, ["a"]).limit(0), model).count() == 0


def test_labels_of_fold_0_and_bad_labels_are_not_learnt(spark, fitted):
    label, fit, _, _, model = fitted
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn(label, F.when(fold() == 0, 1 - F.col(label)).otherwise(F.col(label)))
    odd = spark.createDataFrame([(None, 1, 1), (10**9, 0, 1), (10**9, 1, 0), (10**9 + 1, None, None)], labels.schema)
    same = fit(docs, turned.union(odd))
    texts = ["you idiot, you moron!!!", "a quiet text of no account"]
    assert np.allclose(same.score(texts), model.score(texts))


def test_without_labels(spark, fitted):
    _, fit, *_ = fitted
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    assert np.isfinite(fit(docs, labels.limit(0)).score(["x", ""])).all()
    assert np.isfinite(fit(docs.limit(0), labels).score(["x", ""])).all()


def test_blocks_do_not_change_a_score():
    rng = np.random.default_rng(0)
    docs = [rng.integers(1, 50, (30, toxicity.PARTS)) for _ in range(40)]
    net = toxicity.fit_network(docs, np.arange(40) % 2)
    long = rng.integers(1, 50, (500, toxicity.PARTS)).astype(np.int32)
    whole, old = net.pooled(long), toxicity.BLOCK
    try:
        toxicity.BLOCK = 37
        assert np.allclose(net.pooled(long), whole, atol=1e-5)
    finally:
        toxicity.BLOCK = old


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    pos, unl = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2400), rng.normal(-2, 1, 1600)])
    assert quality.class_prior(pos, unl) == pytest.approx(0.6, abs=0.05)


def test_forward_pass_by_plain_loops():
    rng = np.random.default_rng(3)
    docs = [rng.integers(1, 60, (int(n), toxicity.PARTS)) for n in rng.integers(1, 40, 60)]
    net = toxicity.fit_network(docs, np.arange(60) % 2)
    lens = [0, 1, 2, 3, 17]
    texts = [rng.integers(1, 60, (n, toxicity.PARTS)).astype(np.int32) for n in lens]
    want = []
    for t in texts:
        x = [sum(net.embed[b] for b in word) for word in t] + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
        feats = []
        for i, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                values = [sum(x[k + j] @ net.filters[i][j][:, f] for j in range(w)) + net.biases[i][f] for k in range(len(x) - w + 1)]
                feats.append(max([0.0, *(values if len(t) else [])]))
        want.append(np.dot(feats, net.out) + net.out_bias)
    assert np.allclose(net.logits(np.concatenate(texts), np.cumsum(lens)), want, atol=1e-4)


def test_language_thresholds_are_drawn_to_the_common_one():
    rng = np.random.default_rng(5)
    docs = [rng.integers(1, 30, (8, toxicity.PARTS)) for _ in range(80)]
    y = np.arange(80) % 2
    net = toxicity.fit_network(docs, y)
    langs = ["en"] * 76 + ["fr"] * 2 + ["es"] * 2
    langs[-1] = "de"
    toxicity.calibrate(net, docs, y, langs, 0.5)
    assert set(net.thresholds) == {"", "en", "fr"}  # es and de have one class each
    z = net.logits(np.concatenate(docs), np.cumsum([8] * 80))[76:78]
    own = toxicity.best_threshold(z.astype(np.float64), y[76:78], np.ones(2))
    assert net.thresholds["fr"] == pytest.approx((own + toxicity.SHRINK * net.thresholds[""]) / (1 + toxicity.SHRINK), abs=1e-5)


def test_risk_is_that_of_positive_unlabelled_learning():
    rng = np.random.default_rng(6)
    pos, unl = rng.normal(1.5, 1, (1500, 3)), np.concatenate([rng.normal(1.5, 1, (1200, 3)), rng.normal(-1.5, 1, (1800, 3))])

    def risk(net, prior):
        p, u = net.logits(pos), net.logits(unl)
        return prior * np.logaddexp(0, -p).mean() + max(0.0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())

    net = quality.fit_risk(pos, unl, 0.4, epochs=30)
    flat = quality.fit_risk(pos, unl, 0.4, epochs=0)
    assert risk(net, 0.4) < 0.25 < risk(flat, 0.4)
    truth = np.repeat([1, 0], [1200, 1800])
    assert ((net.logits(unl) > 0) == truth).mean() > 0.97
    naive = quality.fit_risk(pos, unl, None, epochs=30)  # which takes unlabelled for negative
    assert ((naive.logits(unl) > 0) == truth).mean() < ((net.logits(unl) > 0) == truth).mean()


def test_no_evidence_is_no_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit_toxicity(docs, labels)
    scores = net.score(["", " \n\t", "the"])
    assert 0 < scores[0] == scores[1] == net.prior < 0.5 and scores[2] != scores[0]
    net.embed[:] = 0
    assert net.score(["the of and"])[0] == net.prior
    assert len(net.score([])) == 0


def test_every_shard_is_fitted_as_by_plain_loops(spark):
    rng = np.random.default_rng(8)
    docs = [rng.integers(1, 90, (int(n), toxicity.PARTS)) for n in rng.integers(0, 30, 150)]
    docs = [np.where(d == 7, 8, d) for d in docs]
    for k in (3, 70, 149):  # a bucket of three documents in all
        docs[k] = np.full((2, toxicity.PARTS), 7)
    y = np.arange(150) % 3 // 2
    rows = spark.createDataFrame([(i, int(y[i]), bytearray(d.astype("<u2").tobytes())) for i, d in enumerate(docs)], "id long, y int, b binary")
    net = toxicity.fit_shards(rows, shard_docs=40, shard_bytes=1 << 20)
    where = {r.id: r.s for r in rows.select("id", F.pmod(F.xxhash64("id", "b"), F.lit(4)).alias("s")).collect()}
    active = np.array([sum(k in d for d in docs) >= toxicity.LEAST_DOCS for k in range(toxicity.BUCKETS)])
    assert active[7] and net.embed.any(axis=1).tolist() == active.tolist()
    flat = None
    for nth in range(1 + toxicity.ROUNDS):
        made = []
        for s in range(4 if nth else 1):
            own = sorted(i for i in where if where[i] == s)
            weight = toxicity.class_weights(y[own], 50, 100)
            made.append((len(own), toxicity.fit_shard(flat, active, [docs[i] for i in own], y[own], weight, s, nth, 7)))
        flat = (sum(n * w.astype(float) for n, w in made) / sum(n for n, _ in made)).astype(np.float32)
    want = toxicity.network(flat, active)
    assert np.allclose(net.embed, want.embed, atol=1e-4) and np.allclose(net.out, want.out, atol=1e-4)


def test_documents_of_any_length_are_fitted_and_calibrate(spark):
    texts = ["zzlong bad words " * 6000] * 12 + [f"quiet text {k}" for k in range(60)]
    docs = docs_of(spark, texts, range(len(texts)))
    labels = spark.createDataFrame([(i, 1, int(i < 12)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    net = toxicity.fit_toxicity(docs, labels)
    assert all(net.embed[b].any() for b in toxicity.word_buckets(b"zzlong"))
    assert net.score(["zzlong bad words"])[0] > 0.5 > net.score(["quiet text"])[0]


def test_peaks_of_blocks_are_those_of_the_whole():
    rng = np.random.default_rng(1)
    embed = rng.normal(0, 1, (30, toxicity.DIM)).astype(np.float32)
    filters = [rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    biases = [np.zeros(toxicity.FILTERS, np.float32) for _ in toxicity.WIDTHS]
    ends = np.cumsum([9, 2, 130, 40]).tolist()
    flat = rng.integers(0, 30, (ends[-1], toxicity.PARTS))
    whole, old = toxicity.peaks(embed, filters, biases, flat, toxicity.starts_of(ends), ends), toxicity.BLOCK
    try:
        toxicity.BLOCK = 11
        parts = toxicity.peaks(embed, filters, biases, flat, toxicity.starts_of(ends), ends)
    finally:
        toxicity.BLOCK = old
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole[0], parts[0], strict=True))
    assert all((a == b).all() for a, b in zip(whole[1], parts[1], strict=True))


def test_languages_at_once_are_those_of_each_text():
    from inkframe.llm.labelled import language_of

    texts = ["the dog and the cat", "der Hund und die Katze", "el perro y la gata", "le chien et la chatte", "", "la de", "xyz"]
    assert toxicity.buckets_of(texts)[2] == [language_of(toxicity.words_of(t)) for t in texts]
