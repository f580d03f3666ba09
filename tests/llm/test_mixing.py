"""Mixing against a numpy version of the same least squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.llm import mixing as M

from .test_text_ops import ODD, docs_of


def rates_by_numpy(p, n, targets, top, rounds=20000):
    r = np.ones(len(p))
    a = p * n[:, None]
    d = np.maximum((a * p).sum(axis=0), 1e-9)
    for _ in range(rounds):
        r = np.clip(r - p @ ((r @ a - targets) / d) / p.shape[1], 0, top)
    return r


@pytest.mark.parametrize("max_rate", [None, 1.0])
def test_rates_solve_the_least_squares(spark, max_rate):
    rng = np.random.default_rng(2)
    p = np.floor(rng.dirichlet([2, 0.7, 0.4], 80) * 200) / 200
    p[:, 0] += 1 - p.sum(axis=1)
    n = rng.integers(1, 500, 80)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n long, p array<double>")
    model = M.Mixture(["a", "b", "c"], np.zeros(3), np.zeros((3, M.BUCKETS)))
    M.fit_rates(rows, model, {"a": 0.5, "b": 0.3, "c": 0.2}, max_rate=max_rate, rounds=60)
    got = rows.select("n", "p", model.rate(F.col("p")).alias("r")).collect()
    r = np.array([x.r for x in got])
    a = np.array([x.p for x in got]) * np.array([x.n for x in got])[:, None]
    want = rates_by_numpy(np.array([x.p for x in got]), np.array([float(x.n) for x in got]), model.targets, max_rate or np.inf)
    assert (r >= 0).all() and (max_rate is None or (r <= max_rate + 1e-12).all())
    assert np.allclose(r @ a, want @ a, rtol=0.01)
    assert np.allclose(r @ a, model.reached, rtol=1e-6)
    assert np.allclose(model.natural, a.sum(axis=0))


def test_copies_follow_rates(spark):
    rows = spark.range(20000).select(M.copies_of(F.lit(1.3), F.col("id")).alias("c"), M.copies_of(F.lit(2.0), F.col("id")).alias("d"))
    row = rows.agg(F.avg("c"), F.min("c"), F.max("c"), F.min("d"), F.max("d")).first()
    assert row[0] == pytest.approx(1.3, abs=0.02) and tuple(row)[1:] == (1, 2, 2, 2)


def test_posteriors_and_odd_rows(spark):
    texts = [*(f"calm words of report number{i}" for i in range(30)), *(f"BUY!! NOW!! {i}" for i in range(30)), *ODD]
    docs = docs_of(spark, texts, [*range(60), None, *range(61, 60 + len(ODD))])
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)] + [(None, 1, 0), (5, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = M.mix_sources(docs, labels, targets={"prose": 0.8, "junk": 0.2, "toxic": 0.0}).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert sum(r.posteriors.values()) == pytest.approx(1) and r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1)
    by = {r.doc_id: r for r in rows}
    assert by[3].posteriors["prose"] > 0.6 and by[40].posteriors["junk"] > 0.6
    assert by[None].n_tokens == 0 and by[0].n_tokens == 5
    kept = M.mixed(docs, labels, {"prose": 0.8, "junk": 0.2, "toxic": 0.0}, lean=1.02)
    assert kept.columns == docs.columns and 20 < kept.count() <= len(texts)
    assert M.mix_sources(docs.limit(0), labels).count() == 0
    assert M.mix_sources(docs, labels.limit(0)).count() == len(texts)


def test_targets_are_reached_where_little_is_left_of_a_domain(spark):
    # Soft posteriors and a target far below the natural total: 25 rounds of a projected gradient ended at many times it.
    rng = np.random.default_rng(3)
    p = np.floor(rng.dirichlet([3, 1, 1], 300) * 200) / 200
    p[:, 0] += 1 - p.sum(axis=1)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(rng.integers(1, 500, 300), p, strict=True)], "n long, p array<double>")
    model = M.Mixture(["a", "b", "c"], np.zeros(3), np.zeros((3, M.BUCKETS)))
    M.fit_rates(rows, model, {"a": 0.90, "b": 0.08, "c": 0.02})
    r = rows.select("n", "p", model.rate(F.col("p")).alias("r")).collect()
    got = sum(x.n * x.r * np.array(x.p) for x in r)
    assert np.allclose(got, model.targets, rtol=1e-3) and np.allclose(got, model.reached, rtol=1e-6)
    with pytest.warns(UserWarning, match="no rates meet the targets"):
        M.fit_rates(rows, model, {"a": 0.99, "b": 0.005, "c": 0.005}, max_rate=1.0)
    M.fit_rates(rows, model, {"a": 0.9, "b": 0.08, "c": 0.02}, max_rate=1.0, reach=True)
    assert 0 < model.targets.sum() and np.abs(model.reached - model.targets).max() <= 0.002 * model.targets.sum()


def test_temperature_lies_inside_its_range():
    rng = np.random.default_rng(4)
    d = rng.integers(0, 2, 4000)
    z = np.stack([np.zeros(4000), rng.normal(0, 1, 4000)], axis=1)
    z[:, 1] += np.where(d == 1, 0.5, -0.5)
    assert M.best_temperature(z * 500, d) == pytest.approx(500, rel=0.5)
    assert M.best_temperature(z / 50, d) == pytest.approx(1 / 50, rel=0.5)
