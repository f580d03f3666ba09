"""Quality: positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import batches_of
from inkframe.llm.labelled import FUNCTION_WORDS, fold, sigmoid

#: Trusted positives, and unlabelled documents, that the model is fitted on at most.
POSITIVES = 4000
UNLABELLED = 8000
HIDDEN = 16
_KNOWN = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws.split())
_MARKS = "!?.,;:*%#&$|<>{}()[]/\\=_-+~^@\"'"
_LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str) -> list[float]:
    """Shape of a whole text: rates of marks, cases and digits, repetition of
    words, pairs and lines, word and line lengths, function words."""
    n = len(text)
    words = text.split()
    m = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    bare = [w.strip(_MARKS).lower() for w in words]
    counts = Counter(bare)
    pairs = len(set(zip(bare, bare[1:], strict=False)))
    upper = sum(map(str.isupper, text))
    letters = sum(map(len, _LETTERS.findall(text)))
    digits = sum(text.count(d) for d in "0123456789")
    packed = len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1))
    lens = np.array([len(w) for w in words] or [0], float)
    ends = Counter(w[-1] for w in words)
    nn, mm = max(n, 1), max(m, 1)
    out = [np.log1p(n), np.log1p(m), lens.mean(), lens.std(), lens.max()]
    out += [upper / max(letters, 1), letters / nn, digits / nn, text.count(" ") / nn, len(lines) / mm]
    out += [len(counts) / mm, pairs / max(m - 1, 1), max(counts.values(), default=0) / mm, len(set(lines)) / max(len(lines), 1)]
    out += [sum(map(str.isupper, words)) / mm, sum(map(str.istitle, words)) / mm, sum(w in _KNOWN for w in bare) / mm]
    out += [sum(not w for w in bare) / mm, sum(ends[c] for c in _MARKS) / mm, packed / nn, len(counts) / mm**0.5]
    out += [text.count(c) / mm for c in _MARKS]
    return out


@dataclass
class Perceptron:
    """Standardised features, one hidden layer, one logistic unit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.logits(np.array([features(t) for t in texts], float).reshape(-1, len(self.mean))))


def fit_risk(xp: np.ndarray, xu: np.ndarray, prior: float | None, epochs: int = 60, batch: int = 256, rate: float = 0.01, seed: int = 3) -> Perceptron:
    """Adam on the logistic loss l: with a prior p, the non-negative risk
    p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]), where a batch that makes the
    second part negative takes a step against it; with none, positives against
    unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([xp, xu])
    d = both.shape[1]
    net = Perceptron(
        both.mean(axis=0), both.std(axis=0) + 1e-3, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1), 0.5 if prior is None else prior,
    )
    params = [net.w1, net.b1, net.w2, net.b2]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    zp, zu = (np.clip((x - net.mean) / net.scale, -6, 6) for x in (xp, xu))
    step, rounds = 0, max(1, min(60, -(-len(xu) // batch)))
    for _ in range(epochs):
        for _ in range(rounds):
            p = zp[rng.integers(0, len(zp), batch)]
            u = zu[rng.integers(0, len(zu), batch)]
            x = np.concatenate([p, u])
            h = np.tanh(x @ net.w1 + net.b1)
            g = h @ net.w2 + net.b2[0]
            s = sigmoid(g)
            gp, gu = s[:batch], s[batch:]
            if prior is None:
                dg = np.concatenate([gp - 1, gu]) / (2 * batch)
            else:
                loss = np.logaddexp(0, g)  # l(-g)
                rest = loss[batch:].mean() - prior * loss[:batch].mean()
                if rest >= 0:
                    dg = np.concatenate([prior * (gp - 1) - prior * gp, gu]) / batch
                else:
                    dg = -np.concatenate([-prior * gp, gu]) / batch
            dh = dg[:, None] * net.w2 * (1 - h * h)
            grads = [x.T @ dh + 1e-3 * net.w1, dh.sum(axis=0), h.T @ dg + 1e-3 * net.w2, np.array([dg.sum()])]
            step += 1
            lr = rate * min(1.0, 3 * (1 - step / (epochs * rounds + 1)))
            for q, gr, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (gr - m)
                v += 0.001 * (gr * gr - v)
                q -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def class_prior(sp: np.ndarray, su: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among unlabelled scores, by the best top bin: the
    least ratio of how much of the unlabelled and of the positives lies above a
    cut, each with its sampling error added or taken off."""
    slack = [(np.log(4 / delta) / (2 * len(s))) ** 0.5 for s in (sp, su)]
    cuts = np.quantile(sp, np.linspace(0, 0.95, 96))
    qp = np.array([(sp >= c).mean() for c in cuts])
    qu = np.array([(su >= c).mean() for c in cuts])
    bound = (qu + (slack[0] + slack[1])) / np.maximum(qp, 1e-9)
    k = int(np.argmin(bound))
    return float(np.clip(qu[k] / qp[k], 0.05, 0.99))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", text_col: str = "text") -> Perceptron:
    """Trusted positives are documents labelled 1 outside fold 0; unlabelled
    ones are drawn from all documents outside fold 0, labelled or not, without
    looking at labels. Both samples are bounded and have the smallest hashes.
    The class prior is estimated on halves that the ranking model has not seen."""
    def run(batches):
        for batch in batches_of(batches):
            xs = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(xs, pa.list_(pa.float64()))], ["id", "y", "x"])

    learnt = docs.where(fold(id_col) != 0).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    trusted = labels.where((F.col(label) == 1) & (fold(id_col) != 0)).select(F.col(id_col).alias("id")).distinct()
    trusted = F.broadcast(trusted.orderBy(F.xxhash64("id"), "id").limit(positives))  # bounded by ``positives``
    web = F.broadcast(learnt.select("id").orderBy(F.xxhash64("id", F.lit(9)), "id").limit(unlabelled).distinct())  # likewise
    drawn = learnt.join(trusted, "id").withColumn("y", F.lit(1)).unionByName(learnt.join(web, "id").withColumn("y", F.lit(0)))
    rows = sorted(drawn.select("id", "t", "y").mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, y int, x array<double>").collect(), key=lambda r: (r.y, r.id, r.x))
    dims = len(features(""))
    xp = np.array([r.x for r in rows if r.y == 1], float).reshape(-1, dims)
    xu = np.array([r.x for r in rows if r.y == 0], float).reshape(-1, dims)
    if not len(xp) or not len(xu):
        return fit_risk(np.zeros((1, dims)), np.zeros((1, dims)), 0.5, epochs=1)
    rng = np.random.default_rng(1)
    hp, hu = rng.random(len(xp)) < 0.5, rng.random(len(xu)) < 0.5
    hp[:1], hu[:1], hp[-1:], hu[-1:] = True, True, len(xp) == 1, len(xu) == 1
    found = []
    for a, b in ((hp, hu), (~hp, ~hu)):
        if a.any() and b.any() and (~a).any() and (~b).any():
            rank = fit_risk(xp[a], xu[b], None, epochs=25)
            found.append(class_prior(rank.logits(xp[~a]), rank.logits(xu[~b])))
    return fit_risk(xp, xu, float(np.mean(found)) if found else 0.5)
