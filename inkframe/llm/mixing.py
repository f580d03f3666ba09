"""Mixing sources to target weights by soft domain membership.

A logistic regression on hashed features, fitted to a labelled sample, gives
each document posteriors of the domains. A nonnegative rate is then fitted to
every document such that the domains' expected token totals match the targets.
DataFrame operations only on the documents; a document's rate is a function of
its posteriors and of one multiplier a domain, so none of their rows moves.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import fresh, materialise

#: Labelled documents that the classifier is fitted to at most.
SAMPLE = 20_000
BUCKETS = 4096
LEAST_DOCS = 3  # a bucket that fewer labelled documents hold has no weight
GRID = 200  # posteriors are multiples of 1 / GRID
BROADCAST_LABELS = 1_000_000  # labelled documents (12 bytes each) that are broadcast at most
ROUNDS = 200  # Newton steps at each weight of the penalty at most
MISSED = 0.01  # a total off its target by more than this share of all is reported

#: The domains of the labelled table, told by its two labels.
DOMAINS = {"prose": "quality = 1 and toxic = 0", "junk": "quality = 0", "toxic": "quality = 1 and toxic = 1"}
#: Production parameters: shares of the domains in the mixture's tokens.
TARGETS = {"prose": 0.90, "junk": 0.08, "toxic": 0.02}


def shapes(text: Column) -> Column:
    """The shapes of the words between white space, in order: runs of capitals
    and digits, and of letters, are folded to a sign each."""
    folded = F.regexp_replace(F.regexp_replace(text, r"[\p{Lu}\p{N}]{2,}", "1"), r"\p{L}+", "a")
    return F.array_remove(F.split(folded, r"\s+"), "")


def buckets(text: Column, shape: Column) -> Column:
    """Distinct hashed features: lower-cased words and the shapes of words."""
    words = F.array_distinct(F.split(F.lower(text), r"[\s\p{Punct}]+"))

    def hashed(kind):
        return lambda w: (F.pmod(F.xxhash64(F.lit(kind), w), F.lit(BUCKETS)) + 1).cast("int")

    return F.array_distinct(F.concat(F.transform(words, hashed(0)), F.transform(F.array_distinct(shape), hashed(2))))


def _literal(values, digits: int = 9) -> Column:
    """An array of doubles that the optimizer folds into one constant."""
    return F.split(F.lit(",".join(f"{float(v):.{digits}g}" for v in values)), ",").cast("array<double>")


@dataclass
class Mixture:
    domains: list[str]
    log_prior: np.ndarray
    weights: np.ndarray  # (domains, BUCKETS)
    temperature: float = 1.0
    multipliers: np.ndarray | None = None  # what a unit of each posterior takes off a rate
    max_rate: float | None = None
    targets: np.ndarray | None = None
    natural: np.ndarray | None = None
    reached: np.ndarray | None = None

    def scores(self, feats: Column) -> Column:
        """Log-odds of each domain, up to a constant."""

        def total(prior, weights):
            table = _literal(weights, 4)
            return F.aggregate(feats, F.lit(float(prior)), lambda acc, b: acc + F.element_at(table, b))

        # Only differences count: the last domain's score is set to 0.
        first = map(total, self.log_prior[:-1] - self.log_prior[-1], self.weights[:-1] - self.weights[-1])
        return F.array(*first, F.lit(0.0))

    def posteriors(self, scores: Column) -> Column:
        """On a grid of 1 / GRID; the likeliest domain gets what rounding leaves."""
        z = F.transform(scores, lambda s: (s - F.array_max(scores)) / self.temperature)
        e = F.transform(z, lambda x: F.exp(x))
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        p = F.transform(e, lambda x: F.floor(x / total * GRID).cast("int"))
        left = F.lit(GRID) - F.aggregate(p, F.lit(0), lambda a, x: a + x)
        top = F.array_position(p, F.array_max(p))
        return F.transform(p, lambda x, i: (x + F.when(i + 1 == top, left).otherwise(0)).cast("double") / GRID)

    def rate(self, posterior: Column) -> Column:
        """1 less the posteriors' multipliers, held at 0 or more and at
        ``max_rate`` or less."""
        if self.multipliers is None:
            return F.lit(1.0)
        along = F.aggregate(F.zip_with(posterior, _literal(self.multipliers, 17), lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
        r = F.greatest(F.lit(0.0), F.lit(1.0) - along)
        return r if self.max_rate is None else F.least(F.lit(float(self.max_rate)), r)


def copies_of(rate: Column, key: Column, seed: int = 17) -> Column:
    """The rate's whole part, and one more with the probability of the rest,
    drawn by a hash of the key: the same in every run and retry."""
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def domain_labels(labels: DataFrame, domains: dict[str, str], id_col: str) -> DataFrame:
    """``__id`` and ``__d``, the number of its domain; labels that are null or
    disagree within one id are left out."""
    which = F.coalesce(*[F.when(F.expr(cond), i) for i, cond in enumerate(domains.values())])
    one = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), which.alias("__d")).where("__d is not null")
    return one.groupBy("__id").agg(F.min("__d").alias("__d"), F.max("__d").alias("__e")).where("__d = __e").select("__id", "__d")


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: dict[str, str], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Mixture:
    """Fits a logistic regression to a labelled sample of at most ``sample``
    documents (those with the smallest id hashes). Labels that are null or
    disagree are left out. The posteriors' temperature is the one with the least
    logistic loss on every fifth document, which is not fitted on."""
    names, one = list(domains), domain_labels(labels, domains, id_col)
    drawn = F.broadcast(one.orderBy(F.xxhash64("__id"), "__id").limit(sample))  # bounded by ``sample``
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(5)) == 0
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__t")).join(drawn, "__id").withColumn("__w", shapes(F.col("__t")))
    rows = rows.select("__d", held.alias("held"), F.xxhash64("__id", "__t").alias("k"), buckets(F.col("__t"), F.col("__w")).alias("b"))
    got = rows.toArrow()  # ``sample`` documents' features, in Arrow
    got = got.take(np.lexsort((got["k"].to_numpy(),)))
    feats = got["b"].combine_chunks()
    sizes, at = feats.value_lengths().to_numpy(zero_copy_only=False), feats.flatten().to_numpy() - 1
    d, held = got["__d"].to_numpy(), got["held"].to_numpy(zero_copy_only=False).astype(bool)
    each = np.repeat(held, sizes)
    n = np.bincount(d[~held], minlength=len(names)).astype(float)
    model = Mixture(names, np.log((n + 1) / (n.sum() + len(names))), np.zeros((len(names), BUCKETS)))
    if n.sum():
        fit_weights(model, at[~each], sizes[~held], d[~held])
    if held.any():
        z = scores_of(model, at[each], sizes[held])
        model.temperature = best_temperature(z, d[held])
    return model


def sums_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run may be empty."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def scores_of(model: Mixture, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return sums_by(model.weights.T[at], sizes) + model.log_prior


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit_weights(model: Mixture, at: np.ndarray, sizes: np.ndarray, d: np.ndarray, epochs: int = 30, batch: int = 128, step: float = 0.01, decay: float = 3e-3) -> None:
    """Adam on the logistic loss; ``at`` holds the documents' features one
    after another, ``sizes`` how many each has."""
    k = len(model.domains)
    rng = np.random.default_rng(11)
    active = np.bincount(at, minlength=BUCKETS) >= LEAST_DOCS
    starts = np.cumsum(sizes) - sizes
    w, first, second = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    t, most = 0, epochs * -(-len(d) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(d))
        for i in range(0, len(d), batch):
            some = order[i : i + batch]
            x = np.concatenate([at[starts[j] : starts[j] + sizes[j]] for j in some])
            p = np.exp(log_softmax(sums_by(w[x], sizes[some]) + model.log_prior))
            p[np.arange(len(some)), d[some]] -= 1
            each = np.repeat(p / len(some), sizes[some], axis=0)
            g = np.stack([np.bincount(x, each[:, c], BUCKETS) for c in range(k)], axis=1) * active[:, None] + decay * w
            t += 1
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            w -= step * (1 - t / (most + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    model.weights = w.T.copy()


def best_temperature(z: np.ndarray, d: np.ndarray) -> float:
    """The power of the square root of 2 with the least loss, sought outwards
    until the loss rises on both sides (or no more than rounding is left)."""

    def loss(e):
        return -log_softmax(z / 2 ** (e / 2))[np.arange(len(d)), d].mean()

    best = 0
    for way in (1, -1):
        while abs(best) < 40 and loss(best + way) < loss(best):
            best += way
    return 2 ** (best / 2)


def solve(p: np.ndarray, n: np.ndarray, targets: np.ndarray, d: np.ndarray, top: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The multipliers and totals of the rates in [0, top] that minimise the
    squares of (totals - targets), divided by ``d``, and of rates so close to
    1 among them. The dual of the problem with a small penalty on (rate - 1)
    is convex, with one variable a domain; Newton's method runs until its
    gradient is zero, for smaller and smaller penalties."""
    whole = max(1.0, n.sum())
    n, t, d = n / whole, targets / whole, d / whole
    x = np.zeros(len(t))

    def dual(x, eps):
        u = 1 - p @ x
        c = np.clip(u, 0, top)
        value = 0.5 * eps * (d * x * x).sum() + t @ x + (n * (u * c - 0.5 * c * c)).sum()
        return value, eps * d * x + t - (n * c) @ p, (u > 0) & (u < top)

    for eps in 10.0 ** -np.arange(0, 8):
        for _ in range(rounds):
            value, slope, free = dual(x, eps)
            if np.abs(slope).max() <= 1e-10:
                break
            q = p[free] * n[free, None] ** 0.5
            move = np.linalg.solve(q.T @ q + eps * np.diag(d), slope)
            size = 1.0
            while size > 1e-12 and dual(x - size * move, eps)[0] > value - 1e-4 * size * (slope @ move):
                size /= 2
            if size <= 1e-12:  # no lower value in floating point
                break
            x = x - size * move
        if np.abs(dual(x, eps)[1]).max() > 1e-6:
            raise RuntimeError(f"rates did not settle in {rounds} rounds")
    return x, (n * np.clip(1 - p @ x, 0, top)) @ p * whole


def fit_rates(members: DataFrame, model: Mixture, weights: dict[str, float], total: float | None = None, max_rate: float | None = None, lean: float = 1.0, reach: bool = False, rounds: int = ROUNDS) -> Mixture:
    """Least squares: rates r >= 0 that minimise the weighted squares of
    sum(r n p) - target over the domains, and of these the closest to 1.

    ``members`` has n and p (posteriors). Documents of the same posteriors have
    the same rate, so they are first summed by posterior: as many sums as
    points on the grid at most, on which the driver solves the problem to its
    optimum. ``total`` is the tokens of the mixture: those of the documents by
    default, or, with ``max_rate``, as many as the domain with the largest share
    allows at that rate, times ``lean``. With ``reach`` it is lowered to the
    largest total at which all targets are met. Targets that the rates miss by
    over 1 % of the total give a warning.
    """
    k = len(model.domains)
    cells = members.groupBy("p").agg(F.sum("n").cast("double").alias("n")).where("n > 0").toArrow()
    n = cells["n"].to_numpy()
    p = cells["p"].combine_chunks().flatten().to_numpy().reshape(-1, k)
    order = np.lexsort(p.T)
    n, p = n[order], p[order]
    natural = n @ p
    share = np.array([weights[d] for d in model.domains], float)
    share /= share.sum()
    model.max_rate, model.natural, model.multipliers = max_rate, natural, None
    if total is None and max_rate is None:
        total = float(natural.sum())
    elif total is None:
        most = int(np.argmax(share))
        total = lean * float(natural[most]) * max_rate / share[most]
    model.targets, model.reached = share * total, natural
    if not natural.sum():
        return model
    d = np.maximum((n[:, None] * p * p).sum(axis=0), 1e-9 * max(1.0, natural.sum()))
    top = np.inf if max_rate is None else float(max_rate)
    model.multipliers, model.reached = solve(p, n, model.targets, d, top, rounds)
    if reach and missed(model) > MISSED / 10:
        low, high = 0.0, total
        for _ in range(20):
            total = (low + high) / 2
            model.targets = share * total
            model.multipliers, model.reached = solve(p, n, model.targets, d, top, rounds)
            low, high = (low, total) if missed(model) > MISSED / 10 else (total, high)
        if low:
            model.targets = share * low
            model.multipliers, model.reached = solve(p, n, model.targets, d, top, rounds)
    if missed(model) > MISSED:
        said = ", ".join(f"{x} {a:.0f} of {b:.0f}" for x, a, b in zip(model.domains, model.reached, model.targets, strict=True))
        warnings.warn(f"no rates meet the targets; tokens reached: {said}", stacklevel=2)
    return model


def missed(model: Mixture) -> float:
    """The largest distance from a target, as a share of all targets."""
    return float(np.abs(model.reached - model.targets).max() / max(model.targets.sum(), 1e-9))


def members_of(docs: DataFrame, model: Mixture, text: Column, k: str) -> DataFrame:
    """docs with ``n`` and ``p``, the tokens and posteriors of the text; ``k``
    stands in front of all names that are added."""
    out = docs.withColumn(f"{k}w", shapes(text))
    out = out.withColumn(f"{k}b", buckets(text, F.col(f"{k}w"))).withColumn(f"{k}n", F.size(f"{k}w").cast("long")).drop(f"{k}w")
    out = out.withColumn(f"{k}s", model.scores(F.col(f"{k}b"))).drop(f"{k}b")
    return out.withColumn(f"{k}p", model.posteriors(F.col(f"{k}s"))).drop(f"{k}s")


def mix_sources(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    domains: dict[str, str] | None = None,
    max_rate: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """One row per input row: id, n_tokens, posteriors (a map by domain), rate
    and copies, the number of times that the mixture holds the document.

    ``domains`` tells each domain by a condition on the labelled table,
    ``targets`` its share of the mixture's tokens. Null texts are empty: no
    tokens, the posteriors of no features. Null ids are rows like others;
    repeated rows get the same rate and the same draw. An empty table gives no
    rows; with no labels all documents have the same posteriors.
    """
    domains, targets = domains or DOMAINS, targets or TARGETS
    model = fit_classifier(docs, labels, domains, id_col=id_col, text_col=text_col)
    text = F.coalesce(F.col("__t"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t"))
    rows = members_of(rows, model, text, "__").select("id", F.xxhash64("id", "__t").alias("key"), F.col("__n").alias("n"), F.col("__p").alias("p"))
    rows = materialise(rows, "mixing-members")
    fit_rates(rows, model, targets, max_rate=max_rate, **options)
    rate = model.rate(F.col("p"))
    names = F.array(*[F.lit(d) for d in model.domains])
    out = rows.withColumn("rate", rate)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.map_from_arrays(names, "p").alias("posteriors"), "rate", copies_of(F.col("rate"), F.col("key")).alias("copies")
    )


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domains: dict[str, str] | None = None, max_rate: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as many times as drawn.
    Documents whose domain the labels tell belong to it alone; posteriors tell
    the domains of the others."""
    columns, k = docs.columns, fresh("__m", docs.columns)
    domains = domains or DOMAINS
    model = fit_classifier(docs, labels, domains, id_col=id_col, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = F.transform(F.sequence(F.lit(0), F.lit(len(domains) - 1)), lambda i: (i == F.col(f"{k}d")).cast("double"))
    told = materialise(domain_labels(labels, domains, id_col).select(F.col("__id").alias(f"{k}id"), F.col("__d").alias(f"{k}d")), "mixing-labels")
    if told.count() <= BROADCAST_LABELS:  # else the documents are shuffled once
        told = F.broadcast(told)
    rows = members_of(docs, model, text, k).join(told, F.col(id_col) == F.col(f"{k}id"), "left")
    rows = rows.withColumn(f"{k}p", F.when(F.col(f"{k}d").isNotNull(), known).otherwise(F.col(f"{k}p"))).drop(f"{k}id", f"{k}d")
    # Written once: the fit reads tokens and posteriors alone, and the last
    # pass need not score the texts again.
    rows = materialise(rows, "mixing-members")
    fit_rates(rows.select(F.col(f"{k}n").alias("n"), F.col(f"{k}p").alias("p")), model, targets, max_rate=max_rate, **options)
    rows = rows.withColumn(f"{k}c", copies_of(model.rate(F.col(f"{k}p")), F.xxhash64(id_col, text_col)))
    rows = rows.where(F.col(f"{k}c") > 0)
    if max_rate is None or math.ceil(max_rate) > 1:
        rows = rows.withColumn(f"{k}e", F.explode(F.sequence(F.lit(1), F.col(f"{k}c"))))
    return rows.select(*columns)
