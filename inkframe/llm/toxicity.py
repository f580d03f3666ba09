"""Toxicity: a convolutional text classifier over hashed words, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import batches_of, discard, fresh, materialise
from inkframe.llm.decontaminate import words_of
from inkframe.llm.labelled import fold, labelled_rows, languages_of, sigmoid

#: Fitted documents, and bytes of their coded words, to a shard: what a task holds.
SHARD_DOCS, SHARD_BYTES = 4096, 32 << 20
ROUNDS = 2  # over all shards, each starting from the average of the shards' networks
RATE, ROUND_RATE = 0.01, 0.003  # Adam's, of the first shard's fit and of the rounds
PIECE = 1 << 14  # parameters that are averaged by one task
BUCKETS = 1 << 15
PARTS = 3  # hashes to a word: the word and its first 4 and 5 bytes
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
SHRINK = 20  # documents that the common threshold weighs as, against a language's own
LEAST_DOCS = 3  # a bucket that fewer fitted documents hold has no embedding
BLOCK = 1 << 16  # words that are convolved at once


def word_buckets(word: bytes) -> tuple[int, int, int]:
    """Bucket 0 is for padding and for what was not seen in fitting."""
    return tuple(1 + zlib.crc32(x) % (BUCKETS - 1) for x in (word, b"4" + word[:4], b"5" + word[:5]))


def buckets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Buckets of all words, where each text ends, and the texts' languages."""
    seen: dict[bytes, int] = {}
    at, ends = [], []
    for t in texts:
        words = words_of(t)
        at += [seen.setdefault(w, len(seen)) for w in words]
        ends.append(len(at))
    table = np.array([word_buckets(w) for w in seen], np.int32).reshape(-1, PARTS)
    at = np.array(at, np.int64)
    return table[at], np.array(ends, np.int64), languages_of(seen, at, starts_of(ends), ends)


def starts_of(ends) -> list[int]:
    return [0, *(int(e) for e in ends[:-1])][: len(ends)]


@dataclass
class Network:
    """Sum of embeddings, convolutions, ReLU, max pooling, one logistic unit."""

    embed: np.ndarray
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)  # logits by language
    prior: float = 0.0  # share of toxic labels

    def pooled(self, buckets: np.ndarray) -> np.ndarray:
        """Features of one text of any length, a block at a time."""
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        pad = max(WIDTHS) - 1
        for k in range(0, len(buckets), BLOCK):
            part = buckets[k : k + BLOCK + pad]
            x = self.embed[part].sum(axis=1)
            x = np.concatenate([x, np.zeros((pad, DIM), np.float32)]) if k + BLOCK >= len(buckets) else x
            for i, w in enumerate(WIDTHS):
                n = len(x) - w + 1
                conv = sum(x[j : j + n] @ self.filters[i][j] for j in range(w)) + self.biases[i]
                s = slice(i * FILTERS, (i + 1) * FILTERS)
                best[s] = np.maximum(best[s], conv.max(axis=0))
        return best

    def logits(self, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
        feats = [self.pooled(buckets[a:b]) for a, b in zip(starts_of(ends), ends.tolist(), strict=True)]
        return np.array(feats, np.float32).reshape(-1, len(self.out)) @ self.out + self.out_bias

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities, shifted so that each language's threshold is 0.5. A text
        none of whose words was seen in fitting (one without words, too) gives no
        evidence: its score is the share of toxic labels."""
        buckets, ends, langs = buckets_of(texts)
        shift = np.array([self.thresholds.get(lang, self.thresholds.get("", 0.0)) for lang in langs])
        seen = np.concatenate([[0], np.cumsum(self.embed.any(axis=1)[buckets].any(axis=1))])
        evidence = seen[ends] - seen[starts_of(ends)]
        return np.where(evidence > 0, sigmoid(self.logits(buckets, ends).astype(np.float64) - shift), self.prior)


def shapes_of(active: np.ndarray) -> list[tuple[int, ...]]:
    """Of the parameters: an embedding of each active bucket after one of zeros
    for all others, the filters and biases, the unit's weights and bias."""
    return [(1 + int(active.sum()), DIM), *((w, DIM, FILTERS) for w in WIDTHS), *((FILTERS,) for _ in WIDTHS), (len(WIDTHS) * FILTERS,), (1,)]


def split(flat: np.ndarray, active: np.ndarray) -> list[np.ndarray]:
    shapes = shapes_of(active)
    cuts = np.cumsum([np.prod(x) for x in shapes])[:-1]
    return [x.reshape(shape).copy() for x, shape in zip(np.split(flat, cuts), shapes, strict=True)]


def joined(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params]).astype(np.float32)


def first_guess(active: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    scales = [0.1, *((2 / (w * DIM)) ** 0.5 for w in WIDTHS), *(0 for _ in WIDTHS), 0.3, 0]
    params = [rng.normal(0, scale, shape) if scale else np.zeros(shape) for shape, scale in zip(shapes_of(active), scales, strict=True)]
    params[0][0] = 0
    return joined(params)


def network(flat: np.ndarray, active: np.ndarray) -> Network:
    embed, *rest, out, bias = split(flat, active)
    return Network(embed[np.cumsum(active) * active], rest[: len(WIDTHS)], rest[len(WIDTHS) :], out, float(bias[0]))


def peaks(embed: np.ndarray, filters: list, biases: list, flat: np.ndarray, starts: list[int], ends: list[int]) -> tuple[list, list]:
    """Each filter's largest value in each text, before the ReLU, and where its
    window starts in ``flat``; of texts of any length, a block at a time. Texts
    lie between ``starts`` and ``ends``, padding after them included."""
    raw = [np.full((len(ends), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
    places = [np.zeros((len(ends), FILTERS), np.int64) for _ in WIDTHS]
    columns = np.arange(FILTERS)
    for k in range(0, len(flat), BLOCK):
        x = embed[flat[k : k + BLOCK + max(WIDTHS) - 1]].sum(axis=1)
        here = [t for t, (a, b) in enumerate(zip(starts, ends, strict=True)) if a < k + BLOCK and b > k]
        for i, w in enumerate(WIDTHS):
            n = min(BLOCK, len(x) - w + 1)
            if n <= 0:
                continue
            conv = sum(x[j : j + n] @ filters[i][j] for j in range(w)) + biases[i]
            for t in here:
                low, high = max(starts[t], k), min(ends[t] - w + 1, k + n)
                if low < high:
                    part = conv[low - k : high - k]
                    best = part.argmax(axis=0)
                    value = part[best, columns]
                    more = value > raw[i][t]
                    raw[i][t][more], places[i][t][more] = value[more], (low + best)[more]
    return raw, places


def train(flat: np.ndarray, active: np.ndarray, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, rng: np.random.Generator, batch: int = 32) -> np.ndarray:
    """Adam on the weighted logistic loss, from the parameters ``flat``."""
    params = split(flat, active)
    embed, filters, biases, (out, bias) = params[0], params[1 : 1 + len(WIDTHS)], params[1 + len(WIDTHS) : -2], params[-2:]
    # Row 0 stands for all buckets without an embedding; the others lie close together.
    row_of = (np.cumsum(active) * active).astype(np.int32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    pad = np.zeros((max(WIDTHS) - 1, PARTS), np.int32)
    step = 0
    for _ in range(epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            ids = np.concatenate([x for i in some for x in (row_of[docs[i]], pad)])
            ends = np.cumsum([len(docs[i]) + len(pad) for i in some]).tolist()
            raw, places = peaks(embed, filters, biases, ids, starts_of(ends), ends)
            raw = np.concatenate(raw, axis=1)
            keep = (rng.random(raw.shape) > 0.1) / 0.9
            h = np.maximum(raw, 0) * keep
            p = sigmoid(h @ out + bias[0])
            dz = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)
            grads = [np.zeros_like(q) for q in params]
            grads[-2][:] = h.T @ dz
            grads[-1][0] = dz.sum()
            dh = (dz[:, None] * out * (raw > 0) * keep).astype(np.float32)
            for i, w in enumerate(WIDTHS):
                g = dh[:, i * FILTERS : (i + 1) * FILTERS]
                grads[1 + len(WIDTHS) + i][:] = g.sum(axis=0)
                for j in range(w):
                    at = ids[places[i] + j]
                    grads[1 + i][j] = np.einsum("bf,bfd->df", g, embed[at].sum(axis=2))
                    dx = g[:, :, None] * filters[i][j].T[None]
                    for part in range(PARTS):
                        np.add.at(grads[0], at[:, :, part], dx)
            grads[0] += 1e-4 * embed
            grads[0][0] = 0
            step += 1
            for q, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return joined(params)


def epochs_of(n: int, batch: int = 32) -> int:
    """Four passes over the documents, or more (twelve at most) to make 600 steps."""
    return int(np.clip(600 * batch // max(1, n), 4, 12))


def class_weights(y: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """Both classes weigh the same."""
    return np.where(y == 1, 0.5 / max(1, ones), 0.5 / max(1, zeros)) * (ones + zeros)


def fit_network(docs: list[np.ndarray], y: np.ndarray, batch: int = 32, rate: float = RATE, seed: int = 7) -> Network:
    """The fit of one shard, which holds all documents."""
    held = np.zeros(BUCKETS, np.int64)
    for d in docs:
        held[np.unique(d)] += 1
    active = held >= LEAST_DOCS
    active[0] = False
    weight = class_weights(y, int((y == 1).sum()), int((y == 0).sum()))
    rng = np.random.default_rng(seed)
    return network(train(first_guess(active, rng), active, docs, y, weight, epochs_of(len(docs), batch), rate, rng, batch), active)


def fit_shard(flat: np.ndarray, active: np.ndarray, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, shard: int, nth: int, seed: int) -> np.ndarray:
    """What a shard makes of ``flat``: its own fit in round 0, then one pass."""
    if nth:
        return train(flat, active, docs, y, weight, 1, ROUND_RATE / nth, np.random.default_rng([seed, nth, shard]))
    rng = np.random.default_rng(seed)
    return train(first_guess(active, rng), active, docs, y, weight, epochs_of(len(docs)), RATE, rng)


def fit_shards(fit: DataFrame, shard_docs: int, shard_bytes: int, rounds: int = ROUNDS, seed: int = 7) -> Network:
    """The network fitted on every row of ``fit`` (id, y, b), in shards by a hash.

    The first shard's fit is only where the rounds start from: in each, every
    shard makes a pass over its documents from the network so far, and the
    average of the shards' parameters, weighted by documents, is the next
    network. Where all fits one shard, its fit is the result.
    """
    spark = fit.sparkSession

    def held(batches):
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in batch.column(0):
                n[np.unique(np.frombuffer(b.as_py(), "<u2"))] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    stats = {r.y: r for r in fit.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("b")).alias("size")).collect()}
    ones, zeros = (stats[k].n if k in stats else 0 for k in (1, 0))
    active = np.zeros(BUCKETS, bool)
    common = fit.select("b").mapInArrow(held, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    active[[r.bucket for r in common.collect()]] = True  # BUCKETS rows at most
    active[0] = False
    shards = max(1, -(-(ones + zeros) // shard_docs), -(-sum(r.size for r in stats.values()) // shard_bytes))
    sharded = fit.withColumn("shard", F.pmod(F.xxhash64("id", "b"), F.lit(shards)))

    def passed(rows: DataFrame, flat: np.ndarray, nth: int) -> np.ndarray:
        """The average of the networks that the rows' shards make of ``flat``."""
        shared = spark.sparkContext.broadcast((flat, active))  # of fixed size, 2 MB

        def run(table):
            table = table.sort_by([("id", "ascending"), ("b", "ascending")])
            docs = [np.frombuffer(b.as_py(), "<u2").reshape(-1, PARTS) for b in table["b"]]
            y, shard = table["y"].to_numpy(), table["shard"][0].as_py()
            made = fit_shard(*shared.value, docs, y, class_weights(y, ones, zeros), shard, nth, seed)
            pieces = [made[k : k + PIECE].astype("<f4").tobytes() for k in range(0, len(made), PIECE)]
            n = len(pieces)
            return pa.table({"piece": pa.array(range(n), pa.int32()), "shard": pa.array([shard] * n, pa.int64()), "n": pa.array([len(docs)] * n, pa.int64()), "w": pa.array(pieces, pa.binary())})

        def average(table):
            table = table.sort_by("shard")
            total = sum(n * np.frombuffer(w.as_py(), "<f4").astype(np.float64) for n, w in zip(table["n"].to_pylist(), table["w"], strict=True))
            mean = (total / sum(table["n"].to_pylist())).astype("<f4").tobytes()
            return pa.table({"piece": table["piece"][:1], "w": pa.array([mean], pa.binary())})

        nets = rows.groupBy("shard").applyInArrow(run, "piece int, shard long, n long, w binary")
        found = nets.groupBy("piece").applyInArrow(average, "piece int, w binary").collect()
        shared.unpersist()
        return np.frombuffer(b"".join(bytes(r.w) for r in sorted(found, key=lambda r: r.piece)), "<f4") if found else flat

    flat = passed(sharded.where("shard = 0"), first_guess(active, np.random.default_rng(seed)), 0)
    for nth in range(1, 1 + rounds * (shards > 1)):
        flat = passed(sharded, flat, nth)
    return network(flat, active)


def best_threshold(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best F1."""
    order = np.argsort(logits)
    z, hit, w = logits[order], y[order] == 1, weight[order]
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gaps = np.concatenate([[0], z[1:] - z[:-1], [0]])
    tp = (w * hit).sum() - np.concatenate([[0], np.cumsum(w * hit)])
    fp = (w * ~hit).sum() - np.concatenate([[0], np.cumsum(w * ~hit)])
    f1 = 2 * tp / np.maximum(tp + fp + (w * hit).sum(), 1e-12)
    good = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(cuts[good[np.argmax(gaps[good])]])


def calibrate(net: Network, docs, y: np.ndarray, langs: list[str], share: float) -> None:
    """Thresholds from the buckets of documents, see ``set_thresholds``."""
    z = net.logits(np.concatenate(docs), np.cumsum([len(d) for d in docs])).astype(np.float64) if len(docs) else np.zeros(0)
    set_thresholds(net, z, y, np.ones(len(z)), langs, share)


def set_thresholds(net: Network, z: np.ndarray, y: np.ndarray, n: np.ndarray, langs: list[str], share: float) -> None:
    """A threshold on the logit for all documents (""), and one for each
    language with labelled documents of both classes: its own best cut, drawn
    towards the common one as if that had SHRINK documents of its rarer class.
    ``n`` documents each have the logit, label and language."""
    if len(set(y.tolist())) < 2:
        net.thresholds = {"": 0.0}
        return
    weight = n * np.where(y == 1, share / n[y == 1].sum(), (1 - share) / n[y == 0].sum())  # as frequent as in the labels
    net.thresholds = {"": best_threshold(z, y, weight)}
    for lang in sorted(set(langs)):
        here = np.array([x == lang for x in langs])
        rarer = int(min(n[here & (y == 1)].sum(), n[here & (y == 0)].sum()))
        if rarer:
            own = best_threshold(z[here], y[here], weight[here])
            net.thresholds[lang] = (rarer * own + SHRINK * net.thresholds[""]) / (rarer + SHRINK)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> Network:
    """Fit on every labelled document outside fold 0, whole texts, in executors:
    a sixth of them, by a hash, calibrates a threshold for each language (logits
    are counted in thousandths), and the network is fitted on all others, see
    ``fit_shards``. The driver holds networks and counts alone. Null ids and
    labels that are null or disagree are left out; with no labels all scores are
    finite and alike."""

    def encode(batches):
        for batch in batches_of(batches):
            buckets, ends, langs = buckets_of(batch.column(1).to_pylist())
            parts = [buckets[a:b].astype("<u2").tobytes() for a, b in zip(starts_of(ends), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["id", "y", "lang", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = labelled_rows(docs, labels, label, fold(id_col) != 0, id_col, text_col)
    coded = materialise(rows.mapInArrow(encode, f"id {kind}, y int, lang string, b binary"), "toxicity-coded")
    aside = F.pmod(F.xxhash64("id"), F.lit(6)) == 0
    share = labels.where((fold(id_col) != 0) & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    net = fit_shards(coded.where(~aside).select("id", "y", "b"), shard_docs, shard_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def logits(batches):
        for batch in batches_of(batches):
            some = [np.frombuffer(b.as_py(), "<u2").reshape(-1, PARTS) for b in batch.column(2)]
            z = shared.value.logits(np.concatenate([np.zeros((0, PARTS), "<u2"), *some]), np.cumsum([len(d) for d in some], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(z * 1000).astype(np.int64), pa.int64())], ["y", "lang", "z"])

    found = coded.where(aside).select("y", "lang", "b").mapInArrow(logits, "y int, lang string, z long").groupBy("y", "lang", "z").agg(F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r.z, r.y, r.lang))
    z, y, n = (np.array([r[k] for r in found], kind) for k, kind in (("z", float), ("y", np.int64), ("n", float)))
    set_thresholds(net, z / 1000, y, n, [r.lang for r in found], share or 0.0)
    net.prior = share or 0.0
    discard(coded)
    return net


def score_column(docs: DataFrame, model, text: Column) -> Column:
    """The model's score of the whole text, as a column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches_of(batches):
            yield pa.array(shared.value.score([t or "" for t in batch.to_pylist()]), pa.float64())

    return F.arrow_udf(run, "double")(text)


def score_documents(docs: DataFrame, model, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score and predicted.

    Scores depend on the text alone: its language is guessed from its function
    words. Null texts are empty and are scored like them; a null id counts as
    held out. Repeated rows each give a row; ids may be of any type; other
    columns are not read; an empty table gives no rows.
    """
    out = docs.select(F.col(id_col), score_column(docs, model, F.col(text_col)).alias("score"))
    held = F.coalesce(fold(id_col) == 0, F.lit(True))
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def non_toxic(docs: DataFrame, model, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose texts the model scores under ``cut``."""
    name = fresh("__score", docs.columns)
    return docs.withColumn(name, score_column(docs, model, F.col(text_col))).where(F.col(name) < cut).select(*docs.columns)
