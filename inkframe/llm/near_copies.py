"""Near copies by SimHash: multi-index hashing proposes pairs, whole texts decide.

A pair at a similarity of 0.8 differs in some 9 of 64 bits, too many for balls
of all bits. But bits flip where a text's shingles are nearly undecided, so a
ball is enumerated over a segment's least certain bits only: both texts of a
pair enter the tables under every value of theirs, and meet if all bits in which
the segment differs are uncertain in one of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm.common import batches_of, discard, fresh, materialise, row_key
from inkframe.llm.hamming import components
from inkframe.llm.simhash import signed

#: Hash families, a fingerprint each; bits of each of its two segments; bits of a
#: segment that are enumerated; the distance of all families' bits up to which
#: texts are compared (99.95 of 100 pairs at a similarity of 0.8 or more are within it).
#: Share of the pairs of the test tables that meet in a table: 0.97 at a
#: similarity of 0.8 to 0.85, 0.998 at 0.85 to 0.9, 1.00 above.
FAMILIES, WIDTH, FLIPS, COMPLETE = 10, 28, 3, 120
CHUNK = 1020  # shingles whose bits are counted at once: four times what a byte can count
#: Most nodes whose texts are compared (24 bytes each), and dropped rows, that are broadcast.
BROADCAST_KEYS = 500_000
#: Pairs of a node that are compared before all others: with those it meets most
#: often, and then with the nearest.
FIRST, NEAREST = 5, 4
BROADCAST_DROPPED = 500_000
#: Nodes from which on a component is a large group, and how many of them its core is taken from.
LARGE, CORE = 64, 63


_FAMILY = np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(z: np.ndarray) -> np.ndarray:
    """Every bit of a result depends on all of its argument."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, np.uint64(0xD6E8FEB86659FD93)))


_SHORT = _powers(256)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word between white space, A-Z lower-cased."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    most = int(place.max()) + 1
    power = (_SHORT if most <= len(_SHORT) else _powers(most))[place]
    value = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * power)
    return _mixed(np.add.reduceat(value, starts))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles, A-Z
    lower-cased; of fewer words one of all of them, of none none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(shingle, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):  # a word's place counts
        out += h[k : len(h) - n + 1 + k] * (_FAMILY[k] | np.uint64(1))
    out = np.sort(_mixed(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


_ONES = np.uint64(0x0101010101010101)
_POWER = np.uint64(1) << np.arange(64, dtype=np.uint64)


def bit_counts(z: np.ndarray) -> np.ndarray:
    """How many of each row's numbers have each bit; the eighth bits are counted
    side by side in the bytes of one number, 255 numbers at a time."""
    counts = np.zeros((len(z), 8, 8), np.int64)
    starts = np.arange(0, z.shape[1], 255)
    for bit in range(8):
        part = np.add.reduceat((z >> np.uint64(bit)) & _ONES, starts, axis=1)
        counts[:, :, bit] = part.astype("<u8").view(np.uint8).reshape(len(z), -1, 8).sum(axis=1)
    return counts.reshape(len(z), 64)


def sketch(hashes: np.ndarray, families: int = FAMILIES, width: int = WIDTH, flips: int = FLIPS) -> tuple[list[int], list[int]]:
    """A fingerprint of each family, and which of its bits are the least certain
    ``flips`` ones of the lowest and of the next ``width`` bits."""
    counts = np.zeros((families, 64), np.int64)
    for k in range(0, len(hashes), CHUNK):
        counts += bit_counts(_mixed(hashes[None, k : k + CHUNK] + _FAMILY[:families, None]))
    margin = 2 * counts - len(hashes)
    fps = ((margin > 0) * _POWER).sum(axis=1, dtype=np.uint64)
    order = np.argsort(np.abs(margin[:, : 2 * width]).reshape(families, 2, width), axis=2, kind="stable")[:, :, :flips]
    at = (order + np.array([0, width])[None, :, None]).reshape(families, -1)
    low = _POWER[at].sum(axis=1, dtype=np.uint64)
    return fps.view(np.int64).tolist(), low.view(np.int64).tolist()


def sketches(docs: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """``node`` (a hash of the text's shingle set), ``fps`` and ``low``, beside
    the columns ``id`` and ``row`` of ``docs``."""

    def run(batches):
        for batch in batches_of(batches):
            nodes, fps, low = [], [], []
            for text in batch.column(2):
                h = shingle_set(text.as_py(), shingle)
                nodes.append(signed(xxhash.xxh64_intdigest(h.tobytes(), 1)))
                f, m = sketch(h)
                fps.append(f)
                low.append(m)
            longs = pa.list_(pa.int64())
            cols = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(fps, longs), pa.array(low, longs)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "row", "node", "fps", "low"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "row", F.col(text_col)).mapInArrow(run, f"id {kind}, row binary, node long, fps array<bigint>, low array<bigint>")


def table_entries(nodes: DataFrame) -> DataFrame:
    """(node, fp, key) for both segments of every fingerprint: the key is the
    number of the table and the segment's value, with its uncertain bits set in
    every way."""
    rows = nodes.select("node", F.posexplode(F.arrays_zip("fps", "low")).alias("family", "z"))
    rows = rows.select("node", "family", F.col("z.fps").alias("fp"), F.col("z.low").alias("low"), F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    whole = F.lit((1 << WIDTH) - 1).cast("long")
    cut = lambda c: F.when(F.col("s") == 0, F.col(c)).otherwise(F.shiftrightunsigned(c, WIDTH)).bitwiseAND(whole)
    rows = rows.select("node", "fp", F.shiftleft((F.col("family") * 2 + F.col("s")).cast("long"), 32).alias("table"), cut("fp").alias("v"), cut("low").alias("rest"))
    rows = rows.withColumn("v", F.col("v").bitwiseAND(F.bitwise_not("rest")).bitwiseOR(F.col("table"))).drop("table")
    for i in range(FLIPS):
        rows = rows.withColumn(f"b{i}", F.col("rest").bitwiseAND(-F.col("rest"))).withColumn("rest", F.col("rest").bitwiseXOR(F.col(f"b{i}")))
    rows = rows.select("node", "fp", "v", *[f"b{i}" for i in range(FLIPS)])
    for i in range(FLIPS):
        both = F.explode(F.array(F.col("v"), F.col("v").bitwiseOR(F.col(f"b{i}"))))
        rows = rows.withColumn("w", both).drop("v", f"b{i}").withColumnRenamed("w", "v")
    return rows.withColumnRenamed("v", "key")


def _distance(a: str, b: str) -> Column:
    """The complete distance of two arrays of fingerprints."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(FAMILIES)), F.lit(0))


def _close(a: str, b: str) -> Column:
    """Whether that distance is small enough."""
    return _distance(a, b) <= COMPLETE


def _first_met(key: str, fa: str, la: str, fb: str, lb: str) -> Column:
    """Whether ``key`` is the one bucket in which a pair is to be compared, of all
    that hold both texts: in the first table in which they meet, that is where
    the segment's certain bits agree, the key without bits uncertain in both."""
    whole = F.lit((1 << WIDTH) - 1).cast("long")
    cut = lambda c, s: F.shiftrightunsigned(c, s * WIDTH).bitwiseAND(whole)
    table = F.shiftright(key, 32)
    out = F.lit(True)
    for f in range(FAMILIES):
        differs = F.col(fa)[f].bitwiseXOR(F.col(fb)[f]).bitwiseAND(F.bitwise_not(F.col(la)[f].bitwiseOR(F.col(lb)[f])))
        for s in (0, 1):
            out = out & ((table <= 2 * f + s) | (cut(differs, s) != 0))
    both = F.element_at(la, (F.shiftright(table, 1) + 1).cast("int")).bitwiseAND(F.element_at(lb, (F.shiftright(table, 1) + 1).cast("int")))
    both = F.when(table % 2 == 0, cut(both, 0)).otherwise(cut(both, 1))
    return out & (F.col(key).bitwiseAND(both) == 0)


def _often(pairs: DataFrame, most: int) -> DataFrame:
    """Of the pairs (a, b) of each b the ``most`` that come most often."""
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("m"), "a"))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    return counted.select("a", "b", place.alias("place")).where(F.col("place") <= most).select("a", "b")


def _several(buckets: DataFrame, tied: DataFrame) -> DataFrame:
    """(key, x, c, top, centre) of the nodes x, of component c, in buckets that
    hold several components; ``top`` is the most frequent one, ``centre`` the
    most frequent one of the large groups (null: there is none)."""
    sized = tied.join(tied.groupBy("root").agg((F.count(F.lit(1)) >= LARGE).alias("large")), "root")
    rows = buckets.join(sized, F.col("b") == F.col("v"), "left").select("key", F.col("b").alias("x"), F.coalesce("root", "b").alias("c"), "large")
    part, bucket = Window.partitionBy("key", "c"), Window.partitionBy("key")
    rows = rows.select("key", "x", "c", "large", F.struct(F.count(F.lit(1)).over(part).alias("m"), "c").alias("own"))
    centre = F.max(F.when(F.col("large"), F.col("own"))).over(bucket)["c"].alias("centre")
    rows = rows.select("key", "x", "c", F.max("own").over(bucket)["c"].alias("top"), centre, F.min("c").over(bucket).alias("lo"), F.max("c").over(bucket).alias("hi"))
    return rows.where("lo <> hi").select("key", "x", "c", "top", "centre")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a similarity of ``least`` or more."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}

        def of(node, text):
            if node not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                kept[node] = shingle_set(text, shingle)
            return kept[node]

        for batch in batches_of(batches):
            a, b, ta, tb = batch.columns
            same = [jaccard(of(x, p.as_py()), of(y, q.as_py())) >= least for x, y, p, q in zip(a.to_pylist(), b.to_pylist(), ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(same, pa.bool_())], ["a", "b", "same"])

    def side(name):
        return texts.select(F.col("node").alias(name), F.col("t").alias(f"t{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long, same boolean").where("same").select("a", "b")


def _texts(wanted: DataFrame, rows: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, t): a text of each node in the table ``wanted``, as a table."""
    few = F.broadcast if wanted.count() <= BROADCAST_KEYS else lambda df: df
    one = prints.join(few(wanted), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    return materialise(rows.select("row", "t").join(few(one), "row").groupBy("node").agg(F.min("t").alias("t")), "near-texts")


def _links(pairs: DataFrame, rows: DataFrame, prints: DataFrame, shingle: int, least: float, tag: str) -> DataFrame:
    """The verified ``pairs``, as a table. One text of each node in a pair is
    read, so texts are not moved for chance meetings in a bucket."""
    wanted = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-wanted")
    texts = _texts(wanted, rows, prints)
    out = materialise(verified(pairs, texts, shingle, least), tag)
    discard(wanted, texts)
    return out


def _circles(met: DataFrame, tied: DataFrame, rows: DataFrame, prints: DataFrame, shingle: int, least: float) -> DataFrame:
    """The circles of large groups: their nodes and those of ``met`` (g, node),
    which are other components', as a table (g, node, inner, size, common, off,
    added). Of a node's ``size`` shingles ``common`` ones are in its group's
    core (those of more than half of some of its nodes), and ``off`` ones are in
    one of the two alone. ``added`` are those outside the core of which two nodes
    share one if they share any and their similarity is ``least`` or more: that
    takes at least ``least * size - common`` shared ones, so a prefix in a common
    order is enough."""
    met = materialise(met.distinct(), "near-met")
    inner = tied.join(met.select("g").distinct(), F.col("root") == F.col("g"), "left_semi")
    circle = materialise(met.select("g", "node", F.lit(False).alias("inner")).union(inner.select("root", "v", F.lit(True))), "near-circle")
    wanted = materialise(circle.select("node").distinct(), "near-wanted")
    texts = _texts(wanted, rows, prints)

    def core(table):
        sets = [shingle_set(t.as_py(), shingle) for t in table.column("t")]
        found, times = np.unique(np.concatenate(sets), return_counts=True)
        return pa.table({"g": table.column("g").slice(0, 1), "core": pa.array([found[2 * times > len(sets)].tobytes()], pa.binary())})

    def run(batches):
        for batch in batches_of(batches):
            out = []
            for text, held in zip(batch.column(3), batch.column(4), strict=True):
                h, held = shingle_set(text.as_py(), shingle), np.frombuffer(held.as_py(), np.uint64)
                there = np.isin(h, held, assume_unique=True)
                added, common = h[~there], int(there.sum())
                few = max(math.ceil(least * len(h) - 1e-6) - common, 1)
                out.append((len(h), common, len(h) + len(held) - 2 * common, added[: max(len(added) - few + 1, 0)].view(np.int64).tolist()))
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())], strict=False)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], ["g", "node", "inner", "size", "common", "off", "added"])

    place = F.row_number().over(Window.partitionBy("g").orderBy("node"))
    some = circle.where("inner").select("g", "node", place.alias("place")).where(F.col("place") <= CORE)
    cores = some.join(texts, "node").select("g", "t").groupBy("g").applyInArrow(core, "g long, core binary")
    both = circle.join(texts, "node").join(cores, "g").select("g", "node", "inner", "t", "core")
    out = materialise(both.mapInArrow(run, "g long, node long, inner boolean, size long, common long, off long, added array<bigint>"), "near-circles")
    discard(met, circle, wanted, texts)
    return out


def _in_circles(circles: DataFrame, tied: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of one circle in different components, at least one
    of them outside the group: all that may have a similarity of ``least``.

    Two nodes share shingles outside the core, or what they share is in the core
    and in both: at most the smaller ``common``. The latter depends on sizes and
    commons alone, so kinds of nodes are paired first."""
    own, groups = tied.select(F.col("v").alias("node"), F.col("root").alias("c")), tied.select(F.col("v").alias("g"), F.col("root").alias("cg"))
    held = circles.join(own, "node", "left").join(groups, "g").withColumn("c", F.coalesce("c", "node")).withColumn("inner", F.col("c") == F.col("cg"))
    held = materialise(held.select("g", "node", "c", "inner", "size", "common", "added"), "near-placed")
    y = held.where("not inner").select("g", F.col("node").alias("y"), F.col("c").alias("cy"), F.col("size").alias("sy"), F.col("common").alias("my"), F.col("added").alias("wy"))
    z = held.select("g", F.col("node").alias("z"), F.col("c").alias("cz"), "inner", F.col("size").alias("sz"), F.col("common").alias("mz"), F.col("added").alias("wz"))
    enough = F.least("my", "mz") * (1 + least) >= least * (F.col("sy") + F.col("sz")) - 1e-6
    kinds = y.select("g", "sy", "my").distinct().join(z.select("g", "inner", "sz", "mz").distinct(), "g").where(enough)
    once = (F.col("cy") != F.col("cz")) & (F.col("inner") | (F.col("y") < F.col("z")))
    alike = y.drop("wy").join(kinds, ["g", "sy", "my"]).join(z.drop("wz"), ["g", "inner", "sz", "mz"]).where(once).select("y", "z")
    shared = y.select("g", "y", "cy", F.explode("wy").alias("w")).join(z.select("g", "z", "cz", "inner", F.explode("wz").alias("w")), ["g", "w"]).where(once).select("y", "z")
    out = materialise(alike.union(shared).select(F.least("y", "z").alias("a"), F.greatest("y", "z").alias("b")).distinct(), "near-alike")
    discard(held)
    return out


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``row`` (a hash of id and text),
    component_id (the smallest id of the component) and ``keeper`` (the ``row``
    of the component's row that stays: of the smallest id, then hash).

    Texts link when the Jaccard similarity of their sets of word shingles is
    ``least`` or more, and components are what links reach. Every link is
    verified on the whole texts; what the tables may miss is a pair close to
    ``least`` (see ``FAMILIES``).

    Texts of equal sets are one node. In each bucket (nodes under one key of a
    table) of two both are compared. In larger ones a node is first compared
    with the bucket's least node; of the least nodes of all its buckets, with the
    ``FIRST`` that it meets most often. That ties a large group of near copies with
    a few pairs a member. Then, in
    buckets that still hold several components but no large group, every node
    outside the most frequent one is compared with all nodes of other components:
    a pair within one component adds nothing, and a pair is compared in one bucket
    alone; of these the ``NEAREST`` of each such node come first, and then those
    that they left in different components. Distances are compared before texts.
    Nodes in a bucket with a large group are in its circle (``_circles``): each is
    compared with the group's most central node, and those that this left outside
    with all nodes of the circle, in a bucket or not, that may be near by their
    sizes and what they share with the group's core, or that share a shingle
    outside the core. So the first steps only save pairs; the last one leaves none
    out. What remains may still grow with the product of two kinds in a circle:
    nodes almost near enough, and nodes with a variant that is frequent in the
    group but not in its core.

    Null texts are empty and link to each other. Null ids come after all others;
    rows are judged by their texts, so rows that repeat an id are documents of
    their own, and rows that repeat id and text have one ``row``. Other columns
    are not read. An empty table gives no rows. Two of n shingle sets share a
    64-bit node by chance with a probability of n * n / 2 ** 65.
    """
    rows = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("t"))
    prints = materialise(sketches(rows, shingle, "t"), "near-prints")
    nodes = materialise(prints.groupBy("node").agg(F.first("fps").alias("fps"), F.first("low").alias("low")), "near-nodes")
    # Entries are shuffled once, as two numbers. A bucket is one task's, but holds a text once: 1 of its 160 entries.
    bucket = Window.partitionBy("key")
    entries = table_entries(nodes).select("key", "node")
    entries = entries.select("key", F.count(F.lit(1)).over(bucket).alias("n"), F.min("node").over(bucket).alias("a"), F.col("node").alias("b"))
    buckets = materialise(entries.where("n > 1"), "near-buckets")
    met = buckets.where(F.col("a") != F.col("b"))
    first = met.where("n = 2").select("a", "b").union(_often(met.where("n > 2"), FIRST)).distinct()
    for c in ("a", "b"):
        first = first.join(nodes.select(F.col("node").alias(c), F.col("fps").alias(f"fps{c}")), c)
    first = materialise(first.where(_close("fpsa", "fpsb")).select("a", "b"), "near-pairs")
    links = _links(first, rows, prints, shingle, least, "near-links")
    tied = materialise(components(links), "near-tied")
    several = materialise(_several(buckets.where("n > 2"), tied), "near-open")
    met = several.where("c <> centre").select(F.col("centre").alias("g"), F.col("x").alias("node"))
    circles = _circles(met, tied, rows, prints, shingle, least)
    central = circles.where("inner").groupBy("g").agg(F.min(F.struct("off", "node"))["node"].alias("to"))
    central = circles.where("not inner").join(central, "g").select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"))
    group = several.where("centre is null").join(nodes.select(F.col("node").alias("x"), F.col("fps").alias("fpsx"), F.col("low").alias("lowx")), "x")
    others = group.where("c <> top").select("key", F.col("x").alias("y"), F.col("fpsx").alias("fpsy"), F.col("lowx").alias("lowy"), F.col("c").alias("cy"))
    met = (F.col("c") != F.col("cy")) & ((F.col("c") == F.col("top")) | (F.col("x") < F.col("y")))
    once = _first_met("key", "fpsx", "lowx", "fpsy", "lowy")
    more = others.withColumnRenamed("key", "key2").join(group, (F.col("key2") == F.col("key")) & met & _close("fpsx", "fpsy") & once)
    more = more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "y", _distance("fpsx", "fpsy").alias("d"))
    place = F.row_number().over(Window.partitionBy("y").orderBy("d", "a", "b"))
    more = materialise(more.join(first, ["a", "b"], "left_anti").select("a", "b", place.alias("place")), "near-more")
    second = more.where(F.col("place") <= NEAREST).select("a", "b").union(central).distinct()
    links2 = _links(second, rows, prints, shingle, least, "near-links2")
    # What the links so far tie is one edge a node.
    tied2 = materialise(components(tied.select(F.col("v").alias("a"), F.col("root").alias("b")).union(links2)), "near-tied2")
    rest = more.where(F.col("place") > NEAREST).select("a", "b")
    for c in ("a", "b"):
        rest = rest.join(tied2.select(F.col("v").alias(f"v{c}"), F.col("root").alias(f"root{c}")), F.col(c) == F.col(f"v{c}"), "left")
    rest = rest.where(F.coalesce("roota", "a") != F.coalesce("rootb", "b")).select("a", "b")
    alike = _in_circles(circles, tied2, least)
    rest = materialise(rest.union(alike).distinct(), "near-rest")
    found = _links(rest, rows, prints, shingle, least, "near-links3")

    roots = components(tied2.select(F.col("v").alias("a"), F.col("root").alias("b")).union(found))
    member = prints.select("id", "row", "node").join(roots, F.col("node") == F.col("v"), "left").select("id", "row", F.coalesce("root", "node").alias("root"))
    member = materialise(member, "near-members")
    best = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("row").alias("row"))).alias("best")
    shared = member.groupBy("root").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "best")
    out = materialise(member.join(shared, "root", "left").select("id", "row", F.coalesce("best.id", "id").alias("component_id"), F.coalesce("best.row", "row").alias("keeper")), "near-out")
    discard(prints, nodes, buckets, first, links, tied, several, circles, more, links2, tied2, alike, rest, found, member)
    return out


def without_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``near_copies`` (its keeper)."""
    own, other = fresh("__own", docs.columns), fresh("__other", docs.columns)
    groups = near_copies(docs, shingle, least, id_col, text_col)
    dropped = materialise(groups.where("row <> keeper").select(F.col("row").alias(other)).distinct(), "near-dropped")
    few = F.broadcast(dropped) if dropped.count() <= BROADCAST_DROPPED else dropped
    again = groups.where("row = keeper").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row").alias(other))
    again = materialise(again, "near-again")
    kept = docs.withColumn(own, row_key(F.col(id_col), F.col(text_col))).join(few, F.col(own) == F.col(other), "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    # Rows that repeat id and text: the keys of those that stay, and one row of each key.
    some = F.broadcast(again) if again.count() <= BROADCAST_DROPPED else again
    twice = kept.join(some, F.col(own) == F.col(other), "left_semi").groupBy(own).agg(F.first(F.struct(*docs.columns)).alias("d"))
    return kept.join(some, F.col(own) == F.col(other), "left_anti").select(*docs.columns).unionByName(twice.select("d.*"))
