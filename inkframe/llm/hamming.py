"""Multi-index hashing over 64-bit fingerprints, and connected components."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import discard, materialise

#: Buckets of more fingerprints than this are split by a second segment.
BUCKET_LIMIT = 200
#: Most hot bucket keys that are broadcast (8 bytes each).
BROADCAST_KEYS = 500_000


def segments_of(n: int, bits: int = 64) -> list[tuple[int, int]]:
    """(offset, width) of n segments that cover the bits."""
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def radii_of(distance: int, n: int) -> list[int]:
    """Radii by pigeonhole: fingerprints within ``distance`` are within the
    radius of at least one of n segments (-1: that segment needs no search)."""
    return [(distance + 1) // n + (i < (distance + 1) % n) - 1 for i in range(n)]


def ball(width: int, radius: int) -> list[tuple[int, int]]:
    """(mask, weight) of all masks of up to ``radius`` of ``width`` bits."""
    return [(sum(1 << b for b in bits), k) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _value(fp, offset: int, width: int):
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, radius: int):
    """The ball's masks, as an array that the optimizer folds into one constant."""
    return F.split(F.lit(",".join(str(m) for m, _ in ball(width, radius))), ",").cast("array<bigint>")


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def hamming_links(nodes: DataFrame, distance: int, segments: int, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """All links (a, b), a's and b's fingerprints differing in at most
    ``distance`` bits; ``nodes`` holds distinct ``fp`` with a ``rep`` each.

    Every fingerprint is entered in a table under each of its segments' values.
    It probes the small Hamming ball around each value; of two values the
    smaller one probes, so a pair is fetched once a segment. Full distances are
    then verified. A bucket of more than ``bucket_limit`` fingerprints is
    searched in the same way by the other segments of its members, within what
    is left of the distance, so a large group of near copies makes no pairs of
    its own; the result is the same for any limit. A fingerprint has as many
    links at most as its Hamming ball has members (2,081 at a distance of 2).
    """
    nodes = nodes.select("rep", "fp")
    segs = segments_of(segments)
    radii = radii_of(distance, segments)
    entries, probes = [], []
    for i, ((off, width), radius) in enumerate(zip(segs, radii, strict=True)):
        if radius < 0:
            continue
        v = _value(F.col("fp"), off, width)
        table = F.lit(i << 40)
        entries.append(nodes.select("rep", "fp", (table + v).alias("key")))
        rows = nodes.select("rep", "fp", v.alias("v"), F.explode(_masks(width, radius)).alias("x"))
        to = F.col("v").bitwiseXOR(F.col("x"))
        rows = rows.select("rep", "fp", "v", to.alias("to"), F.bit_count("x").alias("w")).where((F.col("w") == 0) | (F.col("to") > F.col("v")))
        probes.append(rows.select("rep", "fp", "w", (table + F.col("to")).alias("key")))

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    entries, probes = union(entries), union(probes)
    hot = materialise(entries.groupBy("key").count().where(F.col("count") > bucket_limit).select("key"), "hamming-hot")

    def pairs(p, e, on):
        p = p.select(*on, F.col("rep").alias("a"), F.col("fp").alias("fa"), "w")
        e = e.select(*on, F.col("rep").alias("b"), F.col("fp").alias("fb"))
        # Spark sizes an explode like its input, so it would broadcast probes of many times the size it reckons with.
        both = p.hint("merge").join(e, on).where((F.col("w") > 0) | (F.col("fa") < F.col("fb")))
        return both.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance).select("a", "b")

    if hot.isEmpty():
        discard(hot)
        return pairs(probes, entries, ["key"]).distinct()
    few = _few(hot)
    plain = pairs(probes.join(few, "key", "left_anti"), entries.join(few, "key", "left_anti"), ["key"])
    hot_probes, hot_entries = probes.join(few, "key", "left_semi"), entries.join(few, "key", "left_semi")
    # A second key: the number of (probed table, bits used up, other segment), then that segment's value.
    second_e, second_p, number = [], [], 0
    for i, radius in enumerate(radii):
        rest = [s for k, s in enumerate(segs) if k != i] or [segs[i]]
        in_table = (F.col("key") >= F.lit(i << 40)) & (F.col("key") < F.lit((i + 1) << 40))
        for w in range(radius + 1):
            for (off, width), r in zip(rest, radii_of(distance - w, len(rest)), strict=True):
                if r < 0:
                    continue
                number += 1
                tag, v = F.lit(number << 40), _value(F.col("fp"), off, width)
                second_e.append(F.when(in_table, tag + v))
                x = F.explode(_masks(width, r))
                p = hot_probes.where(in_table & (F.col("w") == w)).select("rep", "fp", "key", v.alias("v"), x.alias("x"))
                p = p.withColumn("to", F.col("v").bitwiseXOR(F.col("x")))
                if w == 0:  # both are in one bucket: of the two the smaller value probes
                    p = p.where((F.col("x") == 0) | (F.col("to") > F.col("v")))
                    weight = F.bit_count("x")
                else:
                    weight = F.lit(w)
                second_p.append(p.select("rep", "fp", weight.alias("w"), "key", (tag + F.col("to")).alias("key2")))
    second_e = hot_entries.select("rep", "fp", "key", F.explode(F.array_compact(F.array(*second_e))).alias("key2"))
    return plain.union(pairs(union(second_p), second_e, ["key", "key2"])).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(v, root) of every vertex that an edge (a, b) touches; root is the
    smallest vertex reachable. Labels spread to neighbours and are shortened
    through their own labels, so rounds grow with the logarithm of a
    component's diameter; each round is a table in the shared folder."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.where("a <> b").distinct(), "components-edges")
    held = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("l")), "components-0")
    labels = held
    for k in range(1, most_rounds):
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        new = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", "l", F.least("l", "m").alias("n"))
        up = labels.select(F.col("v").alias("n"), F.col("l").alias("up"))
        new = new.join(up, "n").select("v", F.least("n", "up").alias("n"), (F.col("l") > F.least("n", "up")).alias("moved"))
        new = materialise(new, f"components-{k}")
        done = new.where("moved").isEmpty()
        discard(held)
        held, labels = new, new.select("v", F.col("n").alias("l"))
        if done:
            discard(both)
            return labels.select("v", F.col("l").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
