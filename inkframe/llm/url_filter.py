"""URL filters: host-suffix and path-prefix expressions against hashed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import ascii_lower, fresh, materialise

#: Most rules that are broadcast (some 200 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 200_000


def split_url(url):
    """(host, path) of a URL column: host after the first ``://`` up to ``/``,
    ``?``, ``#`` or the end, with A-Z lower-cased; path then up to ``?`` or
    ``#``. Both are empty for null and for texts without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    shape = r"(?s)^([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(rest, shape, 1)), F.regexp_extract(rest, shape, 2)


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    default: str = "allow",
    hash_digits: int = 8,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict appended; columns of these
    names that ``pages`` has already are replaced.

    ``rules`` has host, path and action (allow or block). A rule fits its host
    and all subdomains when the URL's path starts with the rule's path. The
    longest fitting rule (host and path together) wins; of equally long ones a
    block, then the smallest text. URLs that no rule fits get ``default``.

    Each distinct URL is expanded into every host suffix of no more labels than
    some rule's host has, joined to every path prefix of a length that some
    rule's path has, so the rules bound its expressions. The expressions meet the
    rules by the first ``hash_digits`` hex digits of their SHA-256 and the full
    digest confirms the match. Repeated URLs are judged once. Rules with a null
    host are ignored, a null path counts as empty; duplicate rules that
    disagree block. A null URL gets the default. Repeated rows each give a row;
    an empty table gives none.
    """
    clean = (
        rules.where(F.col("host").isNotNull())
        .select(
            F.concat(ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))).alias("rule"),
            F.length(F.coalesce("path", F.lit(""))).alias("path_len"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.col("action").alias("action"),
        )
        .groupBy("rule", "path_len", "labels")
        .agg(F.max(F.when(F.col("action") == "block", 1).otherwise(0)).alias("blocks"))
    )
    # As many shapes as there are different rule paths and host depths at most; a URL bounds them.
    shapes = clean.select("path_len", "labels").distinct().collect()
    lengths, most = sorted({r.path_len for r in shapes}), max((r.labels for r in shapes), default=0)
    host, path = split_url(F.col("u"))
    lens = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    digest = clean.withColumn("rule_digest", F.sha2("rule", 256))
    digest = digest.withColumn("short", F.substring("rule_digest", 1, hash_digits))
    if clean.count() <= BROADCAST_RULES:
        digest = F.broadcast(digest)

    urls = pages.select(F.col(url_col).alias("u")).where(F.col("u").isNotNull()).distinct()
    parts = urls.select("u", F.split(host, r"\.").alias("labels"), path.alias("p"))
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size("labels") - most + 1), F.size("labels")),
        lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."),
    )
    fitting = F.filter(lens, lambda n: n <= F.length("p"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("p"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda q: F.concat(h, q))))
    probes = parts.select("u", F.explode(expressions).alias("e")).withColumn("probe_digest", F.sha2("e", 256))
    probes = probes.withColumn("short", F.substring("probe_digest", 1, hash_digits))
    hits = probes.join(digest, "short").where(F.col("probe_digest") == F.col("rule_digest"))
    rank = F.struct((-F.length("rule")).alias("length"), (-F.col("blocks")).alias("blocks"), F.col("rule"))
    best = materialise(hits.groupBy("u").agg(F.min(rank).alias("best")), "url-best")

    names = ("host", "path", "rule", "verdict")
    own = [c for c in pages.columns if c not in names]
    u, found = fresh("__u", pages.columns), fresh("__best", pages.columns)
    host, path = split_url(F.col(url_col))
    # Null URLs are kept out of the join, where they would meet in one task.
    known = pages.where(F.col(url_col).isNotNull()).join(best.select(F.col("u").alias(u), F.col("best").alias(found)), F.col(url_col) == F.col(u), "left")
    null = pages.where(F.col(url_col).isNull()).withColumn(found, F.lit(None).cast(best.schema["best"].dataType))

    def judged(df):
        rule, blocks = F.col(found)["rule"], F.col(found)["blocks"]
        verdict = F.when(blocks < 0, "block").when(blocks == 0, "allow").otherwise(default)
        return df.select(*own, host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"))

    return judged(known).unionByName(judged(null))
