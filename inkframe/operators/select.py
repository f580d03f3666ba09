"""Choosing among candidates: argmax with stated ties, votes, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, by: list[str], order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    name = rank or "__nth"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def best_trial(trials: DataFrame, by: list[str]) -> DataFrame:
    """Most soft IoU among trials with a curve (all, where none has one)."""
    return top(trials, by, [F.desc("has_curve"), F.desc("soft"), "seq"])


def threshold_shortlist(area: Column, thresholds: Column, most_px: int = 200_000) -> Column:
    """First, middle and last threshold of regions over ``most_px`` pixels."""
    n = F.size(thresholds)
    mid = (F.floor(n / 2) + 1).cast("int")
    few = F.array(F.element_at(thresholds, 1), F.element_at(thresholds, mid), F.element_at(thresholds, -1))
    return F.when((area > most_px) & (n > 3), few).otherwise(thresholds)


def trial_grid(regions: DataFrame, upscale=(4, 8), turd=(2, 3), thresholds=(112, 128, 139, 148, 160, 172, 184), alpha=(0.8, 1.0), tolerance=(0.1,)) -> DataFrame:
    """Every region with every setting: the fixed grid is exploded, not joined.
    ``turd`` is in the source's pixels, ``turd_px`` in the upscaled mask's."""
    out = regions
    for name, values in (("upscale", upscale), ("turd", turd), ("threshold", thresholds), ("alpha", alpha), ("tolerance", tolerance)):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.withColumn("turd_px", F.greatest(F.lit(1), F.col("turd") * F.col("upscale") * F.col("upscale")))


def region_thresholds(regions: DataFrame, thresholds=(112, 128, 139, 148, 160, 172, 184), area: Column | None = None, most_px: int = 200_000) -> DataFrame:
    """Every region with every threshold; with ``area`` large ones with the shortlist."""
    every = F.array(*map(F.lit, thresholds))
    return regions.withColumn("threshold", F.explode(every if area is None else threshold_shortlist(area, every, most_px)))


def shape_score(iou: Column, width_ratio: Column) -> Column:
    """Seven tenths of the IoU, three of how near the width ratio is to 1."""
    return 0.7 * iou + 0.3 * F.greatest(F.lit(0.0), 1 - F.abs(width_ratio - 1))


def adjudicate(reports: DataFrame, candidates: DataFrame, by: list[str], n: int = 6) -> DataFrame:
    """Distinct texts by best score, the first ``n``; then each one's best font."""
    texts = reports.where(F.length(F.trim("text")) > 0).groupBy(*by, "text").agg(F.max("score").alias("score"), F.min("seq").alias("first"))
    texts = top(texts, by, [F.desc("score"), "first"], n)
    return texts.join(candidates.groupBy("text").agg(F.max_by("font", F.struct("iou", -F.col("seq"))).alias("font"), F.max("iou").alias("iou")), "text")


def pick_variant(reports: DataFrame, by: list[str], tolerance: float = 0.05) -> DataFrame:
    """Among reports within ``tolerance`` of the best score: least word gap, then
    score, then order. Where the pick is the group's first report and no other
    report reads as many characters, the most frequent count's reports are tried
    in the same order (the others are compared from the second report on, so
    only a first report can fail the agreement)."""
    w = Window.partitionBy(*by)
    r = reports.withColumn("__best", F.max("score").over(w)).withColumn("__first", F.min("seq").over(w))
    order = ["word_gap", F.desc("score"), "seq"]
    pick = top(r.where(F.col("score") >= F.col("__best") - tolerance), by, order)
    modal = reports.groupBy(*by, "chars").agg(F.count(F.lit(1)).alias("__n"), F.min("seq").alias("__at"))
    modal = top(modal, by, [F.desc("__n"), "__at"]).select(*by, F.col("chars").alias("__modal"))
    agree = r.join(pick.select(*by, F.col("chars").alias("__chars")), by).where((F.col("seq") != F.col("__first")) & (F.col("chars") == F.col("__chars")))
    agree = agree.groupBy(*by).agg(F.count(F.lit(1)).alias("__agree"))
    state = pick.select(*by, F.col("seq").alias("__pick"), "__first").join(modal, by).join(agree, by, "left")
    state = state.withColumn("fallback", F.col("__agree").isNull() & (F.col("__pick") == F.col("__first")))
    r = reports.join(state, by).where(F.when(F.col("fallback"), F.col("chars") == F.col("__modal")).otherwise(F.col("seq") == F.col("__pick")))
    return top(r, by, order).drop("__pick", "__first", "__modal", "__agree")


def vote_text(reports: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """The text that most regions of a group read: regions, then votes, then
    confidence, then first seen; NULL where too few regions read it. Blank texts
    and errors (null) do not vote, but their regions count."""
    n = reports.groupBy(*by).agg(F.count_distinct("region").alias("n_regions"))
    votes = reports.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    votes = votes.groupBy(*by, "text").agg(F.count_distinct("region").alias("regions"), F.count(F.lit(1)).alias("votes"), F.sum("score").alias("conf"), F.min("seq").alias("first"))
    best = top(votes, by, [F.desc("regions"), F.desc("votes"), F.desc("conf"), "first"])
    need = F.greatest(F.lit(1), F.floor(F.col("n_regions") * share + 0.5))
    out = n.join(best, by, "left")
    return out.select(*by, "n_regions", F.when(F.col("regions") >= need, F.col("text")).alias("text"), F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("votes", F.lit(0)).alias("votes"))


def candidate_stats(cands: DataFrame, by: list[str], value: str) -> DataFrame:
    return cands.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.median(value).alias("median"), F.percentile(value, F.lit(0.75)).alias("p75"), F.max(value).alias("max")
    )


VERDICT = {"least_iou": 0.72, "least_lift": 1.25, "lift_iou": 0.35, "least_width": 0.65, "most_width": 1.50, "least_glyph_share": 0.25, "most_glyph_share": 4.0, "least_readable": 4, "least_agree": 1}


def verdict(rows: DataFrame, **limits) -> DataFrame:
    """Convert a region to live text or keep its trace.

    Gates: components to a character within bounds (A; zero characters count as
    one), width ratio within bounds (B) and, where both counts are known, enough
    readable variants that agree (E). Then the rebuilt text must be alike: in
    itself (C) or against the median candidate (D). ``reject_kind`` is not_text
    for failed gates, else weak_match; ``reasons`` name what failed.
    """
    p = VERDICT | limits
    share = F.col("n_cc") / F.greatest(F.col("n_char"), F.lit(1))
    a = (share >= p["least_glyph_share"]) & (share <= p["most_glyph_share"])
    b = (F.col("width_ratio") >= p["least_width"]) & (F.col("width_ratio") <= p["most_width"])
    known = F.col("n_ocr_readable").isNotNull() & F.col("n_ocr_agree").isNotNull()
    e = ~known | ((F.col("n_ocr_readable") >= p["least_readable"]) & (F.col("n_ocr_agree") >= p["least_agree"]))
    c = F.col("iou") >= p["least_iou"]
    d = (F.col("lift") >= p["least_lift"]) & (F.col("iou") >= p["lift_iou"])
    gates = a & b & e
    reasons = F.array_compact(F.array(F.when(~a, "components"), F.when(~b, "width"), F.when(~e, "readings"), F.when(gates & ~(c | d), "similarity")))
    checks = F.struct(a.alias("components"), b.alias("width"), e.alias("readings"), c.alias("alike"), d.alias("lifted"))
    out = rows.withColumn("checks", checks).withColumn("reasons", reasons)
    out = out.withColumn("convert", F.size("reasons") == 0)
    return out.withColumn("reject_kind", F.when(~gates, "not_text").when(~F.col("convert"), "weak_match"))


def group_majority(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Groups of two and more take their majority's verdict (a tie keeps the
    trace); what a member said before stays in ``own``."""
    w = Window.partitionBy(*by)
    n, yes = F.count(F.lit(1)).over(w), F.sum(F.col("convert").cast("int")).over(w)
    return verdicts.withColumn("own", F.col("convert")).withColumn("convert", F.when(n >= 2, yes * 2 > n).otherwise(F.col("convert")))


def block_kind(f: dict[str, Column] | None = None) -> Column:
    """solid, line_art, icon or mixed, tested in this order; unknown is 0."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    return (
        F.when((c("fill") >= 0.85) & (c("area") >= 2000), "solid")
        .when((c("thickness") <= 3.5) & (c("fill") <= 0.35) & (F.greatest(c("w"), c("h")) >= 40), "line_art")
        .when((c("area") <= 9000) & (c("n_comp") >= 1) & (c("n_comp") <= 24), "icon")
        .otherwise("mixed")
    )


def with_default(rows: DataFrame, verdicts: DataFrame, key: str, default: bool = False) -> DataFrame:
    """Each row's verdict by name; rows without one keep their trace."""
    return rows.join(verdicts.select(key, "convert"), key, "left").withColumn("convert", F.coalesce("convert", F.lit(default)))


def symbol_of(w: Column, h: Column, ink: Column, x_height: Column) -> Column:
    """Hyphen (flat and wide), middle dot (low), bullet (round and dense), tested
    in this order; NULL for none, and for shapes without ink."""
    aspect, dense = w / h, ink / (w * h)
    return (
        F.when((w <= 0) | (h <= 0) | (ink <= 0), None)
        .when((h <= 2) & (aspect >= 2.5), "-")
        .when((h <= F.greatest(F.lit(3.0), x_height * 0.28)) & (aspect < 2.0), "·")
        .when((aspect >= 0.8) & (aspect <= 2.0) & (dense >= 0.60), "•")
    )


def text_fonts(texts: DataFrame, fonts: DataFrame, most: int = 10_000) -> DataFrame:
    """Every text with every font. A machine's font catalogue is some hundreds of
    names; up to ``most`` travel as one array, more are a broadcast-free join."""
    names = fonts.select("font").distinct()
    first = names.limit(most + 1).collect()
    if len(first) <= most:
        return texts.withColumn("font", F.explode(F.array(*map(F.lit, sorted(r.font for r in first)))))
    share = F.pmod(F.xxhash64("font"), F.lit(256))
    dealt = texts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(255)).cast("array<bigint>")))
    return dealt.join(names.withColumn("__part", share), "__part").drop("__part")


def zip_words(rows: DataFrame, words: str, tokens: str) -> DataFrame:
    """Words beside tokens by position, where their numbers are equal."""
    same = rows.where(F.size(words) == F.size(tokens))
    return same.withColumn("pair", F.explode(F.arrays_zip(words, tokens)))


def letter_heights(glyphs: DataFrame, by: list[str], low: str, high: str, least: int = 2, gap: float = 2) -> DataFrame:
    """Median heights of the letters of x-height and of cap height; NULL unless
    each has ``least`` samples and they are ``gap`` apart."""
    kind = lambda s: F.contains(F.lit(s), F.col("letter"))
    m = glyphs.groupBy(*by).agg(
        F.count_if(kind(low)).alias("n_low"), F.count_if(kind(high)).alias("n_high"), F.median(F.when(kind(low), F.col("height"))).alias("x"), F.median(F.when(kind(high), F.col("height"))).alias("cap")
    )
    ok = (F.col("n_low") >= least) & (F.col("n_high") >= least) & (F.col("cap") - F.col("x") >= gap)
    return m.select(*by, F.when(ok, F.col("x")).alias("x_height"), F.when(ok, F.col("cap")).alias("cap_height"))


def has_text(text: Column) -> Column:
    """Whether a reading holds a letter or digit; else it is a symbol."""
    return text.rlike(r"[\p{L}\p{N}]")


def suspect(upright: Column, turned: Column, least: Column | float = 0.30) -> Column:
    """Whether a reading's rendering fits its ink in neither direction: it is
    marked, not dropped."""
    return F.greatest(upright, turned) < least


def reading_support(reports: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """How many of a region's reports read anything, and how many as many
    characters as the wanted text (``by``, chars)."""
    r = reports.join(wanted.select(*by, F.col("chars").alias("__want")), by)
    return r.groupBy(*by).agg(F.count_if(F.length(F.trim("text")) > 0).alias("n_readable"), F.count_if(F.col("chars") == F.col("__want")).alias("n_agree"))


def font_consensus(members: DataFrame, by: list[str]) -> DataFrame:
    """What each font's rows (a member of the group each) say together: mean and
    least IoU, mean width ratio and the score of both."""
    m = members.groupBy(*by, "font").agg(F.avg("iou").alias("mean_iou"), F.min("iou").alias("min_iou"), F.avg("width_ratio").alias("mean_ratio"), F.count(F.lit(1)).alias("n_members"))
    return m.withColumn("score", shape_score(F.col("mean_iou"), F.col("mean_ratio")))


def orientation(votes: DataFrame, by: list[str], margin: float = 0.02) -> DataFrame:
    """Which way each detection stands: the fonts' best IoU upright and turned,
    to four digits; 0 where they are within ``margin``."""
    v = votes.groupBy(*by).agg(F.bround(F.max("upright"), 4).alias("iou0"), F.bround(F.max("turned"), 4).alias("iou180"))
    clear = F.bround(F.abs(F.col("iou0") - F.col("iou180")), 4) >= margin
    return v.withColumn("rot", F.when(clear & (F.col("iou180") > F.col("iou0")), 180).otherwise(0))


def accept_edits(lines: DataFrame) -> DataFrame:
    """Folds each line's ``edits`` (an array of STRUCT<word, new, kind>, in order)
    into its ``text``: edits by geometry always, others where the running text's
    score rises by over 1e-6. ``scores`` maps texts to scores; a text without one
    scores 0. Appends ``final`` and ``taken``, the numbers of the edits taken."""
    geometry = ("symbol", "case-height")
    score = lambda t: F.coalesce(F.try_element_at("scores", t), F.lit(0.0))

    def step(state, e):
        tokens = F.split(state["text"], " ")
        changed = F.array_join(F.transform(tokens, lambda t, i: F.when(i == e["word"], e["new"]).otherwise(t)), " ")
        there = e["word"] < F.size(tokens)
        take = there & (e["kind"].isin(*geometry) | (score(changed) > score(state["text"]) + 1e-6))
        return F.struct(
            F.when(take, changed).otherwise(state["text"]).alias("text"),
            F.when(take, F.concat(state["taken"], F.array(state["n"]))).otherwise(state["taken"]).alias("taken"),
            (state["n"] + 1).alias("n"),
        )

    start = F.struct(F.col("text").alias("text"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("n"))
    folded = lines.withColumn("__fold", F.aggregate("edits", start, step))
    return folded.withColumn("final", F.col("__fold")["text"]).withColumn("taken", F.col("__fold")["taken"]).drop("__fold")


def without_overridden(edits: DataFrame, geometry: DataFrame, by: list[str]) -> DataFrame:
    """Edits of words that geometry has none for, and those of geometry."""
    return edits.join(geometry.select(*by), by, "left_anti").unionByName(geometry)
