"""What the trained classifiers share: folds, labelled rows, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Most labels (12 bytes each) that are broadcast; more join by a shuffle.
BROADCAST_LABELS = 1_000_000

#: Frequent function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht zu von mit den dem ein eine sich auf für im des auch als",
    "en": "the of and to in is that for it as was with be by on not he this are from",
    "es": "el la los las de que y en un una por con para del se su no al es como",
    "fr": "le la les de des et un une du que qui dans pour sur est au avec par ne il",
}


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is never learnt from."""
    return (F.crc32(F.col(id_col).cast("string")) % FOLDS).cast("int")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, y) of every labelled document among the rows that ``keep`` allows.
    Labels that are null or disagree within one id are left out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & keep)
    one = one.groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("y"), F.max(label).alias("z")).where("y = z").select("id", "y")
    few = F.broadcast(one) if one.count() <= BROADCAST_LABELS else one
    texts = docs.where(F.col(id_col).isNotNull() & keep).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return texts.join(few, "id").select("id", "t", "y")


def language_of(words) -> str:
    """The language with most function words among ``words``; "" for none."""
    counts = {lang: sum(w in ws for w in words) for lang, ws in _SETS.items()}
    best = max(sorted(counts), key=counts.get)
    return best if counts[best] else ""


def languages_of(number: dict, at, starts, ends) -> list[str]:
    """``language_of`` each text, whose words have the numbers ``at[start:end]``."""
    import numpy as np

    langs = sorted(_SETS)
    known = np.zeros((len(number), len(langs)), np.int32)
    for k, lang in enumerate(langs):
        known[[number[w] for w in _SETS[lang] if w in number], k] = 1
    sums = np.concatenate([np.zeros((1, len(langs)), np.int64), np.cumsum(known[at], axis=0, dtype=np.int64)])
    counts = sums[ends] - sums[starts]
    return [langs[k] if n[k] else "" for k, n in zip(counts.argmax(axis=1).tolist(), counts.tolist(), strict=True)]


_SETS = {lang: frozenset(text.encode().split()) for lang, text in FUNCTION_WORDS.items()}


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
