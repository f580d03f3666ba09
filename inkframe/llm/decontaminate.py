"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.llm.common import batches_of, fresh, materialise

#: Most bytes of benchmark text that one pass's tables are built of: some 40
#: bytes of table to a byte of text, in each Python worker.
PASS_BYTES = 4 << 20
#: Most bytes of benchmark text that are sent to the workers at once. A larger
#: benchmark is searched in rounds, whose results are written in between.
ROUND_BYTES = 64 << 20

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class WuManber:
    """Finds the windows of ``size`` words of many items in texts.

    Words are numbers (a text's unknown words are -1) and a window is a place in
    the items' words, so tables hold numbers only. Blocks of two words (one for
    windows of one word) index the shift table. A block that ends windows has
    no shift but a bucket of them, sorted by their first block; those that begin
    as the text does are compared word by word.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.size, self.block = size, min(2, size)
        self.far = size - self.block + 1
        self.names = [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        coded = [np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64) for _, words in items]
        self.base = len(self.number)
        starts = np.cumsum([0, *map(len, coded)])
        self.words = array("q", np.concatenate(coded).tobytes())
        self.item_at = array("q", starts[:-1].tobytes())
        blocks, shifts, ends, heads, places = [], [], [], [], []
        for c, start in zip(coded, starts, strict=False):
            codes = c[:-1] * self.base + c[1:] if self.block == 2 else c
            blocks.append(codes)
            # The farther into the item a block stands, the nearer to a window's end it may be.
            shifts.append(np.maximum(0, size - self.block - np.arange(len(codes))))
            n = len(c) - size + 1
            ends.append(codes[size - self.block :][:n])
            heads.append(codes[:n])
            places.append(start + np.arange(n))
        ends, heads, places = map(np.concatenate, (ends, heads, places))
        order = np.lexsort((places, heads, ends))
        ends = ends[order]
        self.heads, self.places = array("q", heads[order].tobytes()), array("q", places[order].tobytes())
        blocks, shifts = np.concatenate(blocks), np.concatenate(shifts)
        least = np.lexsort((shifts, blocks))
        keys, first = np.unique(blocks[least], return_index=True)
        jump = shifts[least][first]
        lo, hi = np.searchsorted(ends, keys), np.searchsorted(ends, keys, "right")
        self.shift = dict(zip(keys.tolist(), jump.tolist(), strict=True))
        zero = jump == 0
        self.bucket = dict(zip(keys[zero].tolist(), zip(lo[zero].tolist(), hi[zero].tolist(), strict=True), strict=True))

    def search(self, words: list[bytes]):
        """Yields (start, name of an item) of every occurrence."""
        m, two, shift, far, base, n = self.size, self.block == 2, self.shift, self.far, self.base, len(words)
        number = self.number.get
        text = array("q", [number(w, -1) for w in words])
        end = m
        while end <= n:
            last = text[end - 1]
            if last < 0:  # no window holds this word
                end += m
                continue
            step = shift.get(text[end - 2] * base + last if two and text[end - 2] >= 0 else -1 if two else last, far)
            if step:
                end += step
                continue
            start = end - m
            head = text[start] * base + text[start + 1] if two else text[start]
            lo, hi = self.bucket[text[end - 2] * base + last if two else last]
            a = bisect_left(self.heads, head, lo, hi)
            b = bisect_right(self.heads, head, a, hi)
            if a < b:
                here = text[start:end]
                for place in self.places[a:b]:
                    if self.words[place : place + m] == here:
                        yield start, self.names[bisect_right(self.item_at, place) - 1]
            end += 1


def machines(items: list[tuple[str, str]], window: int) -> list[WuManber]:
    """A machine for each length of windows: items of fewer words are one each."""
    by_size: dict[int, list] = {}
    for item, text in items:
        words = words_of(text)
        if words:
            by_size.setdefault(min(window, len(words)), []).append((item, words))
    return [WuManber(found, size) for size, found in sorted(by_size.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


HITS = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def _searcher(spark, passes: list[list[tuple[str, str]]], window: int):
    """A column function: text to its words, hit spans and items. The benchmark's
    texts are broadcast and tables built by the workers, of one pass at a time."""
    shared = spark.sparkContext.broadcast(passes)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only = machines(shared.value[0], window) if len(shared.value) == 1 else None
        for batch in batches_of(batches, 512 if only is not None else 1 << 30):
            spans, items = [[] for _ in batch], [{} for _ in batch]
            n_words = []
            for j, part in enumerate(shared.value):
                found = only if only is not None else machines(part, window)
                for i, text in enumerate(batch):
                    words = words_of(text.as_py())
                    if not j:
                        n_words.append(len(words))
                    for machine in found:
                        for start, item in machine.search(words):
                            spans[i].append((start, start + machine.size))
                            items[i][item] = None
            spans = [[{"start": a, "end": b} for a, b in merged(x)] for x in spans]
            cols = [pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.StructArray.from_arrays(cols, ["n_words", "spans", "items"])

    return F.arrow_udf(run, HITS)


def _union(spans: Column) -> Column:
    """Sorted spans, the overlapping and adjacent ones joined."""
    ordered = F.array_sort(spans)

    def add(acc, s):
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))
        return F.when(F.size(acc) == 0, F.array(s)).when(F.try_element_at(acc, F.lit(-1))["end"] >= s["start"], joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), add)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str,
    window: int = 10,
    pass_bytes: int = PASS_BYTES,
    round_bytes: int = ROUND_BYTES,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` and a column ``name`` of n_words, spans (of hit words, merged,
    half-open) and items (ids of the items with occurring windows, sorted as
    strings) of the whole text.

    Items are dealt by a hash into passes of about ``pass_bytes`` of text, whose
    tables a worker holds one at a time. More than ``round_bytes`` are searched
    in rounds; each reads and writes the documents once more.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("t")).where("item is not null and t is not null")
    n_bytes = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    rounds = 1 + int(n_bytes) // round_bytes
    passes = 1 + int(n_bytes) // rounds // pass_bytes
    for k in range(rounds):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == k).collect()  # round_bytes, about
        dealt = [[(r.item, r.t) for r in part[j::passes]] for j in range(passes)]
        found = _searcher(spark, dealt, window)(F.col(text_col))
        if not k:
            docs = docs.withColumn(name, found)
            continue
        other = fresh("__more", docs.columns)
        docs = materialise(docs, "contamination-round").withColumn(other, found)
        both = F.struct(
            F.col(name)["n_words"].alias("n_words"),
            _union(F.concat(F.col(name)["spans"], F.col(other)["spans"])).alias("spans"),
            F.array_sort(F.array_union(F.col(name)["items"], F.col(other)["items"])).alias("items"),
        )
        docs = docs.withColumn(name, both).drop(other)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, n_words, n_hit, spans, items and contaminated.

    A window is ``window`` (10) consecutive words of an item; an item of fewer
    words, but not none, is one window. A document word inside an occurrence is
    hit. Null texts have no words; items with a null id or text are left out.
    Repeated rows and null ids each give a row; other columns are not read. An
    empty benchmark hits nothing. The documents are read in place; nothing is
    shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = contamination(rows, benchmark, "c", text_col="t", **options)
    n_hit = F.aggregate("c.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(F.col("id").alias(id_col), "c.n_words", n_hit.alias("n_hit"), "c.spans", "c.items", (F.size("c.spans") > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, as they are, in whose texts no window of an item occurs."""
    name = fresh("__found", docs.columns)
    found = contamination(docs, benchmark, name, text_col=text_col, **options)
    return found.where(F.size(F.col(name)["spans"]) == 0).select(*docs.columns)
