"""Token-id output: documents as zstandard frames under one shared dictionary.

A store is a folder with two tables that Spark commits as a whole:

* ``dictionary``: one row with the dictionary's bytes, its SHA-256, the bytes
  of an id (2 or 4, little-endian) and the end id;
* ``segments``: runs of documents in ascending id order. ``bucket`` and
  ``segment`` number them; ``first_id`` and ``last_id`` bound their ids (and
  prune reads), ``dict_sha256`` names the dictionary; ``ids``, ``n_tokens`` and
  ``offsets`` index the documents, whose frames stand one after another in
  ``blob``; ``local_start`` counts the tokens before the segment in its bucket.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkframe.llm.common import batches_of, discard, materialise, scratch_path, single_thread, worker_cache

#: Documents that the dictionary is trained on (those with the smallest hashes).
DICTIONARY_DOCS = 1000
DICTIONARY_BYTES = 64 << 10
#: Text bytes to a bucket, and documents and frame bytes to a segment at most.
BUCKET_BYTES = 64 << 20
SEGMENT_DOCS = 2048
SEGMENT_BYTES = 1 << 20
#: Bytes of the words that a worker keeps with their ids as Python objects, and
#: what one takes beside its letters and ids; beyond it only those of the last
#: texts stay (and those in the table, which takes a fifth of that a word).
CACHED_BYTES = 8 << 20
WORD_BYTES = 150
LAST_TEXTS = 64
CHARS_AT_ONCE = 150_000
#: Slots (24 bytes each) of a worker's table of words of up to ``KEY`` letters, and
#: ids that it refers to (4 bytes each) before it is begun anew.
SLOT_BITS, KEY, POOLED_IDS = 19, 16, 4 << 20
SPACES, LETTERS, NUMBERS, OTHERS = range(4)
#: Bits of the first letters of a key's half, by their number.
_HALF = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: The word tokenizer's regular expression, after lower-casing.
WORD = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
#: The same words, letters first: no alternative but the last shares a first character with another.
WORD_FAST = "[{L}]+|[{N}]|'(?:s|t|re|ve|m|ll|d)|[^{S}{L}{N}]+"


class WordEncoder:
    """Ids of texts by a tokenizer of the tokenizers library.

    Where the tokenizer lower-cases, drops white space and splits words by the
    pattern ``WORD``, words do not influence one another and their ids are kept.
    That holds for texts of Latin letters and common punctuation; all other
    texts, and those with strings of special tokens, go to the library whole.

    Of these, texts of the 255 commonest letters are cut and looked up as arrays
    of one-byte codes: a slot of the table holds a word's whole code (so words
    are never mixed up) and where its ids are; what the slot does not hold is
    sought in ``cache``, which is the smaller of the two.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        single_thread()
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        config = json.loads(tokenizer_json)
        pattern = WORD.format(L=r"\p{L}", N=r"\p{N}", S=r"\s")
        pre = config["pre_tokenizer"] or {}
        steps = [p["type"] for p in pre.get("pretokenizers", [])]
        norms = [n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])]
        split = pre["pretokenizers"][0] if steps else {}
        self.by_word = (
            steps == ["Split", "ByteLevel"]
            and norms == ["NFC", "Replace", "Lowercase"]
            and split["pattern"]["Regex"].replace(r"[\p{L}]", "[L]").replace(r"[\p{N}]", "[N]") == pattern.replace(r"[\p{L}]", "[L]").replace(r"[\p{N}]", "[N]")
        )
        self.special = [t["content"] for t in config["added_tokens"]]
        # Letters, digits and marks of Latin text: stable under NFC, and their classes and cases are the same everywhere.
        chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]]
        chars = [c for c in chars if len(c.lower()) == 1 and c.lower() in chars]
        import regex

        letters = "".join(c for c in chars if regex.match(r"\p{L}", c))
        numbers = "".join(c for c in chars if regex.match(r"\p{N}", c))
        spaces = "".join(c for c in chars if regex.match(r"[\t-\r \x85\xa0    ]", c))
        self._set_codes(chars, letters, numbers, spaces)
        self.plain = re.compile("[" + re.escape("".join(chars)) + "]*")
        self.words = re.compile(WORD_FAST.format(L=re.escape(letters), N=re.escape(numbers), S=re.escape(spaces)))
        self.cache: dict[str, bytes] = {}
        self.cached_bytes = 0

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.plain.fullmatch(text) is not None
        return True

    def _set_codes(self, chars: list[str], letters: str, numbers: str, spaces: str) -> None:
        """A code of each letter, lower-cased (0: none), and the class of each code."""
        rank = lambda c: (ord(c) > 0xFF, not 0x2010 <= ord(c) <= 0x203A and c != "€", ord(c))
        lower = sorted({c for c in chars if c.lower() == c and (c.isprintable() or c in "\t\n\r\xa0\xad")}, key=rank)[:255]
        code = {c: k for k, c in enumerate(lower, 1)}
        self.codes = np.zeros(1 << 16, np.uint8)
        for c in chars:
            self.codes[ord(c)] = code.get(c.lower(), 0)
        self.kinds = np.full(256, OTHERS, np.uint8)
        for kind, of in ((SPACES, spaces), (LETTERS, letters), (NUMBERS, numbers)):
            self.kinds[[code[c] for c in of if c in code]] = kind
        # Letters after an apostrophe: 1 ends a contraction, or a second one does.
        self.one, self.two = np.zeros(256, bool), np.zeros((256, 256), bool)
        self.one[[code[c] for c in "stmd"]] = True
        for a, b in ("re", "ve", "ll"):
            self.two[code[a], code[b]] = True
        self.apostrophe = code["'"]
        self._new_table()

    def _new_table(self) -> None:
        self.table, self.pool, self.pooled = np.zeros((1 << SLOT_BITS, 3), np.uint64), np.zeros(1 << 12, "<u4"), 0

    def _spans(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words that the pattern finds in a text of codes."""
        kind = self.kinds[code]
        last = np.concatenate([np.full(1, SPACES, np.uint8), kind[:-1]])
        edge = np.append((kind != last) | (kind == NUMBERS), np.zeros(4, bool))
        at = np.flatnonzero((code == self.apostrophe) & (last != OTHERS))  # inside a run of others it is one of them
        after = np.append(code, np.zeros(2, np.uint8))
        one, two = self.one[after[at + 1]], self.two[after[at + 1], after[at + 2]]
        edge[at[one | two] + 1] = False
        edge[at[one] + 2] = edge[at[two] + 3] = True
        edge = np.flatnonzero(edge[: len(code)])
        word = kind[edge] != SPACES
        return edge[word], np.append(edge[1:], len(code))[word]

    def _learn(self, words) -> None:
        """Put words into ``cache`` that it does not hold."""
        new = [w for w in words if w not in self.cache]
        for k in range(0, len(new), 1024):
            some = new[k : k + 1024]
            for w, ids in zip(some, self._of_words(some), strict=True):
                self.cache[w] = ids
                self.cached_bytes += WORD_BYTES + len(w) + len(ids)

    def _coded(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The texts with spaces between, their codes, and where each starts."""
        whole = " ".join(texts)
        return whole, self.codes[np.frombuffer(whole.encode("utf-16-le"), "<u2")], np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]

    def _by_word(self, texts: list[str]) -> list[np.ndarray]:
        whole, code, starts = self._coded(texts)
        if code.all():
            out = self._by_code(whole, code, starts)
        else:
            rare = set((np.searchsorted(starts, np.flatnonzero(code == 0), "right") - 1).tolist())
            rest = [t for i, t in enumerate(texts) if i not in rare]
            slow, fast = iter(self._by_pattern([texts[i] for i in sorted(rare)])), iter(self._by_code(*self._coded(rest)) if rest else [])
            out = [next(slow if i in rare else fast) for i in range(len(texts))]
        if self.cached_bytes > CACHED_BYTES:  # frequent words are in most texts, words that come once in none of the last
            cache, last = self.cache, texts[-LAST_TEXTS:]
            self.cache = {w: cache[w] for w in set().union(*(self.words.findall(t.lower()) for t in last)) if w in cache}
            self.cached_bytes = sum(WORD_BYTES + len(w) + len(ids) for w, ids in self.cache.items())
            if self.cached_bytes > CACHED_BYTES // 2:
                self.cache, self.cached_bytes = {}, 0
                self._new_table()
        return out

    def _by_pattern(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.words.findall(t.lower()) for t in texts]
        self._learn(set().union(*words))
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, ws)), "<u4") for ws in words]

    def _by_code(self, whole: str, code: np.ndarray, text_starts: np.ndarray) -> list[np.ndarray]:
        """Ids of texts, of which ``whole`` is made with spaces between."""
        if self.pooled > POOLED_IDS:
            self._new_table()
        starts, ends = self._spans(code)
        length = ends - starts
        keys = np.lib.stride_tricks.sliding_window_view(np.append(code, np.zeros(KEY, np.uint8)), KEY)[starts].view("<u8")
        keys = keys & np.stack([_HALF[np.minimum(length, 8)], _HALF[np.clip(length - 8, 0, 8)]], axis=1)
        slot = (keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        slot = ((slot ^ (slot >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOT_BITS)
        found = self.table[slot]
        short = length <= KEY
        miss = np.flatnonzero((found[:, 0] != keys[:, 0]) | (found[:, 1] != keys[:, 1]) | ~short)
        place, count = (found[:, 2] >> np.uint64(16)).astype(np.int64), (found[:, 2] & np.uint64(0xFFFF)).astype(np.int64)
        if len(miss):
            low, nth = whole.lower(), {}
            which = np.array([nth.setdefault(low[a:b], len(nth)) for a, b in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)])
            self._learn(nth)
            new = [self.cache[w] for w in nth]
            sizes = np.array([len(b) // 4 for b in new])
            ids, at = np.frombuffer(b"".join(new), "<u4"), self.pooled + np.cumsum(sizes) - sizes
            if self.pooled + len(ids) > len(self.pool):
                self.pool = np.append(self.pool[: self.pooled], np.zeros(max(self.pooled, 2 * len(ids)), "<u4"))
            self.pool[self.pooled : self.pooled + len(ids)] = ids
            self.pooled += len(ids)
            place[miss], count[miss] = at[which], sizes[which]
            kept = miss[short[miss] & (count[miss] < 1 << 16)]
            kept = kept[np.unique(slot[kept], return_index=True)[1]]  # one word a slot
            self.table[slot[kept]] = np.column_stack([keys[kept], (place[kept] << 16 | count[kept]).astype(np.uint64)])
        upto = np.append(0, np.cumsum(count))
        ids = self.pool[np.arange(upto[-1]) + np.repeat(place - upto[:-1], count)]
        cuts = upto[np.append(np.searchsorted(starts, text_starts), len(starts))].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: they stand in one text, whose pre-tokens they are."""
        found = self.tok.encode(" ".join(words), add_special_tokens=False)
        nth = found.word_ids
        if not nth or None in nth or nth[-1] + 1 != len(words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        at = (4 * np.searchsorted(nth, np.arange(len(words) + 1))).tolist()
        data = np.array(found.ids, "<u4").tobytes()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        some: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            if self.by_word and self._plain(t) and not any(s in t for s in self.special):
                some.append(i)
                chars += len(t)
            else:
                out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4")
            if some and (chars > CHARS_AT_ONCE or i + 1 == len(texts)):
                for j, ids in zip(some, self._by_word([texts[j] for j in some]), strict=True):
                    out[j] = ids
                some, chars = [], 0
        return out


def _encoder(tokenizer_json: str) -> WordEncoder:
    """The worker process's encoder: kept from task to task, until another operator's."""
    kept = worker_cache()
    if tokenizer_json not in kept:
        kept[tokenizer_json] = WordEncoder(tokenizer_json)
    return kept[tokenizer_json]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays; where there are too few
    to train one, their bytes; empty for none."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_store(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    end_id: int | None = 1,
    level: int = 3,
    dictionary_docs: int = DICTIONARY_DOCS,
    bucket_bytes: int = BUCKET_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text, append ``end_id`` and write the store at ``path``.

    Null texts are empty (the end id alone); null ids come first; rows that
    repeat an id stand side by side, ordered by a hash of their frames. Buckets
    are ranges of id and hash, so null or repeated ids fill as many as others.
    No text is shuffled and each text is encoded once (the few of the
    dictionary's sample twice). Ids are whole numbers, others raise; other
    columns are not read; an empty table makes a store of no segments.
    """
    import zstandard

    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col}: a store's ids are whole numbers")
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    shared = spark.sparkContext.broadcast(text)  # one vocabulary: some MB
    vocabulary = WordEncoder(text).tok.get_vocab_size(with_added_tokens=True)
    width = 2 if max(vocabulary, end_id or 0) <= 1 << 16 else 4
    kind = f"<u{width}"
    end = [] if end_id is None else [end_id]

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sample = rows.orderBy(F.xxhash64("id", "t"), "id").limit(dictionary_docs)

    def serialize(batches):
        encode = _encoder(shared.value)
        for batch in batches_of(batches, keep=shared.value):
            arrays = encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([np.append(a, end).astype(kind).tobytes() for a in arrays], pa.binary())], ["b"])

    samples = [bytes(r.b) for r in sample.mapInArrow(serialize, "b binary").collect()]
    data = train_dictionary(samples)
    sha = hashlib.sha256(data).hexdigest()

    def compress(batches):
        encode = _encoder(shared.value)
        zd = _dictionary(data)
        z = zstandard.ZstdCompressor(level=level, dict_data=zd) if zd else zstandard.ZstdCompressor(level=level)
        for batch in batches_of(batches, keep=shared.value):
            arrays = encode(batch.column(1).to_pylist())
            arrays = [np.append(a, end).astype(kind) for a in arrays]
            cols = [batch.column(0), pa.array([len(a) for a in arrays], pa.int64()), pa.array([z.compress(a.tobytes()) for a in arrays], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "frame"])

    frames = materialise(rows.mapInArrow(compress, "id long, n long, frame binary"), "token-frames")
    size = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    buckets = max(1, int(size // (bucket_bytes // 4)))

    def pack(batches):
        held, state = [], {"segment": 0, "start": 0, "bytes": 0}

        def flush():
            ids, ns, fs = zip(*held, strict=True)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in fs])]).tolist()
            real = [i for i in ids if i is not None]
            row = {
                "bucket": bucket, "segment": state["segment"], "local_start": state["start"], "first_id": min(real, default=None),
                "last_id": max(real, default=None), "dict_sha256": sha, "ids": list(ids), "n_tokens": list(ns), "offsets": offsets, "blob": b"".join(fs),
            }
            state.update(segment=state["segment"] + 1, start=state["start"] + sum(ns), bytes=0)
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT_ARROW)

        for batch in batches_of(batches):
            for i, n, frame, bucket in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((i, n, frame))
                state["bytes"] += len(frame)
                if len(held) >= SEGMENT_DOCS or state["bytes"] >= SEGMENT_BYTES:
                    yield flush()
        if held:
            yield flush()

    by = [F.asc_nulls_first("id"), F.xxhash64("frame").asc()]
    ranged = frames.repartitionByRange(buckets, *by).sortWithinPartitions(*by, "frame")
    segments = ranged.withColumn("bucket", F.spark_partition_id()).mapInArrow(pack, SEGMENT_DDL)
    segments.write.parquet(f"{path}/segments")
    discard(frames)
    head = [(bytearray(data), sha, width, end_id)]
    spark.createDataFrame(head, "dictionary binary, sha256 string, id_bytes int, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")


SEGMENT_DDL = (
    "bucket int, segment int, local_start long, first_id long, last_id long, dict_sha256 string, "
    "ids array<long>, n_tokens array<long>, offsets array<long>, blob binary"
)
SEGMENT_ARROW = pa.schema(
    [
        ("bucket", pa.int32()), ("segment", pa.int32()), ("local_start", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
        ("dict_sha256", pa.string()), ("ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("blob", pa.binary()),
    ]
)


def _head(spark: SparkSession, path: str):
    head = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(head.dictionary)).hexdigest() != head.sha256:
        raise ValueError(f"{path}: the dictionary does not have the hash it was written with")
    return head


def read_store(spark: SparkSession, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Every document of the store: id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)
    and, if asked for, ``ids``."""
    import zstandard

    head = _head(spark, path)
    data, sha, kind = bytes(head.dictionary), head.sha256, f"<u{head.id_bytes}"
    segments = spark.read.schema(SEGMENT_DDL).parquet(f"{path}/segments")
    totals = segments.groupBy("bucket").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A row a bucket of BUCKET_BYTES / 4 of frames: some two million at 100 TB of text, of 12 bytes each, in one task.
    bases = materialise(totals.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "token-bases")
    placed = segments.join(bases, "bucket").select((F.col("base") + F.col("local_start")).alias("start"), "dict_sha256", "ids", "n_tokens", "offsets", "blob")

    def decode(batches):
        zd = _dictionary(data)
        z = zstandard.ZstdDecompressor(dict_data=zd) if zd else zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                start, named, ids, ns, offsets, blob = (c[row].as_py() for c in batch.columns)
                if named != sha:
                    raise ValueError("a segment names another dictionary")
                starts, crcs, arrays = [], [], []
                for n, a, b in zip(ns, offsets, offsets[1:], strict=False):
                    got = np.frombuffer(z.decompress(blob[a:b]), kind).astype("<u4")
                    if len(got) != n:
                        raise ValueError("a frame does not hold the tokens that the index names")
                    starts.append(start)
                    crcs.append(zlib.crc32(got.tobytes()))
                    arrays.append(got.astype(np.int32) if with_ids else None)
                    start += n
                cols = [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(arrays, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    out = placed.mapInArrow(decode, "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id: only segments whose bounds hold it are
    read, and only its own frames are decompressed."""
    import zstandard

    head = _head(spark, path)
    zd = _dictionary(bytes(head.dictionary))
    z = zstandard.ZstdDecompressor(dict_data=zd) if zd else zstandard.ZstdDecompressor()
    near = spark.read.schema(SEGMENT_DDL).parquet(f"{path}/segments").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    spans = near.select(F.explode(F.arrays_zip("ids", "offsets", F.slice("offsets", 2, SEGMENT_DOCS + 1).alias("ends"))).alias("x"), "blob", "bucket", "segment")
    spans = spans.where(F.col("x.ids") == doc_id).select("bucket", "segment", F.col("x.offsets").alias("o"), F.expr("substring(blob, cast(x.offsets as int) + 1, cast(x.ends - x.offsets as int))").alias("frame"))
    return [np.frombuffer(z.decompress(bytes(r.frame)), f"<u{head.id_bytes}").tolist() for r in spans.orderBy("bucket", "segment", "o").collect()]


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write a store (in the shared folder unless ``path`` says where) and read
    it back: what ``read_store`` returns."""
    path = path or scratch_path(docs.sparkSession, "token-store")
    write_store(docs, tokenizer_path, path, **options)
    return read_store(docs.sparkSession, path)
