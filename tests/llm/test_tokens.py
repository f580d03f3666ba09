"""Token counts and the token store against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkframe.llm import common, token_store
from inkframe.llm.token_count import token_counts
from inkframe.llm.token_store import WordEncoder, read_document, read_store, train_dictionary, write_store

from .test_text_ops import ODD, docs_of, real

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def odd_texts(n=300):
    rng = random.Random(5)
    alphabet = "aAbZ'stvemlld 0129½²!?-_\n\t\r\x0b\x0c\x1c\x1f\x85\xa0éßÀıİẞ  　́KΩ日本жΣσ😀\U0001f468‍ก٠ﬁ­’€͸\U000323b0<|>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(n)] + [
        "a<|endoftext|>b !<|endoftext|>  <|startoftext|>", "  <|endoftext|>", "<|endoftext|><|endoftext|>", "it's IT'S we'll 's", "ΑΣ ΣΑΣ", " x" * 5000,
    ]


def test_counts_are_the_librarys(spark, sf):
    texts = real(spark, sf) + ODD + odd_texts()
    tok = Tokenizer.from_file(BYTE)
    want = {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    for frequent in (262_144, 50):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs_of(spark, texts), BYTE, frequent=frequent).collect()}
        assert got == want
    rows = token_counts(docs_of(spark, ["a b", "a b", None], [1, 1, None]), BYTE, limit=1).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.over_limit) for r in rows) == [(-1, 0, False), (1, 2, True), (1, 2, True)]
    assert token_counts(docs_of(spark, ["a"]).limit(0), BYTE).count() == 0
    with pytest.raises(ValueError):
        token_counts(docs_of(spark, ["a"]), WORD)


def test_word_encoder_is_the_library():
    tok = Tokenizer.from_file(WORD)
    encode = WordEncoder(open(WORD).read())
    assert encode.by_word
    texts = odd_texts(2000) + [t or "" for t in ODD]
    texts += [chr(a) + chr(b) for a in range(0x250) for b in (0x41, 0x27, 0x21)]
    for t, got in zip(texts, encode(texts), strict=True):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_letters_are_tried_first_and_words_stay():
    import re

    encode = WordEncoder(open(WORD).read())
    classes = {"L": "a-zé", "N": "0-9½", "S": r"\s"}
    slow, fast = (re.compile(p.format(**classes)) for p in (token_store.WORD, token_store.WORD_FAST))
    for t in odd_texts(2000):
        assert fast.findall(t.lower()) == slow.findall(t.lower())
    assert encode.words.pattern.startswith("[")


def test_store_round_trip(spark, sf, tmp_path):
    texts = real(spark, sf) + ODD + odd_texts(50)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    tok = Tokenizer.from_file(WORD)
    path = f"file://{tmp_path}/store"
    write_store(docs_of(spark, texts, ids), WORD, path, bucket_bytes=100_000)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in zip(ids, texts, strict=True)}
    got = read_store(spark, path, with_ids=True).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(ids)
    start = 0
    for r in sorted(got, key=lambda r: r.doc_id):
        assert r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) and r.start == start
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert spark.read.parquet(f"{path}/segments").select("bucket").distinct().count() > 1
    for i in (0, 7, len(texts) - 1):
        assert read_document(spark, path, i) == [want[i]]
    assert read_document(spark, path, 10**9) == []


def test_store_of_odd_tables(spark, tmp_path):
    docs = docs_of(spark, ["a", "b", None, "a"], [3, None, 3, 3])
    write_store(docs, WORD, f"file://{tmp_path}/few")
    rows = sorted(read_store(spark, f"file://{tmp_path}/few").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 3, 3, 3] and sum(r.n_tokens for r in rows) == rows[-1].start + rows[-1].n_tokens
    write_store(docs.limit(0), WORD, f"file://{tmp_path}/none")
    assert read_store(spark, f"file://{tmp_path}/none").count() == 0
    assert train_dictionary([]) == b""


def test_word_cache_is_bounded_by_bytes(monkeypatch):
    """Many different words, and long ones: ids stay right and the kept bytes bounded."""
    monkeypatch.setattr(token_store, "CACHED_BYTES", 40_000)
    tok = Tokenizer.from_file(WORD)
    encode = WordEncoder(open(WORD).read())
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    for k in range(30):
        texts = [" ".join(["the", "of", *(word(rng.randint(3, 12)) for _ in range(20))]) for _ in range(3)] + [word(30_000)] * (k == 20)
        for t, got in zip(texts, encode(texts), strict=True):
            assert got.tolist() == tok.encode(t, add_special_tokens=False).ids
        held = sum(len(w) + len(ids) for w, ids in encode.cache.items())
        assert held <= 40_000 and encode.cached_bytes == held + token_store.WORD_BYTES * len(encode.cache) <= 40_000
    assert {"the", "of"} <= set(encode.cache)  # what the last texts hold stays


def test_words_of_common_letters_are_found_without_the_pattern(monkeypatch):
    tok = Tokenizer.from_file(WORD)
    encode = WordEncoder(open(WORD).read())
    monkeypatch.setattr(encode, "words", None)
    rng = random.Random(8)
    alphabet = "abstvremldABZ' '  .,-!09½²é“”’…€\n\tšß"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [word(rng.randint(0, 80)) for _ in range(3000)] + ["", " ", "'s", "x" * 16, "x" * 17, "x" * 40 + "'ll'", "' 's 't's'D'RE'v"]
    for _ in range(2):  # the second time all words are known
        for t, got in zip(texts, encode(texts), strict=True):
            assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_that_share_a_slot_stay_apart(monkeypatch):
    monkeypatch.setattr(token_store, "SLOT_BITS", 2)
    monkeypatch.setattr(token_store, "POOLED_IDS", 50)
    tok = Tokenizer.from_file(WORD)
    encode = WordEncoder(open(WORD).read())
    rng = random.Random(9)
    for _ in range(20):
        texts = odd_texts(10) + [" ".join(rng.choice(["the", "of", "and", "thea", "internationally", "misunderstandings"]) for _ in range(30))]
        for t, got in zip(texts, encode(texts), strict=True):
            assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_stays_small_over_many_words():
    """200,000 words that come once: no more than 20 MB beside the table, and frequent words need no second look."""
    import tracemalloc

    encode = WordEncoder(open(WORD).read())
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 9))) for _ in range(200_000)]
    texts = ["the of " + " ".join(words[k : k + 300]) for k in range(0, len(words), 300)]
    learnt, learn = [], encode._learn
    encode._learn = lambda some: learn(learnt.append(len(some)) or some)
    tracemalloc.start()
    try:
        for k in range(0, len(texts), 50):
            encode(texts[k : k + 50])
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
    finally:
        tracemalloc.stop()
    tok = Tokenizer.from_file(WORD)
    for t, got in zip(texts[:5], encode(texts[:5]), strict=True):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids
    assert sum(learnt) < len(words) * 1.2


def test_workers_forget_what_other_operators_kept():
    text = open(WORD).read()
    kept = token_store._encoder(text)
    assert list(common.batches_of([pa.array([1, 2])], keep=text)) == [pa.array([1, 2])] and token_store._encoder(text) is kept
    assert list(common.batches_of([pa.array([1, 2])])) == [pa.array([1, 2])] and text not in common.worker_cache()
    assert token_store._encoder(text) is not kept
    common.forget()
