"""The near-dedup stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline as C
from inkframe.llm.near_copies import near_copies, without_near_copies

from . import reference as R
from .test_text_ops import docs_of


def shingles(text, n=5):
    w = R.words(text, R.TOKEN)
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def components(sets, least=0.8):
    root = {i: i for i in sets}
    at = {}
    for i, s in sets.items():
        for x in s or {()}:
            at.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {(a, b) for ids in at.values() for a in ids for b in ids if a < b}:
        if find(a) != find(b) and similarity(sets[a], sets[b]) >= least:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def edited(rng, words, edits):
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"new{rng.random()}"
    return " ".join(words)


def pairs_of(rng, edits, count=40):
    """Pairs of texts of 300 words, one of them with some words replaced."""
    for _ in range(count):
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        yield " ".join(words), edited(rng, words, edits)


def test_pairs_just_over_the_threshold_are_linked_and_others_not(spark):
    rng = random.Random(4)
    pairs = [p for edits in (3, 5, 6, 7, 9, 11) for p in pairs_of(rng, edits)]
    docs = docs_of(spark, [t for p in pairs for t in p])
    got = {r.id: r.component_id for r in near_copies(docs).collect()}
    near, lost = 0, 0
    for k, (a, b) in enumerate(pairs):
        if similarity(shingles(a), shingles(b)) >= 0.8:
            near += 1
            lost += got[2 * k] != got[2 * k + 1]
        else:
            assert got[2 * k] != got[2 * k + 1]
    assert 100 < near < 200 and lost <= 0.05 * near


def test_stage_keeps_what_brute_force_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    group = [edited(rng, words, k % 5) for k in range(150)]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(docs_of(spark, group, range(10**6, 10**6 + 150)))
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    want = components(sets)
    got = {r.doc_id for r in C.near_dedup(spark, docs, "").collect()}
    best = {i for i, root in want.items() if i == root}
    assert best <= got and len(got) <= 1.01 * len(best)  # a pair at the threshold may be missed, none is made up


def test_rows_are_judged_by_their_texts(spark):
    texts = ["a b c", "d e f", "a b c", "d e f", None, "", "z", "z", "q r", "q r"]
    docs = docs_of(spark, texts, [1, 2, 3, 3, 5, 6, None, 8, None, None])
    got = sorted((r.id or -1, r.component_id or -1) for r in near_copies(docs).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 8), (1, 1), (2, 2), (3, 1), (3, 2), (5, 5), (6, 5), (8, 8)]
    kept = sorted((r.doc_id or -1, r.text) for r in without_near_copies(docs).collect())
    assert kept == [(-1, "q r"), (1, "a b c"), (2, "d e f"), (5, None), (8, "z")]


def test_two_texts_under_one_id_both_stay(spark):
    docs = docs_of(spark, ["first text of all", "another text of its own", "first text of all"], [4, 4, 4])
    assert sorted(r.text for r in without_near_copies(docs).collect()) == ["another text of its own", "first text of all"]


def test_clashing_columns_string_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [("b", long, 1, 2, 3), ("a", long + " end", 4, 5, 6), ("c", "x", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __own int, node int, row int")
    got = without_near_copies(docs)
    assert got.columns == docs.columns and sorted(tuple(r)[2:] for r in got.where("doc_id <> 'c'").collect()) == [(4, 5, 6)]
    assert got.count() == 2 and without_near_copies(docs.limit(0)).count() == 0


def test_sketch_marks_the_least_certain_bits():
    import numpy as np

    from inkframe.llm import near_copies as N

    h = np.unique(np.random.default_rng(0).integers(0, 2**63, 2500, dtype=np.uint64))
    fps, low = N.sketch(h)
    for f in range(N.FAMILIES):
        z = N._mixed(h + N._FAMILY[f]).tolist()
        margin = [2 * sum(x >> b & 1 for x in z) - len(h) for b in range(64)]
        assert fps[f] % 2**64 == sum(1 << b for b in range(64) if margin[b] > 0)
        margin = [abs(m) for m in margin]
        for s in (0, 1):
            seg = range(s * N.WIDTH, (s + 1) * N.WIDTH)
            marked = [b for b in seg if low[f] >> b & 1]
            assert len(marked) == N.FLIPS and max(margin[b] for b in marked) <= min(margin[b] for b in seg if b not in marked)


def test_keys_are_all_ways_of_the_uncertain_bits(spark):
    from inkframe.llm import near_copies as N

    # Families 0 to 2 are of no matter here.
    fp, low = 0b1011 | 1 << 63, 0b0111 | 0b111 << N.WIDTH
    nodes = spark.createDataFrame([(1, [0, 0, 0, fp - 2**64], [7, 7, 7, low])], "node long, fps array<long>, low array<long>")
    rows = N.table_entries(nodes).where("key >= 6L << 32").collect()
    assert {(r.node, r.fp) for r in rows} == {(1, fp - 2**64)}
    assert sorted(r.key for r in rows) == sorted([6 << 32 | 0b1000 | x for x in range(8)] + [7 << 32 | x for x in range(8)])


def test_entries_are_shuffled_once_and_only_texts_of_pairs_are_read(spark, monkeypatch):
    from inkframe.llm import near_copies as N

    plans, rows, whole = {}, {}, N.materialise

    def made(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        out = whole(df, tag)
        rows[tag] = out.count() if tag == "near-texts" else None
        return out

    monkeypatch.setattr(N, "materialise", made)
    same = " ".join(f"w{i}" for i in range(200))
    texts = [same, same + " end", *(f"text {i} on its own" for i in range(40))]
    N.near_copies(docs_of(spark, texts)).collect()
    assert plans["near-buckets"] == 1 and "near-entered" not in plans
    assert rows["near-texts"] in (0, 2)  # of the first pairs, or of none that are left


def test_a_large_group_makes_a_few_pairs_a_member(spark, monkeypatch):
    from inkframe.llm import near_copies as N

    compared, whole = [], N._links

    def links(pairs, *rest):
        compared.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(N, "_links", links)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    got = N.near_copies(docs_of(spark, [edited(rng, words, 1 + k % 6) for k in range(300)])).collect()
    assert len({r.component_id for r in got}) == 1
    assert sum(compared) < 20 * 300, compared


def test_nodes_around_a_large_group_are_not_compared_with_all_of_it(spark, monkeypatch):
    from inkframe.llm import near_copies as N

    compared, whole = [], N._links

    def links(pairs, *rest):
        compared.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(N, "_links", links)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(150)]
    texts = [edited(rng, words, k % 3) for k in range(300)] + [edited(rng, words, 4 + k % 2) for k in range(150)]
    far = edited(rng, words, 6)  # near to one another, not to the group
    texts += [edited(rng, far.split(" "), k % 2) for k in range(10)]
    got = {r.id: r.component_id for r in N.near_copies(docs_of(spark, texts)).collect()}
    want = components({i: shingles(t) for i, t in enumerate(texts)})
    assert got == want and len(set(want.values())) > 100
    assert sum(compared) < 5000, compared
