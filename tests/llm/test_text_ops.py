"""License scan, exact dedup, SimHash, URL filter and decontamination."""

import random

import pytest
from pyspark.sql import functions as F

from inkframe.llm import license_scan as L
from inkframe.llm import queries as Q
from inkframe.llm.common import row_key
from inkframe.llm.decontaminate import decontaminate
from inkframe.llm.exact_dedup import exact_dedup
from inkframe.llm.hamming import components, hamming_links
from inkframe.llm.simhash import simhash_dedup
from inkframe.llm.url_filter import url_filter

from . import reference as R

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "a b", "Łódź ÉÉ K İ", "mit license MIT-License", "the MIT\nLicense.", "x " * 30000]


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], DOCS)


def real(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


def test_license_scan_matches_brute_force(spark, sf):
    texts = real(spark, sf) + ODD + [
        "Preamble.\nReleased under the MIT License.", "cc by nc cc by nc", "Licensed under Apache License Version 2",
        "licensed under the bsd license " + "filler " * 300, "under a CC BY\n4.0, or CC BY-SA 4.0", "Creative Commons Attribution 4.0 ShareAlike", "filler " * 217 + "licensed under the GNU general public license version 3 " + "more " * 200,
    ]
    table = L.template_table(L.TEMPLATES, 0.8)
    half = max(len(L.words_of(t)) for ts in L.TEMPLATES.values() for t in ts)
    pairs = {t for _, _, toks, _ in table for t in toks if "_" in t}
    got = {r.doc_id: r for r in L.license_scan(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts) and pairs
    some = 0
    for i, text in enumerate(texts):
        n, hits, first, last, labels = R.license_base(text, L.PHRASES)
        best = {}
        for block in R.license_blocks(text, half, pairs):
            for number, label, toks, need in table:
                if (o := len(block & set(toks))) >= need:
                    best[number, label] = max(best.get((number, label), 0), o / len(toks))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, hits, first, last), i
        assert r.base_labels == ",".join(sorted(labels))
        assert {(m.template, m.label): m.containment for m in r.matches} == pytest.approx(best), i
        assert r.labels == ",".join(sorted(labels | {k[1] for k in best}))
        assert r.score == pytest.approx(1 if hits else max(best.values(), default=0))
        some += bool(best)
    assert some > 3


def test_license_scan_sees_notices_over_several_lines(spark):
    texts = [
        "Copyright\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
        "Redistribution and use in source and binary forms, with\n# or without modification, are permitted provided\n# that the following conditions are met:",
        "filler " * 70 + "you may not use this\nfile except in compliance with\r\nthe License. You may obtain a copy\nof the License at" + " more\n" * 90,
    ]
    got = {r.doc_id: r.labels for r in L.license_scan(docs_of(spark, texts)).collect()}
    assert got == {0: "mit", 1: "bsd", 2: "apache-2"}


def test_license_scan_tells_licenses_apart(spark):
    notices = {
        "Licensed under the Apache License, Version 2.0.": "apache-2",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2",
        "This program is under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl-2",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under CC BY 4.0.": "cc-by",
        "licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "Creative Commons Attribution-ShareAlike 4.0 and Creative Commons Attribution 4.0": "cc-by,cc-by-sa",
        "Released under the MIT License.": "mit",
        "Licensed under the BSD license": "bsd",
        "Subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2",
        "licensed under the terms of a license": "",
    }
    got = {r.doc_id: r.labels for r in L.license_scan(docs_of(spark, list(notices))).collect()}
    assert [got[i] for i in range(len(notices))] == list(notices.values())


def test_license_scan_empty_and_repeated(spark):
    assert L.license_scan(docs_of(spark, ["a"]).limit(0)).count() == 0
    rows = L.license_scan(docs_of(spark, ["mit license", "mit license", "x"], [1, 1, None])).collect()
    assert sorted((r.doc_id or -1, r.n_base) for r in rows) == [(-1, 0), (1, 1), (1, 1)]


def test_license_query_has_the_contracts_phrases(spark, tmp_path):
    """The base phrase is "under the mit license"; the bare name adds its label alone."""
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    texts = ODD + ["Released under the MIT License.", "The MIT License", "mit license, under the MIT-license", "Apache License, Version 2.0 and CC BY-NC 4.0", "under the\nMIT\tLICENSE under the mit license"]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.op1_license_scan(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        *want, labels = R.license_base(text, phrases)
        assert [got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels] == [*want, ",".join(sorted(labels))], i
    bare = got[len(ODD) + 1]
    assert (bare.n_base, bare.first_word, bare.base_labels, bare.labels, bare.score) == (0, None, "", "mit", 1.0)


def test_exact_dedup_edge_cases(spark):
    docs = docs_of(spark, ["x", "x", None, "", "y", "x", "x"], [1, 2, 3, 4, 5, None, 2])
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, keep="largest").collect()}
    assert got == {(1, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True)}
    small = {r.keep_id for r in exact_dedup(docs).collect()}
    assert small == {1, 3, 5}
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_tells_collisions_apart(spark):
    docs = docs_of(spark, ["aa", "ab", "aa", "b", "ab", "ac"])
    rows = exact_dedup(docs, content_hash=lambda c: F.substring(c, 1, 1)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(0, 0, 2), (2, 0, 2), (1, 1, 2), (4, 1, 2), (3, 3, 1), (5, 5, 1)}


def test_simhash_matches_brute_force(spark, sf):
    texts = real(spark, sf) + ODD + [t.replace("the ", "thee ", 1) for t in real(spark, sf)[:40]]
    out = simhash_dedup(docs_of(spark, texts), shingle=3, distance=2)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in out.collect()}
    want = {i: R.simhash(t) for i, t in enumerate(texts)}
    assert {i: g[0] for i, g in got.items()} == want
    assert {i: g[1] for i, g in got.items()} == R.linked(want, 2)
    assert len({g[1] for g in got.values()}) < len(texts) - 5


@pytest.mark.parametrize("distance,segments", [(2, 2), (3, 2), (5, 3)])
@pytest.mark.parametrize("limit", [3, 10**6])
def test_hamming_links_are_complete(spark, distance, segments, limit):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance))) for c in centres for _ in range(40)}
    rows = [(i, f - 2**64 if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    got = {tuple(sorted(r)) for r in hamming_links(spark.createDataFrame(rows, "rep long, fp long"), distance, segments, limit).collect()}
    want = {(i, j) for i, f in rows for j, g in rows if i < j and ((f ^ g) % 2**64).bit_count() <= distance}
    assert got == want


@pytest.mark.parametrize("limit", [3, 10**6])
def test_probes_are_not_broadcast(spark, limit):
    """There are many times as many as Spark reckons, whatever size it gives them."""
    nodes = spark.range(64).select(F.col("id").alias("rep"), F.col("id").alias("fp"))
    plan = hamming_links(nodes, 2, 2, limit)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line and "Inner" in line]
    assert len(joins) == (2 if limit == 3 else 1) and all("SortMergeJoin" in j for j in joins)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_null_and_repeated_ids(spark):
    docs = docs_of(spark, ["a b c d", "a b c d", None, "", "q", "a b c d"], [5, None, 7, 3, 9, 5])
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash_dedup(docs, 3, 2, 2).collect())
    assert got == [(-1, None), (3, 3), (5, 5), (5, 5), (7, 3), (9, 9)]
    assert simhash_dedup(docs.limit(0)).count() == 0


def test_decontaminate_matches_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(1000, "short item"), (1001, "a"), (1002, ""), (1003, None), (None, "a b"), (1004, items[0][1]), (1005, "a a a a a a a a a a a")]
    passage = " ".join(R.words(items[1][1])[:14])
    texts = real(spark, sf) + ODD + [f"x {passage} y", passage, f"{passage} {passage}", "Short  ITEM", "a " * 25, items[2][1].upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for pass_bytes in (1 << 25, 2000):
        out = decontaminate(docs_of(spark, texts), bench, pass_bytes=pass_bytes)
        out = out.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("d"), "contaminated")
        got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
        assert got == {i: R.contamination(t, items) for i, t in enumerate(texts)}
    assert decontaminate(docs_of(spark, ["a"]), bench.limit(0)).first().contaminated is False
    two = decontaminate(docs_of(spark, ["a b", "a b"], [None, None]), bench, pass_bytes=2000)
    assert two.count() == 2


def test_url_filter_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?y#z", "http://example.com", "https://a.www.example.com/en/", "http://notexample.com/en/",
            "http://x.net/es/1", "http://net/fr/", "http://a.net/fr", "a://b://c.com/", "http://x.com:80/"]
    rules = spark.createDataFrame([*Q.URL_RULES, ("com", "/", "allow"), (None, "/", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, rules).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[5] == ("example.com", "", None, "allow")
    assert got[6][2:] == ("www.example.com/en/", "allow")
    assert got[7][2:] == ("com/", "allow")
    assert got[8][2:] == ("net/es/", "block") and got[9][2:] == ("net/fr/", "block") and got[10][2] is None
    assert got[11] == ("b:", "//c.com/", None, "allow") and got[12][:3] == ("x.com:80", "/", None)
    assert url_filter(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_url_filter_ties_repeats_and_clashing_columns(spark):
    rules = spark.createDataFrame([("a.net", "/", "block"), ("net", "/ab", "block"), ("a.net", "/x", "allow"), ("net", "/x/y", "block")], "host string, path string, action string")
    long = "http://" + "s." * 2000 + "a.net/ab" + "/p" * 3000
    urls = ["http://a.net/ab", "http://a.net/ab", None, None, long, "http://a.net/x/y", "http://b.net/q"]
    pages = spark.createDataFrame([(i, u, "old", "old", 7) for i, u in enumerate(urls)], "page_id long, url string, verdict string, best string, __u int")
    out = url_filter(pages, rules)
    assert out.columns == ["page_id", "url", "best", "__u", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.rule, r.verdict, r.best, r["__u"]) for r in out.collect()}
    assert got[0] == got[1] == ("a.net/", "block", "old", 7)  # as long as net/ab: the smallest text
    assert got[2] == got[3] == (None, "allow", "old", 7) and got[4][:2] == ("a.net/", "block")
    assert got[5][:2] == ("net/x/y", "block")  # of equally long ones a block
    assert got[6][:2] == (None, "allow") and len(got) == 7


@pytest.mark.parametrize("name", ["op1", "op4", "op5", "op6", "op10"])
def test_odd_ids_and_clashing_columns(spark, name):
    """Ids as text, columns of names that the operators use, rows that repeat."""
    import public_tokenizers

    from inkframe.llm.token_count import token_counts

    ops = {
        "op1": lambda d: L.license_scan(d),
        "op4": lambda d: simhash_dedup(d, 3, 2),
        "op5": lambda d: token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
        "op6": lambda d: decontaminate(d, spark.createDataFrame([("i", "a b")], "item_id string, text string")),
        "op10": lambda d: exact_dedup(d),
    }
    docs = docs_of(spark, ["a b c", "a b c", None, "mit license"]).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    for c in ("id", "key", "t", "n", "c", "h", "fp", "node", "labels", "spans", "kept", "w"):
        docs = docs.withColumn(c, F.lit("own"))
    rows = ops[name](docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["None", "None", "d2", "d3"]
    assert ops[name](docs.limit(0)).count() == 0


def test_license_phrases_of_other_letters(spark):
    rows = L.license_scan(docs_of(spark, ["LICENCE ÉTÉ x", "licence été x"]), phrases={"licence ÉTÉ": "e"}, templates={"f": ["gratuité ÉTÉ x"]}).collect()
    assert {r.doc_id: (r.n_base, r.labels) for r in rows} == {0: (1, "e"), 1: (0, "")}


def test_large_benchmarks_are_searched_in_passes_and_rounds(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = real(spark, sf)[:60]
    docs = docs_of(spark, texts)
    one = {r.doc_id: (r.n_hit, r.spans, r["items"]) for r in decontaminate(docs, bench).collect()}
    size = sum(len(t) for _, t in items)
    few = {r.doc_id: (r.n_hit, r.spans, r["items"]) for r in decontaminate(docs, bench, pass_bytes=size // 7, round_bytes=size // 2).collect()}
    assert one == few and {i for i, v in one.items() if v[0]} == {i for i, t in enumerate(texts) if R.contamination(t, items)[4]}


def test_row_key_tells_null_from_empty(spark):
    rows = spark.createDataFrame([(1, None), (1, ""), (None, "1"), (None, None)], "a long, b string")
    assert rows.select(row_key(F.col("a"), F.col("b"))).distinct().count() == 4
