"""Ranked search against a plain version with dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from dossierflow.llm import queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(docs, items, **named):
    return sorted((tuple(r) for r in ranked.search(ranked.build_index(docs), items, **named).collect()), key=repr)


def test_terms():
    for text in ("", "a_b-C9 É▁x\x7fy\x80z", "ÀB 日本　語 İ \x00q", "x" * 100_000):
        assert [t.decode() for t in ranked.split_terms(text)] == terms(text)


@pytest.mark.parametrize("name", ["docs", "sample"])
def test_search_equals_plain_version(request, spark, name):
    docs = request.getfixturevalue(name)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(-1, "The ALPHA beta, the word!"), (-2, None), (-3, "?!"), (-4, "nosuchterm"), (-5, "the the Ünïcödé 日本語")], "item_id long, text string"))
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert found(docs, items) == want


def test_small_shards_and_blocks_give_the_same_rows(spark, sample, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").withColumns({c: queries.F.lit(1) for c in ("item", "block", "id", "w", "score", "rank")})
    whole = found(sample, items)
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 700)
    assert found(sample, items) == whole


def test_ties_nulls_and_repeats(spark):
    rows = [(7, "same words here"), (3, "same words here"), (None, "same words here"), (3, "same words here"), (5, "same words here"), (9, None), (10, ""), (11, "--"), (12, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: queries.F.lit(1) for c in ("ids", "terms", "id")})
    items = spark.createDataFrame([(1, "same"), (1, "same"), (None, "words"), (2, "other same"), (4, "here"), (4, "other")], "item_id long, text string")
    got = [tuple(r) for r in ranked.search(ranked.build_index(docs), items, k=3).collect()]
    of = lambda i: [(r[1], r[2]) for r in sorted((r for r in got if r[0] == i), key=lambda r: r[1])]
    assert of(1) == [(1, 3), (2, 3), (3, 5)] == of(None)  # repeated rows are documents each, equal items are answered once
    assert of(2) == [(1, 12), (2, 3), (3, 3)]
    assert sorted(of(4)) == [(1, 3), (1, 12), (2, 3), (3, 5)]
    all_ = sorted(r[1:3] for r in ranked.search(ranked.build_index(docs), items.where("item_id = 1").distinct(), k=9).collect())
    assert all_ == [(1, 3), (2, 3), (3, 5), (4, 7), (5, None)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(ranked.build_index(docs), items).collect() == []
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranked.search(ranked.build_index(some), items.limit(0)).collect() == []


def test_selection_keeps_ties():
    sums, ids = np.array([5, 0, 9, 5, 5, 7]), np.array([4, 1, 8, 2, 3, 6])
    none = np.zeros(6, dtype=bool)
    assert ids[ranked._best(sums, ids, none, 3)].tolist() == [8, 6, 2]
    assert ids[ranked._best(sums, ids, none, 9)].tolist() == [8, 6, 2, 3, 4]
    none[3] = True
    assert ids[ranked._best(sums, ids, none, 4)].tolist() == [8, 6, 3, 4]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted((tuple(r) for r in queries.op13_ranked_search(spark, d).collect()), key=repr) == want
