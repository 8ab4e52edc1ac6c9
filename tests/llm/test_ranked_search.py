from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from stratanet.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, all_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked: dict = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, bag in bags:
            m = 10 + (90 * bag.total() * n_docs) // all_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in wanted if t in bag
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def some(seed):
    rng = random.Random(seed)
    words = ["the", "cat", "Dog", "über", "x1", "and", "mat", "zoo", "你好", "ß"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(rng.randint(1, 12))) for i in range(80)]
    docs += [(100 + i, "cat; cat-mat") for i in range(30)] + [(5, "zoo"), (5, "zoo"), (None, "zoo"), (None, "cat cat mat"), (6, ""), (7, None), (8, " .,\x00")]
    items = [(i, text(rng.randint(1, 4))) for i in range(12)] + [(3, "mat"), (20, None), (21, "..."), (22, "nowhere"), (None, "cat"), (23, "the " * 50)]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("block_terms", [200_000, 7])
def test_equals_brute_force_in_one_block_and_in_many(spark, monkeypatch, block_terms):
    monkeypatch.setattr(rs, "BLOCK_TERMS", block_terms)
    docs, items = some(1)
    assert got(rs.search(*tables(spark, docs, items))) == sorted(brute(docs, items), key=repr)


def test_few_results_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(rs, "CELLS", 40)
    docs, items = some(2)
    a, b = tables(spark, docs, items)
    assert got(rs.search(a.repartition(7), b, k=3)) == sorted(brute(docs, items, 3), key=repr)


def test_bags_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(rs.F, "xxhash64", lambda *c: rs.F.lit(1).cast("long"))
    docs, items = some(3)
    assert got(rs.search(*tables(spark, docs, items))) == sorted(brute(docs, items), key=repr)


def test_copies_are_one_class(spark):
    docs = [(i, "one two two") for i in range(50)] + [(99, "two one two"), (98, "one two")]
    items = [(1, "two one")]
    a, _ = tables(spark, docs, items)
    sent = spark.sparkContext.broadcast(rs.Block([(1, "one"), (1, "two")]))
    sized, _ = rs.with_lengths(rs.bags(a, sent))
    found = rs.classes(sized.withColumn("key", rs.F.xxhash64("terms", "counts", "m"))).collect()
    assert sorted(r.first_id for r in found) == [0, 98]
    assert got(rs.search(*tables(spark, docs, items))) == sorted(brute(docs, items), key=repr)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(rs, "PIECE", 5)
    text = "Hello, wörld_again " * 20 + "y" * 30
    assert rs.terms_of(text) == Counter(t.encode() for t in terms(text))


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "the cat am See word"), (2, "你好 grüße 555")]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    assert got(rs.search(odd, asked)) == sorted(brute(rows, items), key=repr)
    assert got(rs.search(none, asked)) == []
    assert got(rs.search(odd, asked.limit(0))) == []
