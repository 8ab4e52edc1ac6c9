from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from stratanet.llm import spelling


def edits(a: str, b: str) -> bool:
    """One inserted, deleted or replaced code point, by trying all."""
    if len(a) < len(b):
        a, b = b, a
    less = {a[:i] + a[i + 1 :] for i in range(len(a))}
    if len(a) == len(b):
        return a != b and any(a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] for i in range(len(a)))
    return b in less


def brute(rows, min_length=5, min_count=3, nth=97):
    counts = Counter()
    for doc_id, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for word in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % nth == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return brute_forms({w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count})


def brute_forms(n):
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def texts(seed: int, words: int, letters: str = "abé"):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
    return [(i, " ".join(make() for _ in range(words))) for i in range(40)]


def test_equals_brute_force_whatever_the_block(spark):
    rows = [*texts(1, 60), (41, "Aab" + "ÀÿÀ× " * 5), (None, "aabbaé " * 3), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, nth=7)
    for block in (4, 512):
        got = rows_of(spelling.spelling_variants(docs, nth=7, block=block))
        assert len(got) == len(want)
        assert set(got) == want
    assert any(r[1] != r[2] for r in want)


def test_short_words_and_long_chains(spark):
    """Words of one and two letters, and forms whose forms have forms."""
    n = {"a": 1, "ab": 2, "abc": 4, "abcd": 8, "abcde": 16, "abcdef": 32, "abcdeg": 32, "b": 3, "zz": 1}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    forms = spelling.near_words(words, block=2).persist()
    ends = dict(spelling.roots(forms.where("form is not null")).collect())
    got = {(r.word, r.form, ends.get(r.word, r.word), r.n, r.n_near, r.form_n) for r in forms.collect()}
    assert got == brute_forms(n)
    assert ends["ab"] == "abcdef"


def test_one_prefix_holds_all_words(spark):
    """A hot bucket is compared in many tiles, none of which is large."""
    rng = random.Random(3)
    n = {"thth" + "".join(rng.choice("abcd") for _ in range(3)): rng.randint(1, 50) for _ in range(60)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    tiles = spelling.tiled(words, block=8)
    assert tiles.groupBy("longer", "side", "half", "i", "j").count().agg({"count": "max"}).first()[0] < 40
    assert {(r.word, r.n_near) for r in spelling.near_words(words, block=8).collect()} == {(w, r[4]) for r in brute_forms(n) for w in [r[0]]}


def test_tiles_may_be_cut_by_batches():
    words = ["aaaaa", "aaaab", "aaabb", "baaaa", "baaab"]
    rows = [(5, "p", w[:2], 0, 0, 0, w, k + 1) for k, w in enumerate(words)]
    schema = pa.schema([("longer", "int32"), ("side", "string"), ("half", "string"), ("i", "int32"), ("j", "int32"), ("at", "int32"), ("word", "string"), ("n", "int64")])
    rows = [pa.table([[v] for v in r], schema=schema).to_batches()[0] for r in rows]
    got = [r for b in spelling._compare(iter(rows)) for r in b.to_pylist()]
    assert {(r["word"], r["n_near"], r["near"]) for r in got} == {("aaaaa", 1, "aaaab"), ("aaaab", 2, "aaabb"), ("aaabb", 1, "aaaab"), ("baaaa", 1, "baaab"), ("baaab", 1, "baaaa")}


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 10)
    text = "hello wörld again, " * 50 + "x" * 40
    assert "".join(spelling.pieces(text)) == text
    assert Counter(w for p in spelling.pieces(text) for w in spelling.LETTERS.findall(p)) == Counter(spelling.LETTERS.findall(text))


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = rows_of(spelling.spelling_variants(odd))
    assert len(got) == len(brute(rows)) and set(got) == brute(rows)
    assert rows_of(spelling.spelling_variants(none)) == []
    assert rows_of(spelling.spelling_variants(odd, min_count=10**9)) == []
