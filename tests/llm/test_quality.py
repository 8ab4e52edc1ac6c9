"""Quality rules and the quality model against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratanet.llm import quality_model, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words, lines, seen, twice = WORD.findall(text), 0, set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            twice += line in seen
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered)


def test_measures_equal_brute_force(spark, odd, none):
    rng = random.Random(2)
    more = [(i, " ".join(rng.choice("a b c d\n |x #").strip(" ") or "e" for _ in range(rng.randint(0, 40))), None, None, None, None) for i in range(60)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    texts = docs.select("doc_id", "text").collect()
    got = quality_rules.judge(docs).select(
        "doc_id", "m.words.n", "m.word_chars", "m.n_symbols", "m.lines.dup", "m.words.repeat", "base_failed", "kept"
    ).collect()
    want = sorted((r.doc_id or 0, *measures(r.text)) for r in texts)
    assert sorted((r[0] or 0, *r[1:6]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n < 20 or 100 * r.repeat > 30 * r.n)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(none).count() == 0


def test_order_of_rules_changes_no_verdict(odd, monkeypatch):
    before = sorted((r.doc_id or 0, r.kept) for r in quality_rules.judge(odd).collect())
    monkeypatch.setattr(quality_rules, "rule_order", lambda sample, checks: list(checks)[::-1])
    assert sorted((r.doc_id or 0, r.kept) for r in quality_rules.judge(odd).collect()) == before


def test_rules_that_reject_more_come_first(spark):
    sample = spark.createDataFrame([("a",)] * 9 + [("b",)], "text string")
    checks = {"few": F.col("text") == "b", "many": F.col("text") == "a"}
    assert quality_rules.rule_order(sample, checks)[0] == "many"


def kneser_ney(texts: list[str], order: int):
    """Probability of an n-gram by the textbook recursion."""
    counts = {order: Counter(g for t in texts for g in quality_model.ngrams(t, order).tolist())}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g & (1 << 8 * k) - 1 for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else None
        out = []
        for i in (1, 2, 3):
            v = i - (i + 1) * y * n[i] / n[i - 1] if y is not None and n[i - 1] else 0.5
            out.append(max(0.1, min(v, i)))
        return out

    tables = {}
    for k, c in counts.items():
        d, total, passed = discounts(c), Counter(), Counter()
        for g, v in c.items():
            total[g >> 8] += v
            passed[g >> 8] += d[min(v, 3) - 1]
        tables[k] = c, d, total, passed

    def p(g, k):
        if not k:
            return 1 / 256
        c, d, total, passed = tables[k]
        low = p(g & (1 << 8 * (k - 1)) - 1, k - 1)
        if not total[g >> 8]:
            return low
        own = max(c[g] - d[min(c[g], 3) - 1], 0) if c[g] else 0
        return own / total[g >> 8] + passed[g >> 8] / total[g >> 8] * low

    return lambda g: p(g, order)


@pytest.mark.parametrize("order", [2, 4])
def test_losses_equal_the_recursion(spark, odd, order):
    rng = random.Random(4)
    words = ["river", "stone", "light", "over", "the", "of", "house"]
    rows = [(100 + i, " ".join(rng.choices(words, k=rng.randint(3, 30))) + ".", "en", "a", 0, "") for i in range(40)]
    rows += [(200 + i, "##$$%%!! " * 5, "en", "a", 0, "") for i in range(3)]
    docs = odd.unionByName(spark.createDataFrame(rows, odd.schema))
    trusted = spark.createDataFrame([(i,) for i in [*range(100, 140), 6]], "doc_id long")
    got = quality_model.classify(docs, trusted, order=order).collect()
    assert len(got) == docs.count()
    import zlib

    texts = [r[1] for r in rows if 100 <= r[0] < 140 and zlib.crc32(str(r[0]).encode()) % quality_model.FOLDS]
    p = kneser_ney(texts, order)
    by_id = {r.doc_id: r for r in got if r.lang == "en"}
    for i, text, lang, *_ in rows + [(8, "word " * 30_000 + "end", "en")]:
        grams = quality_model.ngrams(text, order).tolist()
        known = {g: -math.log(p(g)) for g in set(grams)}
        assert by_id[i].loss == pytest.approx(sum(known[g] for g in grams) / len(grams), rel=1e-5)
    assert not any(by_id[i].kept for i in range(200, 203))
    assert sum(by_id[i].kept for i in range(100, 140)) >= 38
    assert not by_id[3].kept
    kept = quality_model.kept_rows(docs, quality_model.classify(docs, trusted, order=order))
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_nothing_trusted_and_nothing_at_all(spark, odd, none):
    nobody = spark.createDataFrame([], "doc_id long")
    rows = quality_model.classify(odd, nobody).collect()
    assert all(r.kept == (r.symbols > 1) for r in rows)
    assert quality_model.classify(none, nobody).count() == 0


def test_order_tells_what_four_characters_cannot(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "LISTED", 5)
    rows = [(i, "abcdx bcdy " * 20, "en") for i in range(60)] + [(100, "abcdy bcdx " * 20, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    by_id = {r.doc_id: r for r in quality_model.classify(docs, trusted).collect()}
    # The character behind "bcd" depends on the one before it.
    assert quality_model.ORDER >= 5 and len(by_id) == 61
    assert all(by_id[i].kept for i in range(60)) and not by_id[100].kept
    assert by_id[100].loss > by_id[0].loss + 0.1


def test_words_and_letters_of_many_scripts_are_told_apart(spark):
    rng = random.Random(5)
    subjects, verbs, things = ("the river", "a stone", "my house"), ("carries", "has seen", "is near"), ("light", "the water", "some birds")
    def sentence():
        return f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(things)}"
    good = [". ".join(sentence() for _ in range(20)) for _ in range(60)]
    words = good[0].replace(".", "").split()
    senseless = " ".join(rng.choices(words, k=100))
    table = quality_model.classes()
    right = "\u4f60\u597d\u4e16\u754c"
    # Other letters of the same classes.
    wrong = "".join(next(chr(c) for c in range(ord(r) + 1, 0x9FFF) if table[c] == table[ord(r)]) for r in right)
    assert [table[ord(c)] for c in right] == [table[ord(c)] for c in wrong]
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(100, senseless, "en")]
    rows += [(200 + i, right * 20, "zh") for i in range(60)] + [(300, wrong * 20, "zh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    trusted = docs.where("doc_id not in (100, 300)").select("doc_id")
    by_id = {r.doc_id: r for r in quality_model.classify(docs, trusted).collect()}
    assert not by_id[100].kept and not by_id[300].kept
    assert by_id[300].loss == pytest.approx(by_id[200].loss)
    assert sum(by_id[i].kept for i in [*range(60), *range(200, 260)]) >= 116


def test_long_clean_texts_are_kept(spark):
    rng = random.Random(6)
    topics = [rng.sample("river stone light over the of house bird cloud road tree hill".split(), 8) for _ in range(6)]

    def text(n, topic):
        return " ".join(" ".join(rng.choices(topics[topic], k=8)) + "." for _ in range(n))

    rows = [(i, text(rng.randint(5, 12), i % 6), "en") for i in range(400)]
    rows += [(500 + i, text(6_000, i), "en") for i in range(6)]
    rows += [(600 + i, "xq zvk " * 8, "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    found = quality_model.classify(docs, docs.where("doc_id < 400").select("doc_id"))
    by_id = {r.doc_id: r for r in found.collect()}
    long = [by_id[500 + i] for i in range(6)]
    assert all(r.kept for r in long), [(r.excess, r.limit, r.word_excess, r.word_limit) for r in long]
    assert not any(by_id[600 + i].kept for i in range(3))
    # Times the root of their length alone, some of these would lie beyond all that set the limit.
    unseen = [by_id[i] for i in range(400) if zlib.crc32(str(i).encode()) % quality_model.FOLDS == 0]
    middle = sorted(r.loss for r in unseen)[len(unseen) // 2]
    limit = max((r.loss - middle) * math.sqrt(r.symbols) for r in unseen)
    assert any((r.loss - middle) * math.sqrt(r.symbols) > limit for r in long)


def test_ngrams_that_no_trusted_text_has_are_not_shuffled_for_counts():
    import numpy as np
    import pyarrow as pa

    keys, words, counts = (np.array(x, "i8") for x in ([-5, 3, 3, 9], [7, 1, 2, 4], [0, 2, 0, 1]))
    pack = (quality_model._steps(keys), quality_model._zipped(words), quality_model._zipped(counts.astype("i4")))
    rows = [(1, "en", quality_model.PAIR, 0, 4, *pack), (1, "en", 5, 0, 4, pack[0], None, pack[2])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(quality_model.LISTS.values())], list(quality_model.LISTS)
    )
    paired, single = (b.to_pylist()[0] for b in quality_model._seen([batch]))
    assert paired["n"] == single["n"] == 2 and single["words"] is None
    for row in (paired, single):
        assert quality_model._from_steps(row["keys"]).tolist() == [3, 9]
        assert quality_model._unzipped(row["counts"], "i4").tolist() == [2, 1]
    assert quality_model._unzipped(paired["words"], "i8").tolist() == [1, 4]


def test_answers_come_without_their_ngrams_and_lots_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices("river stone light over the of house".split(), k=12)), "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    trusted = docs.where("doc_id < 60").select("doc_id")
    # N-grams are written once, where a slice asks; what comes back has values only.
    assert not {"keys", "words"} & set(quality_model.ANSWERS)
    written, stored = [], quality_model.stored

    def noted(df, name):
        written.append((name, df.columns))
        return stored(df, name)

    monkeypatch.setattr(quality_model, "stored", noted)
    once = sorted(map(tuple, quality_model.classify(docs, trusted).drop("excess", "word_excess").collect()))
    assert sum(name == "model-slices" for name, _ in written) == 1
    assert all(columns == ["slice", "lang", "payload"] for name, columns in written if name == "model-slices")
    monkeypatch.setattr(quality_model, "LOT_BYTES", 1 << 10)
    lots = sorted(map(tuple, quality_model.classify(docs, trusted).drop("excess", "word_excess").collect()))
    assert sum(name == "model-slices" for name, _ in written) == 1 + quality_model.LOTS
    assert len(lots) == 80 and [r[:3] + r[-1:] for r in lots] == [r[:3] + r[-1:] for r in once]
    for a, b in zip(lots, once, strict=True):
        assert a[4:9] == pytest.approx(b[4:9], rel=1e-6)


def test_letters_and_words_are_numbered_without_sorting_characters(monkeypatch):
    import numpy as np

    texts = ["", "a", "the river _1a, a stone!", "\u4f60\u597d x\u0e01y \U0001f600 \u00e9t\u00e9", "\n\n", "the river " * 50]
    want = [quality_model.ngrams(t, 5) for t in texts]
    for table in (1 << 24, 10):
        monkeypatch.setattr(quality_model, "TABLE", table)
        monkeypatch.setattr(quality_model, "CHUNK", 20)
        letters = quality_model._Letters(texts, 5)
        places = [p for own, n in letters.places() for p in np.split(own, np.cumsum(n)[:-1])]
        assert letters.keys.tolist() == sorted(set(np.concatenate(want).tolist()))
        assert [letters.keys[p].tolist() for p in places] == [w.tolist() for w in want]
    before, word, lengths = quality_model._all_pairs(texts)
    words = [quality_model.WORDS.findall(t) for t in texts]
    assert lengths.tolist() == [len(w) + 1 for w in words]
    known = {}
    for w, h in zip([w for own in words for w in [*own, None]], word.tolist(), strict=True):
        assert known.setdefault(w, h) == h and (h == 0) == (w is None)
    assert len(set(known.values())) == len(known)
    assert before.tolist() == [0, *word[:-1].tolist()]
