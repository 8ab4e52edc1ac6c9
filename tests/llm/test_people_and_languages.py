"""Personal data, language identification, mixing and the pipeline."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratanet.llm import language_id, mixing, personal_data as pii, quality_model, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in pii.CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("aA1234567890@@.. -+()a%\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]


def test_long_words_take_linear_time():
    assert pii.base_spans("a" * 200_000 + " " + "1" * 200_000 + "@" * 1000) == []


def test_best_is_the_best_of_all_segmentations():
    rng = random.Random(5)
    field = pii.Field()
    for _ in range(60):
        n = rng.randint(1, 6)
        scores = {
            (i, j, k): (rng.uniform(-2, 2), []) for i in range(n) for j in range(i + 1, min(i + 3, n) + 1) for k in ("email", "ip")
        }

        def all_from(at):
            if at >= n:
                yield 0.0
                return
            yield from all_from(at + 1)
            for (i, j, _), (s, _) in scores.items():
                if i == at:
                    for rest in all_from(j):
                        yield s + rest

        found = field.best(n, scores)
        assert sum(scores[c][0] for c in found) == pytest.approx(max(all_from(0)))
        total = sum(np.exp(s) for s in all_from(0))
        for c, p in field.marginals(n, scores).items():
            part = sum(np.exp(s) for s in _through(scores, n, c))
            assert p == pytest.approx(part / total, rel=1e-6)


def _through(scores, n, wanted):
    def go(at, used, score):
        if at >= n:
            if used:
                yield score
            return
        yield from go(at + 1, used, score)
        for c, (s, _) in scores.items():
            if c[0] == at:
                yield from go(c[1], used or c == wanted, score + s)

    return go(0, False, 0.0)


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(2)
    words = "the of river stone and light over house".split()
    rows, held = [], []
    for i in range(150):
        parts = rng.choices(words, k=30)
        key = "".join(rng.choices("0123456789abcdef", k=40))
        item = rng.choice([f'token = "{key}"', "AKIA" + "".join(rng.choices("ABCDEFGH23456789", k=16)), f"u{i}@mail.example.com", f"10.2.3.{i}"])
        parts.insert(rng.randint(0, 30), item)
        rows.append((i, " ".join(parts)))
        held.append(item)
    return spark.createDataFrame(rows, "doc_id long, text string"), held


def test_field_finds_keys_it_was_not_shown(people):
    docs, held = people
    field = pii.train(docs, texts=60)
    found = {r.doc_id: r for r in pii.find(docs, field).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    caught = sum(any(texts[i][s.begin : s.end] in held[i] or held[i] in texts[i][s.begin : s.end] for s in r.spans) for i, r in found.items())
    assert caught >= 145
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in found.values())
    clean = {r.doc_id: r.text for r in pii.redacted(docs, field).collect()}
    assert sum(held[i].split('"')[-2 if '"' in held[i] else 0] in t for i, t in clean.items()) <= 5


def test_personal_data_of_odd_rows(odd, none):
    field = pii.train(odd)
    rows = pii.find(odd, field).collect()
    assert len(rows) == odd.count()
    nine = next(r for r in rows if r.doc_id == 9)
    assert [s.kind for s in nine.base] == ["email", "ip", "phone"]
    assert pii.find(none, pii.train(none)).count() == 0
    clean = pii.redacted(odd, field)
    assert clean.columns == odd.columns
    by_id = {r.doc_id: r.text for r in clean.collect()}
    assert by_id[9] == "mail [email] or call [phone] from [ip]" and by_id[3] is None
    assert by_id[8] == next(r.text for r in odd.collect() if r.doc_id == 8)


def test_trigrams_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["Hello world", "", "a", "!!", "x y  z", "é", "  "]
    grams, begins = language_id.trigrams(texts)
    for i, t in enumerate(texts):
        assert grams[begins[i] : begins[i + 1]].tolist() == language_id.trigrams([t])[0].tolist()


def test_probabilities_of_a_context_sum_to_one():
    grams, counts = np.unique(language_id.trigrams(["the cat sat on the mat", "a dog ran to the house"])[0], return_counts=True)
    model = language_id.KneserNey(grams, counts.astype(float))
    assert model.p2.reshape(language_id.CLASSES, -1).sum(1) == pytest.approx(np.ones(language_id.CLASSES))
    for context in np.unique(grams >> language_id.CLASS_BITS)[:10]:
        p = model.rest[context] * model.p2[(context & 127) << 7 | np.arange(128)]
        seen = grams >> language_id.CLASS_BITS == context
        p[grams[seen] & 127] = model.p3[seen]
        assert p.sum() == pytest.approx(1)


def test_held_out_accuracy(spark, sf_dir):
    rows = queries.op5_language_id(spark, sf_dir).collect()
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in known if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd, none):
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (3, 4, 7)) for r in rows)
    assert language_id.identify(none).count() == 0
    unnamed = odd.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in language_id.identify(unnamed).collect()} == {("und", 0.0)}


def shared_out(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if target[s] > 2 * sizes[s]]
        if not above:
            return capped | target
        capped |= {s: 2.0 * sizes[s] for s in above}


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(docs, fan=8).collect()
    again = mixing.mix(docs.repartition(2), fan=8).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = shared_out(sizes)
    for source, target in want.items():
        own = [r for r in got if r.source == source]
        assert own[0].target == pytest.approx(target) and own[0].source_size == sizes[source]
        assert abs(sum(r.size * r.copies for r in own) - target) <= 60
    assert all(0 <= r.copies <= 2 for r in got) and len(got) == len(rows)


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert sum(r.rows for r in got) == odd.count()
    assert next(r for r in got if r.doc_id == 2).rows == 2
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns
    copies = {(r.doc_id, r.source): r.copies * r.rows for r in got}
    assert mixed.count() == sum(copies.values())


def test_pipeline_of_small_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns, sizes = docs.columns, [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{number}")
        assert number == 4 or docs.columns == columns
        sizes.append(docs.count())
        if number == 0:
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert sum(q == 1 and i not in kept for i, q in labels.items()) <= 2
            assert sum(q == 0 and i in kept for i, q in labels.items()) <= 4
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] and sizes[4] == sizes[5]


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_and_no_rows(spark, sf_dir, odd, none, number):
    stage = corpus_pipeline.STAGES[number][1]
    for docs in (odd, none):
        docs = docs.withColumnRenamed("size", "n_chars")
        out = stage(spark, docs, sf_dir)
        assert out.count() >= 0
        assert number == 4 or out.columns == docs.columns


def test_near_duplicates_lose_no_text(spark, sf_dir):
    texts = {k: " ".join(f"x{k}{i}" for i in range(40)) for k in range(4)}
    near = texts[3].replace("x339", "other")
    rows = [(3, texts[1]), (5, texts[1]), (5, texts[2]), (6, texts[3]), (2, near), (8, ""), (8, None), (9, ""), (None, texts[1]), (4, texts[0]), (4, texts[0])]
    docs = spark.createDataFrame([(*r, "en", "s", 1, 0) for r in rows], "doc_id long, text string, unit string, row string, hash int, id int")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert {t for _, t in kept if t} == {texts[0], texts[1], texts[2], near}
    assert sorted((i for i, _ in kept), key=str) == [2, 3, 4, 5, 8, 9, None]


def test_rejected_rows_may_have_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y", 1), (2, "b", "x", "y", 1), (None, None, "x", "y", 1)], "doc_id long, text string, _gone_id string, _gone string, row int")
    verdicts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), (F.col("doc_id") == 1).alias("kept"))
    verdicts = verdicts.withColumn("kept", F.coalesce("kept", F.lit(False)))
    assert [r.doc_id for r in quality_model.kept_rows(docs, verdicts).collect()] == [1]


def test_parts_of_an_ip_count_by_value():
    for text, is_ip in (("0000000001.2.3.4", True), ("0000000000.2.3.4", True), ("00000000000256.2.3.4", False), ("1.2.3.0000000000255", True)):
        assert [s[0] for s in pii.base_spans(text) if s[0] == "ip"] == (["ip"] if is_ip else [])


def test_long_keys_colons_and_edges_of_windows_are_whole():
    field = pii.Field({"secret|spelled": 1.0})
    long = "token=" + ("aB3" * 150 + ".") * 3 + "x"
    for text in (long, "password: correcthorse", "password : correcthorse"):
        assert ("secret", 0, len(text)) in pii.all_spans(text, pii.Field())[1]
        assert pii.all_spans(text, field)[1] == [("secret", 0, len(text))]
    # Four tokens of which the first three end a window.
    tokens = [(m.start(), m.end()) for m in pii.TOKEN.finditer(" ".join(f"n{i}" for i in range(150)))]
    found = list(pii.windows(" ".join(f"n{i}" for i in range(150))))
    for i in range(len(tokens) - 3):
        assert any(set(tokens[i : i + 4]) <= set(w) for w in found)


def test_a_rare_kind_is_in_the_sample(spark, monkeypatch):
    rows = [(i, f"order {1000 + i} of {2000 + i} pieces") for i in range(300)]
    rows.append((999, " ".join(f"{i} a b c d e f" for i in range(9)) + " password: correcthorse"))
    seen = []
    monkeypatch.setattr(pii.Field, "learn", lambda self, cut: seen.extend(cut))
    pii.train(spark.createDataFrame(rows, "doc_id long, text string"), texts=12)
    assert len(seen) <= 12 * pii.SAMPLE_WINDOWS
    assert any(kind == "secret" for _, gold in seen for *_, kind in gold)
