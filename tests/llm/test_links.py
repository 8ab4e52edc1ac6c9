"""The Jaccard join, components and substring dedup against brute force."""

from __future__ import annotations

import random

import pytest

from stratanet.llm import jaccard_join, substring_dedup
from stratanet.llm.components import components
from stratanet.llm.jaccard_join import Threshold

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, n):
    out = {}
    for i, text in rows:
        words = (text or "").translate(LOWER).split(" ")
        words = [w for part in words for w in part.split() if w]
        out.setdefault(i, []).append(frozenset(tuple(words[j : j + n]) for j in range(max(1, len(words) - n + 1))) if words else frozenset())
    return out


def brute(rows, n, percent):
    sets = sets_of(rows, n)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            for a in sets[i]:
                for b in sets[j]:
                    both = len(a & b)
                    if both and 100 * both >= percent * (len(a) + len(b) - both):
                        p, q = find(i), find(j)
                        top[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []

    def changed(words, rate):
        out = []
        for w in words:
            x = rng.random()
            out += [] if x < rate / 3 else [rng.choice(vocabulary)] if x < rate else [w]
        return out

    passage = rng.choices(vocabulary, k=40)
    for length, copies in ((120, 60), (40, 30), (13, 20), (9, 20), (7, 10)):
        base = rng.choices(vocabulary, k=length)
        texts += [" ".join(changed(base, rng.choice([0, 0.01, 0.02, 0.04, 0.08]))) for _ in range(copies)]
        for _ in range(8):
            base = changed(base, 0.015)
            texts.append(" ".join(base))
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(60)]
    texts += [" ".join(rng.choices(vocabulary[:4], k=rng.randint(0, 7))) for _ in range(30)]
    rows = list(enumerate([*texts, "", None, "A b C"]))
    rows += rows[:5] + [(0, rows[200][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"light": 13}, {"shingle": 5, "percent": 80}])
def test_components_equal_brute_force(spark, options):
    rows = corpus(len(options))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(docs, **options).collect()
    want = brute(rows, options.get("shingle", 4), options.get("percent", 85))
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] for r in got)


def test_rows_that_share_an_id_are_one_document(spark):
    texts = {f"t{k}": " ".join(f"x{k}{i}" for i in range(30)) for k in range(5)}
    rows = [(3, texts["t1"]), (5, texts["t1"]), (5, texts["t2"]), (7, texts["t2"]), (7, ""), (8, texts["t3"]), (9, None), (9, texts["t3"]), (10, texts["t4"]), (10, texts["t4"])]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows, 4, 85)
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)
    assert want[5] == want[7] == 3 and want[9] == 8


def test_few_rounds_lose_no_link(spark):
    rows = corpus(9)
    limit = Threshold(85)
    members = spark.createDataFrame([(1, i, len(s[0])) for i, s in sets_of(rows, 4).items() if s[0]], "bucket long, node long, n int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").dropDuplicates(["doc_id"])
    sets = docs.select(docs.doc_id.alias("node"), jaccard_join.shingles(docs.text, 4).alias("shingles"))
    sizes = sets.selectExpr("node", "size(shingles) as n")
    members = members.drop("n").join(sizes, "node").where("n > 0").selectExpr("bucket", "node", "n", "0 as own")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute(list(texts.items()), 4, 85)
    for rounds in (0, 2):
        found = {r.node: r.component for r in jaccard_join.linked(members, sets, limit, rounds).collect()}
        assert all(found.get(i, i) == c for i, c in want.items())


def test_bounds_hold_for_every_pair_of_sizes():
    for percent in (80, 85, 90):
        limit = Threshold(percent)
        for a in range(1, 130):
            assert limit.kept(a) <= limit.extended(a)
            assert a < 81 or limit.kept(a) <= limit.missing(a) + 1
            for b in range(limit.least_partner(a), a + 1):
                assert limit.overlap(b, b) <= limit.overlap(a, b)
                assert limit.overlap(b, b) in limit.subset_sizes(a)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = []
    for i, text in rows:
        size = len(sets_of([(i, text)], 4)[i][0])
        want.append((i or 0, size, {None: None, 2: 1}.get(i, i)))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect())
    assert got == sorted(want)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def plain_dedup(rows):
    runs = {}
    for i, text in rows:
        own = substring_dedup.sentences(text or "")
        words = [text[a:b].split() for a, b in own]
        found = set()
        for start in range(len(own)):
            for step in (1, -1):
                n, at = 0, start
                while 0 <= at < len(own):
                    n += len(words[at])
                    if n >= 30 and (at != start or n >= 50):
                        found.add((min(at, start), max(at, start) + 1))
                        break
                    at += step
        runs[i] = own, words, sorted(found)
    first = {}
    for i in sorted(runs):
        for a, b in runs[i][2]:
            first.setdefault(tuple(map(tuple, runs[i][1][a:b])), (i, a))
    out = {}
    for i, text in rows:
        own, words, found = runs[i]
        gone = {k for a, b in found if first[tuple(map(tuple, words[a:b]))] != (i, a) for k in range(a, b)}
        at, kept = 0, ""
        for k in sorted(gone):
            kept += text[at : own[k][0]]
            at = own[k + 1][0] if k + 1 < len(own) else len(text)
        out[i] = kept + text[at:] if gone else text
    return out


def test_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    sentence = lambda: " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 20))) + rng.choice(".!?")
    passages = [" ".join(sentence() for _ in range(rng.randint(1, 9))) for _ in range(12)]
    passages.append(" ".join(f"z{i}" for i in range(55)) + ".")
    rows = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(0, 12))]
        rows.append((i, rng.choice([" ", "\n", "\n\n "]).join(parts)))
    got = {r.doc_id: r for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_dedup(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert any(want[i] != t for i, t in rows)
    assert sum("z0 z1" in (r.text or "") for r in got.values()) == 1


def test_dedup_of_odd_rows(odd, none):
    got = substring_dedup.deduplicate(odd).collect()
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, set()).add(r.text)
    assert len(got) == odd.count()
    assert texts[2] == {""} and texts[3] == {None} and texts[4] == {""} and texts[7] == {" \n\t "}
    assert all(len(r.removed) == 0 for r in got if r.doc_id != 2)
    assert substring_dedup.deduplicate(none).count() == 0


def test_differences_meet_by_their_rarest_elements_only(spark):
    """Both lists of differences are cut, no pair that links is lost, and far fewer meet than share an element."""
    rng = random.Random(9)
    base, pool = list(range(100)), list(range(1000, 1012))
    sets = {0: set(base)}
    for i in range(1, 81):
        gone = rng.sample(base, rng.randint(0, 8))
        sets[i] = set(base) - set(gone) | set(rng.sample(pool, rng.randint(8, 12))) | {10_000 + 100 * i + k for k in range(rng.randint(0, 18))}
    limit = jaccard_join.Threshold(85)

    def links(a, b):
        return 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])

    rows = [(0, i, 100, len(s), links(0, i), sorted(sets[0] ^ s)) for i, s in sets.items() if i]
    compared = spark.createDataFrame(rows, "p long, a long, np int, na int, linked boolean, diff array<bigint>")
    got = {tuple(r) for r in jaccard_join._beside(compared, limit).collect()}
    far = {i for i in sets if i and not links(0, i)}
    every = {(a, b) for a in sets for b in sets if 0 < a < b and far & {a, b}}
    assert {(a, b) for a, b in every if links(a, b)} <= got
    sharing = {(a, b) for a, b in every if (sets[a] ^ sets[0]) & (sets[b] ^ sets[0])}
    assert len(got) < len(sharing) / 2


def test_near_copies_are_not_all_compared(spark, monkeypatch):
    """Of a group of near copies few pairs are verified, all components are found, and few tables are written."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=150)
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, 7)):
            words[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    verified, tables = [], []
    before, stored = jaccard_join._verified, jaccard_join.stored

    def noted(pairs, *rest):
        verified.append(pairs.count())
        return before(pairs, *rest)

    def counted(df, name):
        tables.append(name)
        return stored(df, name)

    monkeypatch.setattr(jaccard_join, "_verified", noted)
    monkeypatch.setattr(jaccard_join, "stored", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85)
    assert sum(verified) < 4 * len(rows) and len(tables) < 25, (verified, tables)
