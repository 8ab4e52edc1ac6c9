from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from stratanet.llm import link_trust as lt

RULES = [("org/", "allow"), ("Example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
FOLD = str.maketrans(lt.UPPER, lt.LOWER)


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(FOLD), m[2]) if m else ("", "")


def rule_of(host, path, rules):
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        h = h.translate(FOLD)
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), verdict, rule))
    return max(fits, default=(0, None, None))[1:]


def links_of(host, html):
    for u in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)""", html or ""):
        if m := re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", u):
            if m[1]:
                yield m[1].translate(FOLD)
        elif not re.match(r"#|[A-Za-z][A-Za-z0-9+.-]*:", u):
            yield host


def brute(pages, rules, rounds=lt.ROUNDS):
    rows = [(i, *(hp := split(url)), *rule_of(*hp, rules), list(links_of(hp[0], html)) if hp[0] else []) for i, url, html in pages]
    seeds, edges = Counter(), Counter()
    for _, host, _, verdict, _, links in rows:
        if verdict and host:
            seeds["trust" if verdict == "allow" else "distrust", host] += 1
        for there in links:
            edges["trust", host, there] += 1
            edges["distrust", there, host] += 1
    total, out = seeds.total() or 1, Counter()
    for (kind, a, _), n in edges.items():
        out[kind, a] += n
    start = {k: math.floor(float(lt.MASS) * n / total) for k, n in seeds.items()}
    rank = start
    for _ in range(rounds):
        new = defaultdict(int, {k: math.floor((1 - lt.DAMPING) * m) for k, m in start.items()})
        for (kind, a, b), n in edges.items():
            if (kind, a) in rank:
                new[kind, b] += math.floor(lt.DAMPING * float(rank[kind, a]) * (n / out[kind, a]))
        rank = new
    result = []
    for i, host, path, verdict, rule, _ in rows:
        good, bad = rank.get(("trust", host), 0), rank.get(("distrust", host), 0)
        result.append((i, host, path, rule, verdict or ("block" if 100 * bad > 50 * (good + bad) else "allow"), good, bad))
    return result


def link(*urls):
    return "<html>" + "".join(f"<p><a class=x href='{u}'>t</a>" for u in urls) + "</html>"


PAGES = [
    (1, "http://good.org/a", link("http://friend.net/x", "/home", "#top", "mailto:a@b.c")),
    (2, "https://FRIEND.net?q=1", link("//second.net/", "https://second.net:80/")),
    (3, "http://second.net/p#x", None),
    (4, "http://spam.com/de/1", link("http://spam.com/de/2")),
    (5, "http://farm.net/1", link("http://spam.com/de/1", "HTTP://Spam.com/", "/x")),
    (6, "http://feeder.net/1", '<A HREF=http://farm.net/1>x</A> <a href="http://">y</a>'),
    (7, "http://mixed.com/de/1", ""),
    (7, "http://mixed.com/fr/1", link("http://a.b.example.org/es/")),
    (8, "http://a.b.example.org/es/1", link("/fr/")),
    (9, "http://example.org/en/12", link("../up")),
    (9, "http://example.org/en/12", link("../up")),
    (10, "http://notexample.org/es/?x", link("javascript:void(0)")),
    (11, None, link("http://friend.net/")),
    (12, "no scheme", link("http://friend.net/")),
    (None, "http://mixed.com/en", link()),
    (13, "http://org/", ""),
    (14, "http://good.org", ""),
    (15, "ftp://x://y/z", ""),
    (16, "://h/p\nq", ""),
]
COLUMNS = ("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def run(spark, pages, rules, parts=3, **more):
    df = spark.createDataFrame([(*p, "x", "y", 1) for p in pages], "page_id long, url string, html string, host string, rule string, mass long")
    asked = spark.createDataFrame(rules, "rule string, verdict string")
    return sorted((tuple(r) for r in lt.judge(df.repartition(parts), asked, **more).select(*COLUMNS).collect()), key=repr)


def test_equals_brute_force_on_any_partitions(spark):
    want = sorted(brute(PAGES, RULES), key=repr)
    assert run(spark, PAGES, RULES) == want
    assert run(spark, PAGES, RULES, 1) == want
    verdict = {(r[0], r[1]): r[4] for r in want}
    assert verdict[2, "friend.net"] == verdict[3, "second.net"] == "allow"
    assert verdict[5, "farm.net"] == verdict[6, "feeder.net"] == "block"
    assert verdict[11, ""] == verdict[12, ""] == "allow"


def test_a_host_with_most_pages_and_many_links(spark):
    pages = [(i, f"http://big.com/{'fr' if i % 3 else 'de'}/{i}", link(*(f"http://n{k}.net/" for k in range(i % 7)))) for i in range(120)]
    pages += [(200 + k, f"http://n{k}.net/", link("http://big.com/")) for k in range(7)]
    assert run(spark, pages, RULES) == sorted(brute(pages, RULES), key=repr)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr("stratanet.llm.common.BROADCAST_BYTES", 0)
    assert run(spark, PAGES, RULES, rounds=2) == sorted(brute(PAGES, RULES, 2), key=repr)


def test_the_longest_rule_wins_and_a_block_among_equals(spark):
    rules = [("a.b.c/", "allow"), ("c/x/yz", "block"), ("b.c/xx", "allow"), ("b.c/x/", "block"), ("c", "allow"), (None, "block"), ("c", "allow")]
    pages = [(i, f"http://{h}{p}", "") for i, (h, p) in enumerate([("a.b.c", "/x/y"), ("a.b.c", "/x/yz"), ("b.c", "/xx"), ("b.c", "/x/"), ("c", ""), ("xc", "/"), ("q.c", "?/x/yz")])]
    got = {r[0]: (r[3], r[4]) for r in run(spark, pages, rules, rounds=1)}
    assert got[0] == ("b.c/x/", "block") and got[1] == ("c/x/yz", "block") and got[2] == ("b.c/xx", "allow")
    assert got[3] == ("b.c/x/", "block") and got[4] == ("c", "allow") and got[5] == (None, "allow") and got[6] == ("c", "allow")


def test_empty_tables(spark):
    assert run(spark, [], RULES) == []
    assert run(spark, PAGES, []) == sorted(brute(PAGES, []), key=repr)
    assert run(spark, [(1, None, None)], RULES) == [(1, "", "", None, "allow", 0, 0)]
