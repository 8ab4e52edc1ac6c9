"""Quality rules as a short-circuit cascade, on DataFrame functions only.

Every rule says which texts it rejects. On a sample, the share that each rule
rejects and the time that it takes are measured; then rules are put in the
order of rejections per second among what the rules before them leave. The
verdict is one CASE expression, which stops at the first rule that rejects.
The order only decides how long that takes, never what is kept.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratanet.llm.common import let, stored, text_of, words

#: Words in a window of the repetition measure; fixed value of the contract.
WINDOW = 8
#: Rows of the sample that costs and shares are estimated on, about.
SAMPLE_ROWS = 2_000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _removed(text: Column, characters: str) -> Column:
    """How many of these characters the text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of words which the text has twice or more.

    Windows are compared by 64-bit hash. Only texts with an equal pair sort
    their windows with their places; the rest are done after one sort of longs.
    """
    starts = F.size(tokens) - window + 1
    hashes = F.when(
        starts > 0,
        F.transform(F.sequence(F.lit(1), starts), lambda i: F.xxhash64(F.slice(tokens, i, window))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - at, F.lit(window)))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def twice(sorted_windows: Column) -> Column:
        again = F.filter(
            sorted_windows,
            lambda w, i: (w["h"] == F.get(sorted_windows, i - 1)["h"]) | (w["h"] == F.get(sorted_windows, i + 1)["h"]),
        )
        return F.sort_array(F.transform(again, lambda w: w["i"]))

    def count(found: Column) -> Column:
        any_pair = let(
            F.sort_array(found), lambda s: F.exists(F.filter(s, lambda h, i: h == F.get(s, i - 1)), lambda h: h.isNotNull())
        )
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(any_pair, let(let(placed, twice), covered)).otherwise(F.lit(0).cast("long"))

    return let(hashes, count)


def measured(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("all"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup")
        )

    lines = let(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0), of_lines)
    of_words = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat")),
    )
    return F.struct(
        of_words.alias("words"),
        (F.length(F.translate(text, BLANKS, ""))).cast("long").alias("word_chars"),
        _removed(text, SYMBOLS).alias("n_symbols"),
        lines.alias("lines"),
    )


def rules() -> dict[str, Column]:
    """What each rule rejects, by columns ``text`` and ``m`` of a measured table."""
    n, chars = F.col("m.words.n"), F.col("m.word_chars")
    return {
        "symbols": 10 * F.col("m.n_symbols") > n,
        "repeated_lines": 2 * F.col("m.lines.dup") > F.col("m.lines.all"),
        "word_length": (chars > 15 * n) | (chars < 2 * n),
        "capitals": 100 * F.regexp_count("text", F.lit(r"\p{Lu}")) > 40 * chars,
        "marks": 5 * _removed(F.col("text"), "!?") > n,
    }


def base_failed() -> Column:
    n = F.col("m.words.n")
    return (n < 20) | (100 * F.col("m.words.repeat") > 30 * n)


def rule_order(sample: DataFrame, checks: dict[str, Column]) -> list[str]:
    """Rules by rejections per second among the rows that the earlier ones leave.

    Shares come from one count by outcome of all rules, costs from the time
    that each rule alone takes on the sample.
    """
    outcomes = sample.groupBy(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()]).count().collect()
    cost = {}
    for name, check in checks.items():
        began = time.perf_counter()
        sample.agg(F.count_if(check)).collect()
        cost[name] = max(time.perf_counter() - began, 1e-6)
    order, left = [], list(checks)
    while left:
        rejected = {k: sum(o["count"] for o in outcomes if o[k]) for k in left}
        best = max(left, key=lambda k: (rejected[k] / cost[k], -cost[k]))
        order.append(best)
        left.remove(best)
        outcomes = [o for o in outcomes if not o[best]]
    return order


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, m, base_failed, kept) of every row; ``m`` holds the measures.

    A null or empty text has no words and so fails. Repeated rows get the same
    verdict each, null ids stay, an empty table gives no rows; other columns
    are not read. Every text is measured whole.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    total = rows.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = stored(
        rows.sample(share, seed=7).select("text", measured(F.col("text")).alias("m")), "rule-sample"
    )
    checks = rules()
    verdict = F.when(base_failed(), False)
    for name in rule_order(sample, checks):
        verdict = verdict.when(checks[name], False)
    return rows.select("doc_id", "text", measured(F.col("text")).alias("m")).select(
        "doc_id", "m", base_failed().alias("base_failed"), verdict.otherwise(True).alias("kept")
    )
