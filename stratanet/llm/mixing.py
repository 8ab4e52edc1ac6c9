"""Mixing sources to target weights by pivotal dependent rounding, on DataFrame functions only.

Every source gets a target number of words; a document then takes part
``target / source size`` times on average. The whole part is kept for each
document and the fraction is rounded by pairing: two units exchange words until
one of them holds none or all of its own, which then is settled, and the other
goes on to the next pair. The exchange keeps the sum of words, and its
direction is drawn so that each unit keeps its expected share. Units are folded
in small groups, the one that is left of each group goes into a group of the
next level, and so on up a tree, until one is left of each source, which is
rounded to the nearer side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratanet.llm.common import let, n_words, stored, text_of, uniform

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Units in a group of the tree.
FAN = 64
SEED = 20


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size).

    Sources by code point, null last, get the weights in turn. A source whose
    share is above ``cap`` times its size gets that, and the rest is shared anew
    among the others. In the order of cap per weight, the level that the
    sources from one on would have is largest at the first that is not capped,
    so that the final level is the maximum. One row per source goes through the
    two windows here, never a document.
    """
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    turn = F.pmod(F.row_number().over(in_turn) - 1, F.lit(len(weights))).cast("int")
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"),
        (F.lit(cap) * F.col("source_size")).alias("most"),
    )
    level = (
        F.lit(share) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    return ranked.withColumn("level", level).select(
        "source",
        "source_size",
        F.least("most", F.col("weight") * F.max("level").over(everything)).alias("target"),
    )


def _pair(held: Column, new: Column) -> Column:
    """One exchange: settles a unit, appends it to ``out`` and holds the other."""

    def moved(m: Column) -> Column:
        away = m["u"] * (m["gives"] + m["takes"]) < m["takes"]
        a = F.when(away, held["mass"] - m["gives"]).otherwise(held["mass"] + m["takes"])
        b = F.when(away, new["mass"] + m["gives"]).otherwise(new["mass"] - m["takes"])
        return F.struct(a.alias("a"), b.alias("b"))

    def settled(m: Column) -> Column:
        near = F.lit(1e-9)
        first = (m["a"] <= near * held["words"]) | (m["a"] >= (1 - near) * held["words"])
        done = F.when(first, held["unit"]).otherwise(new["unit"])
        taken = F.when(first, m["a"] > held["words"] / 2).otherwise(m["b"] > new["words"] / 2)
        return F.struct(
            F.when(first, new["unit"]).otherwise(held["unit"]).alias("unit"),
            F.when(first, new["words"]).otherwise(held["words"]).alias("words"),
            F.when(first, m["b"]).otherwise(m["a"]).alias("mass"),
            F.array_append(
                held["out"], F.struct(done.alias("unit"), taken.cast("int").alias("extra"))
            ).alias("out"),
        )

    exchange = F.struct(
        F.least(held["mass"], new["words"] - new["mass"]).alias("gives"),
        F.least(new["mass"], held["words"] - held["mass"]).alias("takes"),
        uniform(held["unit"]["doc_id"], new["unit"]["doc_id"], new["unit"]["size"], F.lit(SEED)).alias("u"),
    )
    return let(let(exchange, moved), settled)


def _fold(units: Column) -> Column:
    empty = F.expr("cast(array() as array<struct<unit: struct<doc_id: bigint, size: bigint>, extra: int>>)")
    head = F.element_at(units, 1)
    start = F.struct(
        head["unit"].alias("unit"), head["words"].alias("words"), head["mass"].alias("mass"), empty.alias("out")
    )
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, _pair)


def round_units(units: DataFrame, fan: int = FAN) -> DataFrame:
    """(source, doc_id, size, extra) of units (source, doc_id, size, words, mass).

    ``extra`` is 1 where the fraction ``mass / words`` was rounded up.
    """
    counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    unit = F.struct("doc_id", "size")
    groups = F.ceil(F.col("n") / F.lit(fan)).cast("long")
    level = (
        units.alias("u")
        .join(counts.alias("c"), F.col("u.source").eqNullSafe(F.col("c.source")))
        .select(
            "u.source",
            F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED)), groups).alias("slot"),
            unit.alias("unit"),
            F.col("words").cast("double").alias("words"),
            "mass",
        )
    )
    parts, width = [], math.ceil(largest / fan)
    while True:
        order = F.xxhash64("unit", F.lit(SEED + 1))
        folded = stored(
            level.groupBy("source", "slot")
            .agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "unit", "words", "mass"))).alias("units"))
            .select("source", "slot", _fold(F.col("units")).alias("fold")),
            "mixing-level",
        )
        parts.append(folded.select("source", F.explode("fold.out").alias("x")).select("source", "x.unit", "x.extra"))
        level = folded.select(
            "source",
            F.floor(F.col("slot") / F.lit(fan)).cast("long").alias("slot"),
            "fold.unit",
            "fold.words",
            "fold.mass",
        )
        if width <= 1:
            break
        width = math.ceil(width / fan)
    last = F.col("mass") * 2 >= F.col("words")
    settled = level.select("source", "unit", last.cast("int").alias("extra"))
    for part in parts:
        settled = settled.unionByName(part)
    return settled.select("source", "unit.doc_id", "unit.size", "extra")


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    fan: int = FAN,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, rows) per unit of ``docs``.

    A unit is a distinct (doc_id, source, number of words); ``rows`` tells how
    many rows of ``docs`` it has, and all of them take ``copies`` copies, so
    that repeated rows and ids give one defined result. Null ids are ids like
    any other, a null text has no words, and null is a source, the last one.
    A unit without words is rounded by itself, for it has no words to exchange.
    An empty table gives no rows. Other columns are not looked at.
    """
    sized = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        n_words(text_of(text)).alias("size"),
    )
    units = stored(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mixing-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, cap), "mixing-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = (
        units.alias("u")
        .join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "u.source", "size", "rows", "source_size", "target", rate.alias("rate"))
        .withColumn("whole", F.floor("rate").cast("int"))
        .withColumn("part", F.col("rate") - F.col("whole"))
    )
    weighed = F.col("size") * F.col("rows")
    extras = round_units(
        rated.where((weighed > 0) & (F.col("part") > 0)).select(
            "source", "doc_id", "size", weighed.alias("words"), (weighed * F.col("part")).alias("mass")
        ),
        fan,
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("doc_id", "source", "size")]
    alone = F.when(
        (F.col("r.size") == 0) & (uniform(F.col("r.doc_id"), F.lit(SEED + 3)) < F.col("part")), 1
    ).otherwise(0)
    return (
        rated.alias("r")
        .join(extras.alias("x"), same[0] & same[1] & same[2], "left")
        .select(
            "r.doc_id",
            "r.source",
            "r.size",
            "r.source_size",
            "r.target",
            (F.col("whole") + F.coalesce(F.col("extra"), alone.cast("int"))).alias("copies"),
            "r.rows",
        )
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    names = docs.columns
    doc_id, text, source = (options.get(k, k) for k in ("doc_id", "text", "source"))
    plan = mix(docs, **options).select(
        F.col("doc_id").alias("_mix_id"),
        F.col("source").alias("_mix_source"),
        F.col("size").alias("_mix_size"),
        F.col("copies").alias("_mix_copies"),
    )
    keyed = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_mix_row"),
        F.col(doc_id).cast("long").alias("_mix_doc"),
        F.col(source).cast("string").alias("_mix_from"),
        n_words(text_of(text)).alias("_mix_words"),
    )
    return (
        keyed.join(
            plan,
            F.col("_mix_doc").eqNullSafe(F.col("_mix_id"))
            & F.col("_mix_from").eqNullSafe(F.col("_mix_source"))
            & (F.col("_mix_words") == F.col("_mix_size")),
        )
        .where(F.col("_mix_copies") > 0)
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
        .select("_mix_row.*")
    )
