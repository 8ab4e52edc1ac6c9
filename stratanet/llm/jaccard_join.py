"""N-gram Jaccard self-join: a size-aware join of light and heavy sets, and its components.

A document is the set of its shingles. Two sets link when their Jaccard index
reaches a threshold. Equal sets are one class, so that copies meet only once.

Small sets are enumerated: if two of them link, they share a subset of a size
that depends on the smaller one alone, and both list all their subsets of it.
Large sets scan inverted lists. A set enters the lists of a few of its
shingles: of those with the least hashes, about twice as many as can be missing
in a partner, it takes the rarer half. A partner shares at least one of them
(see ``listed``), and shingles of passages that many documents have are not
among them, unless the document is little else. Sets are light up to the size
where enumeration costs more than the lists.

Sets that have a list in common are few, and only these are ordered in full: by
how many of them have an element, rarest first. Two sets link only if they share
an element that stands early in both, as early as their two sizes demand, and a
set with too many elements of its own links with nothing. Sets that share a long
list of early elements are not all paired. One of them, with the fewest elements
of its own, is compared with the others, and after a few rounds only sets of
different components meet, those of a list's largest one not among themselves.
No link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratanet.llm.common import let, small, stored, text_of, words
from stratanet.llm.components import components
from stratanet.session import dropped

#: Sets up to this size are tried as light ones; beyond, the number of subsets explodes.
MOST_LIGHT = 24
#: A list of up to this many sets is compared in full at once.
SHORT_LIST = 6
#: Rounds of comparing with one set of each list, before sets of different components meet.
ROUNDS = 2
#: Elements are counted in so many lots, so that a part of them is on disk at a time.
LOTS = 2


class Threshold:
    """What a Jaccard index of at least ``percent`` per cent says about sizes."""

    def __init__(self, percent: int):
        self.percent = percent

    def least_partner(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def most_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def overlap(self, a: int, b: int) -> int:
        """Shared elements that sets of sizes a and b need."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def missing(self, n: int) -> int:
        """Elements of a set that no partner has, at most."""
        return n - self.least_partner(n)

    def extended(self, n: int) -> int:
        return min(n, 2 * self.missing(n) + 1)

    def kept(self, n: int) -> int:
        """Elements, rarest first, of the ``extended`` least hashes, of which every partner has one.

        Of two partners, let the first be the one whose extended part ends at
        the lower hash. What both share of it lies in both extended parts, and
        that is all of it but the missing ones.
        """
        shared = [
            min(self.extended(n) - (n - self.overlap(n, b)), self.extended(b) - (b - self.overlap(n, b)))
            for b in range(self.least_partner(n), self.most_partner(n) + 1)
        ]
        return min(self.extended(n), self.extended(n) - min(shared) + 1)

    def subset_sizes(self, n: int) -> list[int]:
        """Sizes of subsets that a light set lists: one for each size of a smaller partner."""
        return sorted({self.overlap(a, a) for a in range(max(1, self.least_partner(n)), n + 1)})

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, c) for c in self.subset_sizes(n))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: Column, n: int) -> Column:
    """Sorted 64-bit hashes of the distinct runs of ``n`` words; of all words if there are fewer."""

    def of(tokens: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(tokens, i, n))
        )
        return F.when(F.size(tokens) > 0, F.sort_array(F.array_distinct(runs))).otherwise(
            F.expr("cast(array() as array<bigint>)")
        )

    return let(words(lower_ascii(text)), of)


def _by_size(size: Column, value, top: int, beyond: Column) -> Column:
    """``value(size)`` for sizes up to ``top``, from a short list, and the formula beyond."""
    known = F.array(*[F.lit(value(n)) for n in range(1, top + 1)])
    return F.when(size > top, beyond).when(size > 0, F.get(known, size - 1)).otherwise(0)


def _subset_rows(sets: DataFrame, limit: Threshold) -> DataFrame:
    """(bucket, node, n) of the subsets that light sets (node, n, shingles) list.

    A subset's key is the sum of its hashes, by what is left out.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with np.errstate(over="ignore"):
                    hashes = np.array(values, "i8").view("u8") * np.uint64(0x9E3779B97F4A7C15)
                    keys = [
                        np.array([hashes.sum() - sum(out, np.uint64(0)) + np.uint64(c) for out in combinations(hashes, n - c)])
                        for c in limit.subset_sizes(n)
                    ]
                found = np.unique(np.concatenate(keys)).view("i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), node)), pa.array(np.full(len(found), n, "i4"))],
                    ["bucket", "node", "n"],
                )

    return sets.select("node", "n", "head").mapInArrow(task, "bucket long, node long, n int")


def light_boundary(nodes: DataFrame, limit: Threshold, wanted: int | None) -> int:
    """The size up to which enumerating subsets costs less rows than scanning lists.

    A list costs its entry and, for each partner in it, one more; how many
    partners a shingle has is measured on one in 64 of all shingles.
    """
    if wanted is not None:
        return wanted
    sample = nodes.select(F.explode("head").alias("h")).where(F.pmod("h", F.lit(64)) == 0).groupBy("h").count()
    sums = sample.agg(F.sum("count").alias("rows"), F.sum(F.col("count") * F.col("count")).alias("met")).first()
    partners = sums["met"] / sums["rows"] - 1 if sums["rows"] else 0.0
    best = 0
    while best < MOST_LIGHT and limit.subsets(best + 1) <= limit.extended(best + 1) + limit.kept(best + 1) * partners + 8:
        best += 1
    return best


def _memberships(nodes: DataFrame, limit: Threshold, light: int) -> DataFrame:
    """(bucket, node, n, own), stored: which sets may link because they have a bucket in common.

    ``own`` tells how many elements of a set's head no other set has.
    """
    size = F.col("n")
    least = (size * limit.percent + 99) / 100
    missing = size - F.floor(least).cast("int")
    in_lists = nodes.where(size >= limit.least_partner(light + 1))
    counted, lots = None, []
    for lot in range(LOTS):
        entries = in_lists.select("node", "n", F.explode("head").alias("h")).where(F.pmod("h", F.lit(LOTS)) == lot)
        # Counted before the shuffle and joined back, so that no task holds all entries of a frequent shingle.
        often = entries.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        lots.append(stored(entries.join(often, "h"), "join-counted"))
        counted = lots[-1] if counted is None else counted.unionByName(lots[-1])
    kept = _by_size(size, limit.kept, 80, missing + 1)
    extended = _by_size(size, limit.extended, 80, 2 * missing + 1)
    rare = (
        counted.groupBy("node", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared"))
        .withColumn("own", (extended - F.size("shared")).cast("int"))
        .withColumn("left", kept - F.col("own"))
        .where("left > 0")
        .select("node", "n", "own", F.explode(F.slice("shared", F.lit(1), F.col("left").cast("int"))).alias("s"))
        .select(F.col("s.h").alias("bucket"), "node", "n", "own")
    )
    listed = _subset_rows(nodes.where(size.between(1, light)), limit)
    members = stored(rare.unionByName(listed.withColumn("own", F.lit(0))), "join-members")
    dropped(*lots)
    return members


def _fits(a: Column, b: Column, limit: Threshold) -> Column:
    """Whether sets of these sizes can link."""
    return (a * 100 >= b * limit.percent) & (b * 100 >= a * limit.percent)


def _verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Those pairs (a, b) whose sets link."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .where(both * (100 + limit.percent) >= limit.percent * (F.size("x") + F.size("y")))
        .select("a", "b")
    )


def _beside(compared: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs (a, b) that may link though ``a`` doesn't link with the set ``p`` both were compared with.

    With D for the difference to ``p``, the difference of two sets has
    |Da| + |Db| - 2 |Da and Db| elements, and a link allows it a share of their
    sizes. As Da alone is larger than a link with ``p`` allows, over half of Db
    must lie in Da, so that one of its rarest elements must, counted among the
    differences to ``p``. Most differences are a document's own. Besides,
    Da less Db and Db less Da are each within what a link allows the largest
    partner, so that one more than that of the rarest elements, in one order for
    all, is enough of either; both lists are cut so before they meet.
    """
    near = compared.where("diff is not null").select("p", "a", "np", "na", "linked", "diff")
    alone = near.where("not linked").select("p").distinct()
    near = near.join(alone, "p", "left_semi")
    share = (100 - limit.percent) / (100 + limit.percent)
    entries = near.select("p", "a", "np", "na", "linked", F.size("diff").alias("size"), F.explode("diff").alias("e"))
    often = entries.groupBy("p", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = stored(
        entries.join(often, ["p", "e"])
        .groupBy("p", "a", "np", "na", "linked", "size")
        .agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("held")),
        "join-differences",
    )
    # A little is added before rounding, so that an inexact product never shortens a list.
    of_any = F.floor(F.col("na") * (100 - limit.percent) / limit.percent + 1e-9) + 1
    of_far = F.col("size") - F.floor((F.col("size") + share * (F.col("np") - F.col("na"))) / 2 - 1e-9)

    def rarest(n: Column) -> Column:
        left = F.greatest(n - (F.col("size") - F.size("held")), F.lit(0)).cast("int")
        return F.explode(F.slice("held", F.lit(1), left)).alias("h")

    one = held.where("not linked").select("p", "a", "na", F.col("size").alias("sa"), rarest(of_any))
    two = held.select("p", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("size").alias("sb"), rarest(F.least(of_any, of_far)))
    # What differs between two differences is at least what one of them has more.
    close = F.abs(F.col("sa") - F.col("sb")) * (100 + limit.percent) <= (F.col("na") + F.col("nb")) * (100 - limit.percent)
    return (
        one.select("p", "a", "na", "sa", F.col("h.e").alias("e"))
        .join(two.select("p", "b", "nb", "sb", F.col("h.e").alias("e")), ["p", "e"])
        .where((F.col("a") != F.col("b")) & _fits(F.col("na"), F.col("nb"), limit) & close)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _merged(known: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) after some more edges (a, b); the table of those before is deleted."""
    of = known.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    to = known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = (
        edges.join(of, "a", "left")
        .join(to, "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    merged = components(between)
    top = merged.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = known.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    out = stored(moved.unionByName(merged).groupBy("node").agg(F.min("component").alias("component")), "join-components")
    if hasattr(known, "_scratch_path"):
        dropped(known)
    return out


def _beside_others(members: DataFrame) -> DataFrame:
    """The distinct nodes that are not alone in all of their buckets."""
    crowd = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    return members.join(crowd, "bucket").select("node").distinct()


def _early(nodes: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """(bucket, node, n, own, place): elements by which these sets may link, with their place, rarest first.

    ``own`` tells how many elements no other of these sets has; they come first
    and are left out. What stands behind more elements than a partner of any
    size can lack is left out as well.
    """
    elements = sets.join(nodes, "node", "left_semi").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("e"))
    often = elements.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    missing = F.floor(F.col("n") * (100 - limit.percent) / 100).cast("int")
    return (
        elements.join(often, "e")
        .groupBy("node", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("shared"))
        .withColumn("own", F.col("n") - F.size("shared"))
        .where(F.col("own") <= missing)
        .select("node", "n", "own", F.posexplode(F.slice("shared", F.lit(1), missing + 1 - F.col("own"))).alias("at", "s"))
        .select(F.col("s.e").alias("bucket"), "node", "n", "own", (F.col("own") + F.col("at")).alias("place"))
    )


def _placed(entries: DataFrame, known: DataFrame) -> DataFrame:
    """The entries with the component of their node."""
    return entries.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _with_one(placed: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a, b) of sets in long lists with one of the list, in another component."""
    first = F.struct("own", F.xxhash64("node", F.lit(turn)))
    one = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("crowd"), F.count_distinct("component").alias("parts"),
        F.min_by(F.struct("node", "n", "component"), first).alias("one"),
    ).where((F.col("crowd") > SHORT_LIST) & (F.col("parts") > 1))
    return (
        placed.join(one.select("bucket", "one"), "bucket")
        .where(F.col("component") != F.col("one.component"))
        .select(F.col("one.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )


def _across(placed: DataFrame, limit: Threshold) -> DataFrame:
    """Distinct pairs (a, b) of different components that share an element early enough in both for their sizes.

    The largest component of a list is met by the others only.
    """
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("rows", "component")).alias("main")
    ).where("parts > 1")
    open_ = stored(placed.join(main.select("bucket", "main"), "bucket"), "join-open")
    one = open_.where("component != main").select("bucket", "main", F.col("node").alias("a"), "n", "place", F.col("component").alias("ca"))
    two = open_.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("at"), F.col("component").alias("cb"))
    # With an element at place i, sets have no more than n - i in common if they share none before it.
    needed = (F.col("n") + F.col("nb")) * limit.percent
    early = ((F.col("n") - F.col("place")) * (100 + limit.percent) >= needed) & ((F.col("nb") - F.col("at")) * (100 + limit.percent) >= needed)
    pairs = (
        one.join(two, "bucket")
        .where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & early)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    out = stored(pairs, "join-pairs")
    dropped(open_)
    return out


def linked(members: DataFrame, sets: DataFrame, limit: Threshold, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of nodes that link, found from memberships (bucket, node, n, own).

    Sets that share a bucket are ordered by their rarest elements, ``_early``.
    In each round one set of every long list of these is compared with those
    of other components: that with the fewest elements of its own, of equal
    ones the first by a hash that changes with the round. Then pairs of
    different components that may still link are compared.
    """
    entries = stored(_early(_beside_others(members), sets, limit), "join-early")
    known = members.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(rounds):
        pairs = stored(_with_one(_placed(entries, known), turn), "join-pairs")
        if pairs.take(1):
            known = _merged(known, _verified(pairs, sets, limit))
        dropped(pairs)
    pairs = _across(_placed(entries, known), limit)
    known = _merged(known, _verified(pairs, sets, limit))
    dropped(pairs, entries)
    return known


def jaccard_components(
    docs: DataFrame,
    shingle: int = 4,
    percent: int = 85,
    light: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Documents without a word have an empty set and link with nothing. Rows that
    share an id are one document, which links with whatever one of its texts
    does; repeated rows get equal results. Rows without an id take no part in
    links and have no component. An empty table gives no rows; other columns
    are not read. Sets are compared by 64-bit hashes of their shingles.
    """
    limit = Threshold(percent)
    size = F.size("s")
    missing = size - F.floor((size * percent + 99) / 100).cast("int")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    head = F.slice("s", F.lit(1), F.least(size, 2 * missing + 1))
    heads = stored(
        rows.select("doc_id", shingles(F.col("text"), shingle).alias("s")).select(
            "doc_id",
            size.alias("n"),
            F.xxhash64("s").alias("k1"),
            F.xxhash64(F.lit(1), "s").alias("k2"),
            F.when(size <= MOST_LIGHT, F.col("s")).otherwise(head).alias("head"),
        ),
        "join-heads",
    )
    classes = stored(
        heads.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node")), "join-classes"
    )
    nodes = heads.where("n > 0").join(
        small(classes, 40), (heads.k1 == classes.k1) & (heads.k2 == classes.k2) & (heads.doc_id == classes.node), "left_semi"
    ).dropDuplicates(["doc_id", "k1", "k2"]).select(F.col("doc_id").alias("node"), "n", "head")
    boundary = light_boundary(nodes, limit, light)
    members = _memberships(nodes, limit, boundary)
    named = _beside_others(members).select(F.col("node").alias("doc_id"))
    sets = stored(
        rows.join(small(stored(named, "join-nodes"), 16), "doc_id").select(
            F.col("doc_id").alias("node"), shingles(F.col("text"), shingle).alias("shingles")
        ),
        "join-sets",
    )
    found = linked(members, sets, limit)
    placed = heads.select("doc_id", "n", "k1", "k2").join(classes.select("k1", "k2", "node"), ["k1", "k2"], "left")
    # Of an id with several texts, some or none in a class, all are one document.
    of_id = placed.where("doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("node")).alias("nodes")
    )
    several = stored(of_id.where("rows > 1 and size(nodes) > 0").select("doc_id", "nodes"), "join-repeated")
    if several.take(1):
        apart = several.where("size(nodes) > 1").select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b"))
        found = _merged(found, apart.where("a != b"))
        first = several.select(F.col("doc_id").alias("_id"), F.col("nodes")[0].alias("first"))
        placed = placed.join(small(first, 16), F.col("doc_id") == F.col("_id"), "left").withColumn("node", F.coalesce("node", "first"))
    return placed.join(found, "node", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"),
    )
