"""All-pairs dependence measures over a long panel.

A layer's measure table has N(N-1)/2 rows by definition, but the rows that meet
in it need not be multiplied out.  Nodes are hashed into blocks and each panel
row is sent to the tiles its block takes part in, so a row is copied once per
block rather than once per partner.  A tile is a pair of blocks (and, for
measures that are sums over dates, a slice of dates), which bounds what one
task holds however many nodes or dates a layer has.  A key of several blocks
is packed first, a row for each block, and parts of that table are read side by
side instead of shuffling panel rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratanet.operators import kernels
from stratanet.operators.keyless import keyless
from stratanet.session import cut_lineage, is_empty, written

#: Bytes of a table that is sent to every executor, at most.
BROADCAST_BYTES = 16 << 20
#: Nodes per block (sums take several at once), dates per slice and cells per tile side.
BLOCK_NODES = 128
SUM_BLOCKS = 4
SLICE_DATES = 4096
TILE_CELLS = 4_000_000
#: Nodes whose sums with a block are held at once, where only their measure is kept.
STRIP_NODES = 64
#: Nodes of a group of blocks at most, and groups of a key at least, as far as it has blocks.
GROUP_NODES = 16_384
GROUPS = 6
MIN_OBS = 3
#: What a block has, packed in a row.
PACKED = ("blk", "_names", "_days", "_steps", "_cells")


@dataclass(frozen=True)
class Roles:
    """Which columns play which part; several key columns are allowed."""

    keys: tuple[str, ...] = ("layer",)
    node: str = "node"
    date: str = "dt"
    value: str = "value"


def clean_values(panel: DataFrame, roles: Roles) -> DataFrame:
    """One form of absence: NaN and null rows are gone, value is double."""
    value = F.col(roles.value).cast("double")
    return panel.select(
        *roles.keys, roles.node, roles.date, F.nanvl(value, F.lit(None)).alias(roles.value)
    ).where(F.col(roles.value).isNotNull())


def tile_sizes(panel: DataFrame, roles: Roles, sliced: bool, wide: bool = False) -> DataFrame:
    """(keys, _blocks, _slices, _per): how finely each key is cut, from sketches of its nodes and dates.

    ``_per`` blocks are a group. Blocks of whole series that are ``wide`` have as many nodes as those for sums.

    A sketch may be some per cent off, which makes blocks a little larger and
    changes no result.
    """
    nodes, dates = (F.greatest(F.approx_count_distinct(c), F.lit(1)) for c in (roles.node, roles.date))
    counted = panel.groupBy(*roles.keys).agg(nodes.alias("_nodes"), dates.alias("_dates"))
    if sliced:
        width = F.lit(BLOCK_NODES * SUM_BLOCKS)
        slices = F.ceil(F.col("_dates") / F.lit(SLICE_DATES))
        dates = F.least(F.col("_dates"), F.lit(SLICE_DATES))
    else:
        room = F.floor(F.lit(TILE_CELLS) / F.col("_dates"))
        width = F.greatest(F.lit(1), F.least(F.lit(BLOCK_NODES * (SUM_BLOCKS if wide else 1)), room))
        slices, dates = F.lit(1), F.col("_dates")
    blocks = F.ceil(F.col("_nodes") / width)
    held = F.least(F.floor(F.lit(GROUP_NODES) / width), F.floor(F.lit(TILE_CELLS) / (width * dates)))
    per = F.greatest(F.lit(1), F.least(F.ceil(blocks / F.lit(GROUPS)), held))
    sizes = {"_blocks": blocks, "_slices": slices, "_per": per}
    return counted.select(*roles.keys, *[c.cast("int").alias(name) for name, c in sizes.items()])


def blocks(panel: DataFrame, roles: Roles, sizes: DataFrame) -> DataFrame:
    """Add (blk, slice) of each row, and (_blocks, _per) of its key.

    ``sizes`` is a stored table of ``tile_sizes``, one row for each key.
    """
    of = sizes.select(F.struct(*roles.keys).alias("_of"), "_blocks", "_slices", "_per")
    if sizes.count() * 64 <= BROADCAST_BYTES:
        of = F.broadcast(of)
    same = F.struct(*[F.col(k) for k in roles.keys]).eqNullSafe(F.col("_of"))
    return (
        panel.join(of, same)
        .withColumn("blk", F.pmod(F.xxhash64(roles.node), F.col("_blocks")).cast("int"))
        .withColumn("slice", F.pmod(F.xxhash64(roles.date), F.col("_slices")).cast("int"))
        .drop("_of", "_slices")
    )


def _copied(rows: DataFrame, at: Column, count: Column) -> DataFrame:
    """Each row once for each tile (tile_a, tile_b) that its place ``at`` of ``count`` takes part in."""
    return (
        rows.withColumn("_at", at.cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)))
        .withColumn("tile_a", F.least("_at", "_other"))
        .withColumn("tile_b", F.greatest("_at", "_other"))
        .drop("_other")
    )


def tiles(panel: DataFrame, roles: Roles, sizes: DataFrame) -> DataFrame:
    """Add (tile_a, tile_b, blk, slice) and copy each row to its tiles."""
    placed = blocks(panel, roles, sizes)
    return _copied(placed, F.col("blk"), F.col("_blocks")).drop("_at", "_blocks", "_per")


def _coded(tile: pa.Table, roles: Roles):
    """Sorted nodes, sorted dates, and the place of each row's node and date among them."""
    out = []
    for name in (roles.node, roles.date):
        column = tile.column(name).combine_chunks().dictionary_encode()
        order = np.array(pc.sort_indices(column.dictionary))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        out += [column.dictionary.take(pa.array(order)), place[column.indices.to_numpy()]]
    return out[0], out[2], out[1], out[3]


def _tile_matrix(tile: pa.Table, roles: Roles):
    """Sorted node values, their block, and the (dates x nodes) matrix."""
    names, days, node, day = _coded(tile, roles)
    X = np.full((len(days), len(names)), np.nan)
    X[day, node] = tile.column(roles.value).to_numpy()
    blk = np.empty(len(names), dtype=np.int64)
    blk[node] = tile.column("blk").to_numpy()
    return names, blk, X


def packed(panel: DataFrame, roles: Roles, sizes: DataFrame) -> DataFrame:
    """One row for each block and slice: its nodes, its dates, and of each value the step from the last one's cell."""
    from pyspark.sql.pandas.types import to_arrow_schema

    group = [*roles.keys, "slice", "blk", "_blocks", "_per"]
    placed = blocks(panel, roles, sizes)
    fields = [placed.schema[k] for k in group]
    fields += [T.StructField(c, T.ArrayType(panel.schema[of].dataType)) for c, of in (("_names", roles.node), ("_days", roles.date))]
    fields += [T.StructField(c, T.BinaryType()) for c in ("_steps", "_cells")]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def pack(key, tile):
        names, days, node, day = _coded(tile, roles)
        at = node * len(days) + day
        order = np.argsort(at, kind="stable")
        steps = np.diff(at[order], prepend=0)
        steps = steps.astype(np.min_scalar_type(steps.max()))
        cells = tile.column(roles.value).to_numpy().astype("float64")[order]
        row = [pa.array([k.as_py()], t) for k, t in zip(key, arrow.types, strict=False)]
        row += [pa.ListArray.from_arrays(pa.array([0, len(x)], "int32"), x).cast(arrow.field(c).type) for c, x in (("_names", names), ("_days", days))]
        row += [pa.array([x.tobytes()], pa.binary()).cast(arrow.field(c).type) for c, x in (("_steps", steps), ("_cells", cells))]
        return pa.table(row, names=schema.names)

    return placed.groupBy(*group).applyInArrow(pack, schema)


@dataclass
class _Block:
    """A row of ``packed`` as a matrix."""

    blk: int
    names: pa.Array
    days: pa.Array
    X: np.ndarray


def _unpacked(row: dict[str, pa.Scalar], ending: str = "") -> _Block:
    blk, names, days, raw, cells = (row[c + ending] for c in ("blk", "_names", "_days", "_steps", "_cells"))
    names, days, raw, cells = names.values, days.values, raw.as_py(), np.frombuffer(cells.as_py())
    steps = np.frombuffer(raw, dtype=f"u{len(raw) // len(cells)}")
    X = np.full(len(names) * len(days), np.nan)
    X[np.cumsum(steps, dtype=np.int64)] = cells
    return _Block(blk.as_py(), names, days, X.reshape(len(names), len(days)).T)


def _side_by_side(p: _Block, q: _Block):
    """What ``_tile_matrix`` gives for the rows of both blocks."""
    both = [p] if p is q else [p, q]
    names, days = (pa.concat_arrays([getattr(x, c) for x in both]) for c in ("names", "days"))
    days = days.unique()
    days = days.take(pc.sort_indices(days))
    X, done = np.full((len(days), len(names)), np.nan), 0
    for x in both:
        rows = pc.index_in(x.days, value_set=days).to_numpy()
        X[rows, done : done + len(x.names)] = x.X
        done += len(x.names)
    order = np.array(pc.sort_indices(names))
    blk = np.repeat([x.blk for x in both], [len(x.names) for x in both])
    return names.take(pa.array(order)), blk[order], X[:, order]


def in_tiles(panel: DataFrame, roles: Roles, sizes: DataFrame, compute: Callable, schema: T.StructType) -> DataFrame:
    """``compute(names, blk, X, a, b)`` of every two blocks of a key and slice, as rows of ``schema``.

    It gives parts (i, how many j each has, j, columns). A key of one block is a
    tile as it is. Larger ones are packed and written, and every two parts of
    that table are read in one task, so that no block is shuffled to its partners.
    """
    listed = _listed(schema, roles)
    return _unlisted(_lists_in_tiles(panel, roles, sizes, _in_lists(compute, listed, roles), listed), listed, roles)


def _lists_in_tiles(panel, roles, sizes, compute, schema):
    if is_empty(sizes.where("_blocks > 1")):
        return _one_block(panel, roles, sizes, compute, schema)
    one, many = (cut_lineage(sizes.where(c)) for c in ("_blocks = 1", "_blocks > 1"))
    table = written(packed(panel, roles, many), "packed-blocks")
    group = F.floor(F.col("blk") / F.col("_per"))
    # A block once for each group of its partners, as rows that are joined where they are read.
    left = _copied(table, group, F.ceil(F.col("_blocks") / F.col("_per"))).where("_at = tile_a")
    same = [*roles.keys, "slice"]
    right = table.withColumn("_at", group.cast("int")).select(*[F.col(c).alias(f"{c}_r") for c in (*same, "_at", *PACKED)])
    both = F.struct(*same).eqNullSafe(F.struct(*[f"{c}_r" for c in same]))
    met = left.join(right.hint("shuffle_replicate_nl"), both & (F.col("tile_b") == F.col("_at_r")) & (F.col("blk") <= F.col("blk_r")))
    met = met.select(*roles.keys, *PACKED, *[f"{c}_r" for c in PACKED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                p = _unpacked(row)
                q = p if row["blk"] == row["blk_r"] else _unpacked(row, "_r")
                yield from compute([row[k] for k in roles.keys], *_side_by_side(p, q), p.blk, q.blk).combine_chunks().to_batches()

    found = met.mapInArrow(run, schema)
    return found if is_empty(one) else _one_block(panel, roles, one, compute, schema).unionByName(found)


def _one_block(panel, roles, sizes, compute, schema):
    def run(key, tile):
        return compute(key, *_tile_matrix(tile, roles), 0, 0)

    return tiles(panel, roles, sizes).groupBy(*roles.keys, "tile_a", "tile_b", "slice").applyInArrow(run, schema)


def _listed(schema: T.StructType, roles: Roles) -> T.StructType:
    """``schema`` with a row for each first node: node_j and what follows it are lists."""
    first = len(roles.keys) + 1
    lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields[first:]]
    return T.StructType(schema.fields[:first] + lists)


def _in_lists(compute: Callable, listed: T.StructType, roles: Roles) -> Callable:
    """``compute`` with its parts as a table of ``listed``, so that a pair is not a row on its way from Python."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, depth = to_arrow_schema(listed), len(roles.keys)

    def part(key, names, i, counts, j, columns):
        i, counts = i[counts > 0], counts[counts > 0]
        ends = pa.array(np.append(0, np.cumsum(counts)), "int32")
        keys = [pa.repeat(pa.scalar(k.as_py(), t), len(i)) for k, t in zip(key, arrow.types[:depth], strict=False)]
        flat = [names.take(pa.array(j)), *[pa.array(v, from_pandas=v.dtype.kind == "f") for v in columns.values()]]
        lists = [pa.ListArray.from_arrays(ends, v.cast(t.value_type)).cast(t) for v, t in zip(flat, arrow.types[-len(flat) :], strict=True)]
        return pa.table([*keys, names.take(pa.array(i)).cast(arrow.field("node_i").type), *lists], schema=arrow)

    def run(key, names, blk, X, a, b):
        found = [part(key, names, *p) for p in compute(names, blk, X, a, b) if len(p[2])]
        return pa.concat_tables(found) if found else arrow.empty_table()

    return run


def _unlisted(found: DataFrame, listed: T.StructType, roles: Roles) -> DataFrame:
    """A row for each pair."""
    first, values = listed.names[: len(roles.keys) + 1], listed.names[len(roles.keys) + 2 :]
    rows = found.select(*first, *values, F.posexplode("node_j").alias("_at", "_node_j"))
    return rows.select(*first, F.col("_node_j").alias("node_j"), *[F.get(v, F.col("_at")).alias(v) for v in values])


def _both_ways(left, right, wanted, columns, swapped):
    """Parts of the wanted pairs of two blocks; ``swapped`` has the columns where the later node is on the left."""
    ordered = wanted & (left[:, None] <= right[None, :])
    yield _picked(left, right, ordered, columns)
    if left is not right:
        yield _picked(right, left, (wanted & ~ordered).T, {k: v.T for k, v in swapped.items()})


def _picked(i, j, keep, columns):
    at = np.flatnonzero(keep)
    counts = np.count_nonzero(keep, axis=1)
    place = at - np.repeat(np.arange(len(i)) * len(j), counts)
    return i, counts, j[place], {k: v.reshape(-1).take(at) for k, v in columns.items()}


def _key_types(panel: DataFrame, roles: Roles):
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [panel.schema[k] for k in roles.keys]
    types = [to_arrow_type(f.dataType) for f in fields]
    return fields, types, to_arrow_type(panel.schema[roles.node].dataType)


def _pair_schema(panel: DataFrame, roles: Roles, columns: dict[str, T.DataType]):
    node_type = panel.schema[roles.node].dataType
    fields = [T.StructField(k, panel.schema[k].dataType) for k in roles.keys]
    fields += [T.StructField(c, node_type) for c in ("node_i", "node_j")]
    return T.StructType(fields + [T.StructField(c, t) for c, t in columns.items()])


SUMS = ("sx", "sy", "sxy", "sxx", "syy")


def _sum_names(fourth: bool = False, counts: bool = False) -> tuple[str, ...]:
    return () if counts else SUMS + (("sxxyy",) if fourth else ())


def pair_sums(
    panel: DataFrame,
    roles: Roles,
    *,
    extra_keys: tuple[str, ...] = (),
    self_pairs: bool = False,
    fourth: bool = False,
    counts: bool = False,
    centred: bool = False,
    correlation: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Sums over the common dates of every pair (the pairwise-complete Gram form).

    ``extra_keys`` are added to the slice key, e.g. the block of dates that
    belongs to one set of windows.  Values should be centred per node first;
    ``centred`` does so in the tiles, for keys whose dates fit one slice.
    With ``counts`` only the common dates are counted; with ``correlation``
    a pair has its measure instead of its sums, for keys of one slice.
    Partial sums of slices are *not* added up here; ``pair_totals`` does that
    for the keys that have several.
    """
    all_roles = Roles(roles.keys + extra_keys, roles.node, roles.date, roles.value)
    sums = ("measure",) if correlation else _sum_names(fourth, counts)
    schema = _pair_schema(
        panel,
        all_roles,
        {"n": T.LongType()} | {s: T.DoubleType() for s in sums},
    )

    def sums_of(Zl, Ml, Zr, Mr):
        stats = {"n": Ml.T @ Mr}
        if not counts:
            stats |= {
                "sx": Zl.T @ Mr,
                "sy": Ml.T @ Zr,
                "sxy": Zl.T @ Zr,
                "sxx": (Zl * Zl).T @ Mr,
                "syy": Ml.T @ (Zr * Zr),
            }
        if fourth:
            stats["sxxyy"] = (Zl * Zl).T @ (Zr * Zr)
        return stats

    def gram(names, blk, X, a, b):
        left = np.flatnonzero(blk == a)
        right = left if a == b else np.flatnonzero(blk == b)
        M = (~np.isnan(X)).astype(float)
        Z = np.nan_to_num(X - np.nanmean(X, axis=0) if centred else X, nan=0.0)
        Zl, Zr, Ml, Mr = Z[:, left], Z[:, right], M[:, left], M[:, right]
        if correlation:
            # Some rows at a time: what only leads to the measure stays in the cache.
            stats = {c: np.empty((len(left), len(right))) for c in ("n", "measure")}
            for lo in range(0, len(left), STRIP_NODES):
                rows = slice(lo, lo + STRIP_NODES)
                strip = sums_of(Zl[:, rows], Ml[:, rows], Zr, Mr)
                stats["n"][rows], stats["measure"][rows] = strip["n"], kernels.correlation(**strip)
        else:
            stats = sums_of(Zl, Ml, Zr, Mr)
        wanted = stats["n"] > 0
        if a == b:
            wanted &= np.triu(np.ones(wanted.shape, dtype=bool), 0 if self_pairs else 1)
        stats["n"] = np.rint(stats["n"]).astype(np.int64)
        swapped = {k: stats[{"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}.get(k, k)] for k in stats}
        yield from _both_ways(left, right, wanted, stats, swapped)

    if sizes is None:
        sizes = cut_lineage(tile_sizes(panel, all_roles, sliced=True))
    return in_tiles(panel, all_roles, sizes, gram, schema)


def pair_totals(
    panel: DataFrame, roles: Roles, *, extra_keys: tuple[str, ...] = (), self_pairs: bool = False,
    fourth: bool = False, counts: bool = False, centred: bool = False, correlation: bool = False,
    sizing: DataFrame | None = None,
) -> DataFrame:
    """``pair_sums`` with one row for each pair.

    A key whose dates fit one slice is finished in its tiles; only pairs of
    longer keys are shuffled again. With ``centred`` each node's mean is taken
    off, in the tiles where they hold whole series. With ``correlation`` the
    sums of a pair become its measure as soon as they are whole. ``sizing`` is a
    cheaper table with the same keys, nodes and dates to count.
    """
    keys = roles.keys + extra_keys
    all_roles = Roles(keys, roles.node, roles.date, roles.value)
    sizes = cut_lineage(tile_sizes(panel if sizing is None else sizing, all_roles, sliced=True))
    more = dict(extra_keys=extra_keys, self_pairs=self_pairs, fourth=fourth, counts=counts)
    if is_empty(sizes.where("_slices > 1")):
        return pair_sums(panel, roles, sizes=sizes, centred=centred, correlation=correlation, **more)
    short, long = (cut_lineage(sizes.where(c)) for c in ("_slices = 1", "_slices > 1"))
    apart = centre(panel, all_roles) if centred else panel
    added = add_up(pair_sums(apart, roles, sizes=long, **more), [*keys, "node_i", "node_j"], fourth, counts)
    if correlation:
        added = added.select(*keys, "node_i", "node_j", "n", correlation_of_sums().alias("measure"))
    return pair_sums(panel, roles, sizes=short, centred=centred, correlation=correlation, **more).unionByName(added)


def pair_kernel(
    panel: DataFrame, roles: Roles, fn: Callable, block: bool = False, wide: bool = False
) -> DataFrame:
    """(keys, node_i, node_j, n_obs, raw) of every pair; whole series per tile.

    ``fn(x, Y) -> (value, n)`` gets the earlier node and several later ones;
    with ``block``, ``fn(X, Y)`` gets two blocks and must be symmetric; ``wide``
    is for one that holds no more than some numbers for each pair.
    """
    schema = _pair_schema(
        panel, roles, {"n_obs": T.LongType(), "raw": T.DoubleType()}
    )

    def by_series(blk, X, a, b):
        parts = []
        for p in range(X.shape[1]):
            js = p + 1 + np.flatnonzero(blk[p + 1 :] == (a + b - blk[p]))
            if len(js):
                value, n = fn(X[:, p], X[:, js])
                parts.append((p, np.count_nonzero(n > 0), js[n > 0], n[n > 0], value[n > 0]))
        if parts:
            i, counts, *found = zip(*parts, strict=True)
            j, n, value = [np.concatenate(c) for c in found]
            yield np.array(i), np.array(counts), j, {"n_obs": n.astype(np.int64), "raw": value.astype(float)}

    def by_block(blk, X, a, b):
        left = np.flatnonzero(blk == a)
        right = left if a == b else np.flatnonzero(blk == b)
        if not len(left) or not len(right):
            return
        value, n = fn(X[:, left], X[:, right])
        wanted = n > 0
        if a == b:
            wanted &= np.triu(np.ones(n.shape, dtype=bool), 1)
        columns = {"n_obs": n.astype(np.int64), "raw": value.astype(float)}
        yield from _both_ways(left, right, wanted, columns, columns)

    def pairs_of(names, blk, X, a, b):
        return (by_block if block else by_series)(blk, X, a, b)

    return in_tiles(panel, roles, cut_lineage(tile_sizes(panel, roles, sliced=False, wide=wide)), pairs_of, schema)


def centre(panel: DataFrame, roles: Roles) -> DataFrame:
    """Subtract each node's own mean, so that sums of squares stay accurate."""
    group = [*roles.keys, roles.node]
    means = panel.groupBy(*group).agg(F.avg(roles.value).alias("_mean"))
    return (
        panel.join(means, group)
        .withColumn(roles.value, F.col(roles.value) - F.col("_mean"))
        .drop("_mean")
    )


def add_up(sums: DataFrame, group: list[str], fourth: bool = False, counts: bool = False) -> DataFrame:
    return sums.groupBy(*group).agg(
        F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in _sum_names(fourth, counts)]
    )


def correlation_of_sums(min_obs: int = MIN_OBS) -> Column:
    """Pearson from n and the five sums; null when undefined or flat."""
    n = F.col("n").cast("double")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    flat = F.lit(1e-13)
    defined = (
        (F.col("n") >= min_obs)
        & (vx > flat * n * F.col("sxx"))
        & (vy > flat * n * F.col("syy"))
    )
    r = cov / F.sqrt(vx) / F.sqrt(vy)
    return F.when(defined, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


# -- measures ---------------------------------------------------------------


def pearson(panel: DataFrame, roles: Roles) -> DataFrame:
    group = [*roles.keys, "node_i", "node_j"]
    pairs = pair_totals(panel, roles, centred=True, correlation=True)
    return pairs.select(*group, F.col("n").alias("n_obs"), "measure")


def conditional(panel: DataFrame, roles: Roles, quantile: float = 0.90) -> DataFrame:
    """Correlation over the dates on which both series exceed their own quantile."""
    group = [*roles.keys, roles.node]
    size = F.abs(F.col(roles.value))
    cut = panel.groupBy(*group).agg(F.percentile(size, F.lit(quantile)).alias("_cut"))
    stressed = panel.join(cut, group).where(size > F.col("_cut")).drop("_cut")
    r = pearson(stressed, roles)
    return r.withColumn("measure", (F.col("measure") + 1.0) / 2.0)


def complete_dates(panel: DataFrame, roles: Roles) -> DataFrame:
    """Keep the dates on which every node of the key has a value."""
    keys = list(roles.keys)
    per_date = panel.groupBy(*keys, roles.date).agg(F.count(F.lit(1)).alias("_have"))
    per_node = panel.select(*keys, roles.node).distinct()
    wanted = per_node.groupBy(*keys).agg(F.count(F.lit(1)).alias("_want"))
    full = (
        per_date.join(wanted, keys)
        .where(F.col("_have") == F.col("_want"))
        .select(*keys, roles.date)
    )
    return panel.join(full, [*keys, roles.date], "left_semi")


def shrinkage(panel: DataFrame, roles: Roles) -> DataFrame:
    """Ledoit-Wolf shrunk correlation on listwise-complete dates, as (r+1)/2.

    The shrinkage weight needs only per-pair sums, so no covariance matrix is
    assembled anywhere.
    """
    keys = list(roles.keys)
    group = [*keys, "node_i", "node_j"]
    full = cut_lineage(centre(complete_dates(panel, roles), roles))
    sums = pair_totals(full, roles, self_pairs=True, fourth=True)
    n = F.col("n").cast("double")
    both = F.when(F.col("node_i") == F.col("node_j"), 1.0).otherwise(2.0)
    diag = F.when(F.col("node_i") == F.col("node_j"), F.col("sxy"))
    totals = (
        sums.groupBy(*keys)
        .agg(
            F.max("n").cast("double").alias("_n"),
            F.sum(F.when(F.col("node_i") == F.col("node_j"), 1.0)).alias("_p"),
            F.sum(diag / n).alias("_trace"),
            F.sum(both * F.col("sxxyy")).alias("_x4"),
            F.sum(both * F.col("sxy") * F.col("sxy") / (n * n)).alias("_s2"),
        )
        .withColumn("_mu", F.col("_trace") / F.col("_p"))
        .withColumn(
            "_delta",
            (F.col("_s2") - F.col("_mu") * F.col("_trace")) / F.col("_p"),
        )
        .withColumn(
            "_beta",
            F.least(
                (F.col("_x4") / F.col("_n") - F.col("_s2")) / (F.col("_p") * F.col("_n")),
                F.col("_delta"),
            ),
        )
        .withColumn(
            "_weight",
            F.when(F.col("_beta") > 0, F.col("_beta") / F.col("_delta")).otherwise(0.0),
        )
        .where(F.col("_n") >= 2)
        .select(*keys, "_mu", "_weight")
    )
    keep = 1.0 - F.col("_weight")
    floor = F.col("_weight") * F.col("_mu")
    var_i = keep * F.col("sxx") / n + floor
    var_j = keep * F.col("syy") / n + floor
    r = keep * F.col("sxy") / n / F.sqrt(var_i) / F.sqrt(var_j)
    return (
        sums.where(F.col("node_i") < F.col("node_j"))
        .join(totals, keys)
        .select(
            *group,
            F.col("n").alias("n_obs"),
            F.when((var_i > 0) & (var_j > 0), (r + 1.0) / 2.0).alias("measure"),
        )
    )


def _plain_kernel(fn: Callable, block: bool = False, wide: bool = False):
    def build(panel: DataFrame, roles: Roles) -> DataFrame:
        return pair_kernel(panel, roles, fn, block, wide).withColumnRenamed("raw", "measure")

    return build


def mutual_information(panel: DataFrame, roles: Roles) -> DataFrame:
    """Nearest-neighbour information over the largest of the key, self-pairs included."""
    keys = list(roles.keys)
    pairs = pair_kernel(panel, roles, kernels.mutual_information)
    own = self_kernel(panel, roles, lambda x: kernels.mutual_information(x, x[:, None]))
    peak = (
        pairs.select(*keys, "raw")
        .unionByName(own.select(*keys, "raw"))
        .groupBy(*keys)
        .agg(F.greatest(F.lit(1e-6), F.max("raw")).alias("_peak"))
    )
    return pairs.join(peak, keys).select(
        *keys,
        "node_i",
        "node_j",
        "n_obs",
        F.least(F.lit(1.0), F.col("raw") / F.col("_peak")).alias("measure"),
    )


def self_kernel(panel: DataFrame, roles: Roles, fn: Callable) -> DataFrame:
    """(keys, node, raw) of a series against itself; one small group per node."""
    fields, types, node_type = _key_types(panel, roles)
    schema = T.StructType(
        [T.StructField(k, panel.schema[k].dataType) for k in roles.keys]
        + [
            T.StructField(roles.node, panel.schema[roles.node].dataType),
            T.StructField("raw", T.DoubleType()),
        ]
    )

    def run(key, series):
        value, _n = fn(series.column(roles.value).to_numpy())
        out = {
            f.name: pa.array([k.as_py()], t)
            for f, t, k in zip(fields, types, key, strict=False)
        }
        out[roles.node] = pa.array([key[-1].as_py()], node_type)
        out["raw"] = pa.array(np.asarray(value, dtype=float), from_pandas=True)
        return pa.table(out)

    return panel.groupBy(*roles.keys, roles.node).applyInArrow(run, schema)


def _warping(panel: DataFrame, roles: Roles, radius: int | None) -> DataFrame:
    keys = list(roles.keys)
    pairs = pair_kernel(
        panel, roles, lambda x, Y: kernels.warping_distance(x, Y, radius)
    )
    peak = pairs.groupBy(*keys).agg(
        F.greatest(F.lit(1e-6), F.max("raw")).alias("_peak")
    )
    return pairs.join(peak, keys).select(
        *keys,
        "node_i",
        "node_j",
        "n_obs",
        (1.0 - F.least(F.lit(1.0), F.col("raw") / F.col("_peak"))).alias("measure"),
    )


def dtw(panel: DataFrame, roles: Roles) -> DataFrame:
    return _warping(panel, roles, None)


def banded_dtw(panel: DataFrame, roles: Roles, radius: int = 2) -> DataFrame:
    return _warping(panel, roles, radius)


@dataclass(frozen=True)
class Measure:
    """A measure and what a caller must know to use its values."""

    label: str
    build: Callable[..., DataFrame]
    low: float = 0.0
    high: float = 1.0
    missing: str = "pairwise"
    settings: tuple[str, ...] = field(default=())


MEASURES: dict[str, Measure] = {
    "pearson_correlation": Measure("Pearson correlation", pearson, low=-1.0),
    "spearman_correlation": Measure(
        "Spearman correlation", _plain_kernel(kernels.spearman, block=True, wide=True), low=-1.0
    ),
    "kendall_tau": Measure("Kendall tau-b", _plain_kernel(kernels.kendall, block=True)),
    "distance_correlation": Measure(
        "Distance correlation", _plain_kernel(kernels.distance_correlation, block=True)
    ),
    "chatterjee_xi": Measure("Chatterjee xi", _plain_kernel(kernels.chatterjee_xi)),
    "conditional_correlation": Measure(
        "Conditional correlation", conditional, settings=("quantile",)
    ),
    "shrinkage_correlation": Measure(
        "Shrinkage correlation", shrinkage, missing="listwise"
    ),
    "mutual_information": Measure("Mutual information", mutual_information),
    "dtw_distance": Measure("Time-warping similarity", dtw, missing="own gaps"),
    "fastdtw_distance": Measure(
        "Banded time-warping similarity",
        banded_dtw,
        missing="own gaps",
        settings=("radius",),
    ),
    "maximal_correlation": Measure(
        "Maximal correlation (binned)", _plain_kernel(kernels.maximal_correlation)
    ),
}


def register_measure(
    name: str,
    build: Callable[..., DataFrame],
    *,
    label: str | None = None,
    low: float = 0.0,
    high: float = 1.0,
) -> None:
    """Add ``build(panel, roles, **settings) -> (keys, node_i, node_j, n_obs, measure)``."""
    MEASURES[name] = Measure(label or name, build, low=low, high=high)


def register_pair_kernel(name: str, fn: Callable, **meta) -> None:
    """Add a NumPy kernel ``fn(x, Y) -> (value, n)`` as a measure."""
    register_measure(name, _plain_kernel(fn), **meta)


@keyless
def measure_pairs(
    panel: DataFrame, measure: str, roles: Roles = Roles(), *, stored: bool = False, **settings
) -> DataFrame:
    """(keys, node_i, node_j, n_obs, measure), node_i < node_j.

    Pairs without a common date are absent; pairs with too few are null.  A
    measure reads its panel several times (sizes, means, tiles), so the panel is
    written once first unless it is a stored table already.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    unknown = set(settings) - set(MEASURES[measure].settings)
    if unknown and MEASURES[measure].settings:
        raise ValueError(f"{measure} has no setting {sorted(unknown)}")
    panel = clean_values(panel, roles)
    if not stored:
        panel = written(panel, "panel")
    return MEASURES[measure].build(panel, roles, **settings)
