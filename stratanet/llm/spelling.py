"""Spelling variants: words one edit apart, found in dense tiles of code points, and the forms they stand for."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratanet.llm.common import slices, stored

#: Fixed value of the contract: what words are made of, after A-Z are lower-cased.
LETTERS = re.compile("[a-zÀ-ÿ]+")
OTHER = re.compile("[^a-zÀ-ÿ]")
#: Characters of a text that are split into words at once, about.
PIECE = 1 << 20
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Words of a block, about; a tile compares two blocks.
BLOCK = 512
#: Cells of code points that are compared at once.
CELLS = 1 << 21
COUNTS = "word string, n long"
PARTIAL = "word string, n long, n_near long, near_n long, near string"


def pieces(text: str):
    """The text in parts that cut no run of letters."""
    start = 0
    while len(text) - start > PIECE:
        cut = OTHER.search(text, start + PIECE)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _counter(min_length: int, nth: int):
    def run(batches):
        held: Counter = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                seed = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for piece in pieces(text.encode().lower().decode()):
                    for word, n in Counter(LETTERS.findall(piece)).items():
                        if seed is not None:
                            h = zlib.crc32(word.encode(), seed)
                            if h % nth == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        if len(word) >= min_length:
                            held[word] += n
                    if len(held) > HELD:
                        yield _counts(held)
                        held.clear()
        yield _counts(held)

    return run


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, nth: int = 97) -> DataFrame:
    """(word, n): words of all texts that are long and frequent enough.

    In about one of ``nth`` words of a document, chosen by a checksum of its id
    and the word, one code point is left out. Without an id none is left out.
    A null text has no words. Each row of a repeated id counts.
    """
    parts = docs.select("doc_id", "text").mapInArrow(_counter(min_length, nth), COUNTS)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def tiled(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(longer, side, half, i, j, at, word, n): the words of each pair of blocks that can hold words one edit apart.

    If the longer of two words one edit apart has l code points, they share
    their first or their last l div 2. Words that share one of these form a
    bucket; its words are dealt to blocks by hash, and a tile takes two blocks,
    or one with itself. A word meets the others of its bucket once, and is
    copied once for each block.
    """
    length = F.length("word")
    longer = F.explode(F.array(length, length + 1))
    entries = words.withColumn("longer", longer).withColumn("side", F.explode(F.array(F.lit("p"), F.lit("s"))))
    half = F.expr("if(side = 'p', left(word, longer div 2), right(word, longer div 2))")
    entries = entries.withColumn("half", half).withColumn("long", (F.length("word") == F.col("longer")).cast("int"))
    bucket = ["longer", "side", "half"]
    sizes = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"), F.sum("long").alias("n_long"))
    sizes = sizes.where("size > 1 and n_long > 0").select(*bucket, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = entries.drop("long").join(sizes, bucket).withColumn("at", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *bucket, F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "word", "n"
    )


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded matrices of the words' code points, from the left and from the right, and lengths."""
    texts = np.array(words.to_pylist())
    width = max(1, texts.dtype.itemsize // 4)
    left = texts.view("uint32").reshape(len(texts), width)
    lengths = np.char.str_len(texts)
    column = np.arange(width)[None, :] - (width - lengths)[:, None]
    # What stands before a word from the right differs from what stands behind it from the left.
    right = np.where(column >= 0, np.take_along_axis(left, np.maximum(column, 0), 1), 0)
    return left, right, lengths


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns the rows have in common from the left."""
    same = a == b
    return np.where(same.all(1), a.shape[1], same.argmin(1))


def one_edit(left, right, lengths, a, b) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair of rows (a the longer or as long) is one edit apart, and the length of its common prefix."""
    longest = lengths[a]
    prefix = np.minimum(shared(left[a], left[b]), lengths[b])
    suffix = np.minimum(shared(right[a][:, ::-1], right[b][:, ::-1]), lengths[b])
    near = (longest - lengths[b] <= 1) & (prefix + suffix >= longest - 1)
    return near & ~((longest == lengths[b]) & (prefix == longest)), prefix


def block_pairs(first, count, at, i, j, longer, lengths, cells: int):
    """Pairs of rows to compare, tile by tile, in lots: a is as long as the tile asks, b as long or one shorter.

    ``first`` and ``count`` give each tile's rows. Rows of a tile with two
    blocks meet across blocks only, those of one block each once.
    """
    lot_a, lot_b, held = [], [], 0
    for start, size in zip(first, count, strict=True):
        rows = np.arange(start, start + size)
        is_long = lengths[rows] == longer[start]
        if i[start] == j[start]:
            long, short = rows[is_long], rows[~is_long]
            x, y = np.triu_indices(len(long), 1)
            found = [(long[x], long[y]), (np.repeat(long, len(short)), np.tile(short, len(long)))]
        else:
            lower, found = at[rows] == i[start], []
            for x, y in ((is_long & lower, ~lower), (is_long & ~lower, lower & ~is_long)):
                x, y = rows[x], rows[y]
                found.append((np.repeat(x, len(y)), np.tile(y, len(x))))
        for x, y in found:
            lot_a.append(x)
            lot_b.append(y)
            held += len(x)
        if held > cells:
            yield np.concatenate(lot_a), np.concatenate(lot_b)
            lot_a, lot_b, held = [], [], 0
    if held:
        yield np.concatenate(lot_a), np.concatenate(lot_b)


def best_near(source, other, n, order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of directed near pairs: the rows, how many are near each, and the nearest of largest n, then least order."""
    by = np.lexsort((order[other], -n[other], source))
    rows, begin, count = np.unique(source[by], return_index=True, return_counts=True)
    return rows, count, other[by][begin]


def compare_tiles(table: pa.Table) -> pa.RecordBatch:
    """What the tiles of the table, each whole and its rows together, say of their words."""
    words = table.column("word").combine_chunks()
    left, right, lengths = code_points(words)
    longer, at, i, j, n = (table.column(c).to_numpy() for c in ("longer", "at", "i", "j", "n"))
    is_suffix = pc.equal(table.column("side"), "s").to_numpy()
    first = np.flatnonzero(new_tile(table))
    count = np.diff([*first, table.num_rows])
    texts = np.array(words.to_pylist())
    order = np.empty(len(texts), "int64")
    order[np.argsort(texts, kind="stable")] = np.arange(len(texts))
    source, other = [], []
    lot = max(1, CELLS // left.shape[1])
    for a, b in block_pairs(first, count, at, i, j, longer, lengths, lot):
        for k in range(0, len(a), lot):
            x, y = a[k : k + lot], b[k : k + lot]
            near, prefix = one_edit(left, right, lengths, x, y)
            # A pair that shares both halves counts where the first halves meet.
            near &= ~(is_suffix[x] & (prefix >= longer[x] // 2))
            source += [x[near], y[near]]
            other += [y[near], x[near]]
    source, other = (np.concatenate(v) if v else np.zeros(0, "int64") for v in (source, other))
    rows, near, best = best_near(source, other, n, order)
    return pa.record_batch(
        [words.take(pa.array(rows)), pa.array(n[rows]), pa.array(near, pa.int64()), pa.array(n[best]), words.take(pa.array(best))],
        names=["word", "n", "n_near", "near_n", "near"],
    )


def new_tile(table: pa.Table) -> np.ndarray:
    """Which rows begin a tile."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in ("longer", "side", "half", "i", "j"):
        column = table.column(name)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
    return new


def _compare(batches):
    """Tiles come whole: the last of a batch waits for its rest."""
    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cut = int(np.flatnonzero(new_tile(table))[-1])
        if cut:
            yield compare_tiles(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None:
        yield compare_tiles(rest)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n) of a table of distinct words and their counts.

    Two words are near if one code point inserted, deleted or replaced turns
    one into the other. The form is the near word of largest n, of equals the
    first by code points, if it is at least twice as frequent.
    """
    tiles = tiled(words, block)
    place = ["longer", "side", "half", "i", "j"]
    found = tiles.repartition(*place).sortWithinPartitions(*place).mapInArrow(_compare, PARTIAL)
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("rest"), F.col("near").alias("word"))))
    merged = found.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.rest") >= 2 * F.col("n")
    return merged.select(
        "word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.rest")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the forms of forms.

    Each round doubles the steps; a form is twice as frequent as its word, so
    that six rounds reach the end of any chain of 64-bit counts.
    """
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(
            links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots",
        )
        links = new.drop("moved")
        if not new.where("moved").take(1):
            return links


def spelling_variants(
    docs: DataFrame, min_length: int = 5, min_count: int = 3, nth: int = 97, block: int = BLOCK
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all frequent words of the texts.

    Null and empty texts have no words, rows that share an id each count,
    without an id no code point is left out, and an empty table has no words.
    Texts may be of any length: they are read in pieces, and counts are passed
    on when many words are held. Only doc_id and text are read of docs.
    """
    words = stored(word_counts(docs, min_length, min_count, nth), "spelling-words")
    found = stored(near_words(words, block), "spelling-near")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
