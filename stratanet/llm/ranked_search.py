"""Ranked lexical search of a stated set of items over all documents, which are scored once for each distinct bag."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratanet.llm.common import slices, small, stored

#: Fixed values of the contract: weights and saturation of the score.
GRAIN, LENGTH_SHARE, SPREAD, SATURATION = 1000, 90, 1_000_000_000, 8
#: Bytes that stand between terms; A-Z are lower-cased and all else kept.
BETWEEN = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = bytes(0x20 if b in BETWEEN else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Bytes of a text that are split into terms at once, about.
PIECE = 4 << 20
#: Terms of items that a block of items holds, about; blocks are scored one after another.
BLOCK_TERMS = 200_000
#: Cells of (bag, item) that are added up at once.
CELLS = 1 << 21

BAGS = "doc_id long, n long, terms array<int>, counts array<long>"
BEST = "item int, score long, key long, terms array<int>, counts array<long>, m long, first_id long"
#: What makes two bags one class: the hash, and all that it stands for.
SAME = ["key", "terms", "counts", "m"]


def pieces(text: bytes):
    """The text in parts that cut no term."""
    start = 0
    while len(text) - start > PIECE:
        cut = text.find(b" ", start + PIECE)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def terms_of(text: str | None) -> Counter:
    """Terms of a text and how often each stands in it."""
    found: Counter = Counter()
    for piece in pieces((text or "").encode().translate(FOLD)):
        found.update(piece.split())
    return found


def _terms(batches):
    for batch in slices(batches):
        ids, terms = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = [t.decode() for t in terms_of(text)]
            ids += [item] * len(found)
            terms += found
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(terms, pa.string())], names=["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once; rows that share an id are one item, and so are those without an id."""
    return items.select("item_id", "text").mapInArrow(_terms, "item_id long, term string").distinct()


class Block:
    """Some items with the vocabulary that the documents are restricted to; BLOCK_TERMS bounds its size."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        """``rows``: (item_id, term), each once."""
        self.ids = sorted({i for i, _ in rows}, key=lambda i: (i is None, i or 0))
        number = {i: k for k, i in enumerate(self.ids)}
        self.terms = {t: k for k, t in enumerate(sorted({t.encode() for _, t in rows}))}
        by = sorted((self.terms[t.encode()], number[i]) for i, t in rows)
        #: Items of term t: items[first[t]:first[t + 1]].
        self.items = np.array([i for _, i in by], dtype="int64")
        self.first = np.searchsorted(np.array([t for t, _ in by], dtype="int64"), np.arange(len(self.terms) + 1))


def _bagger(sent):
    def run(batches):
        terms = sent.value.terms
        for batch in slices(batches):
            ids, ns, bags = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                ids.append(doc_id)
                ns.append(found.total())
                bags.append(sorted((terms[t], c) for t, c in found.items() if t in terms))
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(ns, pa.int64()),
                    pa.array([[t for t, _ in b] for b in bags], pa.list_(pa.int32())),
                    pa.array([[c for _, c in b] for b in bags], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


def bags(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term, restricted to the vocabulary of a block of items."""
    return docs.select("doc_id", "text").mapInArrow(_bagger(sent), BAGS)


def with_lengths(found: DataFrame) -> tuple[DataFrame, int]:
    """The bags with m, the length of the document against the mean, and the number of documents that have a term."""
    total = found.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {total.docs}L) div {total.terms}L")
    return found.withColumn("m", m.cast("long")), total.docs


def weights(found: DataFrame, docs: int, n_terms: int) -> np.ndarray:
    """The weight of each term of the block, from the documents that hold it."""
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    value = F.floor(F.lit(float(GRAIN)) * F.log(F.lit(2.0 * docs + 2) / (2.0 * F.col("df") + 1)))
    out = np.zeros(n_terms, "int64")
    for row in df.select("term", value.alias("w")).collect():  # as many as the block has terms at most
        out[row.term] = row.w
    return out


def classes(found: DataFrame) -> DataFrame:
    """(key, terms, counts, m, first_id): distinct bags by a hash, verified by the bags themselves."""
    return found.groupBy(*SAME).agg(F.min("doc_id").alias("first_id"))


def summed(block: Block, terms, row, gain, n_rows: int) -> np.ndarray:
    """Scores (item, row): the gain of each row's term goes to all items that have the term."""
    score = np.zeros((len(block.ids), n_rows), "int64")
    by = np.argsort(terms, kind="stable")
    terms, row, gain = terms[by], row[by], gain[by]
    begin = np.flatnonzero(np.diff(terms, prepend=-1))
    for a, b in zip(begin, [*begin[1:], len(terms)], strict=True):
        # A row has a term once, so that no cell is named twice.
        items = block.items[block.first[terms[a]] : block.first[terms[a] + 1]]
        score[items[:, None], row[None, a:b]] += gain[None, a:b]
    return score


def top(item, score, first, row, k: int):
    """The k best rows of each item, all arguments cut to them: highest score, then least first id."""
    by = np.lexsort((row, first, -score, item))
    ranked = item[by]
    by = by[np.arange(len(by)) - np.searchsorted(ranked, ranked) < k]
    return item[by], score[by], first[by], row[by]


def _scorer(sent, sent_weights, k: int):
    def run(batches):
        block, weight = sent.value, sent_weights.value
        step = max(k, CELLS // max(1, len(block.ids)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                sizes = batch.column("terms").value_lengths().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), sizes)
                terms, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
                m = batch.column("m").to_numpy()
                first = batch.column("first_id").fill_null(np.iinfo("int64").max).to_numpy()
                gain = weight[terms] * ((SPREAD * tf) // (GRAIN * tf + SATURATION * m[row]))
                score = summed(block, terms, row, gain, batch.num_rows)
                least = 1
                if batch.num_rows > k:
                    least = np.maximum(np.partition(score, -k, axis=1)[:, -k], 1)[:, None]
                item, at = np.nonzero(score >= least)
                item, score, _, at = top(item, score[item, at], first[at], at, k)
                rows = batch.take(pa.array(at))
                yield pa.record_batch(
                    [pa.array(item, pa.int32()), pa.array(score), *(rows.column(c) for c in (*SAME, "first_id"))],
                    names=["item", "score", *SAME, "first_id"],
                )

    return run


def best_of(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The k first rows of each ``by``, with their rank; tasks drop what can't be among them before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """The k best documents of each item of a block."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)
    all_bags = stored(bags(docs, sent), "search-bags")
    sized, n_docs = with_lengths(all_bags)
    found = sized.where(F.size("terms") > 0).withColumn("key", F.xxhash64("terms", "counts", "m"))
    sent_weights = spark.sparkContext.broadcast(weights(found, n_docs, len(block.terms)))
    scored = classes(found).mapInArrow(_scorer(sent, sent_weights, k), BEST)
    # Ten classes ahead of one have ten documents ahead of all of its.
    picked = stored(best_of(scored, "item", [F.desc("score"), F.asc_nulls_last("first_id"), *SAME], k).drop("rank"), "search-best")
    named = stored(picked.select(*SAME).distinct().withColumn("class", F.monotonically_increasing_id()), "search-classes")
    members = found.select("doc_id", *SAME).join(small(named, 4096), SAME).select("class", "doc_id")
    members = best_of(members, "class", [F.asc_nulls_last("doc_id")], k).drop("rank")
    hits = picked.join(named, SAME).join(members, "class")
    names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
    ranked = best_of(hits, "item", [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    out = stored(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "search-hits")
    sent.destroy()
    sent_weights.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score of each item.

    The vocabulary of the items restricts every document to a bag of terms and
    counts. Bags with equal terms, counts and length class are scored once;
    their documents follow by ascending id. Items go in blocks of a bounded
    number of terms, each against all documents.

    Null and empty texts have no terms: such documents do not count, such items
    have no rows. Rows of documents that share an id are documents of their
    own, next to each other; rows without an id come last among equals. Items
    that share an id are one item. Empty tables give no rows. Texts may be of
    any length. Only doc_id and text, item_id and text are read.
    """
    terms = stored(item_terms(items), "search-items")
    n_blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    number = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    out = None
    for k_block in range(n_blocks):
        rows = [(r.item_id, r.term) for r in terms.where(number == k_block).collect()]  # about BLOCK_TERMS
        hits = search_block(docs, Block(rows), k)
        out = hits if out is None else out.unionByName(hits)
    return out
