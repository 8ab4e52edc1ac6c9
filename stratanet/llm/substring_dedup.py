"""Substring deduplication by sliding spans of sentences.

From every sentence on, and up to every sentence, the shortest run of sentences
with enough words is hashed. Runs that several documents or places have are
found by one aggregate and one join on the hash. Each keeps its first place,
and sentences that any other place covers are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratanet.llm.common import slices, stored, text_of

#: Words of a run, and of a sentence that is a run by itself.
RUN_WORDS = 30
ALONE_WORDS = 50
#: Sentences end behind these marks before white space, and at line breaks.
BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the sentences that have a word."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def runs(text: str, words: int = RUN_WORDS, alone: int = ALONE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and sentence behind the last of each run.

    A run has at least ``words`` words and two sentences, or one sentence of
    at least ``alone`` words. White space inside sentences makes no difference.
    """
    own = [text[a:b].split() for a, b in sentences(text)]
    n = len(own)
    sums = np.zeros(n + 1, "i8")
    np.cumsum([len(w) for w in own], out=sums[1:])
    at = np.arange(n)
    ends = np.searchsorted(sums, sums[:-1] + words)
    ends = np.where((ends - at < 2) & (ends <= n) & (sums[np.minimum(ends, n)] - sums[:-1] < alone), at + 2, ends)
    begins = np.searchsorted(sums, sums[1:] - words, "right") - 1
    begins = np.where((at + 1 - begins < 2) & (begins >= 0) & (sums[1:] - sums[np.maximum(begins, 0)] < alone), at - 1, begins)
    pairs = np.unique(
        np.concatenate([np.stack([at, ends], 1)[ends <= n], np.stack([begins, at + 1], 1)[begins >= 0]]), axis=0
    ) if n else np.zeros((0, 2), "i8")
    first, behind = pairs[:, 0], pairs[:, 1]
    hashes = np.array([xxhash.xxh3_64_intdigest(" ".join(w)) for w in own], "u8")
    with np.errstate(over="ignore"):
        powers = np.ones(n + 1, "u8")
        np.cumprod(np.full(n, FACTOR), out=powers[1:])
        # A run's hash is a polynomial of its sentences' hashes, without the powers before it.
        total = np.zeros(n + 1, "u8")
        inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
        back = np.ones(n + 1, "u8")
        np.cumprod(np.full(n, inverse), out=back[1:])
        np.cumsum(hashes * powers[:-1], out=total[1:])
        found = (total[behind] - total[first]) * back[first]
        found ^= (behind - first).astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F)
    return found.view("i8"), first, behind


def _runs_of(docs: DataFrame, words: int, alone: int) -> DataFrame:
    """(h, doc_id, key, first, behind, again) of all runs; ``again`` if the document has it before."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 20):
            parts = [runs(t, words, alone) for t in batch.column(0).to_pylist()]
            counts = [len(p[0]) for p in parts]
            again = []
            for h, _, _ in parts:
                earliest = np.zeros(len(h), bool)
                earliest[np.unique(h, return_index=True)[1]] = True
                again.append(~earliest)
            rows = np.repeat(np.arange(len(parts)), counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([p[0] for p in parts])),
                    batch.column(1).take(pa.array(rows)),
                    batch.column(2).take(pa.array(rows)),
                    *[pa.array(np.concatenate([p[i] for p in parts]).astype("i4")) for i in (1, 2)],
                    pa.array(np.concatenate(again)),
                ],
                ["h", "doc_id", "key", "first", "behind", "again"],
            )

    return docs.select("text", "doc_id", "key").mapInArrow(
        task, "h long, doc_id long, key long, first int, behind int, again boolean"
    )


def deduplicate(
    docs: DataFrame, words: int = RUN_WORDS, alone: int = ALONE_WORDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, text, n_sentences, removed) of every row, the text without its repeated sentences.

    The place of a run that stays is in the document of the least id, and there
    the first. ``removed`` lists the (begin, end) in code points of what is
    gone. Rows that share an id are one document, whose runs stay in all of
    them; rows without an id are never the first where a row with one has the
    run. A null or empty text has no sentences and stays as it is, as do texts
    without repeated runs, to the character. An empty table gives no rows;
    other columns are not read. Runs are compared by 64-bit hash.
    """
    rows = docs.select(
        F.col(text).alias("raw"), text_of(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id")
    ).withColumn("key", F.xxhash64("text"))
    found = stored(_runs_of(rows, words, alone), "dedup-runs")
    places = found.groupBy("h").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("again").alias("twice"),
        F.max(F.col("doc_id").isNull()).alias("unnamed"),
    )
    # Stored, so that the join deals both sides out anew and can split a run that many documents have.
    repeated = stored(
        places.where("least < most or twice or (unnamed and least is not null)").select(F.col("h").alias("same"), "least"),
        "dedup-repeated",
    )
    gone = (
        found.join(repeated, F.col("h") == F.col("same"))
        .where("again or (least is not null and not (doc_id <=> least))")
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("first", "behind")).alias("spans"))
        .select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), "spans")
    )
    marked = rows.join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left"
    ).select("raw", "doc_id", "spans")
    place = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            texts, counts, removed = [], [], []
            for value, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = sentences(value or "")
                cut = cut_places(value or "", own, spans or [])
                texts.append(without(value, cut) if cut else value)
                counts.append(len(own))
                removed.append([{"begin": a, "end": b} for a, b in cut])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, place)],
                ["doc_id", "text", "n_sentences", "removed"],
            )

    return marked.mapInArrow(
        task, "doc_id long, text string, n_sentences long, removed array<struct<begin: int, end: int>>"
    )


def cut_places(text: str, own: list[tuple[int, int]], spans: list[dict]) -> list[tuple[int, int]]:
    """Stretches of covered sentences, each up to where the next sentence begins."""
    covered = np.zeros(len(own) + 1, "i4")
    for s in spans:
        covered[s["first"]] += 1
        covered[s["behind"]] -= 1
    inside = np.cumsum(covered[:-1]) > 0
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(inside).tolist():
        end = own[i + 1][0] if i + 1 < len(own) else len(text)
        if out and out[-1][1] == own[i][0]:
            out[-1] = out[-1][0], end
        else:
            out.append((own[i][0], end))
    return out


def without(text: str, cut: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for begin, end in cut:
        out.append(text[at:begin])
        at = end
    return "".join([*out, text[at:]])
