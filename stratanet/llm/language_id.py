"""Language identification by character models with interpolated Kneser-Ney smoothing.

Letters fall into 127 classes (a to z, and the others by hash) and everything
else is a boundary, so that there are at most 2^21 trigrams of any language.
That bounds the model, whatever it is learned from: per language one number for
each trigram seen, found in a sorted array, and two tables of 2^14 for those
that were not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratanet.llm.common import slices, stored, text_of

CLASS_BITS = 7
CLASSES = 1 << CLASS_BITS
PAIRS = CLASSES * CLASSES
TRIGRAMS = PAIRS * CLASSES
UNKNOWN = "und"
#: Symbols that count as evidence for a score at most; they are not independent.
EVIDENCE = 64
#: Share of a language's own training texts that may lie above its limit.
REJECTED = 0.001
#: Languages whose counts a task holds at a time, 16 MB each.
HELD = 8


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: 0 if it is no letter."""
    table = np.zeros(0x110000, "u1")
    letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    table[letters] = 27 + (letters * 2654435761 >> 7) % (CLASSES - 27)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all texts, and where those of each text begin; lower case, one boundary between words."""
    low = [f" {t.lower()} " for t in texts]
    firsts = np.cumsum([0, *map(len, low)])
    codes = classes()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    keep[firsts[:-1]] = True
    kept = codes[keep].astype("i4")
    sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[firsts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    inside = np.flatnonzero(np.arange(len(kept)) + 2 < ends)
    grams = kept[inside] << 2 * CLASS_BITS | kept[inside + 1] << CLASS_BITS | kept[inside + 2]
    return grams, np.concatenate([[0], np.cumsum(np.maximum(sizes - 2, 0))])


class KneserNey:
    """Probabilities of one language from its trigram counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams = grams
        context, last = grams >> CLASS_BITS, grams & (PAIRS - 1)
        middle_of = np.arange(PAIRS) >> CLASS_BITS
        # Lower orders count in how many contexts a pair or a class stands.
        pairs = np.bincount(last, minlength=PAIRS).astype(float)
        single = np.bincount(np.flatnonzero(pairs) & (CLASSES - 1), minlength=CLASSES).astype(float)
        p1 = (single + 1) / (single.sum() + CLASSES)
        cut = self._discount(pairs[pairs > 0])
        totals = np.bincount(middle_of, pairs, CLASSES)
        kinds = np.bincount(middle_of, pairs > 0, CLASSES)
        safe = np.maximum(totals, 1)
        rest = np.where(totals > 0, cut * kinds / safe, 1.0)
        self.p2 = np.maximum(pairs - cut, 0) / safe[middle_of] + rest[middle_of] * p1[np.arange(PAIRS) & (CLASSES - 1)]
        cut = self._discount(counts)
        totals = np.bincount(context, counts, PAIRS)
        kinds = np.bincount(context, minlength=PAIRS)
        safe = np.maximum(totals, 1)
        self.rest = np.where(totals > 0, cut * kinds / safe, 1.0)
        self.p3 = np.maximum(counts - cut, 0) / safe[context] + self.rest[context] * self.p2[last]

    @staticmethod
    def _discount(counts: np.ndarray) -> float:
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        return float(once / (once + 2 * twice)) if once and twice else 0.5


class Model:
    """All languages side by side: a sorted array of trigrams, a row of logarithms for each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        single = [KneserNey(*counts[x]) for x in self.languages]
        self.grams = np.unique(np.concatenate([k.grams for k in single])) if single else np.zeros(0, "i4")
        self.rest = np.log(np.stack([k.rest for k in single], 1)).astype("f4") if single else None
        self.pairs = np.log(np.stack([k.p2 for k in single], 1)).astype("f4") if single else None
        self.logs = np.empty((len(self.grams), len(single)), "f4")
        for i, k in enumerate(single):
            self.logs[:, i] = self._unseen(self.grams)[:, i]
            self.logs[np.searchsorted(self.grams, k.grams), i] = np.log(k.p3)

    def _unseen(self, grams: np.ndarray) -> np.ndarray:
        return self.rest[grams >> CLASS_BITS] + self.pairs[grams & (PAIRS - 1)]

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text in each language, and the number of symbols."""
        grams, begins = trigrams(texts)
        sizes = np.diff(begins)
        out = np.zeros((len(texts), len(self.languages)))
        if len(grams) and self.languages:
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            logs = self.logs[at]
            new = np.flatnonzero(self.grams[at] != grams)
            logs[new] = self._unseen(grams[new])
            sums = np.zeros((len(grams) + 1, len(self.languages)))
            np.cumsum(logs, 0, out=sums[1:], dtype="f8")
            out = -(sums[begins[1:]] - sums[begins[:-1]]) / np.maximum(sizes, 1)[:, None]
        return out, sizes


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of every language of the rows that have one; whole texts, all rows.

    Counts are made in the tasks and summed by (language, trigram); what comes
    back is at most 2^21 numbers per language.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())],
                    ["lang", "gram", "n"],
                )
            held.clear()

        for batch in slices(batches):
            by_lang: dict[str, list[str]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(name, []).append(t)
            for name, texts in by_lang.items():
                if name not in held:
                    if len(held) >= HELD:
                        yield from emptied()
                    held[name] = np.zeros(TRIGRAMS, "i8")
                held[name] += np.bincount(trigrams(texts)[0], minlength=TRIGRAMS)
        yield from emptied()

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    sums = rows.mapInArrow(task, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sums.toArrow().to_pandas().sort_values(["lang", "gram"])
    return Model(
        {name: (g["gram"].to_numpy("i4"), g["n"].to_numpy("f8")) for name, g in found.groupby("lang")}
    )


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score, loss, symbols) of every row.

    ``score`` is the probability of the language among those of the model,
    ``loss`` its cross-entropy per symbol. Texts that are null or have no
    letter are ``und`` with score 0, and so is everything if nothing was
    learned. Equal losses go to the first language by name. Repeated rows and
    null ids stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 0):
            texts = batch.column(0).to_pylist()
            losses, sizes = model.losses(texts)
            lettered = np.array([bool(model.languages) and bool(classes_of(t)) for t in texts], bool)
            best = losses.argmin(1) if model.languages else np.zeros(len(texts), int)
            least = losses.min(1, initial=np.inf) if model.languages else np.zeros(len(texts))
            odds = np.exp(-(losses - least[:, None]) * np.minimum(sizes, EVIDENCE)[:, None]).sum(1)
            score = np.where(lettered, 1 / np.maximum(odds, 1.0), 0.0)
            names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(score), pa.array(least), pa.array(sizes, pa.int64())],
                [*batch.schema.names[1:], "lang_pred", "score", "loss", "symbols"],
            )

    rows = docs.select(text_of(text).alias("_text"), F.col(doc_id).cast("long").alias("doc_id"), *keep)
    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes[1:])
    return rows.mapInArrow(task, f"{kept}, lang_pred string, score double, loss double, symbols long")


def classes_of(text: str) -> bool:
    """Whether the text has a letter."""
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, learned from those not held out.

    ``rejected`` marks texts whose loss is above all but a thousandth of the
    losses of the language's own training texts. It is taken from all of them.
    A null id is held out by the checksum of the empty text.
    """
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts
    model = learn(docs.where(fold != 1), text, lang)
    scored = stored(
        predict(docs, model, doc_id, text, ((fold == 1).alias("held_out"), F.col(lang).cast("string").alias("known"))),
        "language-scores",
    )
    limits = (
        scored.where(~F.col("held_out") & (F.col("known") == F.col("lang_pred")))
        .groupBy("lang_pred")
        .agg(F.percentile_approx("loss", 1 - REJECTED, 10_000).alias("limit"))
    )
    # One row for each language of the model.
    return scored.join(F.broadcast(limits), "lang_pred", "left").select(
        "doc_id", "held_out", "lang_pred", "score", F.coalesce(F.col("loss") > F.col("limit"), F.lit(True)).alias("rejected")
    )
