"""Quality classifier: interpolated modified Kneser-Ney models of trusted text.

One model has all runs of ``ORDER`` characters, in 256 classes, that trusted
texts have, per language; it knows how words are spelled. The other has all
pairs of words, by 48-bit hash of each, and grows with the trusted text; in
scripts without spaces each character is a word.

Trusted texts are counted first: their n-grams are listed by shards, packed,
and the lists of a shard are merged. What the models know of a shard is one
packed row. Documents then come in a few lots, so that only a part of them is on
disk at a time. Those of a lot are gathered into slices of one language of some
megabytes; a slice lists its distinct n-grams for each shard, by number only,
meets what is known of the shard and gets values back in the order of its list.
The slice makes the same lists again from its texts, so that no n-gram is
written beside its values. Rows that are shuffled grow with shards and slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratanet.llm.common import slices, small, stored, text_of
from stratanet.session import dropped

ORDER = 5
#: What a document is used for.
OTHER, LEARN, CALIBRATE = 0, 1, 2
CLASS_BITS = 8
#: Text of a slice, and what a task gathers before its largest slice is closed.
SLICE_BYTES = 8 << 20
GATHERED_BYTES = 10 << 20
#: Characters that are numbered at once, and entries of a table that numbers runs by those they are made of.
CHUNK = 1 << 18
TABLE = 1 << 24
#: N-grams listed by slices that one task looks up, about.
LISTED = 1 << 21
#: Documents are scored in so many lots, where there is more text than that of one.
LOTS = 5
LOT_BYTES = 32 << 20
#: Bits of the hashes of words and of pairs; above them stands the shard.
HASH_BITS = 48
HASH_MASK = (1 << HASH_BITS) - 1
#: Lists that are merged at once.
MERGED = 64
#: Text per shard where all text is as much; shards grow with its root, as do the slices that meet a shard.
SHARD_BYTES = 1 << 20
#: What a list is of, besides letters by their number: a word and a pair of words.
WORD, PAIR = 101, 102
#: One in this many trusted documents, by the checksum of the id, sets thresholds and is not counted.
FOLDS = 5
#: Share of a language's trusted documents that its threshold lets through.
QUANTILE = 0.999
#: Share of those of all languages that no threshold lies below, for languages with few.
POOLED_QUANTILE = 0.99
#: Letters of scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, bopomofo and Han.
UNSPACED = "\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Least standard deviation between the losses of whole texts, as a share of their language's median.
BETWEEN = 0.01
#: A word is one of those letters, a run of others, or a mark.
WORDS = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+|[^\w\s]")
#: Probability of a word that trusted text doesn't have, before it is weighted.
UNSEEN = 2.0**-24


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of a code point: ASCII as it is, the others by hash."""
    table = np.arange(0x110000, dtype="i8")
    table[128:] = 128 + (table[128:] * 2654435761 >> 7) % 128
    return table.astype("u1")


def ngrams(text: str, order: int = ORDER) -> np.ndarray:
    """One n-gram for each character and one for the end; line breaks stand before the beginning."""
    padded = "\n" * (order - 1) + text + "\n"
    codes = classes()[np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4")].astype("i8")
    grams = np.zeros(len(text) + 1, "i8")
    for j in range(order):
        grams = grams << CLASS_BITS | codes[j : j + len(grams)]
    return grams


def _laid(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, lengths) of texts, some at a time, each between the line breaks that ``ngrams`` adds."""
    held, size = [], 0
    for at, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= CHUNK or at == len(texts) - 1:
            laid = "".join(f"{'\n' * (order - 1)}{t}\n" for t in held)
            yield np.frombuffer(laid.encode("utf-32-le", "surrogatepass"), "<u4"), np.array([len(t) for t in held])
            held, size = [], 0


class _Numbering:
    """Numbers for pairs of numbers, in their order: by a table where it has room, else by the sorted pairs."""

    def __init__(self, most: int, width: int, pairs: Iterator[np.ndarray]):
        self.width = width
        self.at = None
        if most * width <= TABLE:
            seen = np.zeros(most * width, bool)
            for p in pairs:
                seen[p] = True
            self.found = np.flatnonzero(seen)
            self.at = np.zeros(len(seen), "i4")
            self.at[self.found] = np.arange(len(self.found), dtype="i4")
        else:
            self.found = np.zeros(0, "i8")
            for p in pairs:
                self.found = np.union1d(self.found, p)

    def of(self, pairs: np.ndarray) -> np.ndarray:
        return self.at[pairs] if self.at is not None else np.searchsorted(self.found, pairs)


class _Letters:
    """The distinct n-grams of texts, sorted, and the place among them of those that a text has.

    A run is known by the numbers of two shorter runs that it is made of, so
    that each character is looked up in a few small tables and none is sorted.
    """

    def __init__(self, texts: list[str], order: int):
        self.order = order
        self.chunks = [(classes()[codes], lengths) for codes, lengths in _laid(texts, order)]
        seen = np.zeros(1 << CLASS_BITS, bool)
        for codes, _ in self.chunks:
            seen[codes] = True
        keys = {1: np.flatnonzero(seen)}
        self.first = (np.cumsum(seen) - 1).clip(0).astype("i4")
        self.steps: list[tuple[int, int, _Numbering]] = []
        n = 1
        while n < order:
            more = max(k for k in keys if k <= order - n)
            last = n + more == order
            width = len(keys[more])
            found = _Numbering(len(keys[n]), width, (self._pairs(i, n, more, width, last) for i in range(len(self.chunks))))
            self.steps.append((n, more, found))
            keys[n + more] = keys[n][found.found // max(width, 1)] << CLASS_BITS * more | keys[more][found.found % max(width, 1)]
            n += more
        self.keys = keys[order]

    def _known(self, chunk: int) -> dict[int, np.ndarray]:
        known = {1: self.first[self.chunks[chunk][0]]}
        for n, more, found in self.steps:
            last = n + more == self.order
            known[n + more] = found.of(self._pairs(chunk, n, more, found.width, last, known))
        return known

    def _pairs(self, chunk: int, n: int, more: int, width: int, last: bool, known=None) -> np.ndarray:
        """Pairs of numbers of runs of n and of ``more`` that follow each other; at last within a text only."""
        known = known or self._known(chunk)
        places = len(known[1]) - n - more + 1
        pairs = known[n][:places].astype("i8") * width + known[more][n : n + places]
        return pairs[self._inside(chunk, places)] if last else pairs

    def _inside(self, chunk: int, places: int) -> np.ndarray:
        ends = np.cumsum(self.chunks[chunk][1] + self.order)[:-1]
        inside = np.ones(places, bool)
        inside[(ends[:, None] - np.arange(1, self.order)).ravel()] = False
        return inside

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places among the keys, how many each text has), some texts at a time."""
        for i, (_, lengths) in enumerate(self.chunks):
            yield self._known(i)[self.order], lengths + 1


@lru_cache(maxsize=1)
def _word_parts() -> np.ndarray:
    """Of each code point: 0 if it is in no word, 1 in a run, 2 if it is a word by itself."""
    table = np.zeros(0x110000, "u1")
    every = "".join(map(chr, range(0x110000)))
    for part, pattern in ((1, rf"[^\W{UNSPACED}]+"), (2, rf"(?:[{UNSPACED}]|[^\w\s])+")):
        for m in re.finditer(pattern, every):
            table[m.start() : m.end()] = part
    return table


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    """Odd 64-bit weights of the places in a word."""
    return np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, 1 << 12, "u8") | np.uint64(1)


def _hashed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``WORDS`` begin, and their hashes: weighted sums of their code points, mixed."""
    parts = _word_parts()[codes]
    begins = (parts == 2) | ((parts == 1) & (np.append(np.uint8(0), parts[:-1]) != 1))
    inside = np.flatnonzero(parts)
    first = np.flatnonzero(begins[inside])
    if not len(first):
        return inside, np.zeros(0, "i8")
    place = np.arange(len(inside)) - np.repeat(first, np.diff(np.append(first, len(inside))))
    weights = _weights()
    sums = np.add.reduceat(weights[place & (len(weights) - 1)] * (codes[inside].astype("u8") + np.uint64(1)), first)
    sums = (sums ^ sums >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return inside[first], (sums >> np.uint64(64 - HASH_BITS)).astype("i8")


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for each pair of words."""
    return (before * -7046029254386353131 + word) & HASH_MASK


def _all_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before and the word, by hash, and how many pairs each text has: one for each word and one for the end.

    0 stands for both ends of a text.
    """
    words, lengths = [], []
    for codes, own in _laid(texts, 1):
        begins, hashes = _hashed(codes)
        n = np.diff(np.searchsorted(begins, np.cumsum(own + 1)), prepend=0)
        ended = np.zeros(len(hashes) + len(n), "i8")
        ended[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes
        words.append(ended)
        lengths.append(n + 1)
    word = np.concatenate(words)
    return np.append(0, word[:-1]), word, np.concatenate(lengths)


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted."""
    ordered = np.sort(numbers)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]]


def _firsts(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct numbers, sorted: where one of each stands, the place of every number among them, their counts."""
    by = np.argsort(numbers)
    ordered = numbers[by]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(by)]
    at = np.empty(len(by), "i8")
    at[by] = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    return by[begins], at, np.diff(np.append(begins, len(by)))


def _counted(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts, and how often each stands in them."""
    letters = _Letters(texts, order)
    counts = np.zeros(len(letters.keys), "i8")
    for places, _ in letters.places():
        counts += np.bincount(places, minlength=len(counts))
    return letters.keys, counts


def _packed(rows: list[tuple]) -> bytes:
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int32()),
            pa.array([r[3] for r in rows], pa.string()),
        ],
        ["doc_id", "key", "role", "text"],
    )
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _zipped(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    rows = np.ascontiguousarray(values).view("u1").reshape(len(values), values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(rows.T.tobytes())


def _unzipped(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1")
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted numbers by their differences, which may wrap around."""
    return _zipped(np.diff(keys, prepend=np.int64(0)))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_unzipped(data, "i8"), dtype="i8")


def _shift(kind: int) -> int:
    """Letters are in shards by their first two, hashes of words by themselves."""
    return CLASS_BITS * max(kind - 2, 0) if kind < WORD else 0


def _numbers(kind: int, keys: np.ndarray, shards: int, by: np.ndarray | None = None) -> np.ndarray:
    """Keys with their shard above them; pairs are in the shard of the word ``by`` before."""
    return ((keys if by is None else by) >> _shift(kind)) % shards << HASH_BITS | keys


def _below(grams: np.ndarray, k: int) -> np.ndarray:
    """The distinct runs of k letters that end or precede what runs of k + 1 have last."""
    return np.unique(np.append(grams & ((1 << CLASS_BITS * k) - 1), ngrams("", k)[0] if k else 0))


def _spelled(grams: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, keys) of the letters by which a slice with these n-grams is looked up."""
    yield order, grams
    for k in range(order - 1, -1, -1):
        grams = _below(grams, k)
        yield k, grams


def _by_shard(numbers: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, keys) of sorted numbers."""
    ends = np.searchsorted(numbers, np.arange(1, shards + 1) << HASH_BITS).tolist()
    for shard, (begin, end) in enumerate(zip([0, *ends], ends, strict=False)):
        if begin < end:
            yield shard, numbers[begin:end] & HASH_MASK


def _texts(payload: pa.BinaryScalar) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(payload.as_buffer())


LISTS = {
    "slice": pa.int64(), "lang": pa.string(), "kind": pa.int32(), "shard": pa.int64(), "n": pa.int64(),
    "keys": pa.binary(), "words": pa.binary(), "counts": pa.binary(),
}
LISTS_DDL = "slice long, lang string, kind int, shard long, n long, keys binary, words binary, counts binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[tuple]]]:
    """(slice, lang, [(doc_id, key, role, text)]) of rows (text, doc_id, key, lang, role)."""
    held: dict[str, list[tuple]] = {}
    sizes: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def closed(lang: str) -> tuple[int, str, list[tuple]]:
        nonlocal number
        number += 1
        sizes.pop(lang)
        return number - 1, lang, held.pop(lang)

    for batch in slices(batches, 0):
        for text, doc_id, key, lang, role in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held.setdefault(lang, []).append((doc_id, key, role, text))
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= SLICE_BYTES:
                yield closed(lang)
            elif sum(sizes.values()) >= GATHERED_BYTES:
                yield closed(max(sizes, key=sizes.get))
    for lang in list(held):
        yield closed(lang)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def _sliced(rows: DataFrame) -> DataFrame:
    """(slice, lang, payload) of rows (text, doc_id, key, lang, role)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, lang, own in _gathered(batches):
            yield _batch([(number, lang, _packed(own))], {"slice": pa.int64(), "lang": pa.string(), "payload": pa.binary()})

    return rows.mapInArrow(task, "slice long, lang string, payload binary")


def _counts(rows: DataFrame, order: int, shards: int) -> DataFrame:
    """Lists of the n-grams of the highest orders of rows (text, doc_id, key, lang, role), with their counts.

    ``keys`` are sorted; where they are words that others, ``words``, follow, by both.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, lang, own in _gathered(batches):
            texts = [r[3] for r in own]
            del own
            grams, counts = _counted(texts, order)
            shard = (grams >> _shift(order)) % shards
            out = []
            for k in np.unique(shard).tolist():
                at = shard == k
                out.append((number, lang, order, k, int(at.sum()), _steps(grams[at]), None, _zipped(counts[at].astype("i4"))))
            before, word, _ = _all_pairs(texts)
            first, _, counts = _firsts(_numbers(PAIR, _joined(before, word), shards, before))
            before, word = before[first], word[first]
            shard = before % shards
            by = np.lexsort([word, before, shard])
            ends = np.cumsum(np.bincount(shard, minlength=shards)).tolist()
            for k, (begin, end) in enumerate(zip([0, *ends], ends, strict=False)):
                at = by[begin:end]
                if begin < end:
                    out.append((number, lang, PAIR, k, end - begin, _steps(before[at]), _zipped(word[at]), _zipped(counts[at].astype("i4"))))
            yield _batch(out, LISTS)

    return rows.mapInArrow(task, LISTS_DDL)


def _asked(payloads: DataFrame, order: int, shards: int, spelled: bool) -> DataFrame:
    """(slice, lang, kind, shard, keys): lists of the distinct letters or words of each slice."""
    kinds = {"slice": pa.int64(), "lang": pa.string(), "kind": pa.int32(), "shard": pa.int64(), "keys": pa.binary()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, lang, payload in zip(*batch.columns, strict=True):
                texts = [t for b in _texts(payload) for t in b["text"].to_pylist()]
                if spelled:
                    lists = ((kind, np.sort(_numbers(kind, keys, shards))) for kind, keys in _spelled(_Letters(texts, order).keys, order))
                else:
                    before, word, _ = _all_pairs(texts)
                    own = _distinct(_numbers(PAIR, _joined(before, word), shards, before))
                    lists = [(PAIR, own), (WORD, np.sort(_numbers(WORD, _distinct(word), shards)))]
                for kind, numbers in lists:
                    yield _batch(
                        [(number.as_py(), lang.as_py(), kind, k, _steps(keys)) for k, keys in _by_shard(numbers, shards)], kinds
                    )

    return payloads.select("slice", "lang", "payload").mapInArrow(task, "slice long, lang string, kind int, shard long, keys binary")


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists without the n-grams that no trusted text has."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {n: batch.column(n)[at].as_py() for n in LISTS}
            counts = _unzipped(row["counts"], "i4")
            seen = counts > 0
            if seen.all():
                yield batch.slice(at, 1)
                continue
            row |= {"n": int(seen.sum()), "keys": _steps(_from_steps(row["keys"])[seen]), "counts": _zipped(counts[seen])}
            if row["words"] is not None:
                row["words"] = _zipped(_unzipped(row["words"], "i8")[seen])
            yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in LISTS.items()], list(LISTS))


def _merged(lists: pa.Table) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(keys, words, counts) of what trusted text has of the lists of one kind and shard."""
    keys, words, counts = [], [], []
    for k, w, c in zip(*[lists[n].to_pylist() for n in ("keys", "words", "counts")], strict=True):
        n = _unzipped(c, "i4")
        seen = n > 0
        keys.append(_from_steps(k)[seen])
        words.append(np.zeros(0, "i8") if w is None else _unzipped(w, "i8")[seen])
        counts.append(n[seen])
    own, after, counts = (np.concatenate(x) for x in (keys, words, counts))
    paired = len(after) > 0
    first, at, _ = _firsts(_joined(own, after) if paired else own)
    total = np.bincount(at, counts, len(first)).astype("i8")
    return own[first], after[first] if paired else None, total


LEARNED = LISTS | {f"n{i}": pa.int64() for i in (1, 2, 3, 4)} | {"total": pa.int64()}
LEARNED_DDL = f"{LISTS_DDL}, n1 long, n2 long, n3 long, n4 long, total long"


def _list_row(table: pa.Table, keys: np.ndarray, words: np.ndarray | None, counts: np.ndarray) -> tuple:
    """One list of LISTS with these contents, of the language, kind and shard of the table."""
    by = np.argsort(keys) if words is None else np.lexsort([words, keys])
    return (
        *(table[n][0].as_py() for n in ("slice", "lang", "kind", "shard")), len(keys),
        _steps(keys[by]), None if words is None else _zipped(words[by]), _zipped(np.minimum(counts[by], 2**31 - 1).astype("i4")),
    )


def _finished(row: tuple, counts: np.ndarray) -> tuple:
    """A list with how many counts are one, two, three and four, and their sum."""
    return (*row, *[int((counts == i).sum()) for i in (1, 2, 3, 4)], int(counts.sum()))


def _learned(lists: DataFrame, n: int, order: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """One finished list for each kind and shard of letters of the highest order and pairs, and one of words.

    Lists of one shard are merged some at a time, in rounds, until one is left;
    ``n`` is about how many there are. The count of a word is the number of
    different words before it.
    """

    def once(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch([_list_row(table, *_merged(table))], LISTS)])

    def last(table: pa.Table) -> pa.Table:
        keys, words, counts = _merged(table)
        out = [_finished(_list_row(table, keys, words, counts), counts)]
        if words is not None:
            after, times = np.unique(words, return_counts=True)
            shard = after % shards
            for k in np.unique(shard).tolist():
                own = shard == k
                row = (out[0][3], out[0][1], WORD, k, int(own.sum()), _steps(after[own]), None, _zipped(times[own].astype("i4")))
                out.append((*row, None, None, None, None, None))
        return pa.Table.from_batches([_batch(out, LEARNED)])

    def of_words(table: pa.Table) -> pa.Table:
        keys, words, counts = _merged(table)
        return pa.Table.from_batches([_batch([_finished(_list_row(table, keys, words, counts), counts)], LEARNED)])

    # What trusted text hasn't is left out before the lists are shuffled.
    own, rounds = lists.mapInArrow(_seen, LISTS_DDL), []
    while n > MERGED:
        n = -(-n // MERGED)
        some = F.pmod(F.xxhash64("slice"), F.lit(n)).alias("some")
        own = stored(own.groupBy("lang", "kind", "shard", some).applyInArrow(once, LISTS_DDL), "model-merged")
        dropped(*rounds)
        rounds = [own]
    learned = stored(own.groupBy("lang", "kind", "shard").applyInArrow(last, LEARNED_DDL), "model-learned")
    dropped(*rounds)
    words = learned.where(F.col("kind") == WORD).select(*LISTS)
    return learned, stored(words.groupBy("lang", "kind", "shard").applyInArrow(of_words, LEARNED_DDL), "model-words")


def _letter_rows(learned: DataFrame, order: int) -> DataFrame:
    """(lang, key, c) of the lists of letters."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = _from_steps(keys)
                c = _unzipped(counts, "i4").astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own), pa.array(c)], ["lang", "key", "c"])

    return learned.where(F.col("kind") == order).select("lang", "keys", "counts").mapInArrow(task, "lang string, key long, c long")


def _off(*more: str) -> list[Column]:
    """``more`` and d1, d2, d3: how much modified Kneser-Ney takes off counts of one, two and more, by n1 to n4."""
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def off(i: int) -> Column:
        value = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.greatest(F.lit(0.1), F.least(F.coalesce(value, F.lit(0.5)), F.lit(float(i)))).alias(f"d{i}")

    return [F.col(c) for c in more] + [off(i) for i in (1, 2, 3)]


def _discounts(types: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of rows (lang, c)."""
    n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    return types.groupBy("lang").agg(*n).select(*_off("lang"))


LETTERS_DDL = "lang string, kind int, shard long, keys binary, left binary, stems binary, total binary, passed binary"


def _letters(learned: DataFrame, order: int, shards: int) -> DataFrame:
    """(lang, kind, shard, keys, left, stems, total, passed): what is known of letters, packed.

    ``left`` is what a seen n-gram keeps after the discount, ``total`` what
    stands behind a stem, and ``passed`` the share of that which the discount
    gives to the order below. The counts of an order are, but for the highest,
    the numbers of different characters before an n-gram.
    """
    types = {order: stored(_letter_rows(learned, order), "model-types")}
    for k in range(order - 1, 0, -1):
        key = F.col("key").bitwiseAND((1 << CLASS_BITS * k) - 1).alias("key")
        types[k] = stored(types[k + 1].groupBy("lang", key).agg(F.count(F.lit(1)).alias("c")).select("lang", "key", "c"), "model-types")
    discounts = None
    for kind, rows in types.items():
        own = _discounts(rows).withColumn("kind", F.lit(kind))
        discounts = own if discounts is None else discounts.unionByName(own)
    discounts = stored(discounts, "model-discounts")
    broad = small(discounts, 48)
    n = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2)] + [F.count_if(F.col("c") > 2).alias("n3")]
    off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    given = sum((F.col(f"n{i}") * F.col(f"d{i}") for i in (2, 3)), F.col("n1") * F.col("d1"))
    nothing = F.lit(None).cast("float")
    out = None
    for kind, rows in types.items():
        of = broad.where(F.col("kind") == kind).drop("kind")
        left = F.greatest(F.col("c") - off, F.lit(0.0)).cast("float").alias("left")
        seen = rows.join(of, "lang").select("lang", F.lit(kind).alias("kind"), "key", left, nothing.alias("total"), nothing.alias("passed"))
        stems = rows.groupBy("lang", F.shiftright("key", CLASS_BITS).alias("key")).agg(F.sum("c").alias("total"), *n).join(of, "lang").select(
            "lang", F.lit(kind - 1).alias("kind"), "key", nothing.alias("left"),
            F.col("total").cast("float").alias("total"), (given / F.col("total")).cast("float").alias("passed"),
        )
        both = seen.unionByName(stems).withColumn("shift", F.when(F.col("kind") == kind, _shift(kind)).otherwise(_shift(kind - 1)))
        out = both if out is None else out.unionByName(both)
    shard = F.pmod(F.expr("shiftright(key, shift)"), F.lit(shards)).cast("long").alias("shard")

    def pack(table: pa.Table) -> pa.Table:
        row = [table[n][0].as_py() for n in ("lang", "kind", "shard")]
        for name, *more in (("left",), ("total", "passed")):
            own = table.filter(table[name].is_valid()).sort_by("key")
            row += [_steps(own["key"].to_numpy()), *[_zipped(own[n].to_numpy()) for n in (name, *more)]]
        kinds = [pa.string(), pa.int32(), pa.int64()] + [pa.binary()] * 5
        return pa.table({n: pa.array([v], t) for n, v, t in zip("lang kind shard keys left stems total passed".split(), row, kinds, strict=True)})

    known = out.select("lang", "kind", shard, "key", "left", "total", "passed").groupBy("lang", "kind", "shard").applyInArrow(pack, LETTERS_DDL)
    known = stored(known, "model-letters")
    dropped(discounts, *types.values())
    return known


def _words(learned: DataFrame, words: DataFrame) -> DataFrame:
    """The lists of pairs and words with the discounts of their kind, and what stands behind all words and is passed on."""
    n = [f"n{i}" for i in (1, 2, 3, 4)]
    lists = learned.where(F.col("kind") == PAIR).unionByName(words).select("lang", "kind", "shard", "keys", "words", "counts", "n", *n, "total")
    sums = lists.groupBy("lang", "kind").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", *n, "total")])
    given = F.col("n1") * F.col("d1") + F.col("n2") * F.col("d2") + (F.col("n") - F.col("n1") - F.col("n2")) * F.col("d3")
    of = sums.select(*_off("lang", "kind", "total", "n", "n1", "n2")).select(
        "lang", "kind", "d1", "d2", "d3", "total", (given / F.col("total")).alias("passed")
    )
    return lists.drop("n", *n, "total").join(small(of, 80), ["lang", "kind"])


def _found(keys: np.ndarray, own: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of sorted keys, 0 where there is no such key."""
    if not len(keys):
        return [np.zeros(len(own), "f4") for _ in values]
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    same = keys[at] == own
    return [np.where(same, v[at], 0).astype("f4") for v in values]


ANSWERS = {"slice": pa.int64(), "kind": pa.int32(), "shard": pa.int64(), "left": pa.binary(), "total": pa.binary(), "passed": pa.binary()}
ANSWERS_DDL = "slice long, kind int, shard long, left binary, total binary, passed binary"


def _spelled_answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    """What is left of the letters of lists, and what stands behind them and is passed on."""
    out: list[tuple] = []
    if asked.num_rows:
        keys = stems = np.zeros(0, "i8")
        left = total = passed = np.zeros(0, "f4")
        if known.num_rows:
            row = known.slice(0, 1).to_pylist()[0]
            keys, stems = _from_steps(row["keys"]), _from_steps(row["stems"])
            left, total, passed = (_unzipped(row[c], "f4") for c in ("left", "total", "passed"))
        for number, kind, shard, data in zip(*[asked[c].to_pylist() for c in ("slice", "kind", "shard", "keys")], strict=True):
            own = _from_steps(data)
            out.append((number, kind, shard, *map(_zipped, [*_found(keys, own, left), *_found(stems, own, total, passed)])))
    return pa.Table.from_batches([_batch(out, ANSWERS)])


def _word_answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Of pairs what is left; of words their probability, what stands behind them and is passed on to the next word."""

    def off(counts: np.ndarray, row: dict) -> np.ndarray:
        return np.choose(np.minimum(counts, 3) - 1, [row["d1"], row["d2"], row["d3"]])

    out: list[tuple] = []
    if asked.num_rows:
        rows = {r["kind"]: r for r in known.to_pylist()}
        joined = stems = words = np.zeros(0, "i8")
        left = total = passed = own_left = np.zeros(0)
        none, share = 0.0, 1.0
        if pair := rows.get(PAIR):
            before, c = _from_steps(pair["keys"]), _unzipped(pair["counts"], "i4")
            taken = off(c, pair)
            joined = _joined(before, _unzipped(pair["words"], "i8"))
            by = np.argsort(joined)
            joined, left = joined[by], np.maximum(c - taken, 0.0)[by]
            stems, first = np.unique(before, return_index=True)
            total = np.add.reduceat(c.astype("f8"), first)
            passed = np.add.reduceat(taken, first) / total
        if word := rows.get(WORD):
            words, c = _from_steps(word["keys"]), _unzipped(word["counts"], "i4")
            own_left = np.maximum(c - off(c, word), 0.0)
        for number, kind, shard, data in zip(*[asked[c].to_pylist() for c in ("slice", "kind", "shard", "keys")], strict=True):
            own = _from_steps(data)
            if kind == PAIR:
                out.append((number, kind, shard, _zipped(_found(joined, own, left)[0]), None, None))
            else:
                out.append((number, kind, shard, *map(_zipped, [*_found(words, own, own_left), *_found(stems, own, total, passed)])))
    return pa.Table.from_batches([_batch(out, ANSWERS)])


def _answered(asked: DataFrame, known: DataFrame, by: list[str], plan: DataFrame, answers) -> DataFrame:
    """The answers to lists, in the order of their keys.

    A shard that slices list often meets them in several tasks; ``plan`` has the
    number of these for each language.
    """
    asked = asked.join(plan, "lang").withColumn("part", F.pmod(F.xxhash64("slice"), "parts")).drop("parts")
    every = known.join(plan, "lang").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return asked.groupBy(*by, "part").cogroup(every.groupBy(*by, "part")).applyInArrow(answers, ANSWERS_DDL)


class _Values:
    """The answers that a slice got, by kind, in the order of its lists."""

    def __init__(self, known: pa.Table):
        self.rows: dict[int, list[tuple]] = {}
        for kind, *data in zip(*[known[n].to_pylist() for n in ("kind", "shard", "left", "total", "passed")], strict=True):
            self.rows.setdefault(kind, []).append(tuple(data))

    def of(self, kind: int, n: int) -> list[np.ndarray]:
        rows = sorted(self.rows.pop(kind), key=lambda r: r[0])
        out = [np.concatenate([_unzipped(r[i], "f4") for r in rows]).astype("f8") for i in (1, 2, 3) if rows[0][i] is not None]
        if any(len(v) != n for v in out):
            raise ValueError("a list of a slice has not been answered in full")
        return out


def _interpolated(left: np.ndarray, total, passed, lower: np.ndarray) -> np.ndarray:
    """What an n-gram has of its context's total, and what that passes on times the lower order's probability."""
    own = np.divide(left, total, out=np.zeros(len(left)), where=total > 0)
    return own + np.where(total > 0, passed, 1.0) * lower


def _letter_logarithms(texts: list[str], values: _Values, order: int, shards: int) -> Iterator[np.ndarray]:
    """Logarithms of probability of the characters of each text, from the lowest order up."""
    letters, tables = _Letters(texts, order), {}
    for kind, keys in _spelled(letters.keys, order):
        by = np.argsort(_numbers(kind, keys, shards))
        own = values.of(kind, len(keys))
        back = np.empty(len(by), "i8")
        back[by] = np.arange(len(by))
        tables[kind] = keys, [v[back] for v in own]
    lower, (_, total, passed) = tables[0]
    p = np.full(1, 1.0 / (1 << CLASS_BITS))
    for k in range(1, order + 1):
        keys, (left, *behind) = tables[k]
        stem = np.searchsorted(lower, keys >> CLASS_BITS)
        p = _interpolated(left, total[stem], passed[stem], p[np.searchsorted(lower, keys & ((1 << CLASS_BITS * (k - 1)) - 1))])
        lower, (total, passed) = keys, behind
    logs = np.log(p)
    for places, lengths in letters.places():
        yield from np.split(logs[places], np.cumsum(lengths)[:-1])


def _pair_logarithms(texts: list[str], values: _Values, shards: int, total: float, passed: float) -> Iterator[np.ndarray]:
    """Logarithms of probability of the words of each text."""
    before, word, lengths = _all_pairs(texts)
    first, at, _ = _firsts(_numbers(PAIR, _joined(before, word), shards, before))
    before, word = before[first], word[first]
    numbers = np.sort(_numbers(WORD, _distinct(word), shards))
    left, *behind = values.of(WORD, len(numbers))
    p = _interpolated(left, np.full(len(left), total), passed, np.full(len(left), UNSEEN))
    stem, end = (np.searchsorted(numbers, _numbers(WORD, w, shards)) for w in (before, word))
    logs = np.log(_interpolated(values.of(PAIR, len(first))[0], behind[0][stem], behind[1][stem], p[end]))[at]
    yield from np.split(logs, np.cumsum(lengths)[:-1])


def _spread(values: np.ndarray, block: int) -> float:
    """Variance of the mean times the length, by means of blocks, as neighbours depend on each other."""
    n = len(values) // block
    return float(block * values[: n * block].reshape(n, block).mean(1).var() if n > 1 else values.var())


def _scored(payloads: DataFrame, answers: DataFrame, words: DataFrame, order: int, shards: int) -> DataFrame:
    """(doc_id, key, lang, role, symbols, loss, spread, words, word_loss, word_spread) of the documents of slices.

    A spread is what the variance of a text's loss is, times its length.
    ``words`` has what stands behind all words of a language, and is passed on.
    """
    kinds = {
        "doc_id": pa.int64(), "key": pa.int64(), "lang": pa.string(), "role": pa.int32(),
        "symbols": pa.int64(), "loss": pa.float64(), "spread": pa.float64(),
        "words": pa.int64(), "word_loss": pa.float64(), "word_spread": pa.float64(),
    }

    def task(payload: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        values = _Values(known)
        for lang, total, passed, data in zip(*[payload[c] for c in ("lang", "total", "passed", "payload")], strict=True):
            docs = [r for b in _texts(data) for r in zip(*[b[n].to_pylist() for n in ("doc_id", "key", "role", "text")], strict=True)]
            texts = [r[3] for r in docs]
            letters = _letter_logarithms(texts, values, order, shards)
            worded = _pair_logarithms(texts, values, shards, total.as_py() or 0.0, passed.as_py() or 0.0)
            for (doc_id, key, role, _), spelled, w in zip(docs, letters, worded, strict=True):
                measures = [f for v, block in ((spelled, 64), (w, 16)) for f in (len(v), -float(v.mean()), _spread(v, block))]
                out.append((doc_id, key, lang.as_py(), role, *measures))
        return pa.Table.from_batches([_batch(out, kinds)])

    return (
        payloads.join(words, "lang", "left")
        .select(F.col("slice").alias("part"), "lang", "total", "passed", "payload")
        .groupBy("part")
        .cogroup(answers.groupBy("slice"))
        .applyInArrow(
            task,
            "doc_id long, key long, lang string, role int, symbols long, loss double, spread double, "
            "words long, word_loss double, word_spread double",
        )
    )


def _limited(scores: DataFrame, size: str, prefix: str, quantile: float) -> DataFrame:
    """The scores with (``prefix``)excess and its (``prefix``)limit.

    The variance of a text's loss is that between texts, which no length
    lowers, and that within a text by its length. The first is the mean square
    of the calibration texts' deviations, by their length; what these have of
    the second is not taken off, so that long texts are not held too strictly.
    """
    excess, limit, loss = f"{prefix}excess", f"{prefix}limit", f"{prefix}loss"
    learned = scores.where(F.col("role") == CALIBRATE)
    middle = learned.groupBy("lang").agg(
        F.percentile_approx(loss, 0.5, 10_000).alias("middle"),
        (F.sum(F.col(f"{prefix}spread") * F.col(size)) / F.sum(size)).alias("within"),
    )
    apart = F.sum((F.col(loss) - F.col("middle")) ** 2 * F.col(size)) / F.sum(size)
    between = F.greatest(apart, (BETWEEN * F.first("middle")) ** 2).alias("between")
    shape = learned.join(F.broadcast(middle), "lang").groupBy("lang").agg(
        F.first("middle").alias("middle"), F.first("within").alias("within"), between
    )
    judged = scores.join(F.broadcast(shape), "lang", "left").withColumn(
        excess,
        F.try_divide(F.col(loss) - F.col("middle"), F.sqrt(F.col("between") + F.col("within") / F.col(size))),
    ).drop("middle", "within", "between")
    unseen = judged.where(F.col("role") == CALIBRATE)
    pooled = unseen.agg(F.percentile_approx(excess, POOLED_QUANTILE, 10_000).alias("pooled"))
    limits = (
        unseen.groupBy("lang")
        .agg(F.percentile_approx(excess, quantile, 10_000).alias("own"))
        .join(F.broadcast(pooled))
        .select("lang", F.greatest("own", "pooled").alias(limit))
    )
    return judged.join(F.broadcast(limits), "lang", "left")


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    quantile: float = QUANTILE,
    order: int = ORDER,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(doc_id, key, lang, symbols, loss, excess, limit, words, word_loss, word_excess, word_limit, kept) of every row of ``docs``.

    ``trusted`` is a table of trusted ids (doc_id). ``loss`` is the mean
    negative log-probability of a character, the logarithm of the perplexity.
    The model counts four in five of the trusted texts and the fifth, which it
    hasn't seen, sets thresholds. ``excess`` is how far the loss lies above the
    language's median of these, over the deviation that texts of its length have: the
    variance between texts plus that within a text by its length. The same holds for words. A document is kept if both are at most their quantile
    or, where a language has few, that of all languages. Texts without a character are not kept. In a language without
    trusted text nothing can be judged and all other texts are kept. A null
    language is the empty one. ``key`` is the hash of the text: repeated rows
    and ids get one row each. An empty table gives no rows.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    role = F.when(F.col("_trusted").isNull(), OTHER).when(fold == 0, CALIBRATE).otherwise(LEARN)
    named = trusted.select(F.col("doc_id").cast("long").alias("_trusted")).where("_trusted is not null").distinct()
    rows = (
        docs.select(
            text_of(text).alias("text"),
            F.col(doc_id).cast("long").alias("doc_id"),
            F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        )
        .withColumn("key", F.xxhash64("text"))
        .join(small(stored(named, "model-trusted"), 16), F.col("doc_id") == F.col("_trusted"), "left")
        .select("text", "doc_id", "key", "lang", role.alias("role"))
    )
    sizes = rows.select(F.octet_length("text").alias("size"), F.spark_partition_id().alias("task"))
    size, tasks = sizes.agg(F.sum("size"), F.count_distinct("task")).first()
    size = size or 0
    shards = 2 * int((size / SHARD_BYTES) ** 0.5 / 2) + 1
    counts = _counts(rows.where(F.col("role") == LEARN), order, shards)
    learned, words = _learned(counts, tasks + size // SLICE_BYTES, order, shards)
    letters, worded = _letters(learned, order, shards), _words(learned, words)
    behind = stored(worded.where(F.col("kind") == WORD).select("lang", "total", "passed").distinct(), "model-behind")
    lots = min(LOTS, size // LOT_BYTES + 1)
    scores = None
    for lot in range(lots):
        own = rows.where(F.pmod(F.xxhash64("key", "doc_id"), F.lit(lots)) == lot)
        payloads = stored(_sliced(own), "model-slices")
        listed = F.count(F.lit(1)) * SLICE_BYTES / (4 * shards * LISTED)
        plan = stored(payloads.groupBy("lang").agg(F.least(F.count(F.lit(1)), F.ceil(listed)).cast("long").alias("parts")), "model-plan")
        met = small(plan, 24)
        answers = [
            stored(_answered(_asked(payloads, order, shards, True), letters, ["lang", "kind", "shard"], met, _spelled_answers), "model-answers"),
            stored(_answered(_asked(payloads, order, shards, False), worded, ["lang", "shard"], met, _word_answers), "model-answers"),
        ]
        found = stored(_scored(payloads, answers[0].unionByName(answers[1]), small(behind, 32), order, shards), "model-scores")
        dropped(payloads, plan, *answers)
        scores = found if scores is None else scores.unionByName(found)
    dropped(learned, words, letters, behind)
    judged = _limited(_limited(scores, "symbols", "", quantile), "words", "word_", quantile)
    fine = [F.coalesce(F.col(f"{p}excess") <= F.col(f"{p}limit"), F.lit(True)) for p in ("", "word_")]
    return judged.select(
        "doc_id", "key", "lang", "symbols", "loss", "excess", "limit", "words", "word_loss", "word_excess", "word_limit",
        ((F.col("symbols") > 1) & fine[0] & fine[1]).alias("kept"),
    )


def kept_rows(docs: DataFrame, verdicts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their own columns."""
    gone = verdicts.where("not kept").select(F.struct(F.col("doc_id").alias("id"), "key").alias("_gone")).distinct()
    gone = stored(gone, "model-rejected")
    # The rows go through as one column, for theirs may have any name.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row_id, row_text = F.col("row").getField(doc_id).cast("long"), F.coalesce(F.col("row").getField(text), F.lit(""))
    same = row_id.eqNullSafe(F.col("_gone.id")) & (F.xxhash64(row_text) == F.col("_gone.key"))
    return rows.join(small(gone, 24), same, "left_anti").select("row.*")
