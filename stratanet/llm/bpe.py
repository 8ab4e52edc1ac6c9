"""Byte-level BPE by prefix dynamic programming, and decoding.

For every prefix of a piece there is one token that the encoding of just this
prefix ends with. It is the only token that ends there and that goes with the
last token of the prefix before it: two tokens go together if the encoding of
their joined bytes is these two. A table of last tokens, one per byte, thus is
the encoding of all prefixes at once; appending bytes extends it, and after an
edit only the entries near it change.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratanet.llm.common import flat_lists, slices, text_of

#: What a worker remembers at most; the rest is computed each time. No result depends on it.
REMEMBERED_CUTS = 400_000
REMEMBERED_PIECES = 200_000
REMEMBERED_PAIRS = 500_000
#: Rows that are decoded at once.
DECODED_ROWS = 256


def by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Vocabulary:
    """Ranks of tokens, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = by_rank(ranks)
        #: Every ending of a token: its id if it is a token itself, else -1.
        self.endings: dict[bytes, int] = {}
        for token in ranks:
            for start in range(len(token)):
                ending = token[start:]
                if ending not in self.endings:
                    self.endings[ending] = ranks.get(ending, -1)
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The plain merge loop, for strings of at most two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` goes with the token before it; -1 is the beginning."""
        key = before << 24 | token
        known = self.pairs.get(key)
        if known is None:
            head = [before] if before >= 0 else []
            joined = b"".join(self.tokens[t] for t in [*head, token])
            known = self.merged(joined) == [*head, token]
            if len(self.pairs) < REMEMBERED_PAIRS:
                self.pairs[key] = known
        return known


class PrefixTable:
    """Last tokens of every prefix of ``data``; follows appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        data = self.data = self.data + more
        last, endings, pairs = self.last, self.vocabulary.endings.get, self.vocabulary.pairs
        for end in range(begin + 1, len(data) + 1):
            start = end - 1
            while (token := endings(data[start:end])) is not None:
                if token >= 0:
                    before = last[start]
                    if (known := pairs.get(before << 24 | token)) is None:
                        known = self.vocabulary.follows(before, token)
                    if known:
                        last.append(token)
                        break
                start -= 1
                if start < 0:
                    token = None
                    break
            if token is None:
                raise ValueError(f"no token of the vocabulary ends at byte {end}")

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` for ``data[start:end]``; returns how many entries were computed.

        Entries up to the edit stay. Behind it, the old ones hold again from
        where as many in a row have come out as before as a token has bytes.
        """
        tail, old = self.data[end:], self.last[end + 1 :]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new)
        longest = max(map(len, self.vocabulary.tokens), default=1)
        same = 0
        for done, was in enumerate(old):
            if same >= longest:
                self.data += tail[done:]
                self.last += old[done:]
                return len(new) + done
            self.append(tail[done : done + 1])
            same = same + 1 if self.last[-1] == was else 0
        return len(new) + len(old)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        at, found = len(self.data) if end is None else end, []
        while at > 0:
            found.append(self.last[at])
            at -= len(self.vocabulary.tokens[found[-1]])
        return found[::-1]


#: Two white-space characters in a row: beside them a space may belong to a piece that began before.
WIDE = re.compile(r"\s\s")


class CutEncoder:
    """Encodes texts, cut at spaces where no piece can cross one, and remembers the cuts.

    A piece may begin with a space but never has one inside, unless white space
    stands beside it. Texts with such places are encoded whole.
    """

    def __init__(self, whole: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED_CUTS):
        self.whole, self.remembered = whole, remembered
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if WIDE.search(text):
            return self.whole([text])[0]
        first, *cuts = text.split(" ")
        known = self.known
        head = self.whole([first])[0]
        try:
            return head + b"".join(map(known.__getitem__, cuts))
        except KeyError:
            missing = [c for c in set(cuts) if c not in known]
        new = dict(zip(missing, self.whole([" " + c for c in missing]), strict=True))
        if len(known) + len(new) <= self.remembered:
            known.update(new)
            return head + b"".join(map(known.__getitem__, cuts))
        return head + b"".join([known[c] if c in known else new[c] for c in cuts])


class PieceEncoder:
    """Encodes each match of ``pattern`` by itself; a piece that is a token is that token."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else PrefixTable(self.vocabulary, data).ids()
        return b"".join(map(self.vocabulary.packed.__getitem__, ids))

    def encode(self, text: str) -> bytes:
        coded, known = [], self.known
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(known) < REMEMBERED_PIECES:
                    known[p] = ids
            coded.append(ids)
        return b"".join(coded)


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(maxsize=2)
def _encoder(name: str, pattern: str, remembered: int) -> CutEncoder:
    with open(SparkFiles.get(name), "rb") as ranks:
        pieces = PieceEncoder(Vocabulary(load_ranks(ranks.read())), pattern)
    return CutEncoder(lambda texts: [pieces.encode(t) for t in texts], remembered)


def shipped(spark, path: str) -> str:
    """Sends the vocabulary file, about a megabyte, to every executor; its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    remembered: int = REMEMBERED_CUTS,
) -> DataFrame:
    """(doc_id, ids array<int>) of every row, ids as of ``pattern``'s matches encoded one by one.

    A null text is the empty text and has no ids. Rows stay apart, repeated
    ones too; null ids stay null; an empty table gives no rows. Other columns
    are not read. A worker remembers ``remembered`` cuts, some 200 bytes each.
    """
    name = shipped(docs.sparkSession, ranks_path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, pattern, remembered)
        for batch in slices(batches):
            coded = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            ids = pa.array(np.frombuffer(b"".join(coded), "<u4").astype("int32"))
            lists = flat_lists(ids, [len(c) // 4 for c in coded])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(task, "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, bytes) of a table (doc_id, ids); null ids are no ids."""
    name = shipped(coded.sparkSession, ranks_path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(name)
        for batch in batches:
            for begin in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(begin, DECODED_ROWS)
                lists = part.column(1)
                data = [b"".join(map(tokens.__getitem__, ids.tolist())) for ids in _rows(lists)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(data, pa.binary())], ["doc_id", "ids", "bytes"])

    return coded.select("doc_id", F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids")).mapInArrow(
        task, "doc_id long, ids array<int>, bytes binary"
    )


@lru_cache(maxsize=2)
def _tokens(name: str) -> list[bytes]:
    with open(SparkFiles.get(name), "rb") as ranks:
        return by_rank(load_ranks(ranks.read()))


def _rows(lists: pa.ListArray) -> Iterator[np.ndarray]:
    values = lists.values.to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield values[a:b]
