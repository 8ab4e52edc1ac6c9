"""Token-id files: one array of ids, with document boundaries in Elias-Fano form.

The ids of many documents lie behind each other in one file. Where documents
end is a rising sequence; its low bits are stored as they are and its high bits
as gaps in unary, which takes about two bits and the low ones for each
document. The place of every 64th one in the unary part lets a reader find the
boundary of any document without reading the ones before it.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratanet.llm.bpe import REMEMBERED_CUTS, WIDE, shipped
from stratanet.llm.common import slices, stored, text_of

MAGIC = b"EFID"
HEADER = struct.Struct("<4sBBxxQQQ")
#: Fixed value of the contract: the id behind every document.
END = 2
#: Text that one task sorts and writes, and ids of a file, about.
PART_BYTES = 8 << 20
FILE_IDS = 4 << 20
#: Text that is encoded at once: the more, the fewer distinct cuts for each of it.
ENCODED_BYTES = 4 << 20
SELECT_EVERY = 64


class EliasFano:
    """A rising sequence of integers of which any element can be read alone."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))
        self.samples = ones[::SELECT_EVERY]

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, "<u8")
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype="<u8")
        bits = (values[:, None] >> shifts) & np.uint64(1)
        low = np.packbits(bits.astype("u1").ravel(), bitorder="little")
        upper = np.zeros((top >> low_bits) + n + 1, "u1")
        upper[(values >> np.uint64(low_bits)).astype("i8") + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(upper, bitorder="little"))

    def _low(self, i: int) -> int:
        begin = i * self.low_bits
        piece = self.low[begin // 8 : (begin + self.low_bits + 7) // 8].tobytes()
        return int.from_bytes(piece, "little") >> begin % 8 & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Element ``i``, from the sample before it and the bits from there on."""
        at, seen = int(self.samples[i // SELECT_EVERY]), i // SELECT_EVERY * SELECT_EVERY
        byte = at // 8
        word = int(self.high[byte]) >> at % 8 << at % 8
        while seen + word.bit_count() <= i:
            seen += word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(i - seen):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return place - i << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = (bits.astype("u8") << np.arange(self.low_bits, dtype="u8")).sum(1, dtype="u8")
        return (ones - np.arange(self.n)).astype("u8") << np.uint64(self.low_bits) | low

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        head = struct.Struct("<QBQQ")
        n, low_bits, a, b = head.unpack_from(data)
        low = np.frombuffer(data, "u1", a, head.size)
        high = np.frombuffer(data, "u1", b, head.size + a)
        return cls(n, low_bits, low, high), head.size + a + b


def pack_file(doc_ids: list[int | None], coded: list[bytes]) -> bytes:
    """A file of documents whose ids are given as little-endian 32-bit integers."""
    ids = np.frombuffer(b"".join(coded), "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ends = np.cumsum(np.array([len(c) // 4 for c in coded], "u8"), dtype="u8")
    bounds = EliasFano.of(ends).to_bytes()
    known = np.array([d is not None for d in doc_ids], "?")
    names = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [bounds, np.packbits(known).tobytes(), names.tobytes(), ids.astype(f"<u{width}").tobytes()]
    return HEADER.pack(MAGIC, 1, width, len(doc_ids), len(ids), len(bounds)) + b"".join(parts)


class TokenFile:
    """Reads a file; documents are found by their number."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, version, width, self.n_docs, self.n_ids, n_bounds = HEADER.unpack_from(view)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        at = HEADER.size
        self.bounds, used = EliasFano.from_bytes(view[at : at + n_bounds])
        at += n_bounds
        flags = (self.n_docs + 7) // 8
        self.known = np.unpackbits(np.frombuffer(view, "u1", flags, at), count=self.n_docs).astype(bool)
        at += flags
        self.doc_ids = np.frombuffer(view, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        begin = self.bounds.select(i - 1) if i else 0
        return self.ids[begin : self.bounds.select(i)]


class BatchEncoder:
    """Encodes texts at once, cut at spaces as by ``bpe.CutEncoder``.

    Each distinct cut of them is looked up once, and those that are not known
    are encoded as one text, for a piece has a space only where it begins.
    ``opens`` tells of each id whether its token begins with a space.
    """

    def __init__(self, whole: Callable[[list[str]], list[bytes]], opens: np.ndarray, remembered: int = REMEMBERED_CUTS):
        self.whole, self.opens, self.remembered = whole, opens, remembered
        # Only the last cut of a text may be empty.
        self.known: dict[str, bytes] = {"": whole([" "])[0]}

    def _fresh(self, cuts: list[str]) -> list[bytes]:
        coded = self.whole([" " + " ".join(cuts)])[0]
        starts = np.flatnonzero(self.opens[np.frombuffer(coded, "<u4")])
        if len(starts) != len(cuts) or any(c[-1].isspace() for c in cuts):
            return self.whole([" " + c for c in cuts])
        ends = (4 * starts).tolist()
        return [coded[a:b] for a, b in zip(ends, [*ends[1:], len(coded)], strict=True)]

    def _cuts(self, cuts: list[str]) -> list[bytes]:
        """Ids of a space and the cut behind it, for distinct cuts."""
        found = list(map(self.known.get, cuts))
        gaps: tuple[list[int], list[int]] = [], []
        for i, ids in enumerate(found):
            if ids is None:
                # White space at the end of a text is kept from what would follow it.
                gaps[cuts[i][-1].isspace()].append(i)
        for own in filter(None, gaps):
            missing = [cuts[i] for i in own]
            new = self._fresh(missing)
            if len(self.known) + len(new) <= self.remembered:
                self.known.update(zip(missing, new, strict=True))
            for i, ids in zip(own, new, strict=True):
                found[i] = ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian 32-bit integers."""
        wide = [WIDE.search(t) is not None for t in texts]
        narrow = pc.split_pattern(pa.array([t for t, w in zip(texts, wide, strict=True) if not w], pa.string()), " ")
        offsets = narrow.offsets.to_numpy()
        begins = offsets[:-1]
        flat = narrow.values.dictionary_encode()
        heads = narrow.values.take(pa.array(begins)).dictionary_encode()
        coded = self._cuts(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
        code = flat.indices.to_numpy().astype("i8")
        code[begins] = heads.indices.to_numpy() + len(coded)
        coded += self.whole(heads.dictionary.to_pylist())
        sizes = np.array([len(c) // 4 for c in coded], "i8")
        places, lengths = (np.cumsum(sizes) - sizes)[code], sizes[code]
        ends = np.cumsum(lengths)
        at = np.repeat(places - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        ids = np.frombuffer(b"".join(coded), "<u4")[at].tobytes()
        bounds = (4 * np.append(0, ends)[offsets]).tolist()
        parts = (ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))
        return [self.whole([t])[0] if w else next(parts) for t, w in zip(texts, wide, strict=True)]


@lru_cache(maxsize=2)
def _library(name: str) -> BatchEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(SparkFiles.get(name))
    tokenizer.encode_special_tokens = True

    def whole(texts: list[str]) -> list[bytes]:
        coded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    known = tokenizer.get_vocab()
    opens = np.zeros(max(known.values(), default=-1) + 1, bool)
    # Byte-level vocabularies write a space as this letter.
    opens[[i for token, i in known.items() if token.startswith("\u0120")]] = True
    return BatchEncoder(whole, opens)


def write_files(
    docs: DataFrame, tokenizer_path: str, end: int = END, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(part, number, n_ids, file) of files with all documents by ascending doc_id.

    Rows without an id come first, repeated ids lie beside each other in the
    order of their texts. A null text is empty and has the end id alone. Rows
    are dealt by ranges of ids and streamed into files of a bounded size, so
    that no task holds a range as a whole. An empty table gives no files.
    """
    name = shipped(docs.sparkSession, tokenizer_path)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    last = np.array([end], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, number = _library(name), TaskContext.get().partitionId(), 0
        names, coded, held = [], [], 0

        def packed() -> pa.RecordBatch:
            columns = [[part], [number], [held], [pack_file(names, coded)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "number", "n_ids", "file"]
            )

        for batch in slices(batches, size=ENCODED_BYTES):
            for d, found in zip(batch.column(0).to_pylist(), library.encode(batch.column(1).to_pylist()), strict=True):
                ids = found + last
                names.append(d)
                coded.append(ids)
                held += len(ids) // 4
                if held >= FILE_IDS:
                    yield packed()
                    names, coded, held, number = [], [], 0, number + 1
        if names:
            yield packed()

    dealt = rows.repartitionByRange(max(1, -(-size // PART_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(task, "part int, number int, n_ids long, file binary"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files.

    What comes before a file is summed over the files, of which each holds
    millions of ids, by one window; the sums, 16 bytes for each 8 MB of text,
    are sent to the files, which stay where they are.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "number", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, begin in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held = TokenFile(data.as_py())
                ends = held.bounds.all().astype("i8")
                first = np.concatenate([[0], ends[:-1]]).astype("i8")
                sums = [zlib.crc32(held.ids[a:b].astype("<u4").tobytes()) for a, b in zip(first, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.doc_ids, mask=~held.known), pa.array(first + begin), pa.array(ends - first), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.join(F.broadcast(starts), ["part", "number"]).select("file", "before").mapInArrow(
        task, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
