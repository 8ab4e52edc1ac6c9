"""Media columns: texts as lossless WebP images, read back and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratanet.llm import webp
from stratanet.llm.common import slices, text_of

#: Fixed value of the contract: payloads are filled up to a positive multiple of this.
ROW = 64


def payload(text: str) -> bytes:
    data = text.encode()
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a 64-bit hash of which columns are brighter than the mean."""
    picture = samples.reshape(-1, ROW)
    bright = picture.mean(0) > samples.mean()
    return f"{samples.mean():.3f};{samples.std():.3f};{int.from_bytes(np.packbits(bright).tobytes(), 'big'):016x}"


def stored_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row: the text's bytes as an image of 64 columns.

    A null or empty text gives one row of zeros. Texts of over a megabyte take
    several images behind each other. Equal texts give equal media; repeated
    rows stay; an empty table gives no rows; other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            media = [webp.store(payload(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_bytes long, media binary")


def described(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    Everything but the first two comes from the stored bytes, decoded.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            columns = [[], [], [], [], [], []]
            for stored in batch.column(2).to_pylist():
                back = webp.load(stored)
                row = (
                    len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]),
                    len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(back, "u1")),
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(
        task,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
        " media_bytes long, media_sha256 string, feature string",
    )
