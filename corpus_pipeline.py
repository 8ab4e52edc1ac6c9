"""From raw documents to token ids: five stages over the documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratanet.llm import bpe, jaccard_join, mixing, personal_data, quality_model
from stratanet.llm.common import small, stored, table, text_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose perplexity under the model of trusted text is too high."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_model.kept_rows(docs, quality_model.classify(docs, trusted))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each component of linked texts; of equal ids and texts, one row.

    Shingles have five words and link at 80 per cent. Null and empty texts
    link with nothing. Rows that share an id but not the text are documents of
    their own, so that no text is lost; of these the first by hash goes by the
    id. Rows without an id are kept as they are; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64(text_of("text")).alias("hash"))
    texts = rows.where("id is not null").groupBy("id").agg(F.min("hash").alias("first"), F.max("hash").alias("last"))
    several = stored(texts.where("first != last").select("id", "first"), "pipeline-several")
    rows = rows.join(small(several, 16), "id", "left")
    # Ids of other texts lie above all that are likely to be given, so that they name no component of others.
    other = F.shiftright(F.xxhash64("id", "hash"), 2).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 61)
    rows = rows.withColumn("unit", F.when(F.col("first").isNull() | (F.col("first") == F.col("hash")), F.col("id")).otherwise(other))
    rows = rows.select("row", "unit")
    found = jaccard_join.jaccard_components(rows.select(F.col("unit").alias("doc_id"), F.col("row.text").alias("text")), shingle=5, percent=80)
    found = stored(found, "pipeline-components")
    gone = stored(found.where("doc_id != component_id").select(F.col("doc_id").alias("unit")).distinct(), "pipeline-copies")
    left = rows.join(small(gone, 16), "unit", "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = stored(again.select(F.col("doc_id").alias("unit")), "pipeline-repeated")
    if not again.take(1):
        return left.select("row.*")
    repeated = left.join(small(again, 16), "unit", "left_semi").groupBy("unit").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    once = left.join(small(again, 16), "unit", "left_anti")
    return once.select("row.*").unionByName(repeated.select("row.*"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of personal data in its place; the length follows."""
    clean = personal_data.redacted(docs, personal_data.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # The executors' heaps have grown by now; the workers make do with less.
    coded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, remembered=120_000), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("text_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal),
    ("mixing sources", mixed),
    ("byte-level BPE", tokens),
]
#: The stages draw on hashes, learned models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
