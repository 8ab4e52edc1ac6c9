"""The operators as registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratanet.llm import bpe, checks, jaccard_join, language_id, link_trust, media, mixing, personal_data, quality_model, quality_rules, ranked_search, spelling, substring_dedup, token_files
from stratanet.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    units = mixing.mix(table(spark, sf_dir, "documents"))
    return units.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("_row"),
    ).drop("_row")


@query
def op1_bpe(spark, sf_dir, ranks: str = "byte_bpe_multi_50k.tiktoken"):
    """Digests of the ids of every document and of what they decode to."""
    path = public_tokenizers.path(ranks)
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op4_quality_rules(spark, sf_dir):
    """Measures and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("m.words.n").alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.lines.dup").alias("n_dup_lines"),
        F.col("m.words.repeat").alias("n_repeat_words"),
        "base_failed",
        "kept",
    )


@query
def op6_token_files(spark, sf_dir, tokenizer: str = "byte_bpe_50k.json"):
    """Place, length and checksum of every document in the token files."""
    path = public_tokenizers.path(tokenizer)
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents"), path))


@query
def op3_media(spark, sf_dir):
    """Digests of every document's image and of what is read back from it."""
    return media.described(media.stored_media(table(spark, sf_dir, "documents")))


@query
def op5_language_id(spark, sf_dir):
    """Predicted language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op8_jaccard_join(spark, sf_dir):
    """Set size and component of every document."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def trusted_ids(spark, sf_dir):
    """Documents that are labelled as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query
def op2_quality_model(spark, sf_dir):
    """Perplexity and verdict of every document."""
    found = quality_model.classify(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return found.select("doc_id", "lang", "symbols", F.exp("loss").alias("perplexity"), "excess", "limit", "kept")


@query
def op7_personal_data(spark, sf_dir):
    """Counts and places of personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    found = personal_data.find(docs, personal_data.train(docs))

    def joined(spans):
        places = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string")))
        return F.array_join(places, ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in personal_data.BASE_KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op9_substring_dedup(spark, sf_dir):
    """Every document without its repeated passages."""
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "text",
        "n_sentences",
        F.size("removed").cast("long").alias("n_removed"),
        F.coalesce(F.aggregate("removed", F.lit(0), lambda a, s: a + s["end"] - s["begin"]), F.lit(0)).cast("long").alias("removed_chars"),
    )


@query
def op13_spelling_variants(spark, sf_dir):
    """Frequent words of all documents with the forms they are variants of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


#: Fixed value of the contract: rules of hosts and paths.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query
def op11_link_trust(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    return link_trust.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


ORACLE_SQL["op11_link_trust"] = checks.trust_sql(URL_RULES, link_trust.ROUNDS)


@query
def op12_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op12_ranked_search"] = checks.SEARCH_SQL
ORACLE_SQL["op13_spelling_variants"] = checks.SPELLING_SQL

WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: The order of rules changes no verdict, so that SQL may have them in any.
ORACLE_SQL["op4_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {WORDS_SQL.format('t')} AS ws FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY 1),
m AS (SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR 100 * len(regexp_extract_all(t, '\p{{Lu}}')) > 40 * word_chars
    OR 5 * (length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) > n_words) AS kept
FROM b"""

ORACLE_SQL["op8_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL.format(
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 3) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
co AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM co JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
bi AS (SELECT a AS u, b AS v FROM ln UNION ALL SELECT b, a FROM ln),
re AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT re.u, bi.v FROM re JOIN bi ON re.v = bi.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sz USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM re GROUP BY 1) USING (doc_id)"""
