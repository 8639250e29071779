"""The queries of the llm operators, each over its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ann, bpe, html_text, jaccard, langid, licenses, mixing, quality, rollup, substrings
from .scratch import new_path, written

#: The tokenizer's vocabulary; a parameter of the deployment.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary lies on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selected(table(spark, sf_dir, "documents")).drop("th")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents enter with an estimate from n_chars, get exact counts, and exact copies leave; batches are sent twice."""
    docs = table(spark, sf_dir, "documents")
    counted = written(docs.select("doc_id", "source", "lang", F.expr("n_chars div 6").alias("guess"), rollup.word_count(F.col("text")).alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("hash")), "token-counts")
    one = F.lit(1)
    loaded = rollup.change(counted, "words-1", (0, 0), (one, F.col("guess")))
    revised = rollup.change(counted, "words-1", (one, F.col("guess")), (one, F.col("n")))
    # copies of a text by group, less the first of all of them
    alike = counted.groupBy("hash", "source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.max("n").alias("each"), F.min("doc_id").alias("first"))
    first = F.min(F.struct(F.col("first").isNull(), "first", "source", "lang")).over(Window.partitionBy("hash"))
    here = (F.struct(F.col("first").isNull(), "first", "source", "lang").eqNullSafe(first)).cast("long")
    gone = rollup.change(alike, "words-1", (F.col("docs"), F.col("tokens")), (here, here * F.col("each")))
    state = rollup.TokenRollup(spark, new_path(spark, "rollup"))
    for batch_id, changes in (("load", loaded), ("revise", revised), ("load", loaded), ("copies", gone), ("copies", gone)):
        state.commit(batch_id, changes)
    return state.totals()


SQL_OP7 = r"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id NULLS LAST, source, lang) AS rn
  FROM documents
)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
FROM d WHERE rn = 1 GROUP BY source, lang
"""


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.neighbours(rows, rows.where("vec_id % 100 = 0"), 10)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learned(docs.where(langid.fold() != 1))
    out = langid.predicted(docs, model)
    return out.select("doc_id", (langid.fold() == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard": op1_jaccard,
        "op2_licenses": op2_licenses,
        "op3_neighbours": op3_neighbours,
        "op4_substrings": op4_substrings,
        "op5_quality_rules": op5_quality_rules,
        "op6_mixing": op6_mixing,
        "op7_token_counts": op7_token_counts,
        "op8_langid": op8_langid,
        "op9_bpe": op9_bpe,
        "op10_html_text": op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.sql(), "op6_mixing": mixing.sql(), "op7_token_counts": SQL_OP7}
