"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

1. quality rules: documents that the rules or the isolation forest reject go.
2. n-gram Jaccard join: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with
   the smallest id stays.
3. substring dedup: windows of 50 words that a document with a smaller id has too are cut; documents of which nothing
   is left go.
4. mixing: documents are selected by token budgets of domains, languages and sources.
5. BPE: the documents' token ids, and the round trip's digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm import bpe, jaccard, mixing, quality, substrings
from keytide.llm.queries import table, tokenizer_path
from keytide.llm.routing import without
from keytide.llm.scratch import written

#: The corpus is taken at most once: repeating what dedup has removed would undo it.
MIXTURE = mixing.Mixture(budget=(4, 5), epochs=1)


def passes_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component; documents without an id or words stay."""
    found = written(jaccard.joined(docs, k=5, num=4, den=5), "groups")
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return without(docs, gone, ["doc_id"])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows that smaller ids have; n_chars is that of the text that is left."""
    out = substrings.deduplicated(docs, whole_rows=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIXTURE)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encoded(docs, tokenizer_path()))


STAGES = [
    ("quality rules", passes_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("mixing to target weights", to_weights),
    ("BPE encoding", to_tokens),
]

#: SQL cannot state the forest, the components or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
