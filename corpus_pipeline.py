"""The corpus pipeline: documents without toxic ones, near copies, repeated passages and benchmark items, as tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontam, jaccard, substr, toxicity
from marlstone.llm.base import checkpointed, free, split_of, table

TOKENIZER = "word_bpe_49k.json"


def _own_names(stage: Callable[[DataFrame], DataFrame], docs: DataFrame, used: Sequence[str]) -> DataFrame:
    """The stage's rows of docs with the columns of docs; those that have a name which the stage uses itself are called otherwise meanwhile."""
    other = {}
    for c in docs.columns:
        if c.lower() in used:
            other[c] = free(docs, f"{c}_of_documents")
    out = stage(docs.withColumnsRenamed(other))
    return out.select(*(F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject; labels of one third of the ids are never learned from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), split_of(F.col("doc_id"), 3) != 1)
    return _own_names(lambda own: toxicity.score(own, model, keep_text=True).where("predicted = 0"), docs, ("score", "predicted"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8 or more) the document with the smallest id."""
    return jaccard.representatives(docs, n=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 20 words that start earlier too; n_chars is that of what is left."""
    return _own_names(lambda own: substr.dedup(own).withColumn("n_chars", F.length("text").cast("long")), docs, ("n_words", "n_removed"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids."""
    return bpe.tokenize(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER)).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [("toxicity", toxic), ("jaccard join", near_copies), ("substring dedup", passages), ("benchmark decontamination", benchmark), ("bpe", tokens)]

#: SQL can express neither the toxicity models nor the retrieval; see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
