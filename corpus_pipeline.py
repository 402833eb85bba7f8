"""Corpus pipeline: language ID, near-duplicate removal, span dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes
each result as Parquet in the shared folder and the next stage reads that.  Rows
keep the columns of ``documents``; the last stage returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm import byte_bpe, language_id, mixing, ngram_join, shared, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document that reads like some mixture of the learned languages.

    Rejected are texts without a letter and texts that a uniform letter model
    explains better than any language set; a missing lang is filled in.  If no
    document has a lang, nothing can be learned: every text with a letter stays.
    """
    model = language_id.learn(docs)
    if not model[0]:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    judged = language_id.predict(docs.select(*COLUMNS), model)
    kept = judged.where("lang_pred <> 'und' and fit > 0")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of every group linked by 5-word shingles at 0.8, the text with the smallest doc_id.

    A row without doc_id stays only where no member of its group has one; texts
    without words link with nothing and stay; of rows equal in doc_id and text one
    stays, that with the smallest lang, source and n_chars.
    """
    kept = ngram_join.one_of_each(docs, words=5, percent=80, tag="near").select(F.struct("doc_id", "key").alias("row"))
    # As a struct, doc_id is compared null-safe, and the window below needs no further exchange.
    rows = docs.select(*COLUMNS, F.struct(F.col("doc_id").cast("long").alias("doc_id"), ngram_join.text_key().alias("key")).alias("row"))
    first = Window.partitionBy("row").orderBy("lang", "source", "n_chars")
    return rows.join(kept, "row", "left_semi").withColumn("copy", F.row_number().over(first)).where("copy = 1").select(*COLUMNS)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated sentence spans out of the texts; every document stays, n_chars follows the text (as it was, where the text is null)."""
    out = substring_dedup.dedup_spans(docs.select(*COLUMNS), tag="spans")
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice; null and wordless texts not at all."""
    mixed = mixing.mix(docs.select(*COLUMNS), tag="mix", keep=COLUMNS)
    return mixed.withColumn("time", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int")))).where("time > 0").select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source with n_tokens and token ids of every row; a null or empty text has no ids."""
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, ["doc_id", "source"], byte_bpe.checked_ids, "n_tokens long, ids array<int>")
    return out


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("span_dedup", drop_repeated_spans),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]

#: Learning, similarity components and BPE are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from a table that lives as long as a DataFrame reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
