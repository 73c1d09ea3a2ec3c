"""From raw documents to tokens in five stages; each writes Parquet, which the next one reads.

Every stage but the last keeps the columns of ``documents``. What it decides takes effect: texts that fail
the quality rules go, of near duplicates the smallest id stays, passages that an earlier document has are
cut out of the later ones, documents that hold a benchmark item go, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import bpe, decontaminate, near_dedup, quality, suffix_dedup
from knotwork.llm.common import keep, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the quality rules go, null and empty ones with them; repeated rows are judged alike.

    Null ids and further columns of any name come through.
    """
    small_batches(spark)
    return quality.keep_good(docs)


#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates on five-word shingles the smallest id stays.

    Texts that are null, empty or without words and rows without an id are linked with nothing and stay; of rows that
    share an id all stay or none.
    """
    small_batches(spark)
    gone = near_dedup.near_duplicates(docs, words=SHINGLE).filter("not kept").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out; ``n_chars`` follows the text.

    Null texts become empty; rows with one id don't cut one another; rows without an id stay whole. Further columns,
    also ones named like results of the operator, come through as they are.
    """
    small_batches(spark)
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffix_dedup.remove_repeats(docs, carry=carry, texts=True)
    kept = cut.columns[-1]
    cut = cut.withColumns({"text": F.col(kept), "n_chars": F.char_length(kept).cast("long")})
    return cut.select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts and rows without an id stay."""
    small_batches(spark)
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id")
    return docs.join(found.distinct(), "doc_id", "left_anti").select(docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns doc_id, ids (the tokens) and n_tokens."""
    import public_tokenizers

    small_batches(spark)
    tokens = bpe.encode(docs, bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    return tokens.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: Windows of bytes, latent search and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
