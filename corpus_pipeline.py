"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``documents``; the last returns each document's ids and the digest of its decoded bytes.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import bpe, decontaminate, jaccard, pii, quality
from strandframe.llm.filters import with_text
from strandframe.session import few_files, small_batches, stored

#: No SQL expresses the stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the nearest-neighbour classifier rejects (score under 0.3)."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates keep the document of the smallest id; repeated rows of it once."""
    classes = jaccard.join(docs.select("doc_id", "text"))
    stays = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct()
    # by equality, so that the rows stay where they are for the removal of repeated ones; rows without an id apart
    known = docs.join(stays.where("doc_id is not null"), "doc_id", "left_semi").select(*docs.columns)
    nameless = docs.where("doc_id is null").join(F.broadcast(stays.where("doc_id is null").limit(1).select(F.lit(True).alias("stays"))), F.col("stays"), "left_semi")
    return known.dropDuplicates(["doc_id", "text"]).unionByName(nameless.dropDuplicates(["text"]))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within a fifth of its words."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data, remove terms that reveal it; every document stays."""
    terms = stored(pii.revealing(docs), "pii-terms")
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = pii.find(docs, terms, carry=rest)
    return with_text(found, F.col("clean"), "text", "n_chars").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and the digest of the bytes that they decode to."""
    import public_tokenizers as tokenizers

    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = bpe.encode(docs, ranks, tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("bytes", 256).alias("decoded_sha256"))


def _bounded(stage):
    """The stage over texts in batches of bounded bytes; what it gives as few files when it is written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return few_files(stage(spark, docs, sf_dir))

    return run


STAGES = [
    ("quality", _bounded(quality_stage)),
    ("near_duplicates", _bounded(near_duplicate_stage)),
    ("decontaminate", _bounded(decontaminate_stage)),
    ("pii", _bounded(pii_stage)),
    ("bpe", _bounded(bpe_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
