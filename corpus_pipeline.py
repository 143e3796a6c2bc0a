"""From raw documents to token ids: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurewatch.llm import bpe, mixing, queries, shingles, substrings, toxicity
from lurewatch.llm.common import small_batches, stored, table
from lurewatch.llm.labelled import fold

#: A document with this toxicity score or more goes.
TOXIC = 0.5
#: Rows of an Arrow batch, each with its whole text, in all stages.
BATCH = 1000
#: No stage after the first can be expressed in SQL; the operators are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for toxic go; all others stay as they are."""
    small_batches(spark, BATCH)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.filter(F.col("score") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Near duplicates have SimHash fingerprints of five-word shingles within two bits, or sets of these
    shingles with a Jaccard similarity of 0.8 or more.
    """
    small_batches(spark, BATCH)
    return shingles.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document with a smaller id has are cut out; ``n_chars`` follows."""
    small_batches(spark, BATCH)
    left = substrings.deduplicate(docs, 13, verbatim=True, block=shingles.BLOCK, bucket=shingles.BUCKET)
    return left.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 rows each."""
    return mixing.taken(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every row of the mix."""
    small_batches(spark, BATCH)
    vocabulary = queries.vocabulary()
    back = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    return back.select("doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("substrings", cut_repeats),
          ("mixing", mix), ("tokens", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "corpus-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
