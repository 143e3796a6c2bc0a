"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (ann, bpe, chat, html_main, jaccard, mixing, quality, simhash, spelling, substrings, topk, toxicity,
               whitening)
from .common import table
from .labelled import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


@query("op1_maxscore_top_k")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


ORACLE["op1_maxscore_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op2_projected_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op3_compression_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~left_out)
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(left_out, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.deduplicate(table(spark, sf_dir, "documents"), 13, carry=["doc_id"])
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_quality_discriminant")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left_out = fold(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~left_out)
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(left_out, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary()
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), words), words)
    return back.select("doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_mix_to_weights")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "copies")


@query("op8_simhash_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html_main.extract(table(spark, sf_dir, "pages"), html_main.fit(), ["page_id", "url"])
    return made.withColumn("n_chars", F.length("text").cast("long"))


@query("op10_chat_format")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.to_json(F.struct(
        F.lit(-7).alias("conv_id"), F.array(*[
            F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")
        ]).alias("messages"))).alias("json"))
    records = chat.turn_records(table(spark, sf_dir, "conversations")).unionByName(chat.json_records(own))
    back = chat.read_back(chat.formatted(chat.canonical_turns(records)))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.concat_ws("", "loss_texts")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", told).cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


# A control string costs one more character; 27 frame a turn.
ORACLE["op10_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(regexp_replace(text,
    '([<\[])(\\*)(\|[a-z_]+\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"))


@query("op12_ngram_jaccard_join")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.named(jaccard.near_duplicates(table(spark, sf_dir, "documents")))


@query("op13_whitened_embeddings")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit(rows), carry=["vec_id"]).withColumn("deviation", F.col("deviation").cast("long"))
