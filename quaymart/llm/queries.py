"""Registered queries of the training-data operators; digests are derived from their real outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from . import decontaminate, language, lines, nearcopies, negatives, neighbours, passages, pieces, simhash, tokenfiles, toxicity, unigram, whitening

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES_END, WORDS_END = 2, 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = unigram.token_counts(docs, unigram.rank_vocabulary(PIECES))
    return counted.select("doc_id", "n_tokens", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = pieces.encode(docs, PIECES, end_id=PIECES_END, decode=True)
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    tokenfiles.write_token_files(documents(spark, sf_dir).select("doc_id", "text"), folder, WORDS, WORDS_END)
    return tokenfiles.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", "n_left", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir).select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = remainder(4) == 2
    net = language.train(docs, ~held_out)
    return language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), net) \
        .select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = remainder(3) == 1
    bag = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(docs.withColumn("held_out", held_out), bag)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(documents(spark, sf_dir).select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    net = whitening.fit(vectors)
    if net is None:
        kept, n, error = vectors.limit(0).withColumn("whitened", F.array().cast("array<double>")).withColumn("deviation", F.lit(0).cast("bigint")), 0, 0.0
        shares = F.array().cast("array<double>")
    else:
        kept, n = whitening.whiten(vectors, net), net.rows
        error = whitening.identity_error(kept, "whitened", len(net.values), n)
        shares = F.array(*[F.lit(float(x)) for x in net.explained]).cast("array<double>")
    spread = kept.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return spread.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                         F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_near_dedup": op3_near_dedup,
    "op4_pieces": op4_pieces,
    "op5_token_files": op5_token_files,
    "op6_neighbours": op6_neighbours,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

CHECKS: dict[str, str] = {
    "op12_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
}
