"""From raw documents to token ids: language, lines, near copies, benchmark items, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Between the stages the rows are written to the shared folder and read again.

1. language: documents whose language cannot be told, because they hold no letter or because no
   language is clearly likelier than chance, go. A missing language is filled in.
2. lines: lines that an aligned earlier document holds are cut, ``n_chars`` follows; documents of
   which nothing but blank lines is left go. Documents that were empty before stay as they are.
3. near_copies: of each class of near copies the document with the smallest id stays.
4. benchmark: documents that hold an item go.
5. pieces: ids with an end id, and whether decoding them gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymart.llm import decontaminate, language, lines, nearcopies, pieces
from quaymart.llm.queries import PIECES, PIECES_END, documents
from quaymart.llm.stores import free_names, stored

LEAST_LIFT = 1.1   # of the best language's probability over chance, which is one divided by the number of languages

ORACLE_SQL = None   # a trained network, sampling and merges are beyond SQL; tests/llm has brute force


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language.train(docs.select("text", "lang"), F.lit(True))
    told = language.identify(docs, net)
    pred, sure = free_names(docs.columns, "lang_pred", "lang_score")
    least = LEAST_LIFT / len(net.labels) if len(net.labels) > 1 else 0.0
    kept = told.where((F.col(pred) != language.UNDETERMINED) & (F.col(sure) >= least))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.line_dedup(docs)
    kept = cut.where((F.col("n_left") > 0) | (F.col("n_removed") == 0))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) \
        .select(*docs.columns)


def by_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.one_of_each(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode(docs.select("doc_id", "source", "lang", "text"), PIECES, end_id=PIECES_END, decode=True)
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language", by_language), ("lines", by_lines), ("near_copies", by_near_copies), ("benchmark", by_benchmark), ("pieces", as_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
