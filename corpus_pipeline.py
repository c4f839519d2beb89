"""A corpus from raw documents to packed sequences, in four written stages.

Each stage takes (spark, docs, sf_dir), keeps the columns of documents but for the last, and is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintlake.llm import ngram_jaccard, packing, quality, toxicity
from stintlake.llm.common import table
from stintlake.llm.linear import keep_predicted
from stintlake.session import ship_package, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Null and empty texts are judged by the bias alone; repeated rows, null ids and columns of any name pass as they are; an
    empty table stays empty. The model is fitted on the labelled rows of sf_dir.
    """
    ship_package(spark)
    weights = quality.model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return keep_predicted(docs, weights, quality.scorer, quality.CUT, 1)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't predict to be toxic; odd rows as in the stage before."""
    ship_package(spark)
    weights = toxicity.model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return keep_predicted(docs, weights, toxicity.scorer, toxicity.CUT, 0)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id (of equal ids, the smallest text hash).

    Of rows with one id and text, one stays. Null ids come last. Documents without words all stay. Columns of any name pass
    as they are; an empty table stays empty.
    """
    ship_package(spark)
    found = written(ngram_jaccard.classes(docs.select("doc_id", "text"), with_key=True), "classes").filter("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = found.groupBy("class").agg(F.min(place).alias("first"))
    gone = found.join(first, "class").filter(place > F.col("first")).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("key"))
    same = [F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.key") == F.col("y.key"))]
    left = rows.alias("x").join(gone.alias("y"), same, "left_anti")
    twice = found.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).count().filter("count > 1").drop("count")
    if twice.isEmpty():
        return left.select("row.*")
    copy = Window.partitionBy("id", "key").orderBy(F.lit(0))
    one = left.alias("x").join(twice.alias("y"), same, "left_semi").withColumn("copy", F.row_number().over(copy)).filter("copy = 1")
    return left.alias("x").join(twice.alias("y"), same, "left_anti").select("row.*").unionByName(one.select("row.*"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed into sequences of at most 2048 tokens.

    A null or empty text is its end id alone; rows with null or repeated ids are packed as documents of their own; columns
    other than doc_id and text are not looked at, whatever their names; an empty table gives no rows.
    """
    import public_tokenizers

    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("packing", packing_stage),
]

#: Training and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
