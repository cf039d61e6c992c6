"""The corpus pipeline: five stages over `documents`, each calling one operator of the llm package.

All stages but the last return the five columns of `documents`; any other column of the table is left out.
Defined results: null and empty texts have no words and go at the quality rules; null languages and
sources are values of their own in the mix; documents with null ids are judged like others, after those
with ids; of repeated rows one stays after near dedup; empty tables give empty tables at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstream.llm import line_dedup, quality_rules
from loamstream.llm.decontaminate import decontaminate
from loamstream.llm.jaccard_dedup import SHINGLE, one_of_each
from loamstream.llm.line_dedup import dedup_lines
from loamstream.llm.mixing import mix
from loamstream.llm.registry import table
from loamstream.llm.shared import settle, text_hash
from loamstream.llm.simhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.judge(docs).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of three lines or fifty words are cut; a document that had lines and keeps none goes."""
    d = F.col(line_dedup.RESULT)
    told = dedup_lines(docs, words=line_dedup.PASSAGE)
    return _documents(told.filter((d.n_lines == 0) | (d.n_removed < d.n_lines)).withColumn("text", d.clean_text))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, Jaccard 0.8) one document stays: the smallest id, null ids last.

    The SimHash operator links texts whose fingerprints over five-word shingles differ in two bits at most, and all
    texts of a class it finds are held exactly against each other, not its first alone; similar texts whose fingerprints
    lie further apart are found by the bands of `jaccard_dedup`. Rows with one id but different texts are judged by their
    texts; of repeated rows one stays.
    """
    docs = docs.select(*COLUMNS)
    classes = near_duplicates(docs.select(text_hash("text").alias("s"), "text"), "s", k=SHINGLE)
    linked = classes.filter("s <> component_id").select("s", F.col("component_id").alias("first")).distinct()
    return one_of_each(docs, linked=linked)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; a document of nothing else goes."""
    c = F.col("contamination")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _documents(found.filter((c.n_hit == 0) | (c.n_hit < c.n_words)).withColumn("text", F.when(c.n_hit > 0, c.clean_text).otherwise(F.col("text"))))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target mix, with their weight and number of copies."""
    return mix(docs).filter("copies > 0")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_dedup), ("decontamination", benchmark), ("mixing", mixing)]

# line winnowing, near-copy classes and raking have no common SQL form; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are cut off before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
