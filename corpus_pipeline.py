"""A corpus pipeline of five operators; each stage is written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the network, trained on the labels of these documents, rejects."""
    from hindcast.llm.queries import table
    from hindcast.llm.toxicity import drop_toxic

    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that at least three documents share, except in the largest doc_id; n_chars follows.

    A document that loses all its lines stays, with an empty text."""
    from hindcast.llm.linededup import line_dedup

    kept = line_dedup(docs, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 over five-word shingles connect, keep the smallest doc_id.

    Of rows of one id in a group one stays; rows with a null id or without words stay."""
    from hindcast.llm.common import stage
    from hindcast.llm.ngramjoin import ngram_groups

    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row"))  # tells rows of one id apart
    groups = ngram_groups(keyed, k=5, parts=80, of=100, row_col="row").select("doc_id", "row", "group_id")
    groups = stage(groups.filter("doc_id is not null and group_id is not null"), "pipeline-groups")
    first = groups.groupBy("group_id").agg(F.min(F.struct("doc_id", "row")).alias("kept"), F.count("*").alias("rows")).filter("rows > 1")
    gone = groups.join(first, "group_id").filter("struct(doc_id, row) != kept").select("doc_id", "row").distinct()
    out = keyed.join(gone, ["doc_id", "row"], "left_anti")
    again = stage(groups.groupBy("doc_id", "row").count().filter("count > 1").select("doc_id", "row"), "pipeline-repeated")
    if not again.isEmpty():  # the same row twice: its group keeps one of it
        once = out.join(again, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
        out = out.join(again, ["doc_id", "row"], "left_anti").unionByName(once)
    return out.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of the benchmark occurs."""
    from hindcast.llm.decontam import decontaminate
    from hindcast.llm.queries import table

    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.filter("not contaminated").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    from hindcast.llm.packing import pack
    from hindcast.llm.queries import word_bpe_path

    return pack(docs, word_bpe_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages include a trained network, which SQL can't express; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; returns the pieces of the packed sequences."""
    from hindcast.llm.common import stage
    from hindcast.llm.queries import table

    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
