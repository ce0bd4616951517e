"""Retrieval corpora on disk: ``corpus.jsonl``, ``queries.jsonl`` and ``qrels/<split>.tsv``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``documents(doc_id, text)``, ``queries(qid, text)`` and ``qrels(qid, doc_id, rel)``; title and text are joined."""
    docs = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    docs = docs.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", "title", "text")).alias("text"))
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("qid"), "text")
    qrels = spark.read.schema("qid string, doc_id string, rel int").option("sep", "\t").option("header", True).csv(f"{folder}/qrels/{split}.tsv")
    return docs, queries.join(qrels.select("qid").distinct(), "qid", "left_semi"), qrels.where("rel > 0")
