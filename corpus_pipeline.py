"""The corpus pipeline: documents go through a quality classifier, near-dedup, benchmark decontamination and mixing to
target weights, and end as a token file. Each stage is written as Parquet and read again as the next one's documents.

All stages but the last return the columns of documents. Each stage says what becomes of awkward rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, small, stored, table
from tidemark.llm.decontaminate import clean
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.quality import classify
from tidemark.llm.token_file import encoded


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    gone = judged.where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(small(stored(gone)), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (low quality or toxic) go.

    A null or empty text is judged like any other, by its site alone; null sources and languages are sites of their own;
    of rows that share a doc_id all go if one does; rows without a doc_id stay; an empty table stays empty; other
    columns are kept as they are.
    """
    return _without(docs, classify(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id. Copies are linked from a
    similarity of 0.80 on; 0.85 is the contract of the query op8_near_dup alone.

    Rows that share both doc_id and text are one document, of which one row stays; rows that share the doc_id alone share
    its fate. Null, empty and blank texts are no copies of each other; rows without a doc_id stay; an empty table stays
    empty; other columns are kept as they are.
    """
    kept = _without(docs, near_duplicates(docs, percent=80))
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not again.limit(1).count():
        return kept
    once = kept.join(small(again), "doc_id", "left_anti").select(*docs.columns)
    return once.union(kept.join(small(again), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay, with or without a doc_id; each repeated row is judged by its own text; an
    empty table, or an empty benchmark, changes nothing; other columns are kept as they are.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights; a row per copy of a document.

    Texts without a word (null, empty, blank) are in no mix and go; a null source is a source of its own; rows that share
    a doc_id, or have none, are taken as often as the plan says for all of them; an empty table stays empty; other
    columns are kept, n_chars being that of a cut text.
    """
    return mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of the mix, read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; rows without a doc_id come first; rows that share one follow each other;
    an empty table makes an empty file and no rows; other columns are ignored.
    """
    return encoded(spark, docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixture", mixture), ("token_output", token_output)]

#: Classifier, edit distances and tokenizer have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/tidemark-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
