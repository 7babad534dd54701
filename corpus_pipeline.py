"""Corpus pipeline: stages over documents, each reading all that the one before kept.

Every stage but the last returns the columns of documents; where a text changes, its
``n_chars`` follows.  Rows without an id pass the stages that compare documents.  No
single SQL text states the stages after the second; ``tests/llm`` holds the whole run
against a plain computation.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.llm.jaccard import jaccard_groups
from recordlake.llm.lines import line_dedup
from recordlake.llm.packing import pack_documents
from recordlake.llm.quality import quality_rules
from recordlake.llm.queries import LINE_PAGES, LINE_RATIO
from recordlake.llm.session import prepared, settled
from recordlake.llm.substrings import suffix_dedup, valid_text
from recordlake.plans.stages import discard


def _with_text(docs: DataFrame, text) -> DataFrame:
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepared(spark)
    return quality_rules(docs).filter("quality.kept").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their sources' boilerplate lines; copies count once, as one of them is to stay whole."""
    prepared(spark)
    out = line_dedup(docs, ratio=LINE_RATIO, min_pages=LINE_PAGES, copies_once=True).select(*docs.columns)
    return _with_text(out, F.col("text"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component whose 5-word shingles overlap by 80 % or more."""
    prepared(spark)
    groups = jaccard_groups(docs.select("doc_id", "text"), size=5, percent=80)
    others = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(settled(others, "near-copies"), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that earlier documents have; cut characters go."""
    prepared(spark)
    out = suffix_dedup(docs, length=50)
    return _with_text(out, valid_text("deduped.kept")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    prepared(spark)
    ranks, library = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(docs, ranks, library, capacity=1024, end_id=2)


STAGES = [
    ("quality rules", keep_good_texts),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", drop_repeated_strings),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again; what the next stage has read goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
