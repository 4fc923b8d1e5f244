"""Corpus pipeline: stages over documents, each written as Parquet and read again.

Quality rules drop what they reject; the Jaccard join keeps one document of each class of
equal or linked texts; decontamination drops documents that hold a benchmark passage;
personal data is masked in the texts; the last stage encodes them. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from plansieve.llm import bpe, decontam, jaccard_join, pii, quality_rules
from plansieve.llm.common import shared_dir, table
from plansieve.storage import scratch


def quality(spark, docs, sf_dir):
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    return jaccard_join.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    return pii.redact(docs)


def encode(spark, docs, sf_dir):
    return bpe.report(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("encode", encode),
]
#: Likelihood pruning, component search and merges have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        with scratch(spark):  # what the stage wrote on its way goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
