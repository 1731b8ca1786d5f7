"""Corpus preparation: quality, near duplicates, benchmark leaks, personal data, curriculum.

Each stage takes what its predecessor kept and its decisions take effect: rejected, duplicate and leaking documents go, personal data is
replaced in the text, and the last stage returns the training order, a row for each copy that the mix takes.
run() writes each stage into the shared folder and reads it again, so that no stage computes another's work twice.
Near duplicates are known by id and words together: rows that share an id, or have none, are told apart by their words.  Null and empty texts are kept by
the stages unless the classifier rejects them, and never mixed in, as they have no words; empty tables give no rows; columns of any name pass through all but the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verdure.llm import common as c
from verdure.llm.op3_pii import redacted
from verdure.llm.op4_omh import one_of_each
from verdure.llm.op8_curriculum import curriculum, training_order
from verdure.llm.op9_decontam import leak_free
from verdure.llm.op10_crf import quality_scores


def quality(spark, docs, sf_dir):
    """Documents that the line model rejects go."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # so that columns of any name pass through
    key, text = (names[docs.columns.index(n)] for n in ("doc_id", "text"))
    labels = c.table(spark, sf_dir, "labels").select(F.col("doc_id").alias(key), "quality")
    return quality_scores(docs.toDF(*names), labels, key, text).filter("predicted = 1").select(*names).toDF(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Of each class of near copies the document with the least id stays (null is the last of ids); of rows with that id and those words, one."""
    return one_of_each(docs)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a test item go."""
    return leak_free(docs, c.table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Spans are replaced by their kind; n_chars follows."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark, docs, sf_dir):
    """The order of training: doc_id, source, text, taken, position; a row for each copy."""
    mixed = curriculum(docs)
    return training_order(docs.select("doc_id", "source", "text"), mixed)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("PII", personal_data), ("mixing sources", mix)]
#: Trained scores and sketches are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents")
    folder = f"{c.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
