"""A training corpus from raw documents: five stages, each one of the corpus operators, each reading what the one before
it has written. The first four return the columns of ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevira.llm import decontaminate, jaccard, pieces, secrets, toxicity
from brevira.llm.common import table
from brevira.session import folders, remove, shared_dir, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labelled rows among them."""
    model = toxicity.fit(docs, table(ship(spark), sf_dir, "labels"))
    return toxicity.scored(docs, model, out_col="_toxic").where("_toxic < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies stays."""
    ship(spark)
    return jaccard.one_of_each(docs, jaccard.near_duplicates(docs)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs, table(ship(spark), sf_dir, "benchmark"))
    return found.where(F.size("_hits") == 0).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    ship(spark)
    return secrets.redacted(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each text: ids as int32 bytes, scores, and whether all decode to the text."""
    ship(spark)
    return pieces.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode),
]

#: Learned scores, verified similarity classes and sampled pieces have no SQL. ``tests/llm`` holds each stage against planted
#: cases, and ``run`` against the stages one after the other.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has read and staged is deleted as soon as its own rows are written."""
    docs, before = table(ship(spark), sf_dir, "documents"), []
    for name, stage in STAGES:
        others = set(folders(spark))
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, [*before, *(x for x in folders(spark) if x not in others)])
        docs, before = spark.read.parquet(path), [path]
    return docs
