"""The corpus pipeline: from raw documents to a mix of clean, distinct ones.

Each stage takes what the one before it kept and returns the columns of
``documents``; the last returns the mix: how often each document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontaminate import drop_contaminated
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.jaccard_join import jaccard_components
from lodestone.llm.mixing import mix_sources
from lodestone.llm.quality import quality_score, train_quality
from lodestone.llm.shared import Folder, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it is fitted on labelled rows of ``docs``.

    A null or empty text is scored as one without words; without labels the score is 0.5 and all stay."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_score(model, F.col("text")) >= 0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, but for the case of A-Z, the one with the smallest id.

    Null and empty texts are equal; a null id loses to all others; of rows with one id and equal texts one stays."""
    out, n = exact_dedup(docs, carry=docs.columns), len(docs.columns)
    out = out.toDF(*(f"c{i}" for i in range(len(out.columns))))  # by place: documents may have columns of the same names
    return out.where(F.col(f"c{n + 2}")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8 or more, the one with the smallest id.

    Texts without words and null ids are linked with nothing and stay. Rows that share an id are one
    document: they go together if one of them is linked with a smaller id, and stay together otherwise."""
    groups = jaccard_components(docs)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, up to one edit in ten bytes; null and empty texts contain none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document enters a mix of 150% of the words, by source weight.

    A null source is a source; a text without words takes nothing; equal rows each get a row."""
    return mix_sources(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


STAGES = [
    ("quality", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", decontaminate),
    ("mix", mix),
]

#: A fitted classifier and alignment are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder.

    With a ``folder``, stages are kept there, and a run that was cut off (a lost
    driver) goes on after the last stage that is whole. Rows of ``documents`` are
    never merged: each stage passes whole rows on or drops them. An empty table
    gives an empty mix; nulls, ties and repeated ids are treated as each stage says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        name = name.replace(" ", "-")
        if folder is None:
            docs = written(stage(spark, docs, sf_dir), name)
            continue
        path = f"{folder.rstrip('/')}/{i}-{name}"
        if "_SUCCESS" not in Folder(spark, path).names():
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
