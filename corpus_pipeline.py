"""A corpus pipeline over ``documents``: language, near duplicates, benchmark passages, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder of the
cluster and reads it again as the documents of the next stage.  All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedstack.llm import pii_boosting, ppm_language, systematic_mix, template_decontam, token_combinations
from feedstack.llm.common import ship_package, written

#: A text that takes more bits for each byte in every learned language is in none of them: a uniform guess takes 8.
MOST_BITS = 8.0
#: The columns of documents that stages read.
READ = ("doc_id", "text", "lang", "source")


def shielded(stage):
    """``stage`` with all columns that it does not read under names of no helper column; they come back as they came."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c: f"column{i}_of_documents" for i, c in enumerate(docs.columns) if c not in READ}
        back = {new: old for old, new in own.items()}
        out = stage(spark, docs.withColumnsRenamed(own), sf_dir)
        return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns])
    return run



@shielded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter, or are in none of the learned languages."""
    ship_package(spark)
    trees = ppm_language.fit(docs)
    if trees is None:  # no labelled row: any text with a letter stays
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = ppm_language.identify(docs, trees, tuple(docs.columns))
    return found.filter((F.col("lang_pred") != ppm_language.UNDECIDED)
                        & (F.col("bits_per_byte") <= MOST_BITS)).select(*docs.columns)


@shielded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    ship_package(spark)
    return token_combinations.keep_one(docs, k=5, percent=80)


@shielded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, also with other numbers, names or units."""
    ship_package(spark)
    return template_decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shielded
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii_boosting.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document that it takes."""
    return systematic_mix.emit(systematic_mix.mix(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: Language model, boosted trees and 64-bit hashes have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
