"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepsake.llm import decontaminate, languages, mixing, shards, similar
from keepsake.llm.common import Workspace, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language that the labels teach go."""
    return languages.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return similar.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order, written as shards; what the shards hold."""
    return shards.materialise(docs)


STAGES = [("language ID", known_language), ("n-gram Jaccard join", one_of_each_group),
          ("benchmark decontamination", without_benchmark), ("mixing sources", mixed), ("token shards", tokens)]

#: Cosines of random vectors, edit distances in texts, and BPE are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    space = Workspace(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), f"{number}-{name.replace(' ', '-')}")
        if number:
            space.drop(f"{number - 1}-{STAGES[number - 1][0].replace(' ', '-')}")
    return docs
