"""From raw documents to token shards: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import decontaminate, jaccard_join, mixing, quality_rules, token_shards
from siftline.llm._common import dropped, forget, made_here, stored, table

#: By application and folder of tables: what the stage before stored for itself; its output is written by now, so that goes when the next stage begins.
_LEFT: dict[tuple[str, str], list[str]] = {}


def staged(stage: Callable) -> Callable:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run = (spark.sparkContext.applicationId, sf_dir)
        read = " ".join(docs.inputFiles())
        forget(spark, [p for p in _LEFT.pop(run, []) if p.rsplit("/", 1)[-1] not in read])
        with made_here() as made:
            out = stage(spark, docs, sf_dir)
        if stage.__name__ != "token_output":  # the result's own index stays
            _LEFT[run] = made
        return out

    return run_stage


@staged
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that quality rules or their host's verdict reject."""
    return quality_rules.passing(docs)


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % or more of their five-word shingles."""
    return jaccard_join.one_of_each(docs, k=5, similar=80)


@staged
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@staged
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, or cut to the words that the mix takes."""
    return mixing.mixed(docs)


@staged
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; a row a sequence tells its place."""
    return token_shards.shard_index(docs)


STAGES = [("quality_rules", rules), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("source_mixing", mixture), ("token_shards", token_output)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if n:
            dropped(before)
    return docs
