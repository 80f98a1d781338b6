"""From raw documents to token ids: the stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is
written as Parquet and read again as the next one's input. Any columns besides ``doc_id``, ``text``
and ``source`` go along untouched, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm.decontamination import remove_contaminated
from loomtrace.llm.mixing import take_mix
from loomtrace.llm.near_dedup import drop_near_duplicates
from loomtrace.llm.quality import keep_good
from loomtrace.llm.queries import tokenizer_path
from loomtrace.llm.storage import materialise
from loomtrace.llm.token_output import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null, empty and blank texts have too few words and
    go; repeated rows are judged alike; very long texts are judged whole."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least id (null ids last).
    Of repeated rows one stays; documents without a word all stay."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. Texts without words hold none; null items and an
    empty benchmark have none."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null is a source of its own; texts without words are
    never taken; rows of one id, text and source share their copies evenly."""
    return take_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files; one row per written document with its place and checksum. Null texts are the
    end id alone; documents without id come first, copies stand next to each other."""
    return read_token_files(write_token_files(docs, tokenizer_path(), end_id=1, word_local=True))


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("token ids", token_ids)]

#: Suffix arrays, random rounding and a tokenizer's merges are beyond SQL; tests/llm checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
