"""A corpus pipeline of five stages over the documents table; counted as part of tidewell.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from tidewell.llm.common import cut, mark, release, table

SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the smallest doc_id stays."""
    return ngram_join.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item, or the whole of a shorter one, go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them, 0 to 3 times."""
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row, and the text that goes there."""
    placed = sharding.shard_documents(docs, SHARDS)
    return sharding.shard_keys(placed, "shard", "slot", "source", "text")


STAGES = [("quality rules", quality), ("n-gram join", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("sharding", shards)]

#: Keyed permutations are not expressible in DuckDB SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over documents, each but the last written and read again."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        release(spark, since, keep=1)  # what the stage wrote for itself, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
