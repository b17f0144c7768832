"""The corpus pipeline: five training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result as Parquet in the shared folder and reads it back as the
next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm.common import stored, table
from mnemospark.llm.decontamination import decontaminate_stage
from mnemospark.llm.mixing import mix_stage
from mnemospark.llm.near_dedup import near_dedup_stage
from mnemospark.llm.quality_rules import filter_quality
from mnemospark.llm.substrings import substring_stage

STAGES = [
    ("quality_rules", filter_quality),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
]

#: The near-dedup and substring stages need recursion over intermediate texts,
#: so the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
