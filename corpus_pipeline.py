"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing, packing.

Defined results: null and empty texts fail the base rules and go with the first stage; null languages
and sources are languages and sources of their own; of equal texts the row of the largest doc_id stays, of near
copies one row of each group; null ids stay null and are hashed by their text; repeated rows are copies
of each other; an empty table gives empty stages and no piece. Other columns pass through all stages but
the last, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import materialise, table
from barloom.llm.exact import exact_stage
from barloom.llm.jaccard import near_stage
from barloom.llm.mixing import mixing_stage
from barloom.llm.packing import packing_stage
from barloom.llm.quality import quality_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_divergence", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("poisson_mixing", mixing_stage),
    ("tier_packing", packing_stage),
]

#: Tokenizing and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
