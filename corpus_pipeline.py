"""A corpus pipeline of five operators: rules, near-duplicates, secrets, mixing, token ids.

``STAGES`` lists them; ``run`` writes each stage's result as Parquet in the shared folder and reads it
as the next one's documents. All but the last return the columns of ``documents``. SQL cannot express
the stages, so ``ORACLE_SQL`` is None and tests hold each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import bpe_replay, cube_mix, minhash_join, quality_rules, secret_scan
from tidegraph.llm.common import forget, ship, written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_duplicates", minhash_join.stage),
    ("secret_scan", secret_scan.stage),
    ("mix", cube_mix.stage),
    ("token_ids", bpe_replay.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(*before)  # what the stage has read
        before = [docs]
    return docs
