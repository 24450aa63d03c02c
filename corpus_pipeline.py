"""The corpus pipeline: five stages from ``documents`` to packed bins.

Each stage takes (session, documents, folder) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epilimnia.llm.best_fit import pack_rest
from epilimnia.llm.common import read_table, settle
from epilimnia.llm.compression_classifier import keep_good
from epilimnia.llm.dart_minhash import keep_one_of_each
from epilimnia.llm.digest_index import drop_copies
from epilimnia.llm.string_kernel import drop_toxic

STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", keep_one_of_each),
    ("packing", pack_rest),
]

#: Trained classifiers and packing can't be stated in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
