"""The corpus pipeline: language ID, near-dedup, substring dedup, PII masking and packing, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet to the shared
folder and read again. All but the last return the columns of documents. SQL cannot express the language models and the
fingerprints, so the rows are held against a brute-force version in the tests.

Defined results: a null text, an empty one or one without a letter is rejected by the first stage, as `und`; a null id stays,
counts as the largest in near-dedup and substring dedup, and sorts first in packing; of repeated rows one stays; very long
texts go through whole; columns that a stage does not know pass through it, whatever their names, and the last stage's rows
are pieces; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from strataline.llm import common, language, packing, pii, simhash, substring

STAGES = [
    ("language_id", language.stage),
    ("near_dedup", simhash.stage),
    ("substring_dedup", substring.stage),
    ("pii_masking", pii.stage),
    ("packing", packing.stage),
]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialise(docs, f"stage-{name}")
    return docs
