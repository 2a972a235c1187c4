"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage works on all that the one before it kept.  Defined results:

* language_id drops rows whose text is null, empty or without a letter, and texts far from every language; all others stay as they are.
* simhash_near_dedup keeps of each group of near duplicates the smallest doc_id, and of repeated rows with that id one.  Rows with a null doc_id
  stay only if no row of their group has an id, one of each fingerprint.
* substring_dedup cuts passages that a smaller doc_id has too (ties: rows that share an id are judged alike, rows without id lose nothing);
  a document of nothing else goes; ``n_chars`` follows the text.
* decontamination drops documents that hold a test item; an empty ``benchmark`` drops none.
* best_fit_packing places every token of what is left; rows with a null doc_id are packed like others.

An empty table gives an empty result of each stage.  Further columns, whatever their names, pass through all stages but the last.  Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import queries
from tessera.llm.common import saved

STAGES = [
    ("language_id", queries.stage_language),
    ("simhash_near_dedup", queries.stage_near_duplicates),
    ("substring_dedup", queries.stage_substring),
    ("decontamination", queries.stage_decontaminate),
    ("best_fit_packing", queries.stage_pack),
]

#: SQL has no classifier, fingerprint or tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
