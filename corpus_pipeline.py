"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Language ID drops what has no language, SimHash keeps one document of each group of near copies, decontamination drops
what holds benchmark passages, the secret scan replaces secrets, and mixing says how many words of each document the
mix takes. The first four return the columns of ``documents``.

Defined results, stage by stage:

* ``language``: null, empty and letterless texts go, as does every document where nothing is there to learn from; all
  others stay, whatever their languages' shares; repeated rows stay repeated.
* ``near_duplicates``: of equal or near-equal texts the least doc_id stays (null ids last, then the least hash of the
  row); rows that repeat id and text stay once; empty texts are copies of each other.
* ``decontamination``: documents of which a twentieth of the words or more is hit go; without items, none does; a text
  without words stays.
* ``secrets``: every document stays, with its spans replaced; a null text stays null, and n_chars follows the text.
* ``mix``: one row for each document; null and empty texts have size 0 and are taken 0 times; ties in the seeded order
  are settled by doc_id and size.

Every stage takes an empty table (and returns one), very long texts whole, nulls in any column, and further columns
under any names, which the first four keep and the last one leaves out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanwise.functions.lineage import shared_folder
from spanwise.llm import decontam, langid, mixing, secret_scan, simhash
from spanwise.llm.common import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mix", mix)]

#: No SQL: the stages learn a model, hash shingles and search secrets by compression. tests/llm/test_pipeline.py holds
#: them against brute force instead.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Results between stages go to the shared folder; each is removed once the next one is
    written, but for the last stage's input, which its rows are read from."""
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if last:
            _drop(spark, last)
        last = f"{folder}/{name}"
        docs = spark.read.parquet(last)
    return STAGES[-1][1](spark, docs, sf_dir)
