"""Corpus pipeline: documents → packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's docs. All but the last return the columns of ``documents``:

1. language ID: documents that the model rejects (no letter, or an unsure language) go;
2. n-gram Jaccard join: of each group of near duplicates the document of least id stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. PII: personal data becomes keyed pseudonyms (``n_chars`` follows the text);
5. packing: the remaining texts along a Hilbert curve, in sequences of 1024 ids.

Defined results. A null text counts as empty where it is read and stays null until packing; stage 1 drops null,
empty and letterless texts. Very long texts go whole through every stage. Rows that repeat one id and text are one
document after stage 2; of near duplicates the least id stays (null ids last), of one id the text of
least digest. Rows without an id are documents like others. An empty table, or one of which nothing is left, gives
an empty result. Further columns of documents pass stages 1 to 4 unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.llm import decontaminate, language_id, near_join, packing, pii
from sparkfeat.llm.common import documents, ship_package, stored, tokenizer_path
from sparkfeat.llm.queries import PSEUDONYM_KEY
from sparkfeat.sources.tables import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return language_id.drop_rejected(docs, language_id.fit(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_join.keep_representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.drop_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(docs, PSEUDONYM_KEY).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("pii", pseudonymize),
    ("packing", pack),
]
#: The language model, the tokenizer and the Feistel network have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
