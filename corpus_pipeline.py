"""A training corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, packing.

Part of pathloom.llm, though it stands at the top. Each stage reads what the one before wrote and applies one operator to
all of it; all but the last give back the columns of documents, whatever further columns those are. An empty table goes through all
stages and gives an empty result. The stages say what they do with null, empty and very long texts, ties, repeated rows and null ids.
"""

from __future__ import annotations

from pathloom.llm.decontaminate import drop_contaminated
from pathloom.llm.line_dedup import drop_lines
from pathloom.llm.near_dedup import keep_one_of_each
from pathloom.llm.packing import pack
from pathloom.llm.quality import keep_good
from pathloom.llm._shared import store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio.

    Null, empty and short texts fail the base rules and go; very long ones are scored whole. Repeated rows score alike and stay or go
    together; a score at the threshold stays. A null id is scored like any other, but is never trusted or learned from.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its source's boilerplate lines; n_chars follows the text.

    Null text stays null, empty text empty; a text of boilerplate alone becomes empty and stays. Repeated rows are pages each. Rows
    without a source are a source of their own. A line at just the ratio stays.
    """
    clean = drop_lines(docs, F.col("source"))
    return clean.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at a similarity of 0.8.

    The smallest id of a group stays, with all its rows; rows with a null id, null or empty text link with nothing and stay. A pair at
    just 0.8 links. Very long texts are compared whole.
    """
    return keep_one_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts hold none and stay; repeated rows go or stay together; very long texts are searched whole. Items without a name
    count; items of null or empty text hold no passage.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left.

    Null and empty text is an end id alone; very long texts are cut into windows; each repeated row is packed; ties in length go to the
    earlier one of its block.
    """
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Quality scores need the engine's hash and packing the tokenizer, so SQL has no equal.
ORACLE_SQL = None
