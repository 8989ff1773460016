"""A corpus from raw documents to token ids: quality, lines, near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it returns is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinsework.llm.bpe import encode
from rinsework.llm.contamination import decontaminate
from rinsework.llm.divergence import keep_good
from rinsework.llm.lines import dedup_lines
from rinsework.llm.neardup import drop_near_duplicates
from rinsework.llm.queries import WORD_BPE, table
from rinsework.llm.simple8b import new_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's references. Null and empty texts go."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on ten sources or more; the first document of a line keeps it.

    Documents that consist of such lines alone are left out. ``n_chars`` follows the text.
    """
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, by five-word shingles and a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, shingle=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words occurs in the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids."""
    return encode(docs, WORD_BPE)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are kept in the working folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The near copies and the token ids are beyond SQL.
ORACLE_SQL = None
