"""Documents to packed training sequences, in five stages of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.decontamination import clean_documents
from maskwright.llm.jaccard_join import one_of_each
from maskwright.llm.line_dedup import drop_lines
from maskwright.llm.packing import pack
from maskwright.llm.quality import filter_documents
from maskwright.llm.shared import WORD, drop_staged, read_table, staged
from maskwright.llm.tokens import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts are rejected (too few words)."""
    return filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has too; ``n_chars``, if there is one, follows
    the text. Lines that only copies share stay, as do those of two documents alone: copies are the next
    stage's case. Of a document whose words all lie in lines that others share nothing is left, and it goes."""
    out = drop_lines(docs, spare_copies=True, min_docs=3).filter(F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens: their pieces, with the ids."""
    return pack(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the template tree, the join's components or the packer; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written below the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
        drop_staged(before)  # the packer's rows come from its own table of pieces
    return docs
