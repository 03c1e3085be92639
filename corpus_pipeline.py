"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next one's
documents.  All but the last return the columns of ``documents``: rejected documents are gone, and the text of the others is what
line dedup has left of it.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and columns with any other names:
null and empty texts fail the base rules of the first stage and would pass the others; each row is judged by its own text, but
of repeated ids the near-dedup stage keeps one row, and rows without an id stay there.  Ties are settled by the larger id in
line dedup (the last document keeps its lines) and the smaller one in near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronozone.llm import decontaminate, lines, packing, quality, simhash
from chronozone.llm.common import shared_dir, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source; null and empty texts fail."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of 20 characters or more that three documents share, but in the last of them; ``n_chars`` follows."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id; documents without an id stay."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; each row is judged by its own text, so null texts stay."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text is a document of the end id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: SQL can't express the SimHash groups; ``tests/llm`` compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    folder, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
