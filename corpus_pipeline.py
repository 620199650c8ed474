"""The corpus pipeline: documents in, packed sequences out.

Five stages, each over all its predecessor kept.  Every stage takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``.

1. quality rules: drops texts that fail the base rule or are outliers of their language and source;
2. MinHash near-dedup: of each class of near-duplicates, keeps the row with the least doc_id;
3. benchmark decontamination: drops documents that contain a test item;
4. PII: replaces personal data in the texts by the names of its kinds;
5. packing: token windows of 2048, with the ids of every piece.

Defined cases are those of the operators: null and empty texts fail the quality rules and go; null, repeated and tied
doc_ids are rows like any other (null counts as the largest where the least id of a class stays, and of rows alike
in id and text one stays); further columns, whatever their names, go through the first four stages
unchanged; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm import containment, icws, mcd, packing, pii
from lakeops.llm.common import pin, table
from lakeops.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mcd.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per class: the one with the least doc_id (null last), of rows alike in id and text one."""
    return icws.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return containment.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts change, so ``n_chars`` is counted anew where the table has it."""
    out = pii.mask(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate),
          ("pii", mask_pii), ("packing", pack)]

#: Models, sampling and a tokenizer stand behind the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), "pipeline", name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
