"""From a raw document table to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and
reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import decontaminate, near_dup, packing, pii_spans, toxicity
from ticketloom.llm.common import boxed, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labels, doesn't reject.

    Null and empty texts stay; equal texts are kept or dropped alike; an empty table stays empty. The
    documents' own columns come back unchanged, whatever their names.
    """
    rows, own = boxed(docs, ["doc_id", "text"])
    model = toxicity.fit(rows, table(spark, sf_dir, "labels"))
    return toxicity.score(rows, model).where("predicted = 0").select(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of equal ids that with the smallest text hash.

    Null, empty and blank texts are copies of nothing and all stay; of repeated rows one stays; null ids come
    last; an empty table stays empty. The documents' own columns come back unchanged, whatever their names.
    """
    return near_dup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark.

    Null and empty texts stay; equal texts are kept or dropped alike; an empty table, of documents or of the
    benchmark, drops nothing. The documents' own columns come back unchanged, whatever their names.
    """
    rows, own = boxed(docs, ["doc_id", "text"])
    return decontaminate.contamination(rows, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(own)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is that of the new text.

    Null and empty texts stay as they are; equal texts are redacted alike; an empty table stays empty. The
    documents' other columns come back unchanged, whatever their names.
    """
    rows, own = boxed(docs, ["text"])
    out = pii_spans.redact(pii_spans.find_all(rows)).select(own)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences.

    Null and empty texts are pieces of one token; repeated rows are packed each; an empty table gives no
    rows. Columns besides doc_id and text are left out, so their names don't matter.
    """
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: The stages learn models, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
