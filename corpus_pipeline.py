"""A training corpus from the documents table: toxicity filter, near-duplicate removal, repeated passages, packing.

Each stage works on all rows that the stage before it kept. All but the last return the columns of documents; the
text of a document that lost passages is what is left of it, and n_chars its length.

Cases, the same for all stages: columns beyond doc_id and text may have any names and types and pass through; an empty
table gives an empty one. What a stage does with nulls, empty texts, ties and repeated rows is in its docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm import common, minhash, packing, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; the classifier learns from the labels table. A null or empty text
    has the score of a text without words; rows without an id are judged like others, and repeated rows alike. Without
    labels of both kinds nothing can be learnt: all stay if no label is toxic, none if all are."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.rejected(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group: five-word shingles, similarity 0.8 or more. Rows repeated
    under one id stay or go together; rows without an id stay, and so do null and empty texts, which are linked with
    nothing."""
    gone = minhash.near_duplicates(docs, k=5, num=80, den=100).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has, by doc_id; ties do not arise, as rows of one id are one
    document and lose the same. Null texts stay null, rows without an id stay whole; no document goes."""
    clean = substring.without_repeats(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 4096 tokens. A null or empty text is a piece of the end id;
    repeated rows and rows without an id are documents of their own."""
    return packing.pack_documents(docs, common.tokenizer_path("word_bpe_49k.json"), keep_ids=False)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", drop_repeated_passages), ("packing", pack)]
#: No stage but the last could be stated in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs, folder = common.table(spark, sf_dir, "documents"), common.shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
