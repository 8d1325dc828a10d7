"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

    toxicity      documents with a toxicity score of 0.7 or more go
    near copies   of documents linked by a Jaccard similarity of 0.8 on five-word shingles one stays
    substrings    passages that an earlier document has are cut out; documents of which nothing is left go
    mixing        documents are repeated or dropped so that their sources meet the target weights, in training order
    packing       texts become token pieces in sequences of at most 2048 tokens

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import mixing, ngram_join, packing, substring, toxicity
from tokenloom.llm._common import free_name, materialise, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no sentence that could offend: they stay, as do rows with null ids."""
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), free_name(docs, "_toxicity")
    return toxicity.with_score(docs, model, to=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words are linked with nothing and stay; so do rows with null ids.  Of rows with equal ids one stays."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that were null, empty or blank before stay as they are; n_chars is counted anew, for all."""
    before = free_name(docs, "_before")
    cut = substring.remove_repeats(docs.withColumn(before, F.octet_length("text")))
    blank = F.col("text").rlike(r"^[\x09-\x0D\x20]*$")
    return cut.filter(~(blank & (F.octet_length("text") < F.col(before))) | F.col("text").isNull()).withColumn("n_chars", F.length("text").cast("long")).drop(before)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null sources are one source; texts without words stay once."""
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are one token each; null ids stay null."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram jaccard", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mix sources", mix_sources),
    ("pack sequences", pack),
]

#: Hashes order the documents, models score them and a tokenizer cuts them: SQL can't tell the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
