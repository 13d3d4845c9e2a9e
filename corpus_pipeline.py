"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from togglelog.llm import jaccard_join, lang_id, mixing, packing, substring_dedup
from togglelog.llm.queries import tokenizer
from togglelog.llm.storage import as_row, from_row, written

# A document whose language is less likely than this, against all others together, is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters or below LEAST_SCORE go.

    Null and empty texts go; a null lang is no label, and the document may stay. Repeated rows stay as often as they
    come. Columns of any name pass through.
    """
    model = lang_id.train(docs.select("text", "lang"), tokenizer("piece_bpe_32k.model"))
    found = lang_id.predict(docs.select(as_row(docs.columns), "text"), model)
    kept = (F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return found.where(kept).select(*from_row(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document: mostly that with the smallest doc_id.

    Rows that are equal in all columns are one. Rows with a null doc_id, or one that other rows have too, are told apart by
    a hash of all their columns, which is their id here; it is below all others that are not negative, so such a
    row stays rather than another of its group. Null and empty texts are alike with nothing and stay.
    """
    repeated = written(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("again")), "repeated")
    known = docs.select(as_row(docs.columns), F.col("doc_id").alias("id"), "text")
    if not repeated.isEmpty():
        same = F.col("id").eqNullSafe(F.col("again"))
        # from -2**63 to -1
        own = F.shiftrightunsigned(F.xxhash64("row"), 1) - F.lit(2**63 - 1) - 1
        odd = known.join(repeated, same, "left_semi").select("row", "text").dropDuplicates(["row"])
        odd = odd.select("row", own.alias("id"), "text")
        known = written(known.join(repeated, same, "left_anti").unionByName(odd), "told-apart")
    found = jaccard_join.similarity_components(known.select(F.col("id").alias("doc_id"), "text"))
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct()
    return known.join(gone, "id", "left_anti").select(*from_row(docs.columns))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words or more that are met elsewhere; emptied ones go.

    A text that loses nothing, a null or empty one too, stays as it is; another has its words joined by single spaces, and
    its n_chars, where there is such a column, set anew. Of a row that comes twice both lose its long passages.
    """
    found = substring_dedup.remove_repeats(docs.select(as_row(docs.columns), "doc_id", "text"))
    cut = F.col("n_removed") > 0
    new = {c: F.col("row").getField(c) for c in docs.columns}
    new["text"] = F.when(cut, F.col("kept_text")).otherwise(new["text"])
    if "n_chars" in new:
        new["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(new["n_chars"]).cast("long")
    return found.where(~cut | (F.col("kept_text") != "")).select(*[value.alias(c) for c, value in new.items()])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source. Texts without words, null ones too, are taken with every epoch. Rows that are equal in doc_id, source
    and text are taken or left together.
    """
    found = mixing.mix(docs.select(as_row(docs.columns), "doc_id", "source", "text")).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return found.select("row", copies.alias("copy")).select(*from_row(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed one by one; a null doc_id is passed on.
    """
    found = packing.pack_texts(docs, tokenizer("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring", substring),
    ("mixture", mixture),
    ("packed", packed),
]

# Learned models and hashes of word sequences are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
