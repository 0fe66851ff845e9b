"""A corpus pipeline of five stages: language, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and all documents that the stage before it
kept; its result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glacierlens.llm import langid, mixing, neardup, packing, queries, secret_scan
from glacierlens.llm.tables import fresh, table, written

# a document is rejected where no language is found or none comes near
LEAST_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language; columns stay as they are."""
    predict = langid.predictor(langid.model(langid.profiles(docs.where(~langid.held_out(F.col("doc_id"))))))
    found = fresh(docs, "found")
    known = (F.col(f"{found}.lang_pred") != langid.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_LANGUAGE_SCORE)
    return docs.withColumn(found, predict("text")).where(known).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the one with the smallest id.

    Of rows that repeat a kept id and its shingle set, one stays; a kept id with different
    texts keeps one row of each.  Documents without an id all stay.
    """
    key = [fresh(docs, c) for c in ("kept_id", "text_a", "text_b")]
    found = neardup.link(docs).where("kept and doc_id is not null")
    one = found.groupBy("doc_id", "set_a", "set_b", "n_shingles").agg(F.min(F.struct("text_a", "text_b")).alias("one"))
    kept = one.select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "one.text_a", "one.text_b"), key, strict=True)])
    rows = docs.where("doc_id is not null").withColumns({k: x for k, x in zip(key, [F.col("doc_id"), *neardup.text_key(F.col("text"))], strict=True)})
    return rows.join(kept, key).dropDuplicates(key).select(docs.columns).unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; ``n_chars`` follows the text."""
    found = fresh(docs, "found")
    clean = docs.withColumn(found, secret_scan.secret_spans("text"))
    text = secret_scan.redact(F.col("text"), F.col(found))
    counted = F.when(F.size(found) > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long")
    return clean.withColumns({"text": text, "n_chars": counted}).drop(found).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights, repeated where an epoch is repeated."""
    return queries.mixed(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return queries.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language profiles, MinHash and byte-pair tokens aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
