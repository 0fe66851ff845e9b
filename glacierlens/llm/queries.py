"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glacierlens.llm import align, ann, chat, edit_counts, langid, mixing, neardup, packing, prefix_trie, quality, recompress, secret_scan, toxicity
from glacierlens.llm.tables import fresh, table


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every query vector (id divisible by 20) by inner product."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents."""
    return neardup.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a window of a smaller document."""
    found = recompress.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and distribution divergence of every document."""
    docs = table(spark, sf_dir, "documents")
    found = quality.judge(docs, quality.references(docs))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after personal data is replaced."""
    return edit_counts.count_edited(table(spark, sf_dir, "documents"), edit_counts.redactions("text"))


# target weights: domains are halves of the sources by number; languages within a domain
# by this table and 1 for any other; sources of a language all alike
DOMAIN_WEIGHTS = {"web": 0.6, "books": 0.4}
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
MIX_TOTAL = 0.8


def _domain(source):
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1).try_cast("long")
    return F.when(F.coalesce(number, F.lit(0)) % 20 < 10, "web").otherwise("books")


def _weight(path: tuple) -> float:
    if len(path) == 1:
        return DOMAIN_WEIGHTS.get(path[0], 0.0)
    return LANGUAGE_WEIGHTS.get(path[1], 1.0) if len(path) == 2 else 1.0


def mixed(docs: DataFrame) -> DataFrame:
    """Documents mixed to the target weights, with ``epoch`` and the token count."""
    domain = fresh(docs, "domain")
    tree = docs.withColumn(domain, _domain(F.col("source")))
    return mixing.mix(tree, [domain, "lang", "source"], MIX_TOTAL, _weight)


def op10_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in each epoch of the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "epoch", "domain", "lang", "source", "n_tokens")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of documents with their place in a training sequence."""
    pieces = packing.pieces(docs)
    placed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", secret_scan.secret_spans("text").alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "dense")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return docs.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    predict = langid.predictor(langid.model(langid.profiles(docs.where(~out))))
    found = docs.select("doc_id", out.alias("held_out"), predict("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizations of every document."""
    return align.scored(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    trie = prefix_trie.build(*prefix_trie.rebuilt(prefix_trie.numbered(table(spark, sf_dir, "conversations"))))
    nodes = trie.nodes.join(prefix_trie.digests(trie.ends), "node", "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def queries() -> dict:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {"op2_perspective_rotation": chat.SQL, "op13_prefix_trie": prefix_trie.SQL}
