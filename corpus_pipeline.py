"""Five stages from raw documents to token ids; each reads what the one before it has written.

All stages keep the defined results of their operators: a null text is an empty one (the first stage rejects it), rows that repeat
are documents of their own until near-duplicates go, a null key is a key, and no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm import bpe, language, minmax, mixing, suffix_runs
from segspark.llm.common import documents, store, word_array

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least probability of the predicted language, in units of 1 / number of languages, which is that of a guess.
LEAST_SCORE = 1.2
#: Bytes of a repeated passage: about 50 words; 99 in 100 passages of 51 words of the four languages are longer.
PASSAGE = 224


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language that is at all likely, go."""
    network = language.fit(docs.filter(~language.held_out()))
    return language.classify(docs.select(*COLUMNS), network).filter(
        (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE / max(1, len(network.labels) if network else 1))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one with the least doc_id stays; of rows with one doc_id and text, one."""
    # A key without null on both sides: join and removal of repeated rows share one shuffle of the texts.
    kept = minmax.linked_documents(docs).filter((F.col("key") == F.col("least_key")) & (F.col("h") == F.col("least_h")))
    kept = store(kept.select(F.col("key").alias("_key"), F.col("h").alias("_h")).distinct(), "kept")
    plain = F.coalesce(F.col("doc_id"), F.lit(minmax.NO_KEY)).alias("_key")
    rows = docs.select(*COLUMNS, plain, minmax.text_hash("text").alias("_h")).join(kept, ["_key", "_h"], "left_semi")
    # Least by the other columns, so that the same row stays in every run.
    one = rows.groupBy("_key", "_h").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("_row"))
    return one.select(*[F.col(f"_row.{c}").alias(c) for c in COLUMNS])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE`` bytes that repeat are cut out of the texts; a character that is cut in two goes, too."""
    spans = suffix_runs.repeated_spans(docs, length=PASSAGE)[0].filter(F.size("removed") > 0)
    spans = store(spans.select(
        F.nullif("key", F.lit(suffix_runs.NO_KEY)).alias("_key"), F.col("h").alias("_h"), "removed"
    ).dropDuplicates(["_key", "_h"]), "removed")
    joined = docs.select(*COLUMNS).join(
        spans, F.col("doc_id").eqNullSafe(F.col("_key")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h")), "left")
    rest = joined.withColumn("_rest", suffix_runs.cut_text("text", "removed"))
    cut = F.col("removed").isNotNull()
    return rest.select(
        "doc_id", F.when(cut, F.col("_rest")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(cut, F.length("_rest").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; a document that is taken in part ends after those words."""
    # Rows that differ in nothing but their words are told apart by a hash of the text; equal rows share what they take.
    same = ["doc_id", "source", "size", "_h"]
    sized = docs.select(*COLUMNS, F.size(word_array(F.col("text"))).cast("long").alias("_size"), F.xxhash64("text").alias("_h"))
    narrow = sized.select("doc_id", "source", F.col("_size").alias("size"), "_h")
    taken = mixing.mix(narrow, row="_h").filter("taken > 0").groupBy(*same).agg(F.sum("taken").alias("taken"))
    # With the number of equal rows: what is taken of them goes to one of them.
    taken = store(taken.join(narrow.groupBy(*same).agg(F.count("*").alias("n")).toDF("_i", "_s", "_z", "_t", "n"), (
        F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s"))
        & (F.col("size") == F.col("_z")) & (F.col("_h") == F.col("_t")))).select(*same, "taken", "n"), "taken")
    rows = sized.join(taken.toDF("_id", "_src", "_n", "_t", "_taken", "_rows"), (
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src"))
        & (F.col("_size") == F.col("_n")) & (F.col("_h") == F.col("_t"))))
    one = rows.filter("_rows > 1").dropDuplicates(["_id", "_src", "_n", "_t"])
    rows = rows.filter("_rows = 1").unionByName(one)
    copies = F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size"))
    rows = rows.withColumn("_copy", F.explode(copies)).withColumn("_words", words.cast("int"))
    text = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(
        F.array_join(F.slice(word_array(F.col("text")), F.lit(1), F.col("_words")), " "))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and what they decode to."""
    file = bpe.tokenizer_path(bpe.TOKENIZER)
    coded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), file)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.bpe_decode("ids", file).alias("decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language), ("near_dedup", near_dedup), ("repeats", without_repeats), ("mix", mixed), ("tokens", token_ids)]
#: Networks, signatures and merges are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
