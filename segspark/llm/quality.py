"""Quality rules: surface counts and a log-likelihood ratio over hashed n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import documents, let, store, word_array

#: Buckets of hashed 1- and 2-grams.
BUCKETS = 10_000


def _repeated(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more; windows are compared by a 64-bit hash."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.when(i == 0, 5).otherwise(F.least(F.lit(5), p - F.get(places, i - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def twice(pairs: Column) -> Column:
        found = F.filter(pairs, lambda x, i: (
            F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False))))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def of(hashes: Column) -> Column:
        # Most texts repeat no window; only the others are sorted.
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, twice))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    return F.when(F.size(words) < 5, 0).otherwise(let(windows, of))


def _grams(words: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbouring words."""
    place = lambda *w: F.pmod(F.xxhash64(*w), F.lit(buckets)).cast("int")
    second = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(F.transform(words, lambda w: place(w)), F.transform(second, lambda w, i: place(F.get(words, i), w)))


def measures(text: Column, ratios: Column | None = None, buckets: int = BUCKETS) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and, with ``ratios``, score.

    Null text counts as empty: all counts 0, base_failed true, score 0. All of it happens within the row.
    """
    own = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(own, "\n"), lambda s: F.translate(s, " \t\x0b\f\r", "") != "")

    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        score = [] if ratios is None else [let(_grams(words, buckets), lambda g: (
            F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(ratios, b)) / F.greatest(F.size(g), F.lit(1)))).alias("score")]
        return let(_repeated(words).cast("long"), lambda repeated: F.struct(
            n.alias("n_words"),
            F.length(F.translate(own, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.length(own) - F.length(F.translate(own, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            ((n < 10) | (100 * repeated > 20 * n)).alias("base_failed"),
            *score))

    return let(word_array(text), of)


def _counts(docs: DataFrame, text: str, buckets: int, name: str) -> DataFrame:
    grams = let(word_array(F.col(text)), lambda w: _grams(w, buckets))
    return docs.select(F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def all_trusted(docs: DataFrame, trusted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of all trusted keys; a null key is never trusted. One plan at every size: both sides are shuffled."""
    keys = trusted.select(key).filter(F.col(key).isNotNull()).distinct()
    return docs.join(keys.hint("merge"), key, "left_semi")


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row with ``ratios``: log p(bucket | trusted) - log p(bucket | all) for each bucket, add-one smoothed.

    The raw multinomial is counted over every document of ``docs``, the target over the documents ``trusted``.
    Counting is partial in each task, so ``buckets`` rows per task are shuffled, whatever the corpus.
    """
    target, raw = (_counts(d, text, buckets, n) for d, n in ((trusted, "t"), (docs, "r")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw, "bucket", "left").join(target, "bucket", "left").select(
        "bucket", (F.coalesce("t", F.lit(0)) + 1).alias("t"), (F.coalesce("r", F.lit(0)) + 1).alias("r"))
    one = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "t", "r"))).alias("c"),
                   F.sum("t").alias("nt"), F.sum("r").alias("nr"))
    ratio = F.transform("c", lambda x: F.log(x["t"] / F.col("nt")) - F.log(x["r"] / F.col("nr")))
    return one.select(F.when(F.col("nt") > buckets, ratio).otherwise(F.transform("c", lambda x: F.lit(0.0))).alias("ratios"))


def _scored(docs: DataFrame, ratios: DataFrame, text: str, buckets: int) -> DataFrame:
    named = docs.withColumn("_ratios", ratios.select("ratios").scalar())
    return named.withColumn("_m", measures(F.col(text), F.col("_ratios"), buckets)).drop("_ratios").select("*", "_m.*").drop("_m")


def quality_filter(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
    least: float | None = None, with_text: bool = True,
) -> DataFrame:
    """Adds the base counts, ``score`` (mean log ratio of the document's n-grams) and ``kept``.

    ``trusted``: a column of keys. A document is kept if the base rules pass and its score is at least
    ``least``; no randomness. If not given, ``least`` lies as far below the lowest thousandth of the trusted
    documents' scores (to four decimals) as that lies below their median, so it adapts to how sharp the counts are. Target and
    threshold come from every trusted document; the rows are then written with their scores, without the text
    unless ``with_text``.
    A document without words has score 0 and fails the base rules. Without trusted documents there is no
    target: every score is 0 and the base rules decide. Repeated rows are scored each; the table of ratios
    has ``buckets`` numbers and comes as one value.
    """
    ratios = store(log_ratios(docs, all_trusted(docs, trusted, key), text, buckets), "ratios")
    scored = _scored(docs, ratios, text, buckets)
    scored = scored if with_text else scored.drop(text)
    if least is None:
        scored = store(scored, "scores")
        passing = all_trusted(scored.filter(~F.col("base_failed")).select(key, "score"), trusted, key)
        # A histogram, whose length depends on the range of the scores alone.
        bins = passing.groupBy(F.round("score", 4).alias("score")).agg(F.count("*").alias("n"))
        low, mid = bins.agg(*[F.percentile("score", F.lit(p), F.col("n")) for p in (0.001, 0.5)]).first()
        least = 2 * low - mid if low is not None else float("-inf")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return quality_filter(docs, trusted, with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("score", 6).alias("score"))


QUERIES = {"op10_ngram_ratio_quality": (q_quality, None)}
