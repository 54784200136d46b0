"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.llm.common import WORD, documents, running_total, store

#: Weights of the sources in code point order, repeating; share of all words to draw; most copies of a source.
WEIGHTS, SHARE, COPIES = (5.0, 2.0, 1.0), 1.5, 2


def source_targets(
    sizes: DataFrame, source: str = "source", size: str = "size",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, copies: int = COPIES,
) -> DataFrame:
    """One row per source: its number in code point order (null last), ``source_size``, ``target`` in words.

    ``share`` times all words are shared by weight; a source stops at ``copies`` times its words and what
    it cannot take is shared again by weight, until none is above. The level at which this ends is found
    by filling sources in order of (most words / weight): one sorted pass over one row per source.
    """
    if share > copies:
        raise ValueError("more words are asked for than all copies have")
    by_source = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    # One row per source from here on; the windows over all of them hold no document.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(source).asc_nulls_last())
    numbered = by_source.withColumn("source_no", (F.row_number().over(order) - 1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    fill = every.orderBy((F.col("most") / F.col("weight")), "source_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    return (
        numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * copies)
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        # Level if all sources before this one are full; it rises to the first open source and falls after it.
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
                    / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("open", F.col("weight") * F.col("level") < F.col("most"))
        .withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(every))
        .withColumn("target", F.least(F.col("most").cast("double"),
                                      F.coalesce(F.col("weight") * F.col("final"), F.col("most").cast("double"))))
        .select(F.col(source).alias("_source"), "source_no", "source_size", "target")
    )


def mix(
    df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", seed: str = "mix",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, copies: int = COPIES, row: str | None = None,
) -> DataFrame:
    """Words that the mix takes of each row: key, size, source, source_size, target, ``taken`` and, where given, ``row``.

    ``df``: one narrow row per document. Documents of a source queue in an order given by a hash of
    (seed, key), its second copy after its first. A document's virtual finish time is the words of its
    source up to and with it, divided by the source's target, so all sources reach their targets at
    time 1 together. The document that stands across the target is cut in two at the target. All pieces are
    range-sorted by finish time and those within the total budget are taken.

    A null source is a source of its own and comes last; null keys and repeated rows are separate documents;
    a document without words takes none; no rows give no rows. The same rows give the same mix in any order.
    ``row``: a column (long, not null) that tells rows of one key and size apart; it orders them and is given back.
    """
    # `_row` tells equal rows apart, so that no order below has ties that matter.
    narrow = store(
        df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(size).cast("long").alias("_size"),
                  *([F.col(row).alias("_own")] if row else [])), "sizes"
    )
    targets = store(source_targets(narrow, "_source", "_size", weights, share, copies), "targets")
    rows = (
        narrow.join(
            targets.select(F.col("_source").alias("_s"), "source_no", "source_size", "target"),
            F.col("_source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_turn", F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("_key").cast("string"), F.lit("")))))
    )
    queued = store(
        running_total(rows, "source_no", ["_turn", "_key", "_size", *(["_own"] if row else [])], "_size", "_start")
        .withColumn("_row", F.monotonically_increasing_id()), "queue")
    limit = F.floor("target").cast("long")
    pieces = (
        queued.filter("_size > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("_begin", F.col("_start") + F.col("_copy") * F.col("source_size"))
        .withColumn("_head", F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), limit - F.col("_begin"))))
        # A piece up to the target and a piece beyond it; most documents are one of the two.
        .withColumn("_piece", F.explode(F.array(
            F.struct(F.col("_head").alias("n"), (F.col("_begin") + F.col("_head")).alias("end")),
            F.struct((F.col("_size") - F.col("_head")).alias("n"), (F.col("_begin") + F.col("_size")).alias("end")))))
        .filter("_piece.n > 0")
        .select("_row", "_copy", "source_no", F.col("_piece.n").alias("_n"),
                F.when(F.col("_piece.end") >= limit, F.lit(1.0) + (F.col("_piece.end") - limit) / F.greatest(limit, F.lit(1)))
                .otherwise(F.col("_piece.end") / F.col("target")).alias("_finish"))
    )
    sent = running_total(pieces, None, ["_finish", "source_no", "_copy", "_row", "_n"], "_n", "_before")
    budget = targets.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0)).cast("long")).first()[0]
    taken = (
        sent.filter(F.col("_before") < budget)
        .groupBy("_row").agg(F.sum(F.least(F.col("_n"), F.lit(budget) - F.col("_before"))).alias("taken"))
    )
    return queued.join(taken, "_row", "left").select(
        F.col("_key").alias(key), F.col("_size").alias(size), F.col("_source").alias(source), "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "_start",
        *([F.col("_own").alias(row)] if row else []))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def q_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (no % 3 + 1)::INT) AS weight, 2 * source_size AS most
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source)
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lev
  FROM s WINDOW w AS (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce(weight * f, most::DOUBLE)) AS target
  FROM (SELECT *, max(CASE WHEN weight * lev < most THEN lev END) OVER () AS f FROM l)
), q AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS lim,
    (sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix/' || coalesce(doc_id::VARCHAR, '')), doc_id, size
      ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, lim - b)) + greatest(0, least(size, lim - b - source_size)))::BIGINT AS taken
FROM q
"""

QUERIES = {"op7_fair_queue_mix": (q_mix, SQL)}
