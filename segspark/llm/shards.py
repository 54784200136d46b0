"""Shard assignment by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import documents, running_total, utf8_bytes

#: (region, rack, shard, weight): two regions of two racks of two shards.
TREE = [(s // 4, s // 2, s, 1.0) for s in range(8)]
#: One more shard, in a region of its own: at the root only draws for the new region are new.
GROWN = [*TREE, (2, 4, 8, 1.0)]


def _level(key: Column, level: str, nodes: Sequence[tuple[int, int, float]], parent: Column) -> Column:
    """The child of ``parent`` with the least weighted draw; nodes: (parent, child, weight)."""
    draws = [
        F.struct(
            # Exponential draw with the node's weight as rate: the least of them wins in proportion to weight.
            (-F.log((F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{level}{child}"))), 1, 12), 16, 10).cast("long")
                     + 0.5) / float(2**48)) / weight).alias("draw"),
            F.lit(child).alias("node"), F.lit(above).alias("above"),
        )
        for above, child, weight in nodes
    ]
    # A branch for each parent, so only the draws of the subtree that was entered are evaluated.
    choice = None
    for above in sorted({n[0] for n in nodes}):
        own = F.array_min(F.array(*[d for d, n in zip(draws, nodes) if n[0] == above]))["node"]
        choice = F.when(parent == above, own) if choice is None else choice.when(parent == above, own)
    return choice


def assign_shards(
    df: DataFrame, key: str, tree: Sequence[tuple[int, int, int, float]], out: str = "shard"
) -> DataFrame:
    """Adds ``out``, the shard of each row, found by descending region, rack and shard.

    At each level every child draws a number from a hash of (key, child), scaled by its weight (the
    sum of the shards below it); the least wins. A change of weights below one node moves rows only
    into or out of the subtrees whose weights change. Only the key and the tree decide: no shuffle,
    no state, the same in every run. A null key counts as the empty text, repeated keys share a shard.
    """
    if not tree or any(w <= 0 for *_, w in tree) or len({s for _, _, s, _ in tree}) < len(tree):
        raise ValueError("the tree needs distinct shards with weights above 0")
    regions, racks, shards = {}, {}, []
    for region, rack, shard, weight in tree:
        regions[0, region] = regions.get((0, region), 0.0) + weight
        racks[region, rack] = racks.get((region, rack), 0.0) + weight
        shards.append((rack, shard, weight))
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found = df.withColumn("_node", F.lit(0))
    for level, nodes in (
        ("region", [(*k, w) for k, w in regions.items()]),
        ("rack", [(*k, w) for k, w in racks.items()]),
        ("shard", shards),
    ):
        found = found.withColumn("_node", _level(text, level, nodes, F.col("_node")))
    return found.withColumn(out, F.col("_node").cast("int")).drop("_node")


def number_in_shards(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Adds ``out``: places 0, 1, 2, ... without gaps within each shard, in ``order``."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), shard, order, "_one", out).drop("_one")


def q_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``key``: doc_id and the tree decide; the ninth shard takes rows only into itself."""
    rows = documents(spark, sf_dir).select(
        "doc_id", utf8_bytes(F.col("text")).alias("bytes"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(assign_shards(rows, "doc_id", TREE), "doc_id", GROWN, "grown_shard")
    numbered = number_in_shards(placed, "shard", ["doc_id", "text_crc32", "bytes"])
    return numbered.select(
        "doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        "grown_shard",
    )


def _node_sql(level: str, parent: str, nodes: list[tuple[int, int, float]]) -> str:
    draw = (
        "-ln((('0x' || substr(md5(k || '/{level}{child}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0) / {weight}"
    )
    cases = []
    for above in sorted({n[0] for n in nodes}):
        own = [n for n in nodes if n[0] == above]
        items = ", ".join(
            "{'draw': " + draw.format(level=level, child=c, weight=float(w)) + f", 'node': {c}" + "}" for _, c, w in own
        )
        cases.append(f"WHEN {parent} = {above} THEN list_min([{items}]).node")
    return "CASE " + " ".join(cases) + " END"


def _tree_sql(name: str, tree: list[tuple[int, int, int, float]]) -> str:
    regions, racks = {}, {}
    for region, rack, _, weight in tree:
        regions[0, region] = regions.get((0, region), 0.0) + weight
        racks[region, rack] = racks.get((region, rack), 0.0) + weight
    return f"""
{name}1 AS (SELECT *, {_node_sql('region', '0', [(*k, w) for k, w in regions.items()])} AS a FROM keyed),
{name}2 AS (SELECT *, {_node_sql('rack', 'a', [(*k, w) for k, w in racks.items()])} AS b FROM {name}1),
{name} AS (SELECT r, {_node_sql('shard', 'b', [(t[1], t[2], t[3]) for t in tree])} AS s FROM {name}2)"""


SQL = f"""
WITH bits AS (
  SELECT v, list_reduce(list_prepend(v, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
  FROM (SELECT unnest(range(256)) AS v)
), tab AS (SELECT list(t ORDER BY v) AS t FROM bits),
keyed AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, ''))) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM documents, tab
), {_tree_sql('old', TREE)}, {_tree_sql('new', GROWN)}
SELECT doc_id, (n + 1)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, old.s::INT AS shard,
  row_number() OVER (PARTITION BY old.s ORDER BY doc_id NULLS FIRST, crc, n) - 1 AS slot, new.s::INT AS grown_shard
FROM keyed JOIN old USING (r) JOIN new USING (r)
"""

QUERIES = {"op6_hash_tree_shards": (q_shards, SQL)}
