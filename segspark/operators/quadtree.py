"""Overlay of boxes on a tree of cells that is grown from counts; no cell size is chosen by hand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.operators.spatial import BOX, spread_join
from segspark.session import scratch_dir

# The cells of a level are a quarter as wide as those of the level above, so a cell has 16 children.
BITS = 2
CELL = ["_level", "_cx", "_cy"]


def _widened(df: DataFrame, key: str, also_on: Sequence[str], p: str, tolerance: float) -> DataFrame:
    sign = {"x0": -1, "y0": -1, "x1": 1, "y1": 1}
    cols = [(F.col(c).cast("double") + sign[c] * tolerance).alias(p + c) for c in BOX]
    whole = F.lit(True)
    for c in BOX:
        whole = whole & F.col(p + c).isNotNull() & ~F.isnan(p + c)
    return df.select(F.col(key), *also_on, *cols).where(whole)


def _own_level(p: str, depth: int) -> Column:
    """The deepest level at which a box reaches no more than two cells either way."""
    extent = f"greatest({p}i1 - {p}i0, {p}j1 - {p}j0)"
    steps = " ".join(f"WHEN {extent} <= {1 << (BITS * k)} THEN {depth - k}" for k in range(depth))
    return F.expr(f"CASE {steps} ELSE 0 END")


def _cells_of(df: DataFrame, p: str, depth: int, least: int, keep: Sequence[str]) -> DataFrame:
    """One row per cell of a box at its own level and at the levels above, down from level ``least``."""
    at = lambda c: F.expr(f"shiftright({p}{c}, {BITS} * ({depth} - _level))")
    spread = lambda c: F.explode(F.sequence(at(c + "0"), at(c + "1")))
    df = df.withColumn("_level", F.explode(F.sequence(F.least(F.lit(least), p + "o"), p + "o")))
    df = df.withColumn("_cx", spread("i")).withColumn("_cy", spread("j"))
    return df.select(*keep, *CELL, (F.col("_level") == F.col(p + "o")).alias("_own"))


def _grown_leaves(entries: DataFrame, leaf_rows: int, depth: int) -> DataFrame:
    """Leaves of the tree: a cell is split while more than ``leaf_rows`` boxes of finer levels reach it."""
    spark = entries.sparkSession
    path = scratch_dir(spark, "crowded")
    entries.where(~F.col("_own")).groupBy(*CELL).count().where(F.col("count") > leaf_rows).select(*CELL).write.parquet(path)
    crowded = spark.read.parquet(path)
    inside = F.expr(f"inline(flatten(transform(sequence(0, {(1 << BITS) - 1}), i -> transform(sequence(0, {(1 << BITS) - 1}), "
                    f"j -> named_struct('_cx', (_cx << {BITS}) + i, '_cy', (_cy << {BITS}) + j)))))")
    children = crowded.select((F.col("_level") + 1).alias("_level"), inside)
    root = spark.range(1).select(F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_cx"), F.lit(0).cast("long").alias("_cy"))
    return children.unionByName(root).join(crowded, CELL, "left_anti")


def _in_leaves(df: DataFrame, p: str, key: str, routes: DataFrame, least: int, depth: int, salt: int) -> DataFrame:
    """Each box once in every leaf that it reaches."""
    e = _cells_of(df, p, depth, least, [c for c in df.columns if c != p + "o"])
    # A leaf above or at the own level is found as such, leaves further down by the cell of the own level.
    way = F.when(F.col("_own"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    e = e.withColumn("_way", F.explode(way)).drop("_own")
    e = e.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salt)).cast("int"))
    met = e.join(routes, ["_way", "_salt", *CELL]).drop("_way", "_salt", *CELL)
    shift = lambda c, d=0: f"shiftleft({c} + {d}, {BITS} * ({depth} - _leaf))"
    reached = (f"{p}i0 < {shift('_lx', 1)} AND {p}i1 >= {shift('_lx')} AND {p}j0 < {shift('_ly', 1)} AND {p}j1 >= {shift('_ly')}")
    return met.where(reached)


def grown_overlay_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, tolerance: float = 0.0, also_on: Sequence[str] = (),
                        leaf_rows: int = 1_000, depth: int = 10, salt: int = 32, hot: int = 20_000) -> DataFrame:
    """Pairs whose bounding boxes overlap with positive area, each pair once; the result of ``spatial.overlay_pairs``.

    The common area of all boxes is the root of a tree. A cell that more than ``leaf_rows`` boxes smaller than itself reach is split
    into 16, down to ``depth`` levels, so crowded places get small cells, empty ones stay whole, and the tree follows the data
    whatever its unit. Leaves cut the area without overlap; every box goes to all leaves that it reaches, and a pair is found in
    the leaf of the lower left corner of the common box. A large box is repeated only where small ones crowd. Cells
    are integers, so a corner on a border falls to the same side in every step. The number of split cells is at most
    ``4 * depth / leaf_rows`` of the number of boxes; they are written to the scratch folder and joined, not collected. Boxes look up
    their leaves under ``salt`` keys, so no task sees more than that share of the boxes of one cell; leaves that
    stay crowded (equal boxes) are cut into blocks on both sides (``hot``). Four bounds and the depth of the shallowest leaf
    reach the driver. Boxes with an unknown or infinite bound are in no pair; tables without boxes give no pairs.
    """
    also_on = list(also_on)
    a2, b2 = _widened(a, a_id, also_on, "_a", tolerance), _widened(b, b_id, also_on, "_b", 0.0)
    spark = a.sparkSession
    low, high = float("-inf"), float("inf")
    finite = lambda df, p: df.where(
        (F.least(*[p + c for c in BOX]) > low) & (F.greatest(*[p + c for c in BOX]) < high))
    a2, b2 = finite(a2, "_a"), finite(b2, "_b")
    plain = lambda df, p: df.select(*[F.col(p + c).alias(c) for c in BOX])
    edge = plain(a2, "_a").unionAll(plain(b2, "_b")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    x0, y0 = edge.x0 or 0.0, edge.y0 or 0.0
    span = max((edge.x1 or 0.0) - x0, (edge.y1 or 0.0) - y0) or 1.0
    top = (1 << (BITS * depth)) - 1

    def placed(df: DataFrame, p: str) -> DataFrame:
        at = lambda c, o: F.least(F.greatest(F.floor((F.col(p + c) - o) / span * (top + 1)), F.lit(0)), F.lit(top)).cast("long")
        df = df.withColumns({p + "i0": at("x0", x0), p + "j0": at("y0", y0), p + "i1": at("x1", x0), p + "j1": at("y1", y0)})
        # A box turned inside out overlaps nothing.
        df = df.where((F.col(p + "x0") <= F.col(p + "x1")) & (F.col(p + "y0") <= F.col(p + "y1")))
        return df.withColumn(p + "o", _own_level(p, depth))

    a3, b3 = placed(a2, "_a"), placed(b2, "_b")
    entries = _cells_of(a3, "_a", depth, 0, []).unionAll(_cells_of(b3, "_b", depth, 0, []))
    path = scratch_dir(spark, "leaves")
    _grown_leaves(entries, leaf_rows, depth).write.parquet(path)
    leaves = spark.read.parquet(path)
    least = leaves.agg(F.min("_level")).first()[0]
    leaf = leaves.select(F.col("_level").alias("_leaf"), F.col("_cx").alias("_lx"), F.col("_cy").alias("_ly"))
    up = F.expr(f"inline(transform(sequence(0, _leaf), l -> named_struct('_way', int(l < _leaf), '_level', l, "
                f"'_cx', shiftright(_lx, {BITS} * (_leaf - l)), '_cy', shiftright(_ly, {BITS} * (_leaf - l)))))")
    routes = leaf.select("_leaf", "_lx", "_ly", up).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    sides = []
    for df, p, key in ((a3, "_a", a_id), (b3, "_b", b_id)):
        # Written once: crowded leaves are counted before they are joined.
        path = scratch_dir(spark, "in-leaves")
        _in_leaves(df, p, key, routes, least, depth, salt).write.parquet(path)
        sides.append(spark.read.parquet(path))
    left, right = sides
    met = spread_join(left, right, ["_leaf", "_lx", "_ly", *also_on], hot, a_id, b_id)
    lx, ly = F.greatest("_ax0", "_bx0"), F.greatest("_ay0", "_by0")
    hx, hy = F.least("_ax1", "_bx1"), F.least("_ay1", "_by1")
    own = lambda i, c: F.expr(f"shiftright(greatest(_a{i}, _b{i}), {BITS} * ({depth} - _leaf)) = {c}")
    met = met.where((lx < hx) & (ly < hy) & own("i0", "_lx") & own("j0", "_ly"))
    return met.select(*also_on, a_id, b_id, ((hx - lx) * (hy - ly)).alias("box_overlap"))
