"""Overlay of shapes of several parts and with holes, cut into trapezoids by built-in expressions.

A shape is ``array<array<ring>>``: its parts, each an outer ring followed by its holes, rings as in
``spatial``. Rings may run in either direction. Parts of one shape do not overlap. A null shape, a shape
without parts and rings of fewer than three vertices cover nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.operators.spatial import ring_edges
from segspark.session import scratch_dir

#: Slabs and trapezoids thinner than this, relative to the coordinates, are rounding errors of crossings.
THIN = 1e-12


def _twice_signed_area(ring: Column) -> Column:
    """Positive for a ring that runs counter-clockwise."""
    first = ring[0]
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, after, lambda p, q: (p["x"] - first["x"]) * (q["y"] - first["y"]) - (q["x"] - first["x"]) * (p["y"] - first["y"]))
    return F.aggregate(cross, F.lit(0.0), lambda acc, c: acc + c)


def directed_rings(shape: Column) -> Column:
    """All rings of a shape; outer rings run counter-clockwise, holes clockwise."""

    def directed(ring: Column, i: Column) -> Column:
        return F.when((_twice_signed_area(ring) >= 0) == (i == 0), ring).otherwise(F.reverse(ring))

    rings = F.flatten(F.transform(shape, lambda part: F.transform(part, directed)))
    return F.filter(rings, lambda ring: F.size(ring) >= 3)


def shape_area(shape: Column) -> Column:
    """Area of the parts without their holes; null for a null shape."""
    signed = F.transform(directed_rings(shape), _twice_signed_area)
    return F.aggregate(signed, F.lit(0.0), lambda acc, a: acc + a) / 2.0


def with_shape_bounds(df: DataFrame, shape: str = "shape") -> DataFrame:
    """Bounding box columns x0, y0, x1, y1 of all rings of a shape."""
    points = F.flatten(F.flatten(F.col(shape)))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return df.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})


def _y_at(x: Column, xl: Column, xr: Column, yl: Column, yr: Column) -> Column:
    return F.when(x == xl, yl).when(x == xr, yr).otherwise(yl + (yr - yl) / (xr - xl) * (x - xl))


def overlay_pieces(pairs: DataFrame, a: DataFrame, b: DataFrame, a_id: str, b_id: str, strip: float,
                   a_shape: str = "shape", b_shape: str = "shape") -> DataFrame:
    """The common piece of every pair of shapes, as trapezoids with vertical sides.

    Columns: both ids, ``xl``, ``xr`` (sides), ``bl``, ``br`` (bottom at the left and right side), ``tl``, ``tr``
    (top). Trapezoids of a pair do not overlap; a pair that shares no area has none.

    Edges meet in vertical strips of width ``strip`` that both boxes reach. Inside a strip the ends and crossings
    of the edges cut slabs in which no two edges cross; from bottom to top of a slab, running sums of the edges'
    directions tell where both shapes are. Work is equi-joins on (pair, strip); a window holds the edges of one
    pair in one slab. Choose ``strip`` of the size of the smaller shapes' extent: edges of one pair in one strip are
    compared with each other.
    """
    edges = []
    for df, key, shape in ((a, a_id, a_shape), (b, b_id, b_shape)):
        rings = df.select(key, F.explode(directed_rings(F.col(shape))).alias("_ring"))
        edges.append(ring_edges(rings, key, "_ring", strip, "_"))
    bounds = lambda df, key, shape, p: with_shape_bounds(df.select(key, shape), shape).select(
        key, *[F.col(c).alias(p + c) for c in ("x0", "x1", "y1")])
    first, last = F.greatest("_ax0", "_bx0"), F.least("_ax1", "_bx1")
    width = float(strip)
    reached = (
        pairs.select(a_id, b_id).distinct().join(bounds(a, a_id, a_shape, "_a"), a_id).join(bounds(b, b_id, b_shape, "_b"), b_id)
        .where(first < last)
        .select(a_id, b_id, first.alias("_from"), last.alias("_to"), F.least("_ay1", "_by1").alias("_top"),
                F.explode(F.sequence(F.floor(first / width), F.floor(last / width))).alias("_strip"))
    )
    # Edges beside the common range of x, or above the lower of the two tops, bound no common area.
    useful = (F.col("_xl") < F.col("_to")) & (F.col("_xr") > F.col("_from")) & (F.least("_yl", "_yr") <= F.col("_top"))
    ends = ["_xl", "_xr", "_yl", "_yr"]
    of, held = [a_id, b_id, "_strip"], [a_id, b_id, "_strip", "_from", "_to", "_in_a", "_in_b", *ends]
    zero = F.lit(0.0)
    both = reached.join(edges[0], [a_id, "_strip"]).where(useful).withColumns({"_in_a": F.col("_s"), "_in_b": zero}).select(*held).unionByName(
        reached.join(edges[1], [b_id, "_strip"]).where(useful).withColumns({"_in_a": zero, "_in_b": F.col("_s")}).select(*held))
    # Written once: ends, crossings and slabs all start from these edges.
    path = scratch_dir(pairs.sparkSession, "edges")
    both.write.parquet(path)
    both = pairs.sparkSession.read.schema(both.schema).parquet(path)

    left = both.where("_in_a <> 0").select(*of, *[F.col(c).alias("_a" + c) for c in ends])
    right = both.where("_in_b <> 0").select(*of, *[F.col(c).alias("_b" + c) for c in ends])
    l, r = F.greatest("_a_xl", "_b_xl"), F.least("_a_xr", "_b_xr")
    gap = lambda x: _y_at(x, *[F.col("_a" + c) for c in ends]) - _y_at(x, *[F.col("_b" + c) for c in ends])
    crossed = left.join(right, of).where(l < r).select(*of, l.alias("_l"), r.alias("_r"), gap(l).alias("_gl"), gap(r).alias("_gr"))
    crossed = crossed.where(F.col("_gl") * F.col("_gr") < 0).select(
        *of, (F.col("_l") + (F.col("_r") - F.col("_l")) * F.col("_gl") / (F.col("_gl") - F.col("_gr"))).alias("_x"))

    inside = lambda c: F.least(F.greatest(F.col(c), F.col("_from")), F.col("_to"))
    cuts = both.select(*of, F.explode(F.array(inside("_xl"), inside("_xr"))).alias("_x")).unionByName(crossed).distinct()
    slabs = cuts.withColumn("_next", F.lead("_x").over(Window.partitionBy(*of).orderBy("_x")))
    scale = F.greatest(F.abs("_x"), F.abs("_next"), F.lit(1.0))
    slabs = slabs.where(F.col("_next") - F.col("_x") > THIN * scale)

    across = both.join(slabs, of).where((F.col("_xl") <= F.col("_x")) & (F.col("_xr") >= F.col("_next"))).select(
        *of, "_in_a", "_in_b", F.col("_x").alias("xl"), F.col("_next").alias("xr"),
        _y_at(F.col("_x"), *[F.col(c) for c in ends]).alias("bl"), _y_at(F.col("_next"), *[F.col(c) for c in ends]).alias("br"))
    up = Window.partitionBy(*of, "xl").orderBy(F.col("bl") + F.col("br"), "bl", "_in_a", "_in_b")
    below = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = across.withColumns({
        "_a": F.sum("_in_a").over(below), "_b": F.sum("_in_b").over(below), "tl": F.lead("bl").over(up), "tr": F.lead("br").over(up)})
    height = F.col("tl") + F.col("tr") - F.col("bl") - F.col("br")
    return stacked.where((F.col("_a") != 0) & (F.col("_b") != 0) & (height > THIN * F.greatest(F.abs("tl"), F.abs("bl"), F.lit(1.0)))).select(
        a_id, b_id, "xl", "xr", "bl", "br", "tl", "tr")


def piece_measures(pieces: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Area and centroid (``cx``, ``cy``) of the common piece of each pair that has one."""
    w, hl, hr = F.col("xr") - F.col("xl"), F.col("tl") - F.col("bl"), F.col("tr") - F.col("br")
    squares = lambda p, q: F.col(p) * F.col(p) + F.col(p) * F.col(q) + F.col(q) * F.col(q)
    area = w * (hl + hr) / 2.0
    x_moment = F.col("xl") * area + w * w * (hl + 2.0 * hr) / 6.0
    y_moment = w * (squares("tl", "tr") - squares("bl", "br")) / 6.0
    total = pieces.groupBy(a_id, b_id).agg(F.sum(area).alias("area"), F.sum(x_moment).alias("_mx"), F.sum(y_moment).alias("_my"))
    return total.select(a_id, b_id, "area", (F.col("_mx") / F.col("area")).alias("cx"), (F.col("_my") / F.col("area")).alias("cy"))
