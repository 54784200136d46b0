"""Polygon area, overlay and adjacency with built-in expressions only.

Polygons are simple rings, ``array<struct<x: double, y: double>>``, not closed (the last vertex
differs from the first). Coordinates are planar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.operators.ranking import first_per_group, max_with_ties

BOX = ("x0", "y0", "x1", "y1")


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The four corners of a box, counter-clockwise."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def ring_area(ring: Column) -> Column:
    """Shoelace area; coordinates are taken from the first vertex to keep digits."""
    first = ring[0]
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(
        ring, after,
        lambda p, q: (p["x"] - first["x"]) * (q["y"] - first["y"])
        - (q["x"] - first["x"]) * (p["y"] - first["y"]),
    )
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, c: acc + c)) / 2.0


def with_bounds(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Bounding box columns x0, y0, x1, y1 of a ring."""
    xs = F.transform(F.col(ring), lambda p: p["x"])
    ys = F.transform(F.col(ring), lambda p: p["y"])
    return df.withColumns({
        "x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys),
    })


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: int,
                left_id: str, right_id: str) -> DataFrame:
    """Inner equi-join whose crowded keys are cut into blocks on both sides.

    A key with more than ``hot`` rows on a side is split there by a hash of the row id, and
    the other side is repeated for every part, so each pair of parts is a task's worth of work
    and every pair of rows still meets exactly once. Other keys are joined as they are. The
    two inputs must not share column names other than ``keys``.
    """
    tally = left.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(
        right.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    crowded = (
        tally.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
        .where((F.col("_a") > hot) | (F.col("_b") > hot))
        .where((F.col("_a") > 0) & (F.col("_b") > 0))
        .select(*keys, F.ceil(F.col("_a") / hot).cast("int").alias("_sa"),
                F.ceil(F.col("_b") / hot).cast("int").alias("_sb"))
    )
    sa = F.coalesce(F.col("_sa"), F.lit(1))
    sb = F.coalesce(F.col("_sb"), F.lit(1))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = left.join(crowded, list(keys), "left").withColumn("_pa", F.pmod(F.xxhash64(left_id), sa).cast("int"))
    a = a.withColumn("_pb", spread(sb)).drop("_sa", "_sb")
    b = right.join(crowded, list(keys), "left").withColumn("_pb", F.pmod(F.xxhash64(right_id), sb).cast("int"))
    b = b.withColumn("_pa", spread(sa)).drop("_sa", "_sb")
    return a.join(b, [*keys, "_pa", "_pb"]).drop("_pa", "_pb")


def _cells(df: DataFrame, prefix: str, size: Column) -> DataFrame:
    """The grid cells a box touches, one row each."""
    at = lambda c: F.floor(F.col(prefix + c) / size)
    df = df.withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1"))))
    return df.withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))


def overlay_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float,
                  n_levels: int = 4, ratio: int = 4, tolerance: float = 0.0,
                  also_on: Sequence[str] = (), hot: int = 20_000) -> DataFrame:
    """Pairs whose bounding boxes overlap with positive area, each pair once.

    An equi-join on grid cells replaces the nested loop a box predicate would cost. The grid
    has ``n_levels`` cell sizes, ``cell * ratio**level``; a box belongs to the first level whose
    cells are as large as the box and is looked up there and at coarser levels, so neither a
    small nor a huge box is spread over many cells. A pair is found at the coarser of its two
    levels, in the cell of the lower left corner of the common box, hence exactly once.
    ``tolerance`` widens the boxes of ``a``; ``also_on`` adds equal columns, such as a state.
    """
    keep = [*BOX]
    a2 = a.select(F.col(a_id), *also_on, *[F.col(c).alias("_a" + c) for c in keep])
    if tolerance:
        sign = {"x0": -1, "y0": -1, "x1": 1, "y1": 1}
        a2 = a2.withColumns({"_a" + c: F.col("_a" + c) + s * tolerance for c, s in sign.items()})
    b2 = b.select(F.col(b_id), *also_on, *[F.col(c).alias("_b" + c) for c in keep])
    sizes = [float(cell) * ratio**i for i in range(n_levels)]

    def own_level(p: str) -> Column:
        extent = F.greatest(F.col(p + "x1") - F.col(p + "x0"), F.col(p + "y1") - F.col(p + "y0"))
        level = F.lit(n_levels - 1)
        for i in reversed(range(n_levels - 1)):
            level = F.when(extent <= sizes[i], F.lit(i)).otherwise(level)
        return level

    def placed(df: DataFrame, p: str, above_own: int) -> DataFrame:
        """Way 0 and way 1 of meeting; ``above_own`` is the way in which coarser cells count."""
        own, top = own_level(p), F.lit(n_levels - 1)
        coarser = F.sequence(own, top) if p == "_a" else F.when(own < top, F.sequence(own + 1, top))
        at_own = F.array(own)
        ways = {above_own: coarser, 1 - above_own: at_own}

        def tagged(w: int) -> Column:
            levels = F.coalesce(ways[w], F.array().cast("array<int>"))
            return F.transform(levels, lambda lv: F.struct(F.lit(w).alias("w"), lv.alias("lv")))

        entries = F.concat(tagged(0), tagged(1))
        df = df.withColumn("_e", F.explode(entries))
        df = df.withColumn("_way", F.col("_e.w")).withColumn("_level", F.col("_e.lv")).drop("_e")
        size = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("_level") + 1)
        return _cells(df, p, size)

    # Way 0: b at its own level, a there or finer. Way 1: a at its own level, b finer.
    left, right = placed(a2, "_a", 0), placed(b2, "_b", 1)
    keys = ["_way", "_level", "_cx", "_cy", *also_on]
    met = spread_join(left, right, keys, hot, a_id, b_id)
    lx, ly = F.greatest("_ax0", "_bx0"), F.greatest("_ay0", "_by0")
    hx, hy = F.least("_ax1", "_bx1"), F.least("_ay1", "_by1")
    size = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("_level") + 1)
    met = met.where(
        (lx < hx) & (ly < hy)
        & (F.floor(lx / size) == F.col("_cx")) & (F.floor(ly / size) == F.col("_cy"))
    )
    return met.select(*also_on, a_id, b_id, ((hx - lx) * (hy - ly)).alias("box_overlap"))


def ring_edges(df: DataFrame, key: str, ring: str, strip: float, prefix: str) -> DataFrame:
    """Non-vertical edges of every ring, cut at the borders of vertical strips of a fixed width.

    Each piece lies in one strip and carries the direction in which the ring runs through it.
    """
    n = F.size(ring)
    nxt = F.element_at(F.col(ring), F.when(F.col("_i") + 1 < n, F.col("_i") + 2).otherwise(1))
    e = df.select(key, ring, F.posexplode(ring).alias("_i", "_p"))
    e = e.select(key, F.col("_p.x").alias("ax"), F.col("_p.y").alias("ay"),
                 nxt["x"].alias("bx"), nxt["y"].alias("by"))
    e = e.where(F.col("ax") != F.col("bx"))
    fwd = F.col("ax") < F.col("bx")
    pick = lambda c, d: F.when(fwd, F.col(c)).otherwise(F.col(d))
    e = e.select(key, F.when(fwd, 1.0).otherwise(-1.0).alias("s"), pick("ax", "bx").alias("xl"),
                 pick("ay", "by").alias("yl"), pick("bx", "ax").alias("xr"), pick("by", "ay").alias("yr"))
    w = float(strip)
    e = e.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("xl") / w), F.floor(F.col("xr") / w))))
    lo, hi = F.greatest(F.col("xl"), F.col("_strip") * w), F.least(F.col("xr"), (F.col("_strip") + 1) * w)

    def y_at(x: Column) -> Column:
        slope = (F.col("yr") - F.col("yl")) / (F.col("xr") - F.col("xl"))
        return F.when(x == F.col("xl"), F.col("yl")).when(x == F.col("xr"), F.col("yr")).otherwise(
            F.col("yl") + slope * (x - F.col("xl"))
        )

    return e.where(lo < hi).select(
        key, "_strip", F.col("s").alias(prefix + "s"), lo.alias(prefix + "xl"), hi.alias(prefix + "xr"),
        y_at(lo).alias(prefix + "yl"), y_at(hi).alias(prefix + "yr"),
    )


def ring_overlap_area(pairs: DataFrame, a: DataFrame, b: DataFrame, a_id: str, b_id: str,
                      strip: float, a_ring: str = "ring", b_ring: str = "ring") -> DataFrame:
    """Common area of the two simple rings of every pair.

    At each x, the signed crossings of a ring add up to 0, and the length of the common
    vertical section is minus half the sum of ``s_a s_b |y_a - y_b|`` over the crossings of both. So
    the area is a sum over edge pairs with overlapping x ranges of a closed-form integral: an
    equi-join on (polygon, strip) and a sum, for convex and non-convex rings alike.
    """
    ea = ring_edges(a, a_id, a_ring, strip, "_a_")
    eb = ring_edges(b, b_id, b_ring, strip, "_b_")
    # Only the strips that both polygons reach: no pair is multiplied by edges outside them.
    width = float(strip)
    reach = lambda df, key, ring, p: df.select(
        key, F.array_min(F.transform(ring, lambda q: q["x"])).alias(p + "0"), F.array_max(F.transform(ring, lambda q: q["x"])).alias(p + "1"))
    first, last = F.greatest("_ra0", "_rb0"), F.least("_ra1", "_rb1")
    strips = (
        pairs.select(a_id, b_id).join(reach(a, a_id, a_ring, "_ra"), a_id).join(reach(b, b_id, b_ring, "_rb"), b_id).where(first <= last)
        .select(a_id, b_id, F.explode(F.sequence(F.floor(first / width), F.floor(last / width))).alias("_strip"))
    )
    m = strips.join(ea, [a_id, "_strip"]).join(eb, [b_id, "_strip"])
    l, r = F.greatest("_a_xl", "_b_xl"), F.least("_a_xr", "_b_xr")

    def y_at(p: str, x: Column) -> Column:
        xl, xr, yl, yr = (F.col(f"_{p}_{c}") for c in ("xl", "xr", "yl", "yr"))
        return F.when(x == xl, yl).when(x == xr, yr).otherwise(yl + (yr - yl) / (xr - xl) * (x - xl))

    m = m.where(l < r).select(
        a_id, b_id, (F.col("_a_s") * F.col("_b_s")).alias("s"), (r - l).alias("w"),
        (y_at("a", l) - y_at("b", l)).alias("dl"), (y_at("a", r) - y_at("b", r)).alias("dr"),
    )
    al, ar = F.abs("dl"), F.abs("dr")
    crossing = F.col("dl") * F.col("dr") < 0
    gap = F.when(crossing, F.col("w") * (al * al + ar * ar) / (2.0 * (al + ar))).otherwise(
        F.col("w") * (al + ar) / 2.0
    )
    summed = m.groupBy(a_id, b_id).agg((F.abs(F.sum(F.col("s") * gap)) / 2.0).alias("area"))
    return pairs.select(a_id, b_id).join(summed, [a_id, b_id], "left").select(
        a_id, b_id, F.coalesce("area", F.lit(0.0)).alias("area")
    )


def assign_largest_overlap(pairs: DataFrame, unit: str, place: str, area: str,
                           ties: str = "keep", least: float = 0.0) -> DataFrame:
    """The place that covers most of each unit; with ``ties="keep"`` all places that tie."""
    covered = pairs.where(F.col(area) > least)
    if ties == "keep":
        best = max_with_ties(covered, [unit], area)
    elif ties == "first":
        best = first_per_group(covered, [unit], [F.col(area).desc(), F.col(place).asc()])
    else:
        raise ValueError("ties is 'keep' or 'first'")
    return best.select(unit, place)


def adjacency(df: DataFrame, key: str, ring: str = "ring", snap: float = 1e-6,
              hot: int = 20_000) -> DataFrame:
    """Pairs ``id1 < id2`` of polygons with vertices no further apart than ``snap`` on either axis (queen contiguity).

    Vertices meet in the cells of a lattice: one side stands in its own cell, the other in every cell that it
    comes within ``snap`` of, so neighbours on both sides of a cell's border are found. No two polygons are
    compared unless they have vertices in one cell.
    """
    cell = 8 * snap
    v = df.select(F.col(key), F.explode(ring).alias("_p")).select(key, F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y")).distinct()
    at = lambda c, d: F.floor((F.col(c) + d) / cell)
    left = v.select(F.col(key).alias("id1"), F.col("_x").alias("_x1"), F.col("_y").alias("_y1"), at("_x", 0.0).alias("_vx"), at("_y", 0.0).alias("_vy"))
    near = F.array_distinct(F.array(*[
        F.struct(at("_x", dx).alias("x"), at("_y", dy).alias("y")) for dx in (-snap, snap) for dy in (-snap, snap)]))
    right = v.withColumn("_c", F.explode(near)).select(
        F.col(key).alias("id2"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"), F.col("_c.x").alias("_vx"), F.col("_c.y").alias("_vy"))
    met = spread_join(left, right, ["_vx", "_vy"], hot, "id1", "id2")
    close = (F.abs(F.col("_x1") - F.col("_x2")) <= snap) & (F.abs(F.col("_y1") - F.col("_y2")) <= snap)
    return met.where((F.col("id1") < F.col("id2")) & close).select("id1", "id2").distinct()
