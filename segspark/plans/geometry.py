"""Area, overlay, assignment and adjacency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.functions import tidy
from segspark.operators import quadtree, ranking, relate, shapes, spatial
from segspark.plans.inputs import METRO_BOX, PLACE_BOX, UNIT_BOX, metro_box, place_box, unit_box
from segspark.plans.registry import query


def box_rings(df):
    return df.withColumn("ring", spatial.box_ring(*[F.col(c) for c in spatial.BOX]))


def unit_rings(spark, sf):
    """Units with a bulge on the right side, by key: pentagons, some of them degenerate."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in spatial.BOX)
    bulge = x1 + 0.25 * (F.col("geoid") % 3)
    ring = F.array(pt(x0, y0), pt(x1, y0), pt(bulge, (y0 + y1) / 2), pt(x1, y1), pt(x0, y1))
    return unit_box(spark, sf).select("geoid", ring.alias("ring"))


def place_diamonds(spark, sf):
    """Places as the diamonds between the midpoints of their box sides."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in spatial.BOX)
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    return place_box(spark, sf).select("place", F.array(pt(mx, y0), pt(x1, my), pt(mx, y1), pt(x0, my)).alias("ring"))


UNIT_RING = f"""{UNIT_BOX}, uring as (select geoid, [{{'x': x0, 'y': y0}}, {{'x': x1, 'y': y0}}, {{'x': x1 + 0.25e0 * (geoid % 3), 'y': (y0 + y1) / 2}},
 {{'x': x1, 'y': y1}}, {{'x': x0, 'y': y1}}] ring from unit_box)"""
PLACE_RING = f"""{PLACE_BOX}, pring as (select place, [{{'x': (x0 + x1) / 2, 'y': y0}}, {{'x': x1, 'y': (y0 + y1) / 2}},
 {{'x': (x0 + x1) / 2, 'y': y1}}, {{'x': x0, 'y': (y0 + y1) / 2}}] ring from place_box)"""


def edges_sql(out: str, src: str, key: str) -> str:
    """Directed edges of a ring table."""
    return f"""{out}_v as (select {key}, i, ring[i] p, ring[case when i < len(ring) then i + 1 else 1 end] q from (select *, unnest(range(1, len(ring) + 1)) i from {src})),
{out} as (select {key}, p.x px, p.y py, q.x qx, q.y qy from {out}_v)"""


@query("polygon_area", f"""with {UNIT_RING}, {edges_sql('e', 'uring', 'geoid')}
select geoid, round(abs(sum(px * qy - qx * py)) / 2, 6) + 0.0 as area, round(any_value(p_retailprice) / (abs(sum(px * qy - qx * py)) / 2), 6) + 0.0 as density
from e join part on geoid = p_partkey group by geoid""")
def q_area(spark, sf):
    from segspark.plans.inputs import table

    price = table(spark, sf, "part").select(F.col("p_partkey").alias("geoid"), "p_retailprice")
    area = unit_rings(spark, sf).withColumn("area", spatial.ring_area(F.col("ring"))).join(price, "geoid")
    return area.select("geoid", tidy(F.col("area")).alias("area"), tidy(F.col("p_retailprice") / F.col("area")).alias("density"))


OVERLAP = """greatest(u.x0, p.x0) < least(u.x1, p.x1) and greatest(u.y0, p.y0) < least(u.y1, p.y1)"""
OVERLAP_AREA = "(least(u.x1, p.x1) - greatest(u.x0, p.x0)) * (least(u.y1, p.y1) - greatest(u.y0, p.y0))"


def overlaps(spark, sf):
    return spatial.overlay_pairs(unit_box(spark, sf), place_box(spark, sf), "geoid", "place", cell=1.0)


@query("overlay_join", f"""with {UNIT_BOX}, {PLACE_BOX} select geoid, place, round({OVERLAP_AREA}, 6) + 0.0 as area from unit_box u join place_box p on {OVERLAP}""")
def q_overlay(spark, sf):
    return overlaps(spark, sf).select("geoid", "place", tidy(F.col("box_overlap")).alias("area"))


def ring_overlaps(spark, sf):
    units = spatial.with_bounds(unit_rings(spark, sf))
    places = spatial.with_bounds(place_diamonds(spark, sf))
    pairs = spatial.overlay_pairs(units, places, "geoid", "place", cell=1.5)
    return spatial.ring_overlap_area(pairs, units, places, "geoid", "place", strip=1.0)


# The check integrates the lower of two edges over their common x range, from the x axis up.
MIN_INT = """case when (al - bl) * (ar - br) >= 0 then (case when al + ar <= bl + br then (al + ar) / 2 else (bl + br) / 2 end) * (r - l)
 else (case when al < bl then (al + m) / 2 * t + (m + br) / 2 * (1 - t) else (bl + m) / 2 * t + (m + ar) / 2 * (1 - t) end) * (r - l) end"""


OVERLAY_RINGS = f"""with {UNIT_RING}, {PLACE_RING}, {edges_sql('ue', 'uring', 'geoid')}, {edges_sql('pe', 'pring', 'place')},
ed as (select geoid, place, sign(u.qx - u.px) * sign(p.qx - p.px) s, greatest(least(u.px, u.qx), least(p.px, p.qx)) l, least(greatest(u.px, u.qx), greatest(p.px, p.qx)) r,
  u.px ax, u.py ay, (u.qy - u.py) / nullif(u.qx - u.px, 0) ak, p.px bx, p.py by_, (p.qy - p.py) / nullif(p.qx - p.px, 0) bk from ue u, pe p where u.px <> u.qx and p.px <> p.qx),
v as (select geoid, place, s, l, r, ay + ak * (l - ax) al, ay + ak * (r - ax) ar, by_ + bk * (l - bx) bl, by_ + bk * (r - bx) br from ed where l < r),
w as (select *, (al - bl) / nullif((al - bl) - (ar - br), 0) t, al + (ar - al) * ((al - bl) / nullif((al - bl) - (ar - br), 0)) m from v),
bb as (select geoid, place, max(u.px) ux1, min(u.px) ux0, max(u.py) uy1, min(u.py) uy0, max(p.px) px1, min(p.px) px0, max(p.py) py1, min(p.py) py0 from ue u, pe p group by geoid, place),
area as (select geoid, place, abs(sum(s * {MIN_INT})) a from w group by geoid, place)
select geoid, place, round(coalesce(a, 0), 6) + 0.0 as area from bb left join area using (geoid, place)
where greatest(ux0, px0) < least(ux1, px1) and greatest(uy0, py0) < least(uy1, py1)"""


@query("overlay_area_rings", OVERLAY_RINGS)
def q_overlay_rings(spark, sf):
    """Common area of pentagons and diamonds, for the pairs whose boxes overlap."""
    return ring_overlaps(spark, sf).select("geoid", "place", tidy(F.col("area")).alias("area"))


@query("largest_overlap_assign", f"""with {UNIT_BOX}, {PLACE_BOX}, o as (select geoid, place, {OVERLAP_AREA} area from unit_box u join place_box p on {OVERLAP}),
m as (select geoid, place from (select *, rank() over (partition by geoid order by area desc) rk from o) where rk = 1)
select u.geoid, coalesce('Place' || cast(m.place as varchar), 'No Place') name_full from unit_box u left join m on u.geoid = m.geoid""")
def q_assign(spark, sf):
    best = spatial.assign_largest_overlap(overlaps(spark, sf), "geoid", "place", "box_overlap")
    named = best.select("geoid", F.concat(F.lit("Place"), F.col("place").cast("string")).alias("name_full"))
    return relate.assign_place(unit_box(spark, sf).select("geoid"), named, "geoid", "name_full")


@query("largest_overlap_assign_rings", f"""with {UNIT_BOX}, a as ({OVERLAY_RINGS}),
m as (select geoid, place from (select *, row_number() over (partition by geoid order by area desc, place) rn from a where area > 0.001) where rn = 1)
select u.geoid, coalesce('Place' || cast(m.place as varchar), 'No Place') name_full from unit_box u left join m on u.geoid = m.geoid""")
def q_assign_rings(spark, sf):
    """Assignment by the common area of the true shapes; slivers count for nothing, the first place wins a tie."""
    areas = ring_overlaps(spark, sf).select("geoid", "place", tidy(F.col("area")).alias("area"))
    best = spatial.assign_largest_overlap(areas, "geoid", "place", "area", ties="first", least=0.001)
    named = best.select("geoid", F.concat(F.lit("Place"), F.col("place").cast("string")).alias("name_full"))
    return relate.assign_place(unit_box(spark, sf).select("geoid"), named, "geoid", "name_full")


@query("central_place_by_overlay", f"""with {PLACE_BOX}, {METRO_BOX}, o as (select u.metro, p.place, p.estimate from metro_box u join place_box p on {OVERLAP})
select metro, place, estimate from (select *, row_number() over (partition by metro order by estimate desc, place) rn from o) where rn = 1""")
def q_central(spark, sf):
    places = place_box(spark, sf)
    pairs = spatial.overlay_pairs(metro_box(spark, sf), places, "metro", "place", cell=4.0)
    ranked = pairs.join(places.select("place", "estimate"), "place").select("metro", "place", "estimate")
    return ranking.first_per_group(ranked, ["metro"], [F.col("estimate").desc(), F.col("place").asc()])


@query("queen_adjacency", f"""with {UNIT_BOX}, v as (select geoid, x0 x, y0 y from unit_box union select geoid, x1, y0 from unit_box
 union select geoid, x1, y1 from unit_box union select geoid, x0, y1 from unit_box)
select distinct a.geoid id1, b.geoid id2 from v a join v b on a.x = b.x and a.y = b.y and a.geoid < b.geoid""")
def q_adjacency(spark, sf):
    return spatial.adjacency(box_rings(unit_box(spark, sf)), "geoid")


# --- shapes of several parts and with holes -----------------------------------------------------


def box_shape(*parts):
    """A shape from parts ``(condition, outer box, hole condition, hole box)``; boxes are four columns."""
    ring = spatial.box_ring
    rings = [F.when(holed, F.array(ring(*outer), ring(*hole))).otherwise(F.array(ring(*outer))) for _, outer, holed, hole in parts]
    return F.array_compact(F.array(*[F.when(part[0], r) for part, r in zip(parts, rings)]))


def unit_shapes(spark, sf):
    """Units of one or two parts, every other one with a hole, each in one of three states."""
    k = F.col("geoid")
    x0, y0, x1, y1 = (F.col(c) for c in spatial.BOX)
    hole = (x0 + 0.25, y0 + 0.25, x1 - 0.25, y1 - 0.25)
    shape = box_shape((F.lit(True), (x0, y0, x1, y1), k % 2 == 0, hole),
                      (k % 3 == 0, (x0 + 2, y0, x1 + 1.5, y1 + 0.5), F.lit(False), hole))
    return shapes.with_shape_bounds(unit_box(spark, sf).select("geoid", (k % 3).alias("state"), shape.alias("shape")))


def place_shapes(spark, sf):
    """Places of one or two parts, two of three with a hole, each in one of three states."""
    k = F.col("place")
    x0, y0, x1, y1 = (F.col(c) for c in spatial.BOX)
    hole = (x0 + 1, y0 + 0.375, x0 + 2, y0 + 1.625)
    shape = box_shape((F.lit(True), (x0, y0, x1, y1), k % 3 != 0, hole),
                      (k % 2 == 0, (x1 + 0.5, y0, x1 + 1.75, y1 - 0.5), F.lit(False), hole))
    return shapes.with_shape_bounds(place_box(spark, sf).select("place", (k % 3).alias("state"), shape.alias("shape")))


# The check has no polygons: a shape is a list of boxes that count 1 (parts) or -1 (holes), and areas and moments add up.
SHAPE_OVERLAP = f"""with {UNIT_BOX}, {PLACE_BOX},
us as (select geoid, geoid % 3 state, 1 s, x0, y0, x1, y1 from unit_box union all select geoid, geoid % 3, -1, x0 + 0.25e0, y0 + 0.25e0, x1 - 0.25e0, y1 - 0.25e0 from unit_box where geoid % 2 = 0
 union all select geoid, geoid % 3, 1, x0 + 2, y0, x1 + 1.5e0, y1 + 0.5e0 from unit_box where geoid % 3 = 0),
ps as (select place, place % 3 state, 1 s, x0, y0, x1, y1 from place_box union all select place, place % 3, -1, x0 + 1, y0 + 0.375e0, x0 + 2, y0 + 1.625e0 from place_box where place % 3 <> 0
 union all select place, place % 3, 1, x1 + 0.5e0, y0, x1 + 1.75e0, y1 - 0.5e0 from place_box where place % 2 = 0),
ov as (select geoid, place, u.state = p.state same_state, u.s * p.s s, greatest(u.x0, p.x0) l, least(u.x1, p.x1) r, greatest(u.y0, p.y0) b, least(u.y1, p.y1) t
 from us u join ps p on {OVERLAP}),
sh as (select geoid, place, bool_or(same_state) same_state, sum(s * (r - l) * (t - b)) area, sum(s * (r - l) * (t - b) * (l + r) / 2) mx, sum(s * (r - l) * (t - b) * (b + t) / 2) my
 from ov group by geoid, place)"""


def shape_pieces(spark, sf, also_on=()):
    units, places = unit_shapes(spark, sf), place_shapes(spark, sf)
    pairs = spatial.overlay_pairs(units, places, "geoid", "place", cell=1.5, also_on=also_on)
    return shapes.overlay_pieces(pairs, units, places, "geoid", "place", strip=2.0)


@query("overlay_pieces", f"""{SHAPE_OVERLAP} select geoid, place, round(area, 6) + 0.0 as area, round(mx / area, 6) + 0.0 as cx, round(my / area, 6) + 0.0 as cy
from sh where area > 1e-9""")
def q_overlay_pieces(spark, sf):
    """Area and centre of what units and places share, both of several parts and with holes."""
    measured = shapes.piece_measures(shape_pieces(spark, sf), "geoid", "place")
    return measured.select("geoid", "place", *[tidy(F.col(c)).alias(c) for c in ("area", "cx", "cy")])


@query("largest_overlap_assign_shapes", f"""{SHAPE_OVERLAP}, m as (select geoid, place from (
 select geoid, place, row_number() over (partition by geoid order by round(area, 6) desc, place) rn from sh where same_state and area > 0.001) where rn = 1)
select u.geoid, coalesce('Place' || cast(m.place as varchar), 'No Place') name_full from unit_box u left join m on u.geoid = m.geoid""")
def q_assign_shapes(spark, sf):
    """Each unit's place of its own state, by the area that the true shapes share; the first place wins a tie."""
    measured = shapes.piece_measures(shape_pieces(spark, sf, ["state"]), "geoid", "place")
    areas = measured.select("geoid", "place", tidy(F.col("area")).alias("area"))
    best = spatial.assign_largest_overlap(areas, "geoid", "place", "area", ties="first", least=0.001)
    named = best.select("geoid", F.concat(F.lit("Place"), F.col("place").cast("string")).alias("name_full"))
    return relate.assign_place(unit_box(spark, sf).select("geoid"), named, "geoid", "name_full")


@query("largest_overlap_assign_buffered", f"""with {UNIT_BOX}, {PLACE_BOX}, wide as (select geoid, x0 - 0.25e0 x0, y0 - 0.25e0 y0, x1 + 0.25e0 x1, y1 + 0.25e0 y1 from unit_box),
o as (select geoid, place, {OVERLAP_AREA} area from wide u join place_box p on {OVERLAP} and geoid % 3 = place % 3)
select geoid, place, round(area, 6) + 0.0 as area from (select *, rank() over (partition by geoid order by area desc) rk from o) where rk = 1""")
def q_assign_buffered(spark, sf):
    """Boxes widened by a buffer that reaches past a border, places of the unit's own state only; ties stay."""
    units = unit_box(spark, sf).withColumn("state", F.col("geoid") % 3)
    places = place_box(spark, sf).withColumn("state", F.col("place") % 3)
    pairs = spatial.overlay_pairs(units, places, "geoid", "place", cell=1.5, tolerance=0.25, also_on=["state"])
    best = spatial.assign_largest_overlap(pairs, "geoid", "place", "box_overlap")
    return pairs.join(best, ["geoid", "place"]).select("geoid", "place", tidy(F.col("box_overlap")).alias("area"))


# --- without a chosen cell size -----------------------------------------------------------------


@query("overlay_join_grown", f"""with {UNIT_BOX}, {PLACE_BOX} select geoid, place, round({OVERLAP_AREA}, 6) + 0.0 as area from unit_box u join place_box p on {OVERLAP}""")
def q_overlay_grown(spark, sf):
    """Overlay on a tree of cells grown from the counts of boxes."""
    pairs = quadtree.grown_overlay_pairs(unit_box(spark, sf), place_box(spark, sf), "geoid", "place")
    return pairs.select("geoid", "place", tidy(F.col("box_overlap")).alias("area"))


@query("central_place_grown", f"""with {PLACE_BOX}, {METRO_BOX}, o as (select u.metro, p.place, p.estimate from metro_box u join place_box p on {OVERLAP})
select metro, place, estimate from (select *, row_number() over (partition by metro order by estimate desc, place) rn from o) where rn = 1""")
def q_central_grown(spark, sf):
    """The most populous place of each metro; large boxes against small ones on one tree."""
    places = place_box(spark, sf)
    pairs = quadtree.grown_overlay_pairs(metro_box(spark, sf), places, "metro", "place")
    ranked = pairs.join(places.select("place", "estimate"), "place").select("metro", "place", "estimate")
    return ranking.first_per_group(ranked, ["metro"], [F.col("estimate").desc(), F.col("place").asc()])
