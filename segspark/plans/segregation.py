"""Entropy, H and decomposition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.functions import tidy
from segspark.operators import relate, reshape, stored, theil
from segspark.operators.compare import type_means
from segspark.plans.inputs import (
    BANDS, AGE_CELL, AGE_PLACE, CELL, CELL_YEAR, CROSSWALK, FOCAL, FOUR, LONG, PRIORITIES, SOURCES,
    UNIT_PLACE, age_cell, age_place, cell, cell_year, crosswalk, direct_theil, rounded, unit_place,
)
from segspark.plans.registry import query
from segspark.session import scratch_dir

FIVE = theil.Hierarchy(scope=["cbsa"], mid="tract", leaf=["block"], group="race", sources=SOURCES)
ROLLED = theil.Hierarchy(scope=["cbsa"], mid="tract", leaf=["blkgrp"], group="race", sources=SOURCES)
FOUR_SQL = ", ".join(f"'{g}'" for g in FOUR)
CORE = ["Hw", "H", "totalE", "Hb", "Pb"]


def rounded_cols(df, cols):
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


# --- the measure itself -----------------------------------------------------------------

UNIT_SQL = f"""with {CELL}
select tract, block, round(coalesce(sum(case when census > 0 then census / t * ln(t / nullif(census, 0)) else 0 end), 0), 6) + 0.0 as "E",
       cast(sum(census) as bigint) as "Pop"
from (select *, sum(census) over (partition by tract, block)::double t from cell) group by tract, block"""


@query("unit_entropy", UNIT_SQL)
def q_unit_entropy(spark, sf):
    return rounded_cols(theil.unit_entropy(cell(spark, sf), ["tract", "block"], "race", "census"), ["E"])


@query("theil_h", f"""with {CELL}, {LONG}, {direct_theil('d', 'long', 'cbsa, "name"', 'tract', 'block', 'race')}
select cbsa, "name", {rounded('H, totalE')} from d""")
def q_theil_h(spark, sf):
    h = theil.Hierarchy(scope=["cbsa"], leaf=["block"], group="race", sources=SOURCES)
    return rounded_cols(theil.decompose(cell(spark, sf), h, PRIORITIES), ["H", "totalE"])


THEIL_SQL = f"""with {CELL}, {LONG}, {direct_theil('d', 'long', 'cbsa, "name"', 'tract', 'block', 'race')}
select cbsa, "name", {rounded('Hw, H, totalE, Hb, Pb')} from d"""


@query("theil_decomposition", THEIL_SQL)
def q_theil_decomposition(spark, sf):
    return rounded_cols(theil.decompose(cell(spark, sf), FIVE, PRIORITIES), CORE)


@query("theil_decomposition_open_groups", THEIL_SQL)
def q_theil_rows(spark, sf):
    """The same table with the group labels not given beforehand."""
    return rounded_cols(theil.decompose(cell(spark, sf), FIVE), CORE)


def focal_sql(src: str, keys: str = 'cbsa, "name"', mid: str = "tract", leaf: str = "block", group: str = "race",
              focal: str = FOCAL) -> str:
    """The three runs of the direct form: all groups, focal against rest, rest only."""
    ks = [k.strip() for k in keys.split(",")]
    using = ", ".join(ks)
    return f"""two as (select * replace (case when {group} = '{focal}' then '{focal}' else 'rest' end as {group}) from {src}),
rest as (select * from {src} where {group} <> '{focal}'),
{direct_theil('d', src, keys, mid, leaf, group)},
{direct_theil('d2', 'two', keys, mid, leaf, group)},
{direct_theil('dr', 'rest', keys, mid, leaf, group)},
q as (select {keys}, sum(case when {group} <> '{focal}' then "value" else 0 end)::double / nullif(sum("value"), 0) q
  from {src} group by {keys}),
split as (select d.*, d2."totalE" / nullif(d."totalE", 0) * d2."H" "Hbg",
    case when abs(d."H") >= 1e-9 then d2."totalE" / nullif(d."totalE", 0) * d2."H" / d."H" end "Pbg",
    dr."totalE" / nullif(d."totalE", 0) * dr."H" * q.q "Hwg"
  from d left join d2 using ({using}) left join dr using ({using}) left join q using ({using}))"""


@query("theil_focal_split", f"""with {CELL}, {LONG}, {focal_sql('long')}
select cbsa, "name", {rounded('Hw, H, totalE, Hb, Pb, Hbg, Pbg, Hwg')} from split""")
def q_theil_focal_split(spark, sf):
    out = theil.decompose(cell(spark, sf), FIVE, PRIORITIES, focal=FOCAL, with_rest=True)
    return rounded_cols(out, [*CORE, "Hbg", "Pbg", "Hwg"])


# --- runs over all metros ---------------------------------------------------------------

def metro_cells(spark, sf):
    """Cells of the counties of the crosswalk, empty ones dropped: one join, no metro loop."""
    cells = reshape.both_zero_dropped(cell(spark, sf).drop("cbsa"), "census", "dp")
    scope = crosswalk(spark, sf).select(F.col("county").alias("tract"), "cbsa")
    return cells.join(scope, "tract")


METRO_LONG = f"""{CELL}, {CROSSWALK}, mcell as (
select x.cbsa, c.* exclude (cbsa) from cell c join crosswalk x on c.tract = x.county where not (c.census = 0 and c.dp = 0)),
mlong as (select cbsa, 'CENSUS' as "name", tract, blkgrp, block, race, census as "value" from mcell where race in ({FOUR_SQL})
union all select cbsa, 'DP', tract, blkgrp, block, race, dp from mcell where race in ({FOUR_SQL}))"""


@query("metro_decomposition_leaf", f"""with {METRO_LONG}, {focal_sql('mlong')}
select cbsa, "name", {rounded('Hw, H, totalE, Hb, Pb, Hbg, Pbg')} from split""")
def q_metro_leaf(spark, sf):
    return rounded_cols(theil.decompose(metro_cells(spark, sf), FIVE, FOUR, focal=FOCAL), [*CORE, "Hbg", "Pbg"])


ROLLED_SQL = f"""with {METRO_LONG}, {focal_sql('mlong', leaf='blkgrp')}
select cbsa, "name", {rounded('Hw, H, totalE, Hb, Pb, Hbg, Pbg')} from split"""


def metro_rolled(spark, sf):
    """The leaf is the coarser unit; the leaf aggregate is the roll-up, so it costs nothing extra."""
    return theil.decompose(metro_cells(spark, sf), ROLLED, FOUR, focal=FOCAL)


@query("metro_decomposition_rolled", ROLLED_SQL)
def q_metro_rolled(spark, sf):
    return rounded_cols(metro_rolled(spark, sf), [*CORE, "Hbg", "Pbg"])


# --- centre and nested levels -----------------------------------------------------------

LEVELS = {"Tract": "tract", "Place": "name_full"}
CENTER = ("Center", "Place", "No Place", "census")
ORDER = ["Center", "Place", "Tract"]


def placed_cells(spark, sf):
    cells = reshape.both_zero_dropped(cell(spark, sf), "census", "dp")
    return relate.assign_place(cells, unit_place(spark, sf), "blkgrp", "name_full")


def nested(spark, sf, rolled: bool, guard: bool = False):
    h = theil.Hierarchy(scope=["cbsa"], leaf=["tract", "blkgrp"] if rolled else ["block"], group="race", sources=SOURCES)
    out = theil.nested_levels(placed_cells(spark, sf), h, LEVELS, FOUR, CENTER, guard)
    return theil.with_increments(out, ["cbsa", "name"], ORDER)


PLACED = f"""{CELL}, {UNIT_PLACE}, pcell as (
select c.*, coalesce(u.name_full, 'No Place') name_full from cell c left join unit_place u using (blkgrp)
where not (c.census = 0 and c.dp = 0)),
pop as (select cbsa, name_full, sum(census) pop from pcell group by cbsa, name_full),
ctr as (select cbsa, arg_min(name_full, (-pop, name_full)) center from pop where name_full <> 'No Place' group by cbsa)"""


def nested_long(src: str, pairs: str, group: str = "race", groups: str = FOUR_SQL, levels: str = "TPC") -> str:
    """Cells stacked by level, each with the mid of its level."""
    mids = {"T": ("Tract", "cast(tract as varchar)"), "P": ("Place", "name_full"),
            "C": ("Center", "case when name_full = center then 'Center' else 'Not Center' end")}
    rows = []
    for k in levels:
        label, mid = mids[k]
        for name, col in (p.split(":") for p in pairs.split(",")):
            rows.append(f"""select cbsa, '{label}' as "Level", '{name}' as "name", {mid} mid, tract, blkgrp, {'block,' if group == 'race' else ''}
 {group}, {col} as "value" from {src} left join ctr using (cbsa) where {group} in ({groups})""")
    return "nlong as (" + "\nunion all ".join(rows) + ")"


def nested_sql(leaf: str, pairs: str = "CENSUS:census,DP:dp") -> str:
    keys = 'cbsa, "Level", "name"'
    return f"""{PLACED}, {nested_long('pcell', pairs)},
{direct_theil('d', 'nlong', keys, 'mid', leaf, 'race')},
geo as (select d.*, center, "Pb" - lag("Pb", 1, 0.0) over (partition by cbsa, "name" order by "Level") seg_explained
  from d left join ctr using (cbsa))"""


GEO_COLS = "Hw, H, totalE, Hb, Pb, seg_explained"


@query("nested_hierarchy", f"""with {nested_sql('block')}
select cbsa, center, "Level", "name", {rounded('Hw, H, totalE, Hb, Pb')} from geo""")
def q_nested(spark, sf):
    return rounded_cols(nested(spark, sf, False).drop("seg_explained"), CORE)


@query("nested_hierarchy_rolled", f"""with {nested_sql('blkgrp')}
select cbsa, center, "Level", "name", {rounded(GEO_COLS)} from geo""")
def q_nested_rolled(spark, sf):
    return rounded_cols(nested(spark, sf, True), [*CORE, "seg_explained"])


@query("seg_explained", f"""with {nested_sql('block')}
select cbsa, "Level", "name", {rounded('Pb, seg_explained')} from geo""")
def q_seg_explained(spark, sf):
    return rounded_cols(nested(spark, sf, False), ["Pb", "seg_explained"]).select("cbsa", "Level", "name", "Pb", "seg_explained")


RESIDUAL = """stack as (select cbsa, "name", center, "Level", seg_explained from geo
 union all select cbsa, "name", center, 'Block Group', 1 - "Pb" from geo where "Level" = '{level}')"""
STACK_COLS = ["cbsa", "name", "center", "Level", "seg_explained"]


@query("residual_level", f"""with {nested_sql('blkgrp')}, {RESIDUAL.format(level='Place')}
select cbsa, "name", center, "Level", {rounded('seg_explained')} from stack""")
def q_residual(spark, sf):
    out = theil.with_residual(nested(spark, sf, True), "Place", "Block Group", STACK_COLS)
    return rounded_cols(out, ["seg_explained"])


@query("residual_level_deepest", f"""with {nested_sql('blkgrp')}, {RESIDUAL.format(level='Tract')}
select cbsa, "name", center, "Level", {rounded('seg_explained')} from stack""")
def q_residual_deepest(spark, sf):
    out = theil.with_residual(nested(spark, sf, True), "Tract", "Block Group", STACK_COLS)
    return rounded_cols(out, ["seg_explained"])


@query("union_residual_level", f"""with {nested_sql('blkgrp')}
select cbsa, "name", center, "Level", {rounded('seg_explained')} from geo where "Level" <> 'Place'
union all select cbsa, "name", center, 'Block Group', round(1 - "Pb", 6) + 0.0 from geo where "Level" = 'Place'""")
def q_union_residual(spark, sf):
    """Strict union by name of two selections of one table."""
    geo = nested(spark, sf, True)
    rest = geo.where(F.col("Level") == "Place").select(
        "cbsa", "name", "center", F.lit("Block Group").alias("Level"), (1 - F.col("Pb")).alias("seg_explained"))
    out = geo.where(F.col("Level") != "Place").select(*STACK_COLS).unionByName(rest)
    return rounded_cols(out, ["seg_explained"])


@query("h_alone", f"""with {nested_sql('block')}, st as (
 select cbsa, center, "name", "Level", "Hb" from geo
 union all select cbsa, center, "name", 'Block', "H" from geo where "Level" = 'Tract'),
 r as (select *, case "Level" when 'Center' then 1 when 'Place' then 2 when 'Tract' then 3 else 4 end k from st)
select cbsa, center, "name", "Level", round("Hb", 6) + 0.0 as "Hb",
 round("Hb" - lag("Hb", 1, 0.0) over (partition by cbsa, center, "name" order by k), 6) + 0.0 as "H_alone" from r""")
def q_h_alone(spark, sf):
    out = theil.level_gains(nested(spark, sf, False), ["cbsa", "center", "name"], ORDER, "Block")
    return rounded_cols(out, ["Hb", "H_alone"])


@query("win_lag_default", f"""with {nested_sql('block')}
select cbsa, "name", "Level", round("Hb", 6) + 0.0 as "Hb",
 round("Hb" - lag("Hb", 1, 0.0) over (partition by cbsa, "name" order by "Level"), 6) + 0.0 as step from geo""")
def q_win_lag(spark, sf):
    """Previous level's value, 0 before the first; a window holds the levels of one scope and source."""
    out = theil.with_increments(nested(spark, sf, False), ["cbsa", "name"], ORDER, "Hb", "step")
    return rounded_cols(out.select("cbsa", "name", "Level", "Hb", "step"), ["Hb", "step"])


@query("center_place", f"""with {PLACED} select cbsa, center, cast(p.pop as bigint) pop
 from ctr join pop p using (cbsa) where p.name_full = center""")
def q_center_place(spark, sf):
    from segspark.operators.ranking import first_per_group

    pop = placed_cells(spark, sf).groupBy("cbsa", "name_full").agg(F.sum("census").alias("pop"))
    top = first_per_group(pop.where(F.col("name_full") != "No Place"), ["cbsa"], [F.col("pop").desc(), F.col("name_full").asc()])
    return top.select("cbsa", F.col("name_full").alias("center"), "pop")


CENTER_UNITS = """cu as (select distinct ctr.cbsa, blkgrp from ctr join unit_place on name_full = center)"""


@query("center_periphery", f"""with {PLACED}, {CENTER_UNITS}, flong as (
 select cbsa, "name", case when (cbsa, blkgrp) in (select (cbsa, blkgrp) from cu) then '1' else '0' end tract, block, race, "value" from (
  select cbsa, 'CENSUS' as "name", blkgrp, block, race, census as "value" from cell where not (census = 0 and dp = 0)
  union all select cbsa, 'DP', blkgrp, block, race, dp from cell where not (census = 0 and dp = 0))
 where race in ({FOUR_SQL})),
 {direct_theil('d', 'flong', 'cbsa, "name"', 'tract', 'block', 'race')}
select cbsa, "name", {rounded('Hw, H, totalE, Hb, Pb')} from d""")
def q_center_periphery(spark, sf):
    """Mid = inside or outside the central place of the scope, as a 0/1 membership column."""
    centers = q_center_place(spark, sf).select("cbsa", "center")
    members = unit_place(spark, sf).join(centers, F.col("name_full") == F.col("center")).select("cbsa", "blkgrp").distinct()
    cells = reshape.both_zero_dropped(cell(spark, sf), "census", "dp").drop("tract")
    inside = members.withColumn("_in", F.lit("1"))
    flagged = cells.join(inside, ["cbsa", "blkgrp"], "left").withColumn("tract", F.coalesce("_in", F.lit("0"))).drop("_in")
    return rounded_cols(theil.decompose(flagged, FIVE, FOUR), CORE)


TYPES = f"{CROSSWALK}, types as (select distinct cbsa, \"type\" from crosswalk)"


@query("type_level_means", f"""with {nested_sql('blkgrp')}, {TYPES}, {RESIDUAL.format(level='Place')}
select "name", "type", "Level", round(avg(seg_explained), 6) + 0.0 as mean_p from stack join types using (cbsa) group by all""")
def q_type_level_means(spark, sf):
    stack = theil.with_residual(nested(spark, sf, True), "Place", "Block Group", STACK_COLS)
    typed = relate.attach_distinct(stack, crosswalk(spark, sf), ["cbsa"], ["type"])
    return typed.groupBy("name", "type", "Level").agg(tidy(F.avg("seg_explained")).alias("mean_p"))


def type_share_sql(share: str, other: str) -> str:
    return f"""with {METRO_LONG}, types as (select distinct cbsa, "type" from crosswalk), {focal_sql('mlong', leaf='blkgrp')},
 m as (select "type", "name", avg("{share}") p from split join types using (cbsa) group by all)
select "type", "name", '{share}' as metric, round(p, 6) + 0.0 as "value" from m
union all select "type", "name", '{other}', round(1 - p, 6) + 0.0 from m"""


@query("type_between_means", type_share_sql("Pb", "Pw"))
def q_type_between(spark, sf):
    typed = relate.attach_distinct(metro_rolled(spark, sf), crosswalk(spark, sf), ["cbsa"], ["type"])
    return rounded_cols(type_means(typed, ["type", "name"], "Pb", "Pw"), ["value"])


@query("type_focal_means", type_share_sql("Pbg", "Between Groups Outside"))
def q_type_focal(spark, sf):
    typed = relate.attach_distinct(metro_rolled(spark, sf), crosswalk(spark, sf), ["cbsa"], ["type"])
    return rounded_cols(type_means(typed, ["type", "name"], "Pbg", "Between Groups Outside"), ["value"])


@query("metric_panel", f"""with {METRO_LONG}, types as (select distinct cbsa, "type" from crosswalk), {focal_sql('mlong', leaf='blkgrp')},
 p as (select cbsa, "name", unnest(['H Index', 'Percent Between Tract', 'Within Tract H', 'Between Tract H']) metric,
   unnest(["H", "Pb", "Hw", "Hb"]) v from split)
select cbsa, metric, round(max(case when "name" = 'CENSUS' then v end), 6) + 0.0 as "CENSUS",
 round(max(case when "name" = 'DP' then v end), 6) + 0.0 as "DP", "type" from p join types using (cbsa) group by cbsa, metric, "type" """)
def q_metric_panel(spark, sf):
    # Panel titles of the four measures.
    titles = {"H Index": "H", "Percent Between Tract": "Pb", "Within Tract H": "Hw", "Between Tract H": "Hb"}
    panel = reshape.metric_panel(metro_rolled(spark, sf), ["cbsa"], titles, ["CENSUS", "DP"])
    out = relate.attach_distinct(panel, crosswalk(spark, sf), ["cbsa"], ["type"])
    return rounded_cols(out, ["CENSUS", "DP"])


# --- age bands ----------------------------------------------------------------------------

AGE = theil.Hierarchy(scope=["cbsa"], mid="tract", leaf=["blkgrp"], group="age_group", sources=SOURCES)
BAND_SQL = "'Under 18', '18-65', '65+'"


@query("age_decomposition", f"""with {AGE_CELL}, along as (
 select cbsa, 'CENSUS' as "name", tract, blkgrp, age_group, census as "value" from age_cell where not (census = 0 and dp = 0)
 union all select cbsa, 'DP', tract, blkgrp, age_group, dp from age_cell where not (census = 0 and dp = 0)),
 {focal_sql('along', leaf='blkgrp', group='age_group', focal='65+')}
select cbsa, "name", {rounded('Hw, H, totalE, Hb, Pb, Hbg, Pbg')} from split""")
def q_age(spark, sf):
    cells = reshape.both_zero_dropped(age_cell(spark, sf), "census", "dp")
    return rounded_cols(theil.decompose(cells, AGE, BANDS, focal="65+"), [*CORE, "Hbg", "Pbg"])


def age_nested(spark, sf):
    cells = reshape.both_zero_dropped(age_cell(spark, sf), "census", "dp")
    cells = relate.assign_place(cells, age_place(spark, sf), "blkgrp", "name_full")
    h = theil.Hierarchy(scope=["cbsa"], leaf=["blkgrp"], group="age_group", sources=SOURCES)
    out = theil.nested_levels(cells, h, {"Place": "name_full"}, BANDS, CENTER)
    return theil.with_increments(out, ["cbsa", "name"], ["Center", "Place"])


AGE_NESTED = f"""{AGE_CELL}, {AGE_PLACE}, acell as (
select c.*, coalesce(u.name_full, 'No Place') name_full from age_cell c left join age_place u using (blkgrp)
where not (c.census = 0 and c.dp = 0)),
pop as (select cbsa, name_full, sum(census) pop from acell group by cbsa, name_full),
ctr as (select cbsa, arg_min(name_full, (-pop, name_full)) center from pop where name_full <> 'No Place' group by cbsa),
{nested_long('acell', 'CENSUS:census,DP:dp', 'age_group', BAND_SQL, 'PC')},
{direct_theil('d', 'nlong', 'cbsa, "Level", "name"', 'mid', 'blkgrp', 'age_group')},
geo as (select d.*, center, "Pb" - lag("Pb", 1, 0.0) over (partition by cbsa, "name" order by "Level") seg_explained
  from d left join ctr using (cbsa))"""


@query("age_nested_hierarchy", f"""with {AGE_NESTED}
select cbsa, center, "Level", "name", {rounded(GEO_COLS)} from geo""")
def q_age_nested(spark, sf):
    return rounded_cols(age_nested(spark, sf), [*CORE, "seg_explained"])


@query("age_type_level_means", f"""with {AGE_NESTED}, {TYPES}, {RESIDUAL.format(level='Place')},
 w as (select cbsa, center, "Level", "type", max(case when "name" = 'CENSUS' then seg_explained end) c,
   max(case when "name" = 'DP' then seg_explained end) d from stack join types using (cbsa) group by all),
 m as (select "type", "Level", avg(c) c, avg(d) d from w group by all)
select "type", "Level", 'CENSUS' as "name", round(c, 6) + 0.0 as "value" from m
union all select "type", "Level", 'DP', round(d, 6) + 0.0 from m""")
def q_age_type_means(spark, sf):
    from segspark.operators.compare import numeric_means

    stack = theil.with_residual(age_nested(spark, sf), "Place", "Block Group", STACK_COLS)
    typed = relate.attach_distinct(stack, crosswalk(spark, sf), ["cbsa"], ["type"])
    wide = reshape.to_wide(typed, ["cbsa", "center", "Level", "type"], "name", "seg_explained", ["CENSUS", "DP"])
    means = numeric_means(wide, ["type", "Level"])
    return rounded_cols(reshape.to_long(means, ["type", "Level"], ["CENSUS", "DP"]), ["value"])


# --- baseline year --------------------------------------------------------------------------

def year_cells(spark, sf):
    """Cells of all years with the place of their unit; the year is a part of the scope."""
    return relate.assign_place(cell_year(spark, sf), unit_place(spark, sf), "blkgrp", "name_full")


def year_nested(spark, sf):
    h = theil.Hierarchy(scope=["yr", "cbsa"], leaf=["tract", "blkgrp"], group="race", sources=SOURCES)
    out = theil.nested_levels(year_cells(spark, sf), h, LEVELS, FOUR, CENTER)
    return theil.with_increments(out, ["yr", "cbsa", "name"], ORDER)


def year_flat(spark, sf):
    h = theil.Hierarchy(scope=["yr", "cbsa"], mid="tract", leaf=["blkgrp"], group="race", sources=SOURCES)
    return theil.decompose(year_cells(spark, sf), h, FOUR, focal=FOCAL)


YEAR_PLACED = f"""{CELL_YEAR}, {UNIT_PLACE}, ypl as (
select c.*, coalesce(u.name_full, 'No Place') name_full from cell_year c left join unit_place u using (blkgrp)),
pop as (select yr, cbsa, name_full, sum(census) pop from ypl group by yr, cbsa, name_full),
yctr as (select yr, cbsa, arg_min(name_full, (-pop, name_full)) center from pop where name_full <> 'No Place' group by yr, cbsa)"""


def year_long() -> str:
    """Both years as one long table; the first year knows one source."""
    return f"""ylong as (
 select yr, cbsa, 'CENSUS' as "name", tract, blkgrp, name_full, race, census as "value" from ypl where race in ({FOUR_SQL})
 union all select yr, cbsa, 'DP', tract, blkgrp, name_full, race, dp from ypl where race in ({FOUR_SQL}) and yr = 2010)"""


YEAR_NESTED = f"""{YEAR_PLACED}, {year_long()}, ynl as (
 select l.yr, l.cbsa, "Level", "name", tract, blkgrp, race, "value",
  case "Level" when 'Tract' then cast(tract as varchar) when 'Place' then name_full
       else case when name_full = center then 'Center' else 'Not Center' end end mid
 from ylong l left join yctr c on l.yr = c.yr and l.cbsa = c.cbsa cross join (values ('Tract'), ('Place'), ('Center')) t("Level")),
 {direct_theil('d', 'ynl', 'yr, cbsa, "Level", "name"', 'mid', 'blkgrp', 'race')},
 geo as (select d.*, center, "Pb" - lag("Pb", 1, 0.0) over (partition by d.yr, d.cbsa, "name" order by "Level") seg_explained
  from d left join yctr using (yr, cbsa))"""


@query("baseline_decomposition", f"""with {YEAR_NESTED}
select cbsa, center, "Level", "name", {rounded(GEO_COLS)} from geo where yr = 2000""")
def q_baseline(spark, sf):
    out = year_nested(spark, sf).where((F.col("yr") == 2000) & (F.col("name") == "CENSUS")).drop("yr")
    return rounded_cols(out, [*CORE, "seg_explained"])


MEAS = "Hw, H, totalE, Hb, Pb, Hbg, Pbg"
YEAR_CHANGE = f"""{YEAR_PLACED}, {year_long()}, {focal_sql('ylong', keys='yr, cbsa, "name"', leaf='blkgrp')},
 m as (select yr, cbsa, "name", unnest(['Hw', 'H', 'totalE', 'Hb', 'Pb', 'Hbg', 'Pbg']) metric,
   unnest(["Hw", "H", "totalE", "Hb", "Pb", "Hbg", "Pbg"]) v from split),
 chg as (select a.cbsa, a.metric, d.v - a.v "DP", c.v - a.v "CENSUS" from m a
   join m d on a.cbsa = d.cbsa and a.metric = d.metric and d.yr = 2010 and d."name" = 'DP'
   left join m c on a.cbsa = c.cbsa and a.metric = c.metric and c.yr = 2010 and c."name" = 'CENSUS'
   where a.yr = 2000)"""


def year_change(spark, sf):
    from segspark.operators.compare import MEASURES, change_between_years

    return change_between_years(year_flat(spark, sf), "yr", ["cbsa"], MEASURES, 2000, 2010, base_source="CENSUS")


@query("change_from_baseline", f"""with {YEAR_CHANGE} select cbsa, metric, {rounded('DP, CENSUS')} from chg""")
def q_change(spark, sf):
    return rounded_cols(year_change(spark, sf), ["DP", "CENSUS"])


@query("increase_summary", f"""with {YEAR_CHANGE}, l as (
 select 'DP' as "name", "DP" v from chg where metric = 'Pb' union all select 'CENSUS', "CENSUS" from chg where metric = 'Pb')
select "name", round(avg(v * 100), 2) + 0.0 as mu, round(avg((sign(v) + 1) / 0.02), 6) + 0.0 as pplus from l group by "name" """)
def q_increase(spark, sf):
    from segspark.operators.compare import increase_summary

    out = increase_summary(year_change(spark, sf).where(F.col("metric") == "Pb"))
    return out.withColumns({"mu": F.col("mu") + 0.0, "pplus": tidy(F.col("pplus"))})


@query("level_change_from_baseline", f"""with {YEAR_NESTED}, {TYPES}, st as (
 select yr, cbsa, "name", "Level", seg_explained v from geo where "Level" <> 'Tract'
 union all select yr, cbsa, "name", 'Block Group', 1 - "Pb" from geo where "Level" = 'Place')
select t."type", a.cbsa, a."Level", round(d.v - a.v, 6) + 0.0 as "DP", round(c.v - a.v, 6) + 0.0 as "CENSUS"
from st a join types t on a.cbsa = t.cbsa
 join st d on a.cbsa = d.cbsa and a."Level" = d."Level" and d.yr = 2010 and d."name" = 'DP'
 left join st c on a.cbsa = c.cbsa and a."Level" = c."Level" and c.yr = 2010 and c."name" = 'CENSUS'
where a.yr = 2000""")
def q_level_change(spark, sf):
    from segspark.operators.compare import change_between_years

    geo = year_nested(spark, sf).where(F.col("Level") != "Tract")
    stack = theil.with_residual(geo, "Place", "Block Group", ["yr", *STACK_COLS])
    out = change_between_years(stack, "yr", ["cbsa", "Level"], ["seg_explained"], 2000, 2010, base_source="CENSUS").drop("metric")
    typed = relate.attach_distinct(out, crosswalk(spark, sf), ["cbsa"], ["type"])
    return rounded_cols(typed, ["DP", "CENSUS"])


# --- sums that are kept -------------------------------------------------------------------------

@query("theil_stored_sums", f"""with {CELL}, {LONG}, {focal_sql('long')}
select cbsa, "name", {rounded('Hw, H, totalE, Hb, Pb, Hbg, Pbg, Hwg')} from split""")
def q_stored(spark, sf):
    """Blocks delivered in three parts: the first call keeps the sums of one, the second adds the other two."""
    cells = cell(spark, sf).withColumn("delivery", F.pmod(F.xxhash64("block"), F.lit(3)).cast("int"))
    path, parts = scratch_dir(spark, "sums"), cells.select("delivery").distinct()
    for wanted in (parts.where("delivery = 1"), parts):
        sums = stored.stored_sums(spark, path, cells, FIVE, PRIORITIES, ["delivery"], wanted, FOCAL, with_rest=True)
    out = stored.decompose_stored(sums, FIVE, PRIORITIES, FOCAL, with_rest=True)
    return rounded_cols(out, [*CORE, "Hbg", "Pbg", "Hwg"])


@query("change_from_stored_baseline", f"""with {YEAR_CHANGE} select cbsa, metric, {rounded('DP, CENSUS')} from chg""")
def q_stored_change(spark, sf):
    """The baseline year is kept as sums; the later year adds its own and plans nothing of the baseline again."""
    from segspark.operators.compare import MEASURES, change_between_years

    h = theil.Hierarchy(scope=["yr", "cbsa"], mid="tract", leaf=["blkgrp"], group="race", sources=SOURCES)
    cells, path = year_cells(spark, sf), scratch_dir(spark, "year-sums")
    years = cells.select("yr").distinct()
    for wanted in (years.where("yr = 2000"), years):
        sums = stored.stored_sums(spark, path, cells, h, FOUR, ["yr"], wanted, FOCAL)
    out = stored.decompose_stored(sums, h, FOUR, FOCAL)
    return rounded_cols(change_between_years(out, "yr", ["cbsa"], MEASURES, 2000, 2010, base_source="CENSUS"), ["DP", "CENSUS"])
