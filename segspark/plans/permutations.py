"""Null distributions of the measures under random pairing of people and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.operators import reshape, theil
from segspark.operators.permute import drawn_cells, permuted_cells
from segspark.plans.inputs import CELL, FOCAL, FOUR, cell, rounded
from segspark.plans.registry import query
from segspark.plans.segregation import CORE, FOUR_SQL, focal_sql, rounded_cols

SEED, N_SIMS = 123, 100


def null_measures(spark, sf, strata: list[str]):
    """H and its splits for every simulated table; the simulation is one more scope column."""
    cells = reshape.both_zero_dropped(cell(spark, sf), "census", "dp").where(F.col("race").isin(FOUR))
    carry = [] if "tract" in strata else ["tract"]
    sims = permuted_cells(cells, strata, "block", "race", "census", N_SIMS, SEED, carry, wide=FOUR)
    h = theil.Hierarchy(scope=["cbsa", "sim"], mid="tract", leaf=["block"], group="race", sources={None: "value"})
    out = theil.decompose(sims, h, FOUR, focal=FOCAL, wide=True)
    out = out.withColumn("name", F.format_string("SIM%03d", "sim")).drop("sim")
    return rounded_cols(out, [*CORE, "Hbg", "Pbg"])


def null_sql(strata: str) -> str:
    return f"""with {CELL}, pc as (select * from cell where not (census = 0 and dp = 0) and race in ({FOUR_SQL}) and census > 0),
lv as (select cbsa, tract, block, sum(census) v from pc group by all),
people as (select sim, cbsa, tract, block, k from (select lv.*, unnest(range(1, cast(v as bigint) + 1)) k from lv) cross join range({N_SIMS}) s(sim)),
a as (select *, row_number() over (partition by sim, {strata} order by md5(concat('{SEED}|', cast(sim as varchar), '|', cast(block as varchar), '|', cast(k as varchar))), block, k) rn from people),
mg as (select {strata}, race, sum(census) v from pc group by {strata}, race),
b as (select {strata}, race, row_number() over (partition by {strata} order by race, k) rn from (select mg.*, unnest(range(1, cast(v as bigint) + 1)) k from mg)),
sims as (select sim, cbsa, tract, block, race, count(*) "value" from a join b using ({strata}, rn) group by all),
{focal_sql('sims', keys='cbsa, sim')}
select cbsa, 'SIM' || lpad(cast(sim as varchar), 3, '0') as "name", {rounded('Hw, H, totalE, Hb, Pb, Hbg, Pbg')} from split"""


@query("permutation_null", null_sql("cbsa"))
def q_null(spark, sf):
    return null_measures(spark, sf, ["cbsa"])


@query("permutation_null_stratified", null_sql("cbsa, tract"))
def q_null_stratified(spark, sf):
    """Shuffles only inside each mid unit."""
    return null_measures(spark, sf, ["cbsa", "tract"])


def drawn(spark, sf, strata: list[str], wide: list[str] | None = None):
    cells = reshape.both_zero_dropped(cell(spark, sf), "census", "dp").where(F.col("race").isin(FOUR))
    carry = [] if "tract" in strata else ["tract"]
    return drawn_cells(cells, strata, "block", "race", "census", N_SIMS, SEED, carry, wide=wide)


def drawn_measures(spark, sf, strata: list[str]):
    """As ``null_measures``, from tables drawn at the level of counts."""
    h = theil.Hierarchy(scope=["cbsa", "sim"], mid="tract", leaf=["block"], group="race", sources={None: "value"})
    out = theil.decompose(drawn(spark, sf, strata, FOUR), h, FOUR, focal=FOCAL, wide=True)
    return rounded_cols(out.withColumn("name", F.format_string("SIM%03d", "sim")).drop("sim"), [*CORE, "Hbg", "Pbg"])


@query("permutation_null_drawn")
def q_drawn(spark, sf):
    """Null distribution from hypergeometric draws: random, so its margins and moments are checked, not its values."""
    return drawn_measures(spark, sf, ["cbsa"])


@query("permutation_null_drawn_stratified")
def q_drawn_stratified(spark, sf):
    return drawn_measures(spark, sf, ["cbsa", "tract"])


def margins_sql(strata: str) -> str:
    """Both margins of every simulated table are those of the counts."""
    return f"""with {CELL}, pc as (select * from cell where not (census = 0 and dp = 0) and race in ({FOUR_SQL}) and census > 0),
sims as (select 'SIM' || lpad(cast(i as varchar), 3, '0') as "name" from range({N_SIMS}) t(i)),
g as (select {strata}, 'race' kind, cast(race as varchar) unit, cast(sum(census) as bigint) n from pc group by {strata}, race),
l as (select {strata}, 'block' kind, cast(block as varchar) unit, cast(sum(census) as bigint) n from pc group by {strata}, block)
select * from sims cross join (select * from g union all select * from l)"""


def drawn_margins(spark, sf, strata: list[str]):
    cells = drawn(spark, sf, strata)
    name = F.format_string("SIM%03d", "sim").alias("name")
    sums = lambda unit: cells.groupBy("sim", *strata, unit).agg(F.sum("value").alias("n")).select(
        name, *strata, F.lit(unit).alias("kind"), F.col(unit).cast("string").alias("unit"), "n")
    return sums("race").unionByName(sums("block"))


@query("permutation_drawn_margins", margins_sql("cbsa"))
def q_drawn_margins(spark, sf):
    return drawn_margins(spark, sf, ["cbsa"])


@query("permutation_drawn_margins_stratified", margins_sql("cbsa, tract"))
def q_drawn_margins_stratified(spark, sf):
    return drawn_margins(spark, sf, ["cbsa", "tract"])
