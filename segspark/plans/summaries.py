"""Aggregates, windows, distributions and source-against-source summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.functions import right_closed_bin, tidy
from segspark.operators import compare, distribution, ranking, reshape, theil
from segspark.plans.inputs import CELL, FOCAL, FOUR, PRIORITIES, SOURCES, cell, direct_theil, rounded, table
from segspark.plans.registry import query
from segspark.plans.segregation import FOUR_SQL, METRO_LONG, focal_sql, metro_rolled, rounded_cols
from segspark.session import scratch_dir
from segspark.sources import materialize

# --- aggregates -------------------------------------------------------------------------------


@query("agg_group_sum", f"with {CELL} select tract, race, cast(sum(census) as bigint) n from cell group by tract, race")
def q_group_sum(spark, sf):
    return cell(spark, sf).groupBy("tract", "race").agg(F.sum("census").alias("n"))


@query("agg_multi", f"with {CELL} select race, cast(sum(dp) as bigint) dp, cast(sum(census) as bigint) census from cell group by race")
def q_multi(spark, sf):
    return cell(spark, sf).groupBy("race").agg(F.sum("dp").alias("dp"), F.sum("census").alias("census"))


@query("rollup_leaf", f"""with {CELL} select tract, blkgrp, race, cast(sum(census) as bigint) census, cast(sum(dp) as bigint) dp
 from cell group by tract, blkgrp, race""")
def q_rollup(spark, sf):
    return cell(spark, sf).groupBy("tract", "blkgrp", "race").agg(F.sum("census").alias("census"), F.sum("dp").alias("dp"))


@query("agg_peel", f"""with {CELL}, u as (select cbsa, tract, sum(census) n from cell group by cbsa, tract)
select cbsa, cast(sum(n) as bigint) total, cast(max(n) as bigint) largest, count(*) units from u group by cbsa""")
def q_peel(spark, sf):
    """Cells to units, units to scopes."""
    units = cell(spark, sf).groupBy("cbsa", "tract").agg(F.sum("census").alias("n"))
    return units.groupBy("cbsa").agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("units"))


@query("agg_mean_narm", f"""with {CELL} select tract, round(avg(case when census > 0 then dp / census::double end), 6) + 0.0 as mean_ratio
 from cell group by tract""")
def q_mean(spark, sf):
    """Mean over the defined values: a ratio with a zero base is NULL and left out."""
    ratio = F.try_divide(F.col("dp").cast("double"), F.col("census").cast("double"))
    return cell(spark, sf).groupBy("tract").agg(tidy(F.avg(ratio)).alias("mean_ratio"))


@query("agg_count", "select l_returnflag, l_linestatus, count(*) n from lineitem group by all")
def q_count(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("agg_first", """select l_suppkey, any_value(s_name) s_name, cast(sum(l_quantity) as bigint) q
 from lineitem join supplier on l_suppkey = s_suppkey group by l_suppkey""")
def q_first(spark, sf):
    """A value that is constant within the group, carried through the aggregate."""
    joined = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q")).join(
        table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("l_suppkey").agg(F.any_value("s_name").alias("s_name"), F.sum("q").alias("q"))


@query("agg_diff", f"""with {CELL} select tract, race, cast(sum(dp) - sum(census) as bigint) diff from cell group by tract, race""")
def q_diff(spark, sf):
    """Second minus first of the two source rows of a group."""
    sums = cell(spark, sf).groupBy("tract", "race").agg(F.sum("dp").alias("dp"), F.sum("census").alias("census"))
    long = reshape.to_long(sums, ["tract", "race"], {"DP": "dp", "CENSUS": "census"})
    return compare.paired_difference(long, ["tract", "race"], "name", "value", "CENSUS", "DP", "diff")


@query("agg_all_numeric", """select l_returnflag, round(avg(l_quantity), 6) + 0.0 as l_quantity, round(avg(l_discount), 6) + 0.0 as l_discount,
 round(avg(l_tax), 6) + 0.0 as l_tax, round(avg(l_linenumber), 6) + 0.0 as l_linenumber from lineitem group by l_returnflag""")
def q_all_numeric(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus")
    out = compare.numeric_means(rows, ["l_returnflag"])
    return rounded_cols(out, [c for c in out.columns if c != "l_returnflag"])


GROWTH = f"""{CELL}, growth as (select tract, block, sum(census) "cPop", sum(dp) "dPop", sum(case when race = '{FOCAL}' then census end) focal
 from cell group by tract, block having sum(census) <> 0)"""


def growth(spark, sf):
    return compare.growth_frame(cell(spark, sf), ["tract", "block"], "race", FOCAL, "census", "dp")


@query("growth_frame", f"""with {GROWTH} select tract, block, cast("cPop" as bigint) "cPop", cast("dPop" as bigint) "dPop", cast(focal as bigint) focal,
 cast("dPop" - "cPop" as bigint) "popChange", round(focal / "cPop"::double, 6) + 0.0 as "pFocal", "dPop" > "cPop" as increase from growth""")
def q_growth(spark, sf):
    return rounded_cols(growth(spark, sf), ["pFocal"])


def binned_sql(bins: int) -> str:
    return f"""with {GROWTH}, b as (select "dPop" - "cPop" d, cast(case when focal is not null then least({bins}, greatest(1,
 (focal * {bins} + "cPop" - 1) // "cPop")) end as int) bin from growth)
select bin, cast(sum(d) as bigint) "popChange" from b group by bin"""


def binned(spark, sf, bins: int):
    g = growth(spark, sf).withColumn("bin", right_closed_bin(F.col("focal"), F.col("cPop"), bins))
    return g.groupBy("bin").agg(F.sum("popChange").alias("popChange"))


@query("binned_sum_10", binned_sql(10))
def q_binned_10(spark, sf):
    return binned(spark, sf, 10)


@query("binned_sum_100", binned_sql(100))
def q_binned_100(spark, sf):
    return binned(spark, sf, 100)


@query("equal_width_bins", """with e as (select min(o_totalprice) lo, max(o_totalprice) hi from orders)
select o_orderkey, cast(least(20, greatest(1, ceil((o_totalprice - lo) * 20.0e0 / (hi - lo)))) as int) bin from orders, e""")
def q_equal_bins(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return distribution.equal_width_bins(rows, "o_totalprice", 20).select("o_orderkey", "bin")


ERASED = f"""{CELL}, t as (select tract, block, sum(census) tot from cell group by tract, block),
 er as (select c.*, census / nullif(tot, 0)::double p from cell c join t using (tract, block) where dp = 0 and census <> 0)"""


def erased_shares(spark, sf):
    """Share that the emptied cells had in their unit."""
    shared = ranking.share_of_total(cell(spark, sf), ["tract", "block"], {"p": "census"}, small_groups=True)
    return shared.where(compare.erased(F.col("census"), F.col("dp")))


@query("erased_shares", f"""with {ERASED} select tract, block, race, census, dp - census diff, round(p, 6) + 0.0 as p from er""")
def q_erased(spark, sf):
    return erased_shares(spark, sf).select(
        "tract", "block", "race", "census", (F.col("dp") - F.col("census")).alias("diff"), tidy(F.col("p")).alias("p"))


@query("erased_by_size", f"""with {ERASED} select tract, block, race, dp - census diff from er order by diff, tract, block, race""")
def q_erased_by_size(spark, sf):
    """Emptied cells, the largest losses first."""
    cells = cell(spark, sf).where(compare.erased(F.col("census"), F.col("dp")))
    return cells.select("tract", "block", "race", (F.col("dp") - F.col("census")).alias("diff")).orderBy("diff", "tract", "block", "race")


@query("histogram_by_group", f"""with {ERASED}, e as (select min(p) lo, max(p) hi from er)
select race, cast(least(30, greatest(1, coalesce(ceil((p - lo) * 30.0e0 / nullif(hi - lo, 0)), 1))) as int) bin, count(*) n from er, e group by all""")
def q_histogram(spark, sf):
    return distribution.histogram(erased_shares(spark, sf), ["race"], "p", 30)


@query("histogram_free_scale", f"""with {ERASED}, e as (select race, min(p) lo, max(p) hi from er group by race)
select race, cast(least(30, greatest(1, coalesce(ceil((p - lo) * 30.0e0 / nullif(hi - lo, 0)), 1))) as int) bin, count(*) n from er join e using (race) group by all""")
def q_histogram_free(spark, sf):
    return distribution.histogram(erased_shares(spark, sf), ["race"], "p", 30, per_group=True)


ENT = "sum(case when {c} > 0 then {c} / t * ln(t / nullif({c}, 0)) else 0 end)"


def local_sql(unit: str) -> str:
    return f"""{CELL}, lc as (select {unit}, race, sum(census)::double census, sum(dp)::double dp, sum(sum(census)) over (partition by {unit})::double ct,
  sum(sum(dp)) over (partition by {unit})::double dt from cell where race in ({FOUR_SQL}) group by {unit}, race),
 le as (select {unit}, coalesce({ENT.format(c='dp').replace('t *', 'dt *').replace('/ t', '/ dt').replace('ln(t', 'ln(dt')}, 0) "DP",
  coalesce({ENT.format(c='census').replace('/ t', '/ ct').replace('ln(t', 'ln(ct')}, 0) "CENSUS", sum(census) "Pop" from lc group by {unit})"""


@query("local_entropy", f"""with {local_sql('tract, block')} select tract, block, round("CENSUS", 6) + 0.0 as "CENSUS", round("DP", 6) + 0.0 as "DP",
 cast("Pop" as bigint) "Pop" from le""")
def q_local(spark, sf):
    out = compare.local_entropy(cell(spark, sf), ["tract", "block"], "race", FOUR, SOURCES, pop="census")
    return rounded_cols(out, ["CENSUS", "DP"])


@query("local_entropy_tract", f"""with {local_sql('tract')} select tract, round("CENSUS", 6) + 0.0 as "CENSUS", round("DP", 6) + 0.0 as "DP",
 cast("Pop" as bigint) "Pop" from le""")
def q_local_tract(spark, sf):
    out = compare.local_entropy(cell(spark, sf), ["tract"], "race", FOUR, SOURCES, pop="census")
    return rounded_cols(out, ["CENSUS", "DP"])


@query("local_entropy_long", f"""with {local_sql('tract, block')} select * from (
 select tract, block, 'CENSUS' as "name", round("CENSUS", 6) + 0.0 as "value" from le where not ("CENSUS" = 0 and "DP" = 0)
 union all select tract, block, 'DP', round("DP", 6) + 0.0 from le where not ("CENSUS" = 0 and "DP" = 0))""")
def q_local_long(spark, sf):
    """One row per unit and source, without units that are of one group under both."""
    out = compare.local_entropy(cell(spark, sf), ["tract", "block"], "race", FOUR, SOURCES)
    some = out.where((F.col("CENSUS") != 0) | (F.col("DP") != 0))
    return rounded_cols(reshape.to_long(some, ["tract", "block"], ["CENSUS", "DP"]), ["value"])


POINTS, MASS = 512, 1024


@query("density_curve", f"""with {local_sql('tract, block')}, v as (
 select 'CENSUS' as "name", round("CENSUS", 9) x from le union all select 'DP', round("DP", 9) from le),
 ends as (select min(x) lo, max(x) hi from v),
 q as (select "name", count(*) n, stddev_samp(x) sd, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34e0 iq from v group by "name"),
 bw as (select "name", n, 0.9e0 * coalesce(case when least(sd, iq) > 0 then least(sd, iq) when sd > 0 then sd end, 1.0e0) * pow(n, -0.2e0) bw from q),
 pos as (select "name", (x - lo) / ((hi - lo) / {MASS - 1}) a, lo, hi from v, ends),
 lf as (select "name", a, lo, hi, least(floor(a), {MASS - 2}) g from pos),
 mass as (select "name", g, sum(m) m from (select "name", g, 1 - (a - g) m from lf union all select "name", g + 1, a - g from lf) group by "name", g)
select m."name", cast(point as int) point, round(any_value(lo + (hi - lo) * point / {POINTS - 1}), 6) + 0.0 as x,
 round(sum(m.m * exp(-0.5e0 * pow((lo + (hi - lo) * point / {POINTS - 1} - lo - (hi - lo) * g / {MASS - 1}) / bw, 2)) / (bw * sqrt(2 * pi()))) / any_value(n), 6) + 0.0 as density
from mass m join bw on m."name" = bw."name", ends, range({POINTS}) t(point) group by m."name", point""")
def q_density(spark, sf):
    """Distribution of unit entropy under each source, from a written table of the entropies."""
    def build():
        local = compare.local_entropy(cell(spark, sf), ["tract", "block"], "race", FOUR, SOURCES)
        return reshape.to_long(local, [], ["CENSUS", "DP"]).withColumn("value", F.round("value", 9))

    long = materialize(spark, scratch_dir(spark, "entropies"), build)
    return rounded_cols(distribution.density_curve(long, "name", "value", POINTS, MASS), ["x", "density"])


@query("quantiles_by_group", """select l_returnflag, p, round(q, 6) + 0.0 as quantile from (select l_returnflag,
 unnest([0.05, 0.25, 0.5, 0.75, 0.99])::double p, unnest(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.99])) q from lineitem group by 1)""")
def q_quantiles(spark, sf):
    """Quantiles behind the kernel bandwidth."""
    out = distribution.exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.99])
    return rounded_cols(out, ["quantile"])


# --- windows ----------------------------------------------------------------------------------


@query("win_share", f"""with {CELL} select tract, block, race, round(census / nullif(sum(census) over (partition by tract, block), 0)::double, 6) + 0.0 as share from cell""")
def q_share(spark, sf):
    out = ranking.share_of_total(cell(spark, sf), ["tract", "block"], {"share": "census"}, small_groups=True)
    return out.select("tract", "block", "race", tidy(F.col("share")).alias("share"))


@query("layout_check", """with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int) field_size, cast(1 + 25 * (l_linenumber - 1) as int) starting_pos from lineitem),
 r as (select *, cast(coalesce(sum(field_size) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, field_size rows between unbounded preceding and 1 preceding) + 1, 1) as bigint) expected_pos from l)
select l_orderkey, l_linenumber, l_partkey, starting_pos, expected_pos from r where expected_pos <> starting_pos""")
def q_layout(spark, sf):
    """Every order is a record layout, its lines the fields, with a declared start to be checked."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("field_size"),
        (1 + 25 * (F.col("l_linenumber") - 1)).alias("starting_pos"))
    bad = ranking.layout_mismatches(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "field_size"], "field_size", "starting_pos")
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "starting_pos", "expected_pos")


@query("top1_per_group", """select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) rn
 from customer) where rn = 1""")
def q_top1(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return ranking.first_per_group(rows, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey").asc()])


@query("max_with_ties", """select l_suppkey, l_orderkey, l_linenumber, l_quantity from (select *, rank() over (partition by l_suppkey order by l_quantity desc) rk from lineitem) where rk = 1""")
def q_max_ties(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return ranking.max_with_ties(rows, ["l_suppkey"], "l_quantity")


@query("row_id", "select o_orderkey, row_number() over (order by o_orderkey) id from orders")
def q_row_id(spark, sf):
    return ranking.dense_row_id(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


# --- source against source ----------------------------------------------------------------------


@query("count_change", f"""with {CELL} select race, round(avg(dp - census), 6) + 0.0 as mean_change, count(*) cells from cell group by race""")
def q_count_change(spark, sf):
    d = F.col("dp") - F.col("census")
    return cell(spark, sf).groupBy("race").agg(tidy(F.avg(d)).alias("mean_change"), F.count(F.lit(1)).alias("cells"))


def erasure_sql(src: str) -> str:
    return f"""select race, round(avg(case when dp = 0 and census <> 0 then 1.0e0 else 0 end), 6) + 0.0 as erasure_rate,
 cast(sum(case when dp = 0 and census <> 0 then dp - census else 0 end) as bigint) erased_count,
 round(avg(case when dp <> 0 and census = 0 then 1.0e0 else 0 end), 6) + 0.0 as creation_rate,
 cast(sum(case when dp <> 0 and census = 0 then dp - census else 0 end) as bigint) created_count from {src} group by race"""


@query("erasure_creation", f"with {CELL} {erasure_sql('cell')}")
def q_erasure(spark, sf):
    return rounded_cols(compare.erasure_creation(cell(spark, sf), ["race"], "census", "dp"), ["erasure_rate", "creation_rate"])


@query("erasure_creation_rolled", f"""with {CELL}, rc as (select tract, blkgrp, race, sum(census) census, sum(dp) dp from cell group by all) {erasure_sql('rc')}""")
def q_erasure_rolled(spark, sf):
    rolled = cell(spark, sf).groupBy("tract", "blkgrp", "race").agg(F.sum("census").alias("census"), F.sum("dp").alias("dp"))
    return rounded_cols(compare.erasure_creation(rolled, ["race"], "census", "dp"), ["erasure_rate", "creation_rate"])


# The classes of the collapsed groups.
CLASSES = {"High": ["1-URGENT", "2-HIGH"], "Medium": ["3-MEDIUM"], "Low": ["4-NOT SPECIFIED", "5-LOW"]}
CLASS_CASE = """case when race in ('1-URGENT', '2-HIGH') then 'High' when race = '3-MEDIUM' then 'Medium' else 'Low' end"""


def collapsed(spark, sf):
    cells = cell(spark, sf).withColumn("race2", reshape.collapse(F.col("race"), CLASSES))
    return cells.groupBy("tract", "block", "race2").agg(F.sum("dp").alias("dp"), F.sum("census").alias("census"))


@query("collapse_groups", f"""with {CELL} select tract, block, {CLASS_CASE} race2, cast(sum(dp) as bigint) dp, cast(sum(census) as bigint) census from cell group by all""")
def q_collapse(spark, sf):
    return collapsed(spark, sf)


@query("binomial_counts", f"""with {CELL}, c5 as (select tract, block, {CLASS_CASE} race2, sum(dp) dp, sum(census) census from cell group by all)
select tract, block, eth, cast(sum(case when race2 = eth then dp else 0 end) as bigint) "dpY", cast(sum(dp) as bigint) "dpN",
 cast(sum(case when race2 = eth then census else 0 end) as bigint) "cY", cast(sum(census) as bigint) "cN",
 round(sum(case when race2 = eth then census else 0 end) / nullif(sum(census), 0)::double, 6) + 0.0 as "cP",
 round(sum(case when race2 = eth then dp else 0 end) / nullif(sum(dp), 0)::double, 6) + 0.0 as "dpP"
from c5 cross join (values ('High'), ('Low')) e(eth) group by tract, block, eth having not (sum(dp) = 0 and sum(census) = 0)""")
def q_binomial(spark, sf):
    out = compare.binomial_counts(collapsed(spark, sf), ["tract", "block"], "race2", ["High", "Low"], "census", "dp")
    return rounded_cols(out, ["cP", "dpP"])


ERR = ", ".join(
    f"""round(max(case when "name" = 'DP' then "{m}" end) - max(case when "name" = 'CENSUS' then "{m}" end), 6) + 0.0 as "{m}\""""
    for m in compare.MEASURES
)


@query("measure_error", f"""with {METRO_LONG}, {focal_sql('mlong', leaf='blkgrp')} select cbsa, {ERR} from split group by cbsa""")
def q_measure_error(spark, sf):
    return rounded_cols(compare.measure_errors(metro_rolled(spark, sf), ["cbsa"]), compare.MEASURES)
