"""Projection, filter, reshape, join, sort and scalar queries on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.functions import inverse_logit, invert, pad_code, replace_first, squash_suffix, tidy
from segspark.operators import ranking, relate, reshape
from segspark.operators.permute import expand_counts
from segspark.plans.inputs import (
    AGE_CELL, AGE_LONG, AGE_VARS, CELL, CELL_YEAR, CROSSWALK, FOUR, LONG, PRIORITIES, SOURCES, UNIT_PLACE,
    age_long, age_vars, cell, cell_year, crosswalk, table, unit_place,
)
from segspark.plans.registry import query

# --- projections and filters --------------------------------------------------------------


@query("project_drop", "select o_orderkey, o_custkey, o_orderpriority from orders")
def q_project(spark, sf):
    ids = ["o_orderkey", "o_custkey"]
    return table(spark, sf, "orders").select(*ids, "o_orderpriority", "o_orderstatus").drop("o_orderstatus")


@query("bulk_rename", 'select c_custkey "Total", c_nationkey "County", c_acctbal "Balance" from customer')
def q_rename(spark, sf):
    labels = {"Total": "c_custkey", "County": "c_nationkey", "Balance": "c_acctbal"}
    return table(spark, sf, "customer").select(*labels.values()).withColumnsRenamed(invert(labels))


@query("filter_eq", "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority <> '1-URGENT'")
def q_filter_eq(spark, sf):
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "1-URGENT")).select(
        "o_orderkey", "o_orderpriority")


@query("filter_in", "select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')")
def q_filter_in(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderpriority").isin(FOUR)).select("o_orderkey", "o_orderpriority")


@query("drop_both_zero", f"with {CELL} select block, race, census, dp from cell where not (census = 0 and dp = 0)")
def q_drop_both_zero(spark, sf):
    return reshape.both_zero_dropped(cell(spark, sf).select("block", "race", "census", "dp"), "census", "dp")


@query("filter_notnull", f"""with {UNIT_PLACE} select distinct concat(cast(c_nationkey as varchar), '-', c_mktsegment) blkgrp, name_full
 from customer left join unit_place on blkgrp = concat(cast(c_nationkey as varchar), '-', c_mktsegment)
 where name_full is not null and c_mktsegment is not null""")
def q_filter_notnull(spark, sf):
    c = table(spark, sf, "customer").select(
        F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")).alias("blkgrp")).distinct()
    joined = c.join(unit_place(spark, sf), "blkgrp", "left")
    return joined.where(F.col("name_full").isNotNull() & F.col("blkgrp").isNotNull())


@query("recode_case", """select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'High'
 when o_orderpriority in ('3-MEDIUM') then 'Medium' when o_orderpriority in ('5-LOW') then 'Low' end as class from orders""")
def q_recode_case(spark, sf):
    classes = {"High": ["1-URGENT", "2-HIGH"], "Medium": ["3-MEDIUM"], "Low": ["5-LOW"]}
    return table(spark, sf, "orders").select("o_orderkey", reshape.collapse(F.col("o_orderpriority"), classes).alias("class"))


@query("recode_ifelse", f"""with {UNIT_PLACE} select c_custkey, coalesce(name_full, 'No Place') name_full,
 case when c_mktsegment = 'BUILDING' then 'BUILDING' else 'Other' end seg
 from customer left join unit_place on blkgrp = concat(cast(c_nationkey as varchar), '-', c_mktsegment)""")
def q_recode_ifelse(spark, sf):
    c = table(spark, sf, "customer").withColumn(
        "blkgrp", F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")))
    placed = relate.assign_place(c, unit_place(spark, sf), "blkgrp", "name_full")
    return placed.select("c_custkey", "name_full", reshape.focal_or_rest(F.col("c_mktsegment"), "BUILDING", "Other").alias("seg"))


@query("recode_dict", """select o_orderkey, case substr(o_orderpriority, 1, 2) when '1-' then 'first' when '2-' then 'second'
 when '3-' then 'third' end as label from orders""")
def q_recode_dict(spark, sf):
    names = {"1-": "first", "2-": "second", "3-": "third"}
    return table(spark, sf, "orders").select("o_orderkey", reshape.recode_prefix(F.col("o_orderpriority"), 2, names).alias("label"))


BAND_OF = {"low": range(1, 4), "mid": range(4, 9), "high": range(9, 13)}
MONTHS = ", ".join(f"sum(case when month(o_orderdate) = {m} then 1 else 0 end) m{m:02d}" for m in range(1, 13))


@query("rowwise_band_sum", f"""with w as (select o_custkey, {MONTHS} from orders group by o_custkey)
select o_custkey, cast({' + '.join(f'm{m:02d}' for m in BAND_OF['low'])} as bigint) low,
 cast({' + '.join(f'm{m:02d}' for m in BAND_OF['mid'])} as bigint) mid,
 cast({' + '.join(f'm{m:02d}' for m in BAND_OF['high'])} as bigint) high from w""")
def q_band_sum(spark, sf):
    """Twelve count columns per unit summed into three bands."""
    month = F.month("o_orderdate")
    wide = table(spark, sf, "orders").groupBy("o_custkey").agg(
        *[F.sum(F.when(month == m, 1).otherwise(0)).alias(f"m{m:02d}") for m in range(1, 13)])
    bands = {b: reshape.row_sum([f"m{m:02d}" for m in ms]) for b, ms in BAND_OF.items()}
    return wide.select("o_custkey", *[c.alias(b) for b, c in bands.items()])


@query("key_build", """select c_custkey, printf('%02d', c_nationkey) || printf('%03d', c_custkey % 1000) "COUNTY",
 printf('%02d', c_nationkey) || c_mktsegment "TRACT" from customer""")
def q_key_build(spark, sf):
    pad = pad_code
    rows = table(spark, sf, "customer").select(
        "c_custkey", pad(F.col("c_nationkey"), 2).alias("st"), pad(F.col("c_custkey") % 1000, 3).alias("co"), "c_mktsegment")
    return reshape.build_keys(rows, {"COUNTY": ["st", "co"], "TRACT": ["st", "c_mktsegment"]}).select("c_custkey", "COUNTY", "TRACT")


@query("key_split", """with g as (select o_orderkey, printf('%015d', o_orderkey) "GEOID" from orders)
select o_orderkey, substr("GEOID", 1, 2) "STATE", substr("GEOID", 3, 3) "COUNTY", substr("GEOID", 6, 6) "TRACT",
 substr("GEOID", 12, 1) "BLKGRP", substr("GEOID", 13, 3) "BLOCK" from g""")
def q_key_split(spark, sf):
    # Positions of the parts of a 15-digit block code.
    parts = {"STATE": (1, 2), "COUNTY": (3, 5), "TRACT": (6, 11), "BLKGRP": (12, 12), "BLOCK": (13, 15)}
    rows = table(spark, sf, "orders").select("o_orderkey", pad_code(F.col("o_orderkey"), 15).alias("GEOID"))
    return reshape.split_key(rows, "GEOID", parts).drop("GEOID")


@query("audit_totals", """with w as (select o_custkey, count(*) total, sum(case when o_orderstatus = 'F' then 1 else 0 end) f,
 sum(case when o_orderstatus = 'O' then 1 else 0 end) o from orders group by o_custkey)
select o_custkey, total, cast(f as bigint) f, cast(o as bigint) o from w where total <> f + o""")
def q_audit(spark, sf):
    """Units whose listed classes do not add up to their total (a third status exists)."""
    st = F.col("o_orderstatus")
    wide = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(st == "F", 1).otherwise(0)).alias("f"),
        F.sum(F.when(st == "O", 1).otherwise(0)).alias("o"))
    return reshape.totals_differ(wide, "total", ["f", "o"])


@query("label_clean_match", """select c_custkey, n_name label from customer join nation
 on c_nationkey = n_nationkey""")
def q_label_clean(spark, sf):
    """Labels with an area suffix, cleaned and then matched."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("label"))
    kind = F.when(F.col("c_nationkey") % 2 == 0, " Metro Area").otherwise(" Micro Area")
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), kind).alias("full"))
    cleaned = c.select("c_custkey", squash_suffix(F.col("full"), [" Metro Area", " Micro Area"]).alias("label"))
    return cleaned.join(n, "label").select("c_custkey", "label")


# --- reshape --------------------------------------------------------------------------------


@query("unpivot_sources", f"""with {CELL} select block, race, 'DP' as "name", dp as "value" from cell
 union all select block, race, 'CENSUS', census from cell""")
def q_unpivot(spark, sf):
    return reshape.to_long(cell(spark, sf), ["block", "race"], {"DP": "dp", "CENSUS": "census"})


@query("pivot_sources", f'with {CELL} select block, race, dp as "DP", census as "CENSUS" from cell')
def q_pivot(spark, sf):
    long = reshape.to_long(cell(spark, sf), ["block", "race"], {"DP": "dp", "CENSUS": "census"})
    return reshape.to_wide(long, ["block", "race"], "name", "value", ["DP", "CENSUS"])


@query("melt_dcast", """select printf('%06d', o_custkey) "GEOID", o_orderpriority "RACE",
 cast(sum(case when o_orderkey % 3 <> 0 then 1 else 0 end) as bigint) "Census",
 cast(sum(case when o_orderkey % 3 <> 1 then 1 else 0 end) as bigint) "DP" from orders group by o_custkey, o_orderpriority""")
def q_melt(spark, sf):
    """Wide file with one column per (group, source): melt, decode the names, cast back by source."""
    # Variable code of each group.
    codes = {"V001": "1-URGENT", "V002": "2-HIGH", "V003": "3-MEDIUM", "V004": "4-NOT SPECIFIED", "V005": "5-LOW"}
    key, pr = F.col("o_orderkey"), F.col("o_orderpriority")
    aggs = []
    for code, g in codes.items():
        aggs += [F.sum(F.when(pr == g, (key % 3 != 0).cast("long"))).alias(f"{code}_sf"),
                 F.sum(F.when(pr == g, (key % 3 != 1).cast("long"))).alias(f"{code}_dp")]
    wide = table(spark, sf, "orders").groupBy(F.concat(F.lit("G"), pad_code(F.col("o_custkey"), 6)).alias("id")).agg(*aggs)
    long = reshape.to_long(wide, ["id"], [c for c in wide.columns if c != "id"], "variable", "value").where(F.col("value").isNotNull())
    long = long.select(
        F.expr("substring(id, 2)").alias("GEOID"), reshape.recode_prefix(F.col("variable"), 4, codes).alias("RACE"),
        F.when(F.col("variable").endswith("sf"), "Census").otherwise("DP").alias("Type"), "value")
    return reshape.to_wide(long, ["GEOID", "RACE"], "Type", "value", ["Census", "DP"])


@query("paired_cells", f"""with {CELL}
select tract "TRACT", blkgrp "BLKGRP", block "BLOCK", race "RACE", dp "DP", census "CENSUS" from cell""")
def q_paired(spark, sf):
    """End of an extract: two source files, record geography, stack, long, wide."""
    geo = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("LOGRECNO"), F.col("c_nationkey").alias("TRACT"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")).alias("BLKGRP"),
        F.col("c_custkey").alias("BLOCK"))
    orders, stacked = table(spark, sf, "orders"), None
    for source, dropped in (("DP", 1), ("CENSUS", 0)):
        hit = (F.col("o_orderkey") % 3 != dropped).cast("long")
        file = orders.groupBy(pad_code(F.col("o_custkey"), 12).alias("LOGRECNO")).agg(
            *[F.sum(F.when(F.col("o_orderpriority") == g, hit)).alias(g) for g in PRIORITIES])
        placed = relate.record_geography(file, geo, "LOGRECNO", 12).drop("LOGRECNO").withColumn("SOURCE", F.lit(source))
        stacked = placed if stacked is None else stacked.unionByName(placed)
    long = reshape.to_long(stacked, ["TRACT", "BLKGRP", "BLOCK", "SOURCE"], PRIORITIES, "RACE").where(F.col("value").isNotNull())
    return reshape.to_wide(long, ["TRACT", "BLKGRP", "BLOCK", "RACE"], "SOURCE", "value", ["DP", "CENSUS"])


@query("age_band_pair", f"with {AGE_CELL} select * from age_cell")
def q_age_band(spark, sf):
    """Variables to bands by the dimension, summed, paired with the other source on the full key."""
    keys = ["cbsa", "tract", "blkgrp", "age_group"]
    coded = age_long(spark, sf).join(age_vars(spark, sf).select("base", "age_group"), "base")
    return coded.groupBy(*keys).agg(F.sum("dp").alias("dp"), F.sum("census").alias("census"))


# --- joins ------------------------------------------------------------------------------------


@query("join_record_geo", """select printf('%07d', o_custkey) "LOGRECNO", o_orderkey, c_nationkey from orders
 join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'""")
def q_record_geo(spark, sf):
    geo = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("LOGRECNO"), "c_nationkey")
    rec = table(spark, sf, "orders").select(pad_code(F.col("o_custkey"), 7).alias("LOGRECNO"), "o_orderkey")
    return relate.record_geography(rec, geo, "LOGRECNO", 7)


@query("join_left_place", f"""with {CELL}, {UNIT_PLACE} select block, race, census, name_full from cell left join unit_place using (blkgrp)""")
def q_left_place(spark, sf):
    return cell(spark, sf).join(unit_place(spark, sf), "blkgrp", "left").select("block", "race", "census", "name_full")


@query("join_right", """select c_custkey, n.n_nationkey, n.n_name from (select * from customer where c_mktsegment = 'BUILDING') c
 right join nation n on c.c_nationkey = n.n_nationkey""")
def q_right(spark, sf):
    c = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").select("c_custkey", "n_nationkey", "n_name")


@query("join_natural_multi", f"""with {CELL_YEAR}, a as (select * from cell_year where yr = 2010), b as (select * from cell_year where yr = 2000)
select a.cbsa, a.tract, a.blkgrp, a.block, a.race, a.dp, b.census from a left join b
 on a.cbsa = b.cbsa and a.tract = b.tract and a.blkgrp = b.blkgrp and a.block = b.block and a.race = b.race""")
def q_natural(spark, sf):
    keys = ["cbsa", "tract", "blkgrp", "block", "race"]
    rows = cell_year(spark, sf)
    a, b = rows.where(F.col("yr") == 2010).select(*keys, "dp"), rows.where(F.col("yr") == 2000).select(*keys, "census")
    return a.join(b, keys, "left")


@query("join_semi", """select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')""")
def q_semi(spark, sf):
    keys = table(spark, sf, "customer").where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@query("membership_flag", """select o_orderkey, case when o_custkey in (select c_custkey from customer where c_acctbal > 5000) then '1' else '0' end inside
 from orders""")
def q_membership(spark, sf):
    rich = table(spark, sf, "customer").where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("o_custkey"))
    return relate.membership_flag(table(spark, sf, "orders"), "o_custkey", rich, "inside").select("o_orderkey", "inside")


@query("join_dim_distinct", f"""with {CELL}, {CROSSWALK} select block, race, census, "type" from cell join (select distinct cbsa, "type" from crosswalk) using (cbsa)""")
def q_dim_distinct(spark, sf):
    return relate.attach_distinct(cell(spark, sf), crosswalk(spark, sf), ["cbsa"], ["type"]).select("block", "race", "census", "type")


@query("scope_join", f"""with {CROSSWALK} select x.cbsa, o_orderpriority race, count(*) n from orders join customer on o_custkey = c_custkey
 join crosswalk x on c_nationkey = x.county group by all""")
def q_scope(spark, sf):
    """Every county to its metro at once; customers count first, so few rows meet the crosswalk."""
    per = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("race")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("county"))
    return per.join(c, "o_custkey").join(crosswalk(spark, sf), "county").groupBy("cbsa", "race").agg(F.sum("n").alias("n"))


@query("join_literal_dim", """select o_orderkey, case o_orderstatus when 'F' then 'Finished' when 'O' then 'Open' end as "name" from orders""")
def q_literal_dim(spark, sf):
    # Status codes spelled out.
    names = {"F": "Finished", "O": "Open"}
    out = relate.attach_literal(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", names, "name")
    return out.select("o_orderkey", "name")


# --- sorts, set operations, scalars -----------------------------------------------------------


@query("sort_multi", "select o_orderstatus, o_orderpriority, o_orderkey from orders order by 1, 2, 3")
def q_sort(spark, sf):
    cols = ["o_orderstatus", "o_orderpriority", "o_orderkey"]
    return table(spark, sf, "orders").select(*cols).orderBy(*cols)


@query("sort_abs_topk", f"""with {CELL} select block, race, dp - census diff from cell where census <> 0
 order by abs(dp - census), block, race""")
def q_topk(spark, sf):
    d = (F.col("dp") - F.col("census")).alias("diff")
    return cell(spark, sf).where(F.col("census") != 0).select("block", "race", d).orderBy(F.abs("diff"), "block", "race")


@query("union_sources", """select o_orderkey id, o_orderpriority label, 'orders' source, cast(null as double) price from orders
 union all select l_orderkey, l_returnflag, 'lines', l_extendedprice from lineitem""")
def q_union(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.lit("orders").alias("source"))
    b = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("label"), F.col("l_extendedprice").alias("price"), F.lit("lines").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_keys", "select distinct c_nationkey, c_mktsegment from customer")
def q_distinct(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("scalar_strings", """select p_partkey, p_brand || '/' || p_type joined, substr(p_brand, 7) tail, regexp_replace(p_name, 'r', 'R') first_only,
 regexp_replace(p_name, 'r', 'R', 'g') every, p_name like '%ring' ends, regexp_matches(p_type, 'ECO') found,
 lpad(cast(p_size as varchar), 7, '0') padded, 'SIM' || lpad(cast(p_size as varchar), 3, '0') sim,
 replace(p_name, ' ', '_') underscored from part""")
def q_strings(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("joined"), F.substring("p_brand", 7, 1000).alias("tail"),
        replace_first(name, "r", "R").alias("first_only"), F.regexp_replace(name, "r", "R").alias("every"),
        name.endswith("ring").alias("ends"), F.col("p_type").rlike("ECO").alias("found"),
        F.format_string("%07d", "p_size").alias("padded"), F.format_string("SIM%03d", "p_size").alias("sim"),
        F.replace(name, F.lit(" "), F.lit("_")).alias("underscored"))


@query("scalar_math", """select o_orderkey, round(ln(o_totalprice), 6) + 0.0 as ln_v, round(exp(o_totalprice / 1e6), 6) + 0.0 as exp_v,
 round(abs(o_totalprice - 250000), 6) + 0.0 as abs_v, cast(sign(o_totalprice - 250000) as double) sign_v, round(o_totalprice / 7, 2) + 0.0 as round_v,
 round(power(o_totalprice / 1e5, 2), 6) + 0.0 as pow_v, isfinite(o_totalprice / nullif(o_custkey % 2, 0)) fin,
 round(1 / (1 + exp(-(o_totalprice / 1e5 - 2))), 6) + 0.0 as logit_v from orders""")
def q_math(spark, sf):
    v = F.col("o_totalprice")
    q = F.try_divide(v, (F.col("o_custkey") % 2).cast("double"))
    return table(spark, sf, "orders").select(
        "o_orderkey", tidy(F.ln(v)).alias("ln_v"), tidy(F.exp(v / 1e6)).alias("exp_v"), tidy(F.abs(v - 250000)).alias("abs_v"),
        F.signum(v - 250000).alias("sign_v"), (F.round(v / 7, 2) + 0.0).alias("round_v"), tidy(F.pow(v / 1e5, F.lit(2.0))).alias("pow_v"),
        F.when(q.isNotNull(), ~F.isnan(q) & (F.abs(q) < float("inf"))).alias("fin"), tidy(inverse_logit(v / 1e5 - 2)).alias("logit_v"))


@query("scalar_cast", """select c_custkey, cast(c_nationkey as varchar) txt, cast(lpad(cast(c_nationkey as varchar), 3, '0') as double) num,
 try_cast(c_mktsegment as int) bad, c_acctbal is null missing from customer""")
def q_cast(spark, sf):
    txt = F.col("c_nationkey").cast("string")
    return table(spark, sf, "customer").select(
        "c_custkey", txt.alias("txt"), F.lpad(txt, 3, "0").cast("double").alias("num"),
        F.col("c_mktsegment").try_cast("int").alias("bad"), F.col("c_acctbal").isNull().alias("missing"))


@query("expand_counts", f"""with {CELL} select block, race, unnest(range(1, census + 1)) k from cell where census > 0""")
def q_expand(spark, sf):
    return expand_counts(cell(spark, sf), ["block", "race"], "census")
