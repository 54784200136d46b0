"""Input tables of the measures, built from the star-schema tables.

Every table is given twice: as a DataFrame and as the text of a common table expression with
the same rows, so that a query and its check share the input but not the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The group labels of the stand-in cells, and the one treated as focal.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FOUR = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
FOCAL = "1-URGENT"
BANDS = ["Under 18", "18-65", "65+"]
SOURCES = {"CENSUS": "census", "DP": "dp"}


# Schemas of the tables read. Given, so that no file is opened just to plan a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf dimension: customer with its nation and region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    return c.join(geo, c.c_nationkey == geo.n_nationkey).select(
        F.col("r_name").alias("cbsa"), F.col("n_nationkey").alias("tract"),
        F.concat(F.col("n_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")).alias("blkgrp"),
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("block"),
    )


def cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired cells. Orders are counted per customer before they meet the hierarchy."""
    key = F.col("o_orderkey")
    counts = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("block"), F.col("o_orderpriority").alias("race")
    ).agg(_n(key % 3 != 0).alias("census"), _n(key % 3 != 1).alias("dp"))
    return counts.join(_customers(spark, sf_dir), "block").select(
        "cbsa", "tract", "blkgrp", "segment", "block", "race", "census", "dp")


CELL = """cell as (
select r.r_name cbsa, n.n_nationkey tract, concat(cast(n.n_nationkey as varchar), '-', c.c_mktsegment) blkgrp,
       c.c_mktsegment segment, c.c_custkey block, o.o_orderpriority race,
       cast(sum(case when o.o_orderkey % 3 <> 0 then 1 else 0 end) as bigint) census,
       cast(sum(case when o.o_orderkey % 3 <> 1 then 1 else 0 end) as bigint) dp
from orders o join customer c on o.o_custkey = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
group by all)"""


def cell_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    counts = o.groupBy(
        F.when(early, 2000).otherwise(2010).alias("yr"),
        F.col("o_custkey").alias("block"), F.col("o_orderpriority").alias("race"),
    ).agg(_n(key % 3 != 0).alias("census"), _n(key % 3 != 1).alias("dp"))
    return counts.join(_customers(spark, sf_dir), "block").select(
        "yr", "cbsa", "tract", "blkgrp", "block", "race", "census", "dp")


CELL_YEAR = """cell_year as (
select case when o.o_orderdate < timestamp '1998-01-01 00:00:00' then 2000 else 2010 end yr,
       r.r_name cbsa, n.n_nationkey tract, concat(cast(n.n_nationkey as varchar), '-', c.c_mktsegment) blkgrp,
       c.c_custkey block, o.o_orderpriority race,
       cast(sum(case when o.o_orderkey % 3 <> 0 then 1 else 0 end) as bigint) census,
       cast(sum(case when o.o_orderkey % 3 <> 1 then 1 else 0 end) as bigint) dp
from orders o join customer c on o.o_custkey = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
group by all)"""


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kind = F.when(F.col("r_regionkey") % 2 == 0, "Metropolitan").otherwise("Micropolitan")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("county"), F.col("r_name").alias("cbsa"), kind.alias("type"))


CROSSWALK = """crosswalk as (
select n.n_nationkey county, r.r_name cbsa,
       case when r.r_regionkey % 2 = 0 then 'Metropolitan' else 'Micropolitan' end as "type"
from nation n join region r on n.n_regionkey = r.r_regionkey)"""


def unit_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("c_nationkey") + F.ascii("c_mktsegment")) % 5
    return table(spark, sf_dir, "customer").where(code != 0).select(
        F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment")).alias("blkgrp"),
        F.concat(F.lit("Place"), code.cast("string")).alias("name_full"),
    ).distinct()


UNIT_PLACE = """unit_place as (
select distinct concat(cast(c_nationkey as varchar), '-', c_mktsegment) blkgrp,
       concat('Place', cast((c_nationkey + ascii(c_mktsegment)) % 5 as varchar)) name_full
from customer where (c_nationkey + ascii(c_mktsegment)) % 5 <> 0)"""


def age_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("l_linestatus") == "O", 3).otherwise(27) + F.col("l_quantity").cast("int") % 23
    flag = F.col("l_returnflag")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("blkgrp"), base.alias("base")).agg(
        _n(flag != "R").alias("census"), _n(flag != "A").alias("dp"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    dim = s.join(geo, s.s_nationkey == geo.n_nationkey).select(
        F.col("r_name").alias("cbsa"), F.col("n_nationkey").alias("tract"), F.col("s_suppkey").alias("blkgrp"))
    return counts.join(dim, "blkgrp").select("cbsa", "tract", "blkgrp", "base", "census", "dp")


AGE_LONG = """age_long as (
select r.r_name cbsa, n.n_nationkey tract, s.s_suppkey blkgrp,
       case when l.l_linestatus = 'O' then 3 else 27 end + cast(l.l_quantity as int) % 23 base,
       cast(sum(case when l.l_returnflag <> 'R' then 1 else 0 end) as bigint) census,
       cast(sum(case when l.l_returnflag <> 'A' then 1 else 0 end) as bigint) dp
from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
  join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
group by all)"""


def age_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age variables that occur, with sex and band (first and last variable per band)."""
    base = F.when(F.col("l_linestatus") == "O", 3).otherwise(27) + F.col("l_quantity").cast("int") % 23
    b = F.col("base")
    band = F.when((b <= 6) | b.between(27, 30), "Under 18").when((b <= 19) | b.between(27, 43), "18-65")
    return table(spark, sf_dir, "lineitem").select(base.alias("base")).distinct().select(
        "base", F.concat(F.lit("P01200"), F.lpad(b.cast("string"), 2, "0")).alias("id"),
        F.when(b <= 25, "male").otherwise("female").alias("sex"), band.otherwise("65+").alias("age_group"))


AGE_VARS = """age_vars as (
select distinct b.base, concat('P01200', lpad(cast(b.base as varchar), 2, '0')) id,
       case when b.base <= 25 then 'male' else 'female' end sex,
       case when b.base <= 6 or (b.base >= 27 and b.base <= 30) then 'Under 18'
            when b.base <= 19 or (b.base >= 27 and b.base <= 43) then '18-65' else '65+' end age_group
from (select case when l_linestatus = 'O' then 3 else 27 end + cast(l_quantity as int) % 23 base from lineitem) b)"""


def age_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age variables summed to bands, both sources."""
    return age_long(spark, sf_dir).join(age_vars(spark, sf_dir).select("base", "age_group"), "base").groupBy(
        "cbsa", "tract", "blkgrp", "age_group").agg(F.sum("dp").alias("dp"), F.sum("census").alias("census"))


AGE_CELL = f"""{AGE_LONG}, {AGE_VARS}, age_cell as (
select cbsa, tract, blkgrp, age_group, cast(sum(dp) as bigint) dp, cast(sum(census) as bigint) census
from age_long join age_vars using (base) group by all)"""


def age_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each supplier unit; every fourth unit lies in none."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(key % 4 != 0).select(
        key.alias("blkgrp"), F.concat(F.lit("Place"), ((key * 7 + F.col("s_nationkey")) % 6).cast("string")).alias("name_full"))


AGE_PLACE = """age_place as (
select s_suppkey blkgrp, concat('Place', cast((s_suppkey * 7 + s_nationkey) % 6 as varchar)) name_full
from supplier where s_suppkey % 4 <> 0)"""


def unit_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k % 50).cast("double"), F.floor(k / 50.0).cast("double")
    return table(spark, sf_dir, "part").select(
        k.alias("geoid"), x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"))


UNIT_BOX = """unit_box as (
select p_partkey geoid, cast(p_partkey % 50 as double) x0, cast(floor(p_partkey / 50.0) as double) y0,
       cast(p_partkey % 50 + 1 as double) x1, cast(floor(p_partkey / 50.0) + 1 as double) y1 from part)"""


def place_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    x0, y0 = ((s * 7) % 45).cast("double") + 0.25, ((s * 11) % 36).cast("double") + 0.5
    return table(spark, sf_dir, "supplier").select(
        s.alias("place"), F.col("s_acctbal").alias("estimate"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 3 + s % 4).alias("x1"), (y0 + 2 + s % 3).alias("y1"))


PLACE_BOX = """place_box as (
select s_suppkey place, s_acctbal estimate,
       (s_suppkey * 7) % 45 + 0.25e0 x0, (s_suppkey * 11) % 36 + 0.5e0 y0,
       (s_suppkey * 7) % 45 + 0.25e0 + 3 + s_suppkey % 4 x1, (s_suppkey * 11) % 36 + 0.5e0 + 2 + s_suppkey % 3 y1
from supplier)"""


def metro_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = ((k % 5) * 10).cast("double"), (F.floor(k / 5.0) * 8).cast("double")
    return table(spark, sf_dir, "nation").select(
        k.alias("metro"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 8).alias("y1"))


METRO_BOX = """metro_box as (
select n_nationkey metro, cast((n_nationkey % 5) * 10 as double) x0, cast(floor(n_nationkey / 5.0) * 8 as double) y0,
       cast((n_nationkey % 5) * 10 + 10 as double) x1, cast(floor(n_nationkey / 5.0) * 8 + 8 as double) y1
from nation)"""

LONG = """long as (
select cbsa, 'CENSUS' as "name", tract, blkgrp, block, race, census as "value" from cell
union all select cbsa, 'DP', tract, blkgrp, block, race, dp from cell)"""


def direct_theil(out: str, src: str, keys: str, mid: str, leaf: str, group: str, value: str = '"value"') -> str:
    """Check text of the decomposition in its direct form: shares, entropies and joins.

    Makes the table ``out`` (keys, Hw, H, totalE, Hb, Pb) from a long table.
    """
    ks = [k.strip() for k in keys.split(",")]
    on = lambda a, b, more=(): " and ".join(f"{a}.{k} = {b}.{k}" for k in [*ks, *more])
    ent = "sum(case when n > 0 then n / t * ln(t / nullif(n, 0)) else 0 end)"

    def level(name: str, units: str) -> str:
        return f"""{name} as (select {keys}, {units}, {ent} e, max(t) n from (
  select {keys}, {units}, {group}, sum({value})::double n,
         sum(sum({value})) over (partition by {keys}, {units})::double t
  from {src} group by {keys}, {units}, {group}) group by {keys}, {units})"""

    kb = ", ".join(f"b.{k}" for k in ks)
    kt = ", ".join(f"t.{k}" for k in ks)
    return f"""{level(out + '_b', f'{mid}, {leaf}')},
{level(out + '_t', mid)},
{out}_top as (select {keys}, case when min(n) > 0 then {ent} end e, max(t) n from (
  select {keys}, {group}, sum({value})::double n, sum(sum({value})) over (partition by {keys})::double t
  from {src} group by {keys}, {group}) group by {keys}),
{out}_h as (select {kb}, sum(b.n / top.n * (top.e - b.e)) / nullif(max(top.e), 0) h, max(top.e) total_e, max(top.n) n
  from {out}_b b join {out}_top top on {on('b', 'top')} group by {kb}),
{out}_tr as (select {kb}, b.{mid}, coalesce(sum(b.n / nullif(t.n, 0) * (t.e - b.e)) / nullif(max(t.e), 0), 1) th,
    max(t.e) te, max(t.n) tn
  from {out}_b b join {out}_t t on {on('b', 't', [mid])} group by {kb}, b.{mid}),
{out} as (select {kt}, sum(t.te * t.th * t.tn / (nullif(h.total_e, 0) * h.n)) + 0 * max(h.h) "Hw", max(h.h) "H", max(h.total_e) "totalE",
    max(h.h) - sum(t.te * t.th * t.tn / (nullif(h.total_e, 0) * h.n)) "Hb",
    case when abs(max(h.h)) >= 1e-9 then 1 - sum(t.te * t.th * t.tn / (nullif(h.total_e, 0) * h.n)) / max(h.h) end "Pb"
  from {out}_tr t join {out}_h h on {on('t', 'h')} group by {kt})"""


def rounded(cols: str, digits: int = 6) -> str:
    """``round(c, digits) + 0.0`` for quoted output columns."""
    return ", ".join(f'round("{c.strip()}"::double, {digits}) + 0.0 as "{c.strip()}"' for c in cols.split(","))
