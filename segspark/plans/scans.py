"""Source and sink queries: every one writes or reads whole tables in a shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark import sources
from segspark.functions import pad_code
from segspark.plans.inputs import CELL, cell, table
from segspark.plans.registry import query
from segspark.session import scratch_dir
from segspark.sources import Field

CUSTOMER_LAYOUT = [
    Field("c_custkey", 10, 1, "N"), Field("c_name", 22, 11), Field("c_nationkey", 3, 33, "N"),
    Field("c_acctbal", 12, 36, "N"), Field("c_mktsegment", 12, 48), Field("zip", 5, 60),
]


@query("fwf_scan", """select c_custkey::double c_custkey, c_name, c_nationkey::double c_nationkey, c_acctbal, c_mktsegment,
 printf('%05d', c_custkey % 1000) zip from customer""")
def q_fwf(spark, sf):
    """Customers written as fixed-width text and read back through a layout table."""
    path = scratch_dir(spark, "fwf")
    fields = [(i, f.name, f.width, f.start, f.kind) for i, f in enumerate(CUSTOMER_LAYOUT)]
    layout = sources.layout_fields(spark.createDataFrame(
        fields, "pos int, ddref string, field_size int, starting_pos int, data_type string"))
    data = table(spark, sf, "customer").withColumn("zip", pad_code(F.col("c_custkey") % 1000, 5))
    sources.write_fixed_width(data, path, layout)
    return sources.read_fixed_width(spark, path, layout)


@query("delimited_scan", """select printf('%07d', o_orderkey) "LOGRECNO", o_orderstatus "STUSAB",
 cast(o_custkey as int) "P0010001", cast(o_custkey % 5 as int) "P0010003", cast(o_custkey % 73 as int) "P0020073" from orders""")
def q_delimited(spark, sf):
    """A headerless file of 149 generated columns, of which five are read."""
    path = scratch_dir(spark, "delimited")
    # Names of the record header.
    names = ["FILEID", "STUSAB", "CHARITER", "CIFSN", "LOGRECNO"]
    counts = sources.numbered_names("P00100", 1, 71) + sources.numbered_names("P00200", 1, 73)
    key = F.col("o_custkey")
    first = {c: (key if i == 0 else key % (i + 3)) for i, c in enumerate(sources.numbered_names("P00100", 1, 71))}
    cols = [F.lit("uPL"), F.col("o_orderstatus"), F.lit("000"), F.lit("01"), pad_code(F.col("o_orderkey"), 7)]
    cols += list(first.values()) + [key % i if i > 1 else F.lit(0) for i in range(1, 74)]
    table(spark, sf, "orders").select(*[c.alias(n) for c, n in zip(cols, names + counts)]).write.csv(path)
    schema = sources.schema_from_codes(names + counts, "c" * 5 + "i" * 144)
    wide = sources.read_delimited(spark, path, schema, header=False)
    return wide.select("LOGRECNO", "STUSAB", "P0010001", "P0010003", "P0020073")


# Column names of the file kind that is read.
AGE_NAMES = ["STATE", "COUNTY", "TRACT", "BLKGRP", "age_group", "DP", "CENSUS"]


@query("typed_csv_scan", """select printf('%02d', s_nationkey) "STATE", printf('%03d', s_nationkey) "COUNTY",
 printf('%06d', l_suppkey) "TRACT", cast(l_suppkey % 9 as varchar) "BLKGRP", l_returnflag age_group,
 cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as int) "DP", cast(count(*) as int) "CENSUS"
from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey, l_suppkey, l_returnflag""")
def q_typed_csv(spark, sf):
    """Typed CSV with a header; codes stay text with their leading zeros."""
    path = scratch_dir(spark, "typed")
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("DP"), F.count(F.lit(1)).alias("CENSUS"))
    rows = counts.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pad = lambda c, n: pad_code(F.col(c), n)
    sources.write_csv(rows.select(
        pad("s_nationkey", 2).alias("STATE"), pad("s_nationkey", 3).alias("COUNTY"), pad("l_suppkey", 6).alias("TRACT"),
        (F.col("l_suppkey") % 9).cast("string").alias("BLKGRP"), F.col("l_returnflag").alias("age_group"), "DP", "CENSUS"), path)
    return sources.read_delimited(spark, path, sources.schema_from_codes(AGE_NAMES, "cccccii"), header=True)


@query("pruned_scan", "select l_orderkey, l_quantity from lineitem")
def q_pruned(spark, sf):
    return sources.read_columns(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("year_slice_scan", """select o_orderkey, o_orderpriority, cast(year(o_orderdate) as int) datayear from orders
 where year(o_orderdate) = 1998""")
def q_year_slice(spark, sf):
    """A labelled extract of several years, cut to one; labels are column comments."""
    path = scratch_dir(spark, "extract")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("datayear"))
    sources.write_csv(rows, path)
    schema = T.StructType.fromDDL("o_orderkey long, o_orderpriority string, datayear int")
    df = sources.read_delimited(spark, path, schema, header=True).where(F.col("datayear") == 1998)
    return sources.with_labels(df, {"datayear": "Year the counts refer to", "o_orderpriority": "Priority class"})


@query("multi_file_scan", "select o_custkey, o_orderkey from orders where o_orderstatus in ('F', 'O')")
def q_multi_file(spark, sf):
    """One file set per state, two of them read as one table."""
    path = scratch_dir(spark, "states")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    sources.write_partitioned(orders, path, ["o_orderstatus"])
    return sources.read_many(spark, [f"{path}/o_orderstatus={s}" for s in ("F", "O")], pattern="*.parquet").select(
        "o_custkey", "o_orderkey")


CELL_OUT = f"with {CELL} select cbsa, tract, block, race, census, dp from cell"


@query("parquet_roundtrip", CELL_OUT)
def q_parquet(spark, sf):
    path = scratch_dir(spark, "cells")
    cell(spark, sf).select("cbsa", "tract", "block", "race", "census", "dp").write.parquet(path)
    return spark.read.parquet(path)


@query("csv_roundtrip", CELL_OUT)
def q_csv(spark, sf):
    path = scratch_dir(spark, "cells-csv")
    sources.write_csv(cell(spark, sf).select("cbsa", "tract", "block", "race", "census", "dp"), path)
    schema = T.StructType.fromDDL("cbsa string, tract int, block long, race string, census long, dp long")
    return sources.read_delimited(spark, path, schema, header=True)


@query("partitioned_sink", f"""with {CELL}
select cbsa state, '050' sumlev, cast(tract as varchar) unit, race, cast(sum(census) as bigint) census from cell group by all
union all select cbsa, '150', blkgrp, race, cast(sum(census) as bigint) from cell group by all""")
def q_partitioned(spark, sf):
    """All summary levels from one pass, one folder per state and level."""
    path = scratch_dir(spark, "levels")
    rows = cell(spark, sf).select(
        F.col("cbsa").alias("state"), "race", "census",
        F.expr("inline(array(named_struct('sumlev', '050', 'unit', cast(tract as string)), "
               "named_struct('sumlev', '150', 'unit', blkgrp)))"))
    out = rows.groupBy("state", "sumlev", "unit", "race").agg(F.sum("census").alias("census"))
    sources.write_partitioned(out, path, ["state", "sumlev"])
    schema = T.StructType.fromDDL("unit string, race string, census long, state string, sumlev string")
    return sources.read_partitioned(spark, path, schema)


@query("materialize", f"with {CELL} select tract, race, cast(sum(dp) as bigint) dp from cell group by all")
def q_materialize(spark, sf):
    """The first call builds and writes, the second only reads."""
    path = scratch_dir(spark, "cache")

    def build():
        return cell(spark, sf).groupBy("tract", "race").agg(F.sum("dp").alias("dp"))

    sources.materialize(spark, path, build)
    return sources.materialize(spark, path, build)


# --- levels, restarts and audits ----------------------------------------------------------------

# The summary levels of the extract (county, tract, block group, block).
LEVELS_SQL = f"""with {CELL}, lv as (
select cbsa state, '050' sumlev, cast(tract as varchar) unit, race, census, dp from cell
union all select cbsa, '140', blkgrp, race, census, dp from cell
union all select cbsa, '150', concat(blkgrp, '-', cast(block % 9 as varchar)), race, census, dp from cell
union all select cbsa, '750', cast(block as varchar), race, census, dp from cell),
levels as (select state, sumlev, unit, race, cast(sum(census) as bigint) census, cast(sum(dp) as bigint) dp from lv group by all)"""


def levels_schema() -> T.StructType:
    return T.StructType.fromDDL("unit string, race string, census long, dp long, state string, sumlev string")


def summary_levels(cells):
    """All four levels of the cells given, one row per level, unit and group; one shuffle, with partial sums before it."""
    text = lambda c: F.col(c).cast("string")
    units = {"050": text("tract"), "140": F.col("blkgrp"),
             "150": F.concat_ws("-", "blkgrp", (F.col("block") % 9).cast("string")), "750": text("block")}
    each = F.array(*[F.struct(F.lit(level).alias("sumlev"), unit.alias("unit")) for level, unit in units.items()])
    rows = cells.select(F.col("cbsa").alias("state"), "race", "census", "dp", F.inline(each))
    return rows.groupBy("state", "sumlev", "unit", "race").agg(F.sum("census").alias("census"), F.sum("dp").alias("dp"))


@query("summary_level_sink", f"{LEVELS_SQL} select state, sumlev, unit, race, census, dp from levels")
def q_level_sink(spark, sf):
    """The four summary levels of the extract, one folder per state and level."""
    path = scratch_dir(spark, "four-levels")
    sources.write_partitioned(summary_levels(cell(spark, sf)), path, ["state", "sumlev"])
    return sources.read_partitioned(spark, path, levels_schema())


@query("scope_join_pruned", f"""{LEVELS_SQL} select state, n_name, unit, race, census, dp from levels join nation on unit = cast(n_nationkey as varchar)
 join region on n_regionkey = r_regionkey and r_name = state where sumlev = '050' and r_regionkey % 2 = 1""")
def q_scope_pruned(spark, sf):
    """Counties of the states in a scope: only those states' folders of one level are opened."""
    path = scratch_dir(spark, "four-levels")
    sources.write_partitioned(summary_levels(cell(spark, sf)), path, ["state", "sumlev"])
    return scope_rows(spark, sf, sources.read_partitioned(spark, path, levels_schema()))


def scope_rows(spark, sf, levels):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region").where(F.col("r_regionkey") % 2 == 1)
    scope = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("state"), F.col("n_nationkey").cast("string").alias("unit"), "n_name")
    return levels.where(F.col("sumlev") == "050").join(scope, ["state", "unit"]).select("state", "n_name", "unit", "race", "census", "dp")


@query("build_by_state", f"{LEVELS_SQL} select state, sumlev, unit, race, census, dp from levels")
def q_build_by_state(spark, sf):
    """Levels built in two calls: the second wants all states and builds only those that the first has not."""
    path = scratch_dir(spark, "by-state")
    states = table(spark, sf, "region").select(F.col("r_name").alias("state"), "r_regionkey")

    def build(missing):
        cells = cell(spark, sf)
        return summary_levels(cells.join(missing, cells.cbsa == missing.state, "left_semi"))

    for wanted in (states.where(F.col("r_regionkey") < 2), states):
        out = sources.build_missing(spark, path, wanted, ["state"], levels_schema(), build)
    return out


@query("audited_sink", f"""with {CELL}, a as (select count(*) n_rows, count(*) filter (census = 0 and dp = 0) both_zero, count(*) filter (census = 0 and dp > 0) erased,
 count(*) filter (abs(census - dp) > 1) far_apart, count(*) filter (block is null or race is null) no_key from cell)
select unnest(['rows', 'both_zero', 'erased', 'far_apart', 'no_key']) as "check", unnest([n_rows, both_zero, erased, far_apart, no_key]) n from a""")
def q_audited(spark, sf):
    """Failing rows of each check, counted while the cells are written."""
    census, dp = F.col("census"), F.col("dp")
    counts = sources.write_audited(
        cell(spark, sf).select("cbsa", "tract", "block", "race", "census", "dp"), scratch_dir(spark, "audited"),
        {"both_zero": (census == 0) & (dp == 0), "erased": (census == 0) & (dp > 0), "far_apart": F.abs(census - dp) > 1,
         "no_key": F.col("block").isNull() | F.col("race").isNull()})
    return spark.createDataFrame(list(counts.items()), "check string, n long")


# --- geography and segments together ------------------------------------------------------------

GEO_LAYOUT = [Field("STUSAB", 2, 1), Field("SUMLEV", 3, 3), Field("LOGRECNO", 7, 6), Field("STATE", 2, 13), Field("COUNTY", 3, 15),
              Field("TRACT", 6, 18), Field("BLOCK", 4, 24)]
# Names of the record header.
HEADER = ["FILEID", "STUSAB", "CHARITER", "CIFSN", "LOGRECNO"]


def delivery(spark, sf, label: str, shift: int) -> sources.Extract:
    """Customers as the records of 25 states, written as a geography and two segments that each lack some records."""
    base = scratch_dir(spark, f"delivery-{label}")
    key, state = F.col("c_custkey"), F.col("c_custkey") % 25
    record = table(spark, sf, "customer").select(
        key.alias("k"), pad_code(state, 2).alias("STUSAB"), pad_code(F.floor(key / 25), 7).alias("LOGRECNO"),
        F.when(key % 3 == 0, "050").otherwise("750").alias("SUMLEV"), pad_code(state, 2).alias("STATE"), pad_code(key % 7, 3).alias("COUNTY"),
        pad_code(key % 101, 6).alias("TRACT"), pad_code(key % 1000, 4).alias("BLOCK"))
    sources.write_fixed_width(record, f"{base}/geo", GEO_LAYOUT)
    header = [F.lit("uPL"), F.col("STUSAB"), F.lit("000"), F.lit("01"), F.col("LOGRECNO")]
    segments = []
    for number, (prefix, n, without) in enumerate([("P00100", 71, 10), ("H00100", 3, 4)], 1):
        names = sources.numbered_names(prefix, 1, n)
        values = [(F.col("k") + shift) % (i + 5) for i in range(n)]
        record.where(F.col("k") % without != 0).select(*header, *[v.alias(c) for v, c in zip(values, names)]).write.csv(f"{base}/seg{number}")
        segments.append(sources.Segment(f"{base}/seg{number}", HEADER + names))
    return sources.Extract(f"{base}/geo", GEO_LAYOUT, segments)


@query("extract_segments", """with s(source, shift) as (values ('CENSUS', 0), ('DP', 1)),
r as (select source, c_custkey k, c_custkey + shift v from customer, s where c_custkey % 3 <> 0 and not (c_custkey % 10 = 0 and c_custkey % 4 = 0))
select source "SOURCE", printf('%02d', k % 25) "STUSAB", printf('%07d', k // 25) "LOGRECNO", printf('%02d', k % 25) "STATE", printf('%03d', k % 7) "COUNTY",
 printf('%04d', k % 1000) "BLOCK", '750' "SUMLEV", case when k % 10 <> 0 then cast(v % 7 as bigint) end white, case when k % 10 <> 0 then cast(v % 75 as bigint) end last_race,
 case when k % 4 <> 0 then cast(v % 6 as bigint) end occupied from r""")
def q_extract(spark, sf):
    """Blocks of all states in two deliveries, each of a geography and two segments that hold part of the counts."""
    deliveries = {label: delivery(spark, sf, label, shift) for label, shift in (("CENSUS", 0), ("DP", 1))}
    counts = {"P0010003": "white", "P0010071": "last_race", "H0010002": "occupied"}
    return sources.stack_extracts(spark, deliveries, counts, ["750"], ["STATE", "COUNTY", "BLOCK"])
