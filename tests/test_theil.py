import math

import pytest
from pyspark.sql import functions as F

from segspark.operators import theil
from segspark.operators.theil import Hierarchy

# Vectors of the published worked example.
GROUPS = ["B", "W"] * 4
TRACTS = ["1"] * 4 + ["2"] * 4
BLOCKS = ["1", "1", "2", "2", "3", "3", "4", "4"]
LN2 = math.log(2)
# value, H, Hw, Hb, Pb
FIXTURES = [
    ([10] * 8, 0.0, 0.0, 0.0, None),
    ([10, 0, 0, 10, 10, 0, 0, 10], 1.0, 1.0, 0.0, 0.0),
    ([10, 0, 10, 0, 0, 10, 0, 10], 1.0, 0.0, 1.0, 1.0),
    ([10, 1, 10, 9, 5, 10, 5, 10], 0.144244022144, 0.062539856199, 0.081704165946, 0.566430169729),
]
SCHEMA = "name string, tract string, block string, race string, value double"
ROWS = Hierarchy(scope=["name"], mid="tract", leaf=["block"], group="race", sources={None: "value"})


def long(spark, values, groups=GROUPS, tracts=TRACTS, blocks=BLOCKS, name="test"):
    rows = [(name, t, b, g, None if v is None else float(v)) for t, b, g, v in zip(tracts, blocks, groups, values)]
    return spark.createDataFrame(rows, SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def close(a, b, tol=1e-9):
    if a is None or b is None:
        assert a is None and b is None, (a, b)
    else:
        assert abs(a - b) <= tol, (a, b)


@pytest.mark.parametrize("case", FIXTURES)
@pytest.mark.parametrize("groups", [["B", "W"], None])
def test_fixture(spark, case, groups):
    values, h, hw, hb, pb = case
    r = one(theil.decompose(long(spark, values), ROWS, groups))
    close(r["H"], h), close(r["Hw"], hw), close(r["Hb"], hb), close(r["Pb"], pb), close(r["totalE"], LN2)


FOCAL = ([10, 2, 3, 4, 8, 0, 1, 1, 9, 6, 0, 6], ["White", "Black", "Asian"] * 4, ["1"] * 6 + ["2"] * 6, ["1"] * 3 + ["2"] * 3 + ["3"] * 3 + ["4"] * 3)


@pytest.mark.parametrize("groups", [["White", "Black", "Asian"], None])
def test_focal_split(spark, groups):
    r = one(theil.decompose(long(spark, *FOCAL), ROWS, groups, focal="White", with_rest=True))
    want = {"H": 0.334044759594, "Hw": 0.152504909886, "totalE": 1.065252788726, "Pb": 0.543459654713,
            "Hbg": 0.096877553998, "Pbg": 0.290013691926, "Hwg": 0.237167205595}
    for k, v in want.items():
        close(r[k], v)
    close(r["Hbg"] + r["Hwg"], r["H"])
    close(r["Hw"] + r["Hb"], r["H"])


@pytest.mark.parametrize("groups", [["B", "W", "A"], None])
def test_group_without_count(spark, groups):
    base = long(spark, FIXTURES[3][0])
    empty = base.select("name", "tract", "block", F.lit("A").alias("race"), F.lit(0.0).alias("value")).distinct()
    df = base.unionByName(empty)
    r = one(theil.decompose(df, ROWS, groups))
    assert [r[k] for k in ("H", "Hw", "Hb", "Pb", "totalE")] == [None] * 5
    r = one(theil.decompose(df, ROWS, groups, guard_total=True))
    close(r["H"], FIXTURES[3][1]), close(r["Pb"], FIXTURES[3][4])


@pytest.mark.parametrize("groups", [["B", "W"], None])
def test_missing_count_makes_scope_undefined(spark, groups):
    a = long(spark, [10, None, 10, 9, 5, 10, 5, 10])
    b = long(spark, FIXTURES[3][0], name="other")
    got = {r.name: r for r in theil.decompose(a.unionByName(b), ROWS, groups).collect()}
    assert got["test"].H is None and got["test"].totalE is None
    close(got["other"].H, FIXTURES[3][1])


@pytest.mark.parametrize("groups", [["B", "W"], None])
def test_scope_of_one_group(spark, groups):
    df = long(spark, [10, 5], groups=["B", "B"], tracts=["1", "2"], blocks=["1", "2"])
    r = one(theil.decompose(df, ROWS, groups))
    close(r["totalE"], 0.0)
    assert r["H"] is None and r["Pb"] is None


def test_scale_and_names_do_not_matter(spark):
    df = long(spark, FIXTURES[3][0])
    a = one(theil.decompose(df, ROWS, ["B", "W"]))
    b = one(theil.decompose(df.withColumn("value", F.col("value") * 7).withColumn("block", F.concat(F.lit("x"), "block")), ROWS, ["B", "W"]))
    for k in ("H", "Hw", "Hb", "Pb"):
        close(a[k], b[k])


def test_split_rows_are_summed(spark):
    """Counts of one cell spread over many rows give the same measure."""
    df = long(spark, FIXTURES[3][0])
    halves = df.withColumn("value", F.col("value") / 2)
    a = one(theil.decompose(df, ROWS, None))
    b = one(theil.decompose(halves.unionByName(halves), ROWS, ["B", "W"]))
    close(a["H"], b["H"]), close(a["Hw"], b["Hw"])


def paired(spark):
    import random

    rng = random.Random(5)
    rows = []
    for scope in ("s1", "s2"):
        for tract in range(4):
            for block in range(5):
                place = f"P{tract // 2}" if block % 4 else "No Place"
                for g in "abc":
                    rows.append((scope, f"{scope}t{tract}", f"{scope}{tract}{block}", place, g, rng.randint(0, 9), rng.randint(0, 9)))
    return spark.createDataFrame(rows, "scope string, tract string, block string, place string, race string, dp int, census int")


SRC = {"CENSUS": "census", "DP": "dp"}


def test_nested_equals_one_run_per_level(spark):
    df = paired(spark)
    h = Hierarchy(scope=["scope"], leaf=["block"], group="race", sources=SRC)
    out = theil.nested_levels(df, h, {"Tract": "tract", "Place": "place"}, list("abc"), ("Center", "Place", "No Place", "census"))
    got = {(r.scope, r.Level, r.name): r for r in out.collect()}
    centers = {r.scope: r.center for r in out.collect()}
    pops = df.where("place <> 'No Place'").groupBy("scope", "place").agg(F.sum("census").alias("n")).collect()
    for scope, center in centers.items():
        best = sorted((-r.n, r.place) for r in pops if r.scope == scope)[0][1]
        assert center == best
    center_col = F.when((F.col("scope") == "s1") & (F.col("place") == centers["s1"]), "in").when(
        (F.col("scope") == "s2") & (F.col("place") == centers["s2"]), "in").otherwise("out")
    for level, col in {"Tract": F.col("tract"), "Place": F.col("place"), "Center": center_col}.items():
        run = theil.decompose(df.withColumn("m", col), Hierarchy(["scope"], ["block"], "race", SRC, "m"), None)
        for r in run.collect():
            g = got[(r.scope, level, r.name)]
            for k in ("H", "Hw", "Hb", "Pb", "totalE"):
                close(g[k], r[k])
    for scope in ("s1", "s2"):
        for name in SRC:
            assert got[(scope, "Center", name)].Pb <= got[(scope, "Place", name)].Pb + 1e-12


def test_tied_assignment_counts_a_leaf_twice_in_all_levels(spark):
    df = paired(spark)
    twice = df.unionByName(df.where("block = 's100'").withColumn("place", F.lit("P1")))
    h = Hierarchy(scope=["scope"], leaf=["block"], group="race", sources=SRC)
    out = theil.nested_levels(twice, h, {"Tract": "tract", "Place": "place"}, list("abc"))
    got = {(r.scope, r.Level, r.name): r for r in out.collect()}
    for level, col in {"Tract": "tract", "Place": "place"}.items():
        run = theil.decompose(twice, Hierarchy(["scope"], ["block"], "race", SRC, col), None)
        for r in run.collect():
            close(got[(r.scope, level, r.name)].H, r.H), close(got[(r.scope, level, r.name)].Hw, r.Hw)


def test_levels_and_residual_add_up(spark):
    h = Hierarchy(scope=["scope"], leaf=["block"], group="race", sources=SRC)
    out = theil.nested_levels(paired(spark), h, {"Tract": "tract", "Place": "place"}, list("abc"), ("Center", "Place", "No Place", "census"))
    inc = theil.with_increments(out, ["scope", "name"], ["Center", "Place", "Tract"])
    stack = theil.with_residual(inc, "Tract", "Block", ["scope", "name", "Level", "seg_explained"])
    for r in stack.groupBy("scope", "name").agg(F.sum("seg_explained").alias("s"), F.count("*").alias("n")).collect():
        close(r.s, 1.0)
        assert r.n == 4
    gains = theil.level_gains(out, ["scope", "name"], ["Center", "Place", "Tract"], "Block")
    total = {(r.scope, r.name): r.H for r in out.where("Level = 'Tract'").collect()}
    for r in gains.groupBy("scope", "name").agg(F.sum("H_alone").alias("s")).collect():
        close(r.s, total[(r.scope, r.name)])


def test_unit_entropy_of_empty_unit_is_zero(spark):
    df = long(spark, [0, 0, 5, 5, 1, 0, 2, 2])
    got = {r.block: (r.E, r.Pop) for r in theil.unit_entropy(df, ["block"], "race", "value").collect()}
    assert got["1"] == (0.0, 0.0)
    close(got["2"][0], LN2), close(got["3"][0], 0.0)


def test_labels_with_quotes(spark):
    df = long(spark, FIXTURES[3][0], groups=["it's", "b\\c"] * 4)
    r = one(theil.decompose(df, ROWS, ["it's", "b\\c"], focal="it's"))
    close(r["H"], FIXTURES[3][1]), close(r["Pbg"], 1.0)


def test_stored_sums_of_parts_add_up_to_the_whole(spark):
    from segspark.operators import stored
    from segspark.session import scratch_dir

    groups = ["White", "Black", "Asian"]
    rows = long(spark, *FOCAL).withColumn("part", F.when(F.col("block") < "3", F.col("block")))
    # A mid in two parts, one of them null; a group missing from one part; a scope that only a later part has.
    rows = rows.where("not (part = '1' and race = 'Asian')").unionByName(
        long(spark, [5, 1], ["White", "Black"], ["9"] * 2, ["7"] * 2, "late").withColumn("part", F.lit("3")))
    path, read = scratch_dir(spark, "s"), []

    def cut(cells, missing):
        keys = [r.part for r in missing.collect()]
        read.append(sorted(keys, key=str))
        return cells.join(missing.toDF("_p"), F.col("part").eqNullSafe(F.col("_p")), "left_semi")

    def have(*parts):
        wanted = spark.createDataFrame([(p,) for p in parts], "part string")
        sums = stored.stored_sums(spark, path, rows, ROWS, groups, ["part"], wanted, "White", True, cut)
        out = stored.decompose_stored(sums, ROWS, groups, "White", True)
        return {r.name: r.asDict() for r in out.collect()}

    assert have() == {} and read == []
    first = have("1")
    assert set(first) == {"test"} and have("1") == first
    got = have("1", "2", None, "3")
    assert read == [["1"], ["2", "3", None]]
    want = {r.name: r.asDict() for r in theil.decompose(rows, ROWS, groups, "White", True).collect()}
    assert set(got) == set(want) == {"test", "late"}
    for name in want:
        for k, v in want[name].items():
            assert v == got[name][k] if k == "name" else close(got[name][k], v) is None


def test_stored_sums_without_a_cut_keep_null_parts_and_missing_counts(spark):
    from segspark.operators import stored
    from segspark.session import scratch_dir

    rows = long(spark, [1, 2, None, 4, 5, 6, 7, 8]).withColumn("part", F.when(F.col("block") < "3", F.col("tract").cast("int")))
    wanted = rows.select("part").distinct()
    sums = stored.stored_sums(spark, scratch_dir(spark, "s"), rows, ROWS, ["B", "W"], ["part"], wanted)
    got, want = one(stored.decompose_stored(sums, ROWS, ["B", "W"])), one(theil.decompose(rows, ROWS, ["B", "W"]))
    assert got == want and got["H"] is None
