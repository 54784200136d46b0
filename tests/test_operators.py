import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark import sources
from segspark.functions import equal_width_bin, finite_or, invert, replace_first, right_closed_bin, strict_sum
from segspark.operators import compare, distribution, factored, models, permute, quadtree, ranking, relate, reshape, shapes, spatial
from segspark.session import scratch_dir


# --- functions ---


def test_right_closed_bins(spark):
    pairs = [(0, 10), (7, 100), (1, 10), (10, 10), (3, 10), (None, 10), (1, 0), (29, 100)]
    df = spark.createDataFrame(pairs, "n int, d int").select(
        right_closed_bin(F.col("n"), F.col("d"), 100).alias("b"))
    assert [r.b for r in df.collect()] == [1, 7, 10, 100, 30, None, None, 29]


def test_strict_sum_and_finite(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    got = {r.k: r.s for r in df.groupBy("k").agg(strict_sum(F.col("v")).alias("s")).collect()}
    assert got == {"a": None, "b": 2}
    x = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r.v for r in x.select(finite_or(F.col("x"), F.lit(0.0)).alias("v")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_text(spark):
    df = spark.createDataFrame([("a b c",)], "s string")
    assert df.select(replace_first(F.col("s"), " ", "_")).first()[0] == "a_b c"
    with pytest.raises(ValueError):
        invert({"a": "x", "b": "x"})


# --- reshape and joins ---


def test_wide_needs_unique_cells(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (1, "b", 7)], "k int, name string, v int")
    with pytest.raises(PySparkException):
        reshape.to_wide(df, ["k"], "name", "v", ["a", "b"]).collect()
    assert reshape.to_wide(df, ["k"], "name", "v", ["a", "b"], unique=False).first().a == 11


def test_membership_is_never_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    got = relate.membership_flag(df, "k", spark.createDataFrame([(1,), (1,)], "k int"), "f").collect()
    assert sorted((r.k or 0, r.f) for r in got) == [(0, "0"), (1, "1"), (2, "0")]


def test_share_of_total_by_window_and_by_join(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 2), ("b", 0), ("b", None)], "k string, v long")
    by_join, by_window = (sorted(ranking.share_of_total(df, ["k"], {"p": "v"}, s).collect(), key=str) for s in (False, True))
    assert by_join == by_window
    assert {(r.k, r.v): r.p for r in by_window} == {("a", 1): 0.25, ("a", 3): 0.75, (None, 2): 1.0, ("b", 0): None, ("b", None): None}


def test_share_of_total_with_null_keys_and_hot_group(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"),
        F.lit(2).alias("v"))
    out = ranking.share_of_total(df, ["k"], {"p": "v"})
    assert out.count() == 30_000
    sums = {r.k: r.s for r in out.groupBy("k").agg(F.sum("p").alias("s")).collect()}
    assert all(abs(s - 1) < 1e-6 for s in sums.values()) and None in sums


# --- ranking ---


@pytest.mark.parametrize("cast", ["long", "string"])
def test_dense_ids(spark, cast):
    df = spark.range(5_000).select((F.col("id") * F.col("id")).cast(cast).alias("k"))
    rows = sorted((r.k, r.id) for r in ranking.dense_row_id(df, "k", buckets=37).collect())
    assert [i for _, i in rows] == list(range(1, 5_001))


def test_dense_ids_small_and_empty(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    assert {r.k: r.id for r in ranking.dense_row_id(df, "k").collect()} == {None: 1, "a": 2, "b": 3}
    assert ranking.dense_row_id(df.where("false"), "k").count() == 0


def test_group_maximum_with_ties(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") % 10).alias("v"), "id")
    out = ranking.max_with_ties(df, ["k"], "v")
    # Ties of a key are rows of a join, not of one window.
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("v <> 9").count() == 0 and out.count() == 100
    odd = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("a", None)], "k string, v int")
    assert sorted(map(str, ranking.max_with_ties(odd, ["k"], "v").collect())) == [
        "Row(k='a', v=None)", "Row(k='a', v=None)", "Row(k=None, v=2)"]


def test_layout(spark):
    good = spark.createDataFrame([("f", 1, 3, 1), ("f", 2, 12, 4), ("f", 3, 2, 16)], "file string, pos int, size int, start int")
    assert ranking.layout_mismatches(good, ["file"], ["pos"], "size", "start").count() == 0
    bad = good.withColumn("start", F.when(F.col("pos") == 3, 17).otherwise(F.col("start")))
    assert [r.pos for r in ranking.layout_mismatches(bad, ["file"], ["pos"], "size", "start").collect()] == [3]


# --- distribution ---


@pytest.mark.parametrize("limit", [20, 1_000, 100_000])
def test_quantiles_large_and_small_groups(spark, limit):
    rng = np.random.default_rng(1)
    rows = [("big", float(x)) for x in rng.normal(size=30_000).round(3)] + [("small", float(x)) for x in [3, 1, 2, 10]] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.p): r.quantile for r in distribution.exact_quantiles(df, ["k"], "v", probs, limit=limit).collect()}
    for k in ("big", "small", "one"):
        v = [x for kk, x in rows if kk == k]
        for p in probs:
            assert got[(k, p)] == pytest.approx(np.quantile(v, p), abs=1e-12)


def test_quantiles_with_a_dominating_value(spark):
    rows = [(5.0,)] * 20_000 + [(float(i),) for i in range(10_000)]
    df = spark.createDataFrame(rows, "v double")
    got = {r.p: r.quantile for r in distribution.exact_quantiles(df, [], "v", [0.1, 0.5, 0.8], limit=100).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile([r[0] for r in rows], p))


@pytest.mark.parametrize("limit", [50, 2_000])
def test_brackets_hold_few_rows_whatever_the_distribution(spark, limit):
    # One group of all rows; values over 600 decades, so that no cut by value would balance them.
    rng = np.random.default_rng(5)
    v = np.exp(rng.uniform(-690, 690, 40_000))
    df = spark.createDataFrame([(1, float(x)) for x in v], "k int, _x double").repartition(8)
    probs = [0.0, 0.001, 0.37, 0.5, 1.0]
    for r in distribution.quantile_brackets(df, ["k"], probs, limit).collect():
        inside = ((v >= r._lo) & (v <= r._hi)).sum()
        assert r._lo <= np.quantile(v, r._p, method="lower") and np.quantile(v, r._p, method="higher") <= r._hi
        assert 1 <= inside <= limit, (r, inside)
    got = {r.p: r.quantile for r in distribution.exact_quantiles(df, ["k"], "_x", probs, limit).collect()}
    assert all(got[p] == pytest.approx(np.quantile(v, p), rel=1e-12) for p in probs)


def test_quantiles_of_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)], "k string, v double")
    assert {r.k: r.quantile for r in distribution.exact_quantiles(df, ["k"], "v", [0.5]).collect()} == {None: 2.0, "b": 2.0}
    assert distribution.exact_quantiles(df.where("false"), ["k"], "v", [0.5]).count() == 0


def test_density_close_to_direct_sum(spark):
    rng = np.random.default_rng(2)
    x = rng.gamma(2.0, size=2_000)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")
    got = sorted((r.x, r.density) for r in distribution.density_curve(df, "k", "v", points=64).collect())
    iqr = np.subtract(*np.quantile(x, [0.75, 0.25]))
    bw = 0.9 * min(x.std(ddof=1), iqr / 1.34) * len(x) ** -0.2
    for at, d in got:
        direct = np.exp(-0.5 * ((at - x) / bw) ** 2).sum() / (len(x) * bw * math.sqrt(2 * math.pi))
        assert d == pytest.approx(direct, abs=2e-4)


def test_constant_column_goes_to_one_bin(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.bin for r in distribution.equal_width_bins(df, "v", 20).collect()] == [1, 1]
    assert distribution.histogram(df.withColumn("g", F.lit("x")), ["g"], "v").first().n == 2


# --- compare ---


def test_difference_needs_both_sides(spark):
    df = spark.createDataFrame([("a", "C", 1.0), ("a", "D", 3.0), ("b", "C", 1.0), ("c", "C", None), ("c", "D", 2.0)], "k string, name string, v double")
    got = {r.k: r.d for r in compare.paired_difference(df, ["k"], "name", "v", "C", "D", "d").collect()}
    assert got == {"a": 2.0, "c": None}


def test_no_change_is_half_an_increase(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.2, -1.0)], "DP double, CENSUS double")
    got = {r.name: (r.mu, r.pplus) for r in compare.increase_summary(df).collect()}
    assert got["DP"] == (10.0, pytest.approx(75.0)) and got["CENSUS"] == (0.0, pytest.approx(50.0))


def test_unknown_focal_share_is_null(spark):
    df = spark.createDataFrame([(1, "a", 5, 6), (1, "b", 5, 2), (2, "b", 3, 3)], "u int, race string, census int, dp int")
    got = {r.u: (r.pFocal, r.increase) for r in compare.growth_frame(df, ["u"], "race", "a", "census", "dp").collect()}
    assert got == {1: (0.5, False), 2: (None, False)}


# --- permutation ---


def cells(spark):
    rng = random.Random(3)
    rows = [("s", f"t{i % 4}", f"b{i}", g, rng.randint(0, 6)) for i in range(24) for g in "xyz"]
    rows.append(("s", "t0", "b0", "x", 500))  # one leaf with most of the people
    return spark.createDataFrame(rows, "scope string, tract string, block string, race string, n int")


@pytest.mark.parametrize("strata", [["scope"], ["scope", "tract"]])
def test_permutation_keeps_margins(spark, strata):
    df = cells(spark)
    carry = [c for c in ["tract"] if c not in strata]
    out = permute.permuted_cells(df, strata, "block", "race", "n", 3, 11, carry, bucket_rows=20, block=16).cache()
    for keys in (strata + ["race"], ["block"]):
        want = {tuple(r[k] for k in keys): r.n for r in df.groupBy(*keys).agg(F.sum("n").alias("n")).collect() if r.n}
        for sim in range(3):
            have = {tuple(r[k] for k in keys): r.n for r in out.where(F.col("sim") == sim).groupBy(*keys).agg(F.sum("value").alias("n")).collect()}
            assert have == want
    # The sizes of ranges and blocks are internal.
    other = permute.permuted_cells(df, strata, "block", "race", "n", 3, 11, carry)
    assert out.exceptAll(other).count() == 0 and other.exceptAll(out).count() == 0
    plain = permute.permuted_cells(df, strata, "block", "race", "n", 3, 11, carry, counted=False)
    assert plain.count() == out.agg(F.sum("value")).first()[0]


def person_by_person(df, strata, carry, sims, seed):
    """Rank everybody of a stratum by digest, and hand the groups out in order."""
    rows = [r for r in df.collect() if r.n and all(r[k] is not None for k in strata)]
    out = Counter()
    for stratum in {tuple(r[k] for k in strata) for r in rows}:
        here = [r for r in rows if tuple(r[k] for k in strata) == stratum]
        homes, kinds = Counter(), []
        for r in here:
            homes[(r.block, *(r[c] for c in carry))] += r.n
        for r in sorted(here, key=lambda r: r.race):
            kinds += [r.race] * r.n
        for sim in range(sims):
            people = sorted((hashlib.md5(f"{seed}|{sim}|{home[0]}|{k}".encode()).hexdigest(), home) for home, n in homes.items() for k in range(1, n + 1))
            out.update((sim, *stratum, *home, kind) for (_, home), kind in zip(people, kinds))
    return out


@pytest.mark.parametrize("strata", [["scope"], ["scope", "tract"]])
@pytest.mark.parametrize("spread", [6.0, 0.0])
def test_permutation_by_marks_is_person_by_person(spark, strata, spread):
    """Also where no mark lies where it is looked for, a leaf is cut in pieces, a stratum has one group, or is null (left out)."""
    more = [("u", "t9", "c1", "y", 5), ("u", "t9", "c2", "y", 4), (None, "t9", "d", "x", 3), ("v", "t8", "e", "z", 1), ("v", "t8", "e", "x", 0)]
    df = cells(spark).unionByName(spark.createDataFrame(more, "scope string, tract string, block string, race string, n int"))
    carry = [c for c in ["tract"] if c not in strata]
    names = ["sim", *strata, "block", *carry]
    want = person_by_person(df, strata, carry, 3, 11)
    long = permute.permuted_cells(df, strata, "block", "race", "n", 3, 11, carry, block=50, spread=spread)
    assert {tuple(r[k] for k in [*names, "race"]): r.value for r in long.collect()} == want
    wide = permute.permuted_cells(df, strata, "block", "race", "n", 3, 11, carry, block=50, spread=spread, wide=["z", "none", "x", "y"]).collect()
    assert {(*(r[k] for k in names), g): r[g] for r in wide for g in "xyz" if r[g] is not None} == want
    assert all(r["none"] is None for r in wide) and len(wide) == len({k[:-1] for k in want})


def test_permutation_of_a_leaf_with_two_mids_keeps_margins(spark):
    """Its people have equal digests; every mark still parts them exactly."""
    rows = [("s", t, f"b{i}", g, 7) for t in ("t1", "t2") for i in range(5) for g in "xyz"] + [("s", None, "b0", "x", 9)]
    df = spark.createDataFrame(rows, "scope string, tract string, block string, race string, n int")
    got = permute.permuted_cells(df, ["scope"], "block", "race", "n", 20, 11, ["tract"], wide=list("xyz")).groupBy("sim").agg(*[F.sum(g).alias(g) for g in "xyz"])
    assert [(r.x, r.y, r.z) for r in got.collect()] == [(79, 70, 70)] * 20


@pytest.mark.parametrize("make", [permute.permuted_cells, permute.drawn_cells])
def test_wide_simulations_measure_alike(spark, make):
    """One row per leaf with a column per group gives the measures of the rows per group, without an exchange of leaves."""
    from segspark.operators import theil

    df = cells(spark)
    h = theil.Hierarchy(scope=["scope", "sim"], mid="tract", leaf=["block"], group="race", sources={None: "value"})
    long = theil.decompose(make(df, ["scope"], "block", "race", "n", 4, 11, ["tract"]), h, list("xyz"), focal="x")
    wide = theil.decompose(make(df, ["scope"], "block", "race", "n", 4, 11, ["tract"], wide=list("xyz")), h, list("xyz"), focal="x", wide=True)
    rounded = lambda out: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.collect()}
    assert rounded(wide) == rounded(long) and wide.count() == 4


@pytest.mark.parametrize("strata", [["scope"], ["scope", "tract"]])
def test_drawn_tables_keep_margins(spark, strata):
    """Every simulated table has both margins, whatever the buckets; a null stratum is one."""
    df = cells(spark).unionByName(cells(spark).withColumn("scope", F.lit(None).cast("string")))
    carry = [c for c in ["tract"] if c not in strata]
    for bucket in (512, 3):
        out = permute.drawn_cells(df, strata, "block", "race", "n", 7, 11, carry, bucket=bucket, sims_at_once=3).cache()
        for keys in (strata + ["race"], [*strata, *carry, "block"]):
            want = {tuple(r[k] for k in keys): r.n for r in df.groupBy(*keys).agg(F.sum("n").alias("n")).collect() if r.n}
            for sim in range(7):
                assert {tuple(r[k] for k in keys): r.n for r in out.where(F.col("sim") == sim).groupBy(*keys).agg(F.sum("value").alias("n")).collect()} == want
    again = permute.drawn_cells(df.repartition(7), strata, "block", "race", "n", 7, 11, carry, bucket=3, sims_at_once=3)
    assert out.exceptAll(again).count() == 0
    assert permute.drawn_cells(df.limit(0), strata, "block", "race", "n", 7, 11, carry).count() == 0


def test_drawn_tables_are_distributed_as_permutations(spark):
    """Mean and spread of every cell, and of a measure, agree with those of tables made person by person."""
    rng = np.random.default_rng(3)
    counts, sizes, sims = np.array([40, 25, 10]), np.array([5, 30, 0, 12, 9, 19]), 4000
    got = permute.split_counts(rng, np.tile(counts, (sims, 1)), sizes)
    assert (got.sum(1) == counts).all() and (got.sum(2) == sizes).all() and (got >= 0).all()
    people, homes = np.repeat(np.arange(3), counts), np.repeat(np.arange(6), sizes)
    plain = np.zeros_like(got)
    for s in range(sims):
        np.add.at(plain[s], (homes, rng.permutation(people)), 1)
    total = counts.sum()
    mean = np.outer(sizes, counts) / total
    var = mean * (1 - counts / total) * ((total - sizes) / (total - 1))[:, None]
    for table in (got, plain):
        assert (np.abs(table.mean(0) - mean) <= 5 * np.sqrt(var / sims)).all()
        assert np.allclose(table.var(0), var, rtol=0.15, atol=0.02)
    h = lambda t: -(t * np.log(np.maximum(t, 1) / np.maximum(t.sum(2, keepdims=True), 1))).sum((1, 2)) / total
    a, b = h(got), h(plain)
    assert abs(a.mean() - b.mean()) < 5 * np.sqrt((a.var() + b.var()) / sims) and abs(a.std() / b.std() - 1) < 0.1


def test_expand_large_count(spark):
    df = spark.createDataFrame([("a", 10_000), ("b", 3), ("c", 0)], "k string, n int")
    ks = permute.expand_counts(df, ["k"], "n", out="i", chunk=64).groupBy("k").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_distinct("i").alias("d"))
    assert {r.k: (r.lo, r.hi, r.d) for r in ks.collect()} == {"a": (1, 10_000, 10_000), "b": (1, 3, 3)}
    with pytest.raises(ValueError):
        permute.expand_counts(df, ["k"], "n", out="k")


# --- spatial ---


def ring_df(spark, rings):
    rows = [(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>")


def shoelace(r):
    x, y = np.array(r)[:, 0], np.array(r)[:, 1]
    return abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def clip(subject, window):
    """Sutherland-Hodgman; the window is convex and counter-clockwise."""
    out = [tuple(p) for p in subject]
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        pts, out = out, []
        for p, q in zip(pts, pts[1:] + pts[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0) != (sq > 0) and sp != sq:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            return 0.0
    return shoelace(out) if len(out) > 2 else 0.0


def regular(rng, n):
    cx, cy, r = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0.3, 4)
    ang = np.sort(rng.uniform(0, 2 * np.pi, n))
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in ang]


def test_ring_overlap_against_clipping(spark):
    rng = np.random.default_rng(4)
    # Non-convex subjects: a comb and an L, in both directions; convex windows.
    comb = [(-4, -3), (4, -3), (4, 3), (3, 3), (3, -2), (1, -2), (1, 3), (0, 3), (0, -2), (-4, -2)]
    ell = [(0, 0), (0, 5), (1, 5), (1, 1), (5, 1), (5, 0)]
    subjects = [comb, comb[::-1], ell] + [regular(rng, 6) for _ in range(15)]
    windows = [regular(rng, 5) for _ in range(15)] + [[(-1, -1), (2, -1), (2, 2), (-1, 2)]]
    a, b = ring_df(spark, subjects).withColumnRenamed("id", "a"), ring_df(spark, windows).withColumnRenamed("id", "b")
    pairs = spatial.overlay_pairs(spatial.with_bounds(a), spatial.with_bounds(b), "a", "b", cell=0.7)
    for strip in (0.37, 50.0):
        got = {(r.a, r.b): r.area for r in spatial.ring_overlap_area(pairs, a, b, "a", "b", strip).collect()}
        for i, s in enumerate(subjects):
            for j, w in enumerate(windows):
                # Clipping a non-convex ring may leave zero-width bridges, which have no area.
                assert got.get((i, j), 0.0) == pytest.approx(clip(s, w), abs=1e-8)


def test_overlap_with_itself_is_the_area(spark):
    rng = np.random.default_rng(9)
    a = ring_df(spark, [regular(rng, 7) for _ in range(6)])
    area = {r.id: r.s for r in a.select("id", spatial.ring_area(F.col("ring")).alias("s")).collect()}
    pairs = a.select(F.col("id").alias("a"), F.col("id").alias("b"))
    own = spatial.ring_overlap_area(pairs, a.withColumnRenamed("id", "a"), a.withColumnRenamed("id", "b"), "a", "b", 0.5)
    for r in own.collect():
        assert r.area == pytest.approx(area[r.a])


def boxes(spark, name, n, seed, top):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.uniform(-20, 20), rng.uniform(-20, 20)
        w, h = rng.choice([0.1, 1, 5, top]), rng.choice([0.1, 1, 5, top])
        rows.append((i, x, y, x + w, y + h))
    rows += [(n + i, 0.0, 0.0, 1.0, 1.0) for i in range(40)]  # a crowded cell
    return rows, spark.createDataFrame(rows, f"{name} int, x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize("hot", [5, 20_000])
def test_overlay_pairs_are_complete_and_single(spark, hot):
    ra, a = boxes(spark, "a", 150, 1, 60)
    rb, b = boxes(spark, "b", 150, 2, 300)
    got = [(r.a, r.b) for r in spatial.overlay_pairs(a, b, "a", "b", cell=0.5, n_levels=3, hot=hot).collect()]
    want = {(p[0], q[0]) for p in ra for q in rb
            if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4])}
    assert len(got) == len(set(got)) and set(got) == want


def overlapping(ra, rb):
    return {(p[0], q[0]) for p in ra for q in rb if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4])}


@pytest.mark.parametrize("leaf_rows, depth, hot", [(4, 6, 5), (4, 10, 20_000), (30, 1, 20_000), (1_000, 10, 20_000)])
def test_grown_tree_finds_the_pairs_of_a_nested_loop(spark, leaf_rows, depth, hot):
    ra, a = boxes(spark, "a", 150, 1, 60)
    rb, b = boxes(spark, "b", 150, 2, 300)
    pairs = quadtree.grown_overlay_pairs(a, b, "a", "b", leaf_rows=leaf_rows, depth=depth, salt=3, hot=hot)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == overlapping(ra, rb)


def test_grown_tree_where_most_boxes_crowd_in_a_thousandth_of_the_area(spark):
    rng = random.Random(5)

    def crowd(name, n, seed_id):
        rows = []
        for i in range(n):
            wide = i % 10 == 0
            x, y = (rng.uniform(0, 1000), rng.uniform(0, 1000)) if wide else (rng.uniform(500, 530), rng.uniform(500, 530))
            w, h = (rng.uniform(1, 30), rng.uniform(1, 30)) if wide else (rng.uniform(0.01, 0.5), rng.uniform(0.01, 0.5))
            rows.append((i, x, y, x + w, y + h))
        return rows, spark.createDataFrame(rows, f"{name} int, x0 double, y0 double, x1 double, y1 double")

    (ra, a), (rb, b) = crowd("a", 1500, 0), crowd("b", 1500, 1)
    # Points, lines, turned and unknown boxes are in no pair; a box over everything meets all others.
    odd = [(9000, 510.0, 510.0, 510.0, 510.0), (9001, 505.0, 400.0, 505.0, 600.0), (9002, 520.0, 520.0, 510.0, 510.0), (9003, 0.0, 0.0, 1000.0, 1000.0)]
    ra += odd
    a = a.unionByName(spark.createDataFrame(odd + [(9004, None, 0.0, 1.0, 1.0), (9005, float("nan"), 0.0, 1.0, 1.0), (9006, float("-inf"), 0.0, 900.0, 900.0)], a.schema))
    pairs = quadtree.grown_overlay_pairs(a, b, "a", "b", leaf_rows=20)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == overlapping(ra, rb)
    fixed = spatial.overlay_pairs(a.where("a < 9004"), b, "a", "b", cell=1.0)
    assert {(r.a, r.b) for r in fixed.collect()} == set(got)


def test_grown_tree_with_equal_columns_buffer_and_no_rows(spark):
    ra, a = boxes(spark, "a", 80, 3, 10)
    rb, b = boxes(spark, "b", 80, 4, 10)
    a, b = a.withColumn("state", F.col("a") % 3), b.withColumn("state", F.col("b") % 3)
    got = {(r.state, r.a, r.b): r.box_overlap for r in quadtree.grown_overlay_pairs(a, b, "a", "b", 0.25, ["state"], leaf_rows=5).collect()}
    want = {(r.state, r.a, r.b): r.box_overlap for r in spatial.overlay_pairs(a, b, "a", "b", 0.5, tolerance=0.25, also_on=["state"]).collect()}
    assert got == want and len(got) > 50
    for left, right in ((a.where("false"), b), (a, b.where("false")), (a.where("false"), b.where("false"))):
        assert quadtree.grown_overlay_pairs(left, right, "a", "b").count() == 0
    one = a.limit(1).select("a", *[F.lit(2.0).alias(c) for c in spatial.BOX])
    assert quadtree.grown_overlay_pairs(one, one.withColumnRenamed("a", "b"), "a", "b").count() == 0


def test_ties_of_an_assignment(spark):
    pairs = spark.createDataFrame([(1, "p", 2.0), (1, "q", 2.0), (2, "p", 1.0), (3, "q", 0.0)], "u int, place string, area double")
    keep = sorted((r.u, r.place) for r in spatial.assign_largest_overlap(pairs, "u", "place", "area").collect())
    assert keep == [(1, "p"), (1, "q"), (2, "p")]
    first = sorted((r.u, r.place) for r in spatial.assign_largest_overlap(pairs, "u", "place", "area", ties="first").collect())
    assert first == [(1, "p"), (2, "p")]


def test_adjacency_of_a_grid(spark):
    rows = [(i, float(i % 5), float(i // 5), float(i % 5 + 1), float(i // 5 + 1)) for i in range(25)]
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")
    rings = df.withColumn("ring", spatial.box_ring(*[F.col(c) for c in spatial.BOX]))
    for hot in (2, 1000):
        got = {(r.id1, r.id2) for r in spatial.adjacency(rings, "id", hot=hot).collect()}
        want = {(i, j) for i in range(25) for j in range(i + 1, 25) if abs(i % 5 - j % 5) <= 1 and abs(i // 5 - j // 5) <= 1}
        assert got == want


# --- models ---


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(6)
    x1, x2 = rng.normal(size=200) + 1000, rng.exponential(size=200)
    y = 3 - 0.5 * x1 + 2 * x2 + rng.normal(size=200)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(y, x1, x2)] + [(1.0, None, 2.0), (float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y double, x1 double, x2 double")
    got = {r.term: r for r in models.ols(df, F.col("y"), {"x1": F.col("x1"), "x2": F.col("x2")}).collect()}
    X = np.column_stack([np.ones(200), x1, x2])
    beta, rss, *_ = np.linalg.lstsq(X, y, rcond=None)
    cov = rss[0] / 197 * np.linalg.inv(X.T @ X)
    for i, t in enumerate(["(Intercept)", "x1", "x2"]):
        assert got[t].estimate == pytest.approx(beta[i], rel=1e-6)
        assert got[t].std_error == pytest.approx(math.sqrt(cov[i, i]), rel=1e-5)
        assert got[t].n == 200
    bic = 200 * math.log(rss[0] / 200) + 200 + 200 * math.log(2 * math.pi) + 4 * math.log(200)
    assert got["x1"].bic == pytest.approx(bic, rel=1e-9)


def test_factored_fit_keeps_digits_of_powers(spark):
    # Powers 0 to 5 of 0..20: the response is their plain sum, or a sum with falling weights, so all coefficients are known.
    x = F.col("id").cast("double")
    terms = {f"x{i}": F.pow(x, F.lit(float(i))) for i in range(1, 6)}
    plain = sum(terms.values(), F.lit(1.0))
    falling = sum((c * 10.0 ** -(i + 1) for i, c in enumerate(terms.values())), F.lit(1.0))
    for parts in (1, 7, 40):
        df = spark.range(0, 21, 1, parts)
        got = {(r.model, r.term): r.estimate for r in factored.ols_factored(df, {"plain": (plain, terms), "falling": (falling, terms)}).collect()}
        for i, t in enumerate(["(Intercept)", *terms]):
            assert got[("plain", t)] == pytest.approx(1.0, rel=1e-8)
            assert got[("falling", t)] == pytest.approx(10.0**-i, rel=1e-8)


def test_factored_fit_against_numpy_with_aliases_and_unusable_rows(spark):
    rng = np.random.default_rng(8)
    x1, x2 = rng.normal(size=300) + 1e6, rng.exponential(size=300)
    y = 3 - 0.5 * x1 + 2 * x2 + rng.normal(size=300)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(y, x1, x2)] + [(1.0, None, 2.0), (float("inf"), 1.0, 1.0), (float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y double, x1 double, x2 double").repartition(6)
    a, b = F.col("x1"), F.col("x2")
    fits = {"m": (F.col("y"), {"x1": a, "twice": 2 * a, "x2": b}), "none": (F.lit(None).cast("double"), {"x1": a})}
    got = {(r.model, r.term): r for r in factored.ols_factored(df, fits).collect()}
    X = np.column_stack([np.ones(300), x1 - 1e6, x2])
    beta, rss, *_ = np.linalg.lstsq(X, y, rcond=None)
    cov = rss[0] / 297 * np.linalg.inv(X.T @ X)
    assert got[("m", "x1")].estimate == pytest.approx(beta[1], rel=1e-7) and got[("m", "x2")].estimate == pytest.approx(beta[2], rel=1e-9)
    assert got[("m", "x2")].std_error == pytest.approx(math.sqrt(cov[2, 2]), rel=1e-7)
    assert got[("m", "(Intercept)")].estimate == pytest.approx(beta[0] - beta[1] * 1e6, rel=1e-7)
    assert got[("m", "twice")].estimate is None and got[("m", "x1")].n == 300 and got[("m", "x1")].rss == pytest.approx(rss[0], rel=1e-7)
    assert got[("none", "x1")].estimate is None and got[("none", "x1")].n == 0
    assert {r.n for r in factored.ols_factored(df.where("false"), fits).collect()} <= {0}


def test_stored_factors_of_two_halves_merge_to_the_whole(spark):
    df = spark.range(0, 1000, 1, 8).select(F.col("id").cast("double").alias("x"), F.sin("id").alias("y"))
    job = {"m": (F.col("y"), {"x": F.col("x"), "xx": F.col("x") * F.col("x")})}
    halves = [factored.model_factors(df.where(c), job) for c in ("x < 400", "x >= 400")]
    whole, merged = (factored.merge_factors(f, 1).first() for f in (factored.model_factors(df, job), halves[0].unionByName(halves[1])))
    assert merged.n == whole.n == 1000
    assert np.allclose(np.abs(merged.factor), np.abs(whole.factor), rtol=1e-9, atol=1e-6)


def test_t_distribution():
    # Known two-sided probabilities: t = 12.706 at 1, 2.228 at 10 and 1.984 at 100 degrees are 5 percent.
    for t, dof in ((12.7062, 1), (2.22814, 10), (1.98397, 100)):
        assert models.t_two_sided(t, dof) == pytest.approx(0.05, abs=1e-5)
    assert models.t_two_sided(0.0, 5) == 1.0


# --- sources ---


def test_fixed_width_keeps_zeros_and_blanks(spark):
    path = scratch_dir(spark, "t")
    layout = [sources.Field("code", 4, 1), sources.Field("n", 5, 5, "N")]
    df = spark.createDataFrame([("007", 12.0), (None, None)], "code string, n double")
    sources.write_fixed_width(df, path, layout)
    assert sorted(map(tuple, sources.read_fixed_width(spark, path, layout).collect()), key=str) == [("007", 12.0), (None, None)]
    table = spark.createDataFrame([(2, "n", 5, 5, "N"), (1, "code", 4, 1, "A")], "pos int, ddref string, field_size int, starting_pos int, data_type string")
    assert sources.layout_fields(table) == layout


def test_materialize_builds_once_and_replaces_an_unfinished_write(spark):
    path, calls = scratch_dir(spark, "m"), []

    def build():
        calls.append(1)
        return spark.range(3)

    spark.range(7).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert not sources.is_complete(spark, path)
    assert sources.materialize(spark, path, build).count() == 3
    assert sources.materialize(spark, path, build).count() == 3 and len(calls) == 1


def test_only_missing_keys_are_built(spark):
    path, calls = scratch_dir(spark, "b"), []
    schema = T.StructType.fromDDL("v long, k string")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")], schema)

    def build(missing):
        calls.append(sorted((r.k for r in missing.collect()), key=str))
        return rows.join(missing.toDF("w"), F.col("k").eqNullSafe(F.col("w")), "left_semi")

    want = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    have = lambda *keys: sorted(r.v for r in sources.build_missing(spark, path, want(*keys), ["k"], schema, build).collect())
    assert have() == [] and calls == []
    assert have("a", "a", "no rows") == [1, 2] and have("a", "no rows") == [1, 2] and calls == [["a", "no rows"]]
    # A killed write: rows of "b" and of the null key are there, but their keys are not in the list.
    spark.createDataFrame([(9, "b"), (9, None)], schema).write.mode("append").partitionBy("k").parquet(f"{path}/data")
    assert have("a") == [1, 2] and len(calls) == 1
    assert have("a", "b", None) == [1, 2, 3, 4] and calls[1:] == [[None, "b"]]
    # A build that fails leaves what was there.
    def fails(missing):
        return rows.where("k = 'c'").withColumn("v", F.raise_error(F.lit("lost")).cast("long"))

    with pytest.raises(PySparkException):
        sources.build_missing(spark, path, want("c"), ["k"], schema, fails)
    assert have("a") == [1, 2, 3, 4] and have("c") == [1, 2, 3, 4, 5]


def test_audit_counts_in_the_pass_of_the_write(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("v", F.when(F.col("id") % 10 != 0, F.col("id")))
    path = scratch_dir(spark, "aud")
    got = sources.write_audited(df, path, {"odd": F.col("v") % 2 == 1, "none": F.col("v").isNull()})
    assert got == {"rows": 1000, "odd": 500, "none": 100} and spark.read.parquet(path).count() == 1000
    assert sources.write_audited(df.where("false"), path, {"odd": F.col("v") % 2 == 1}) == {"rows": 0, "odd": 0}
    with pytest.raises(ValueError):
        sources.write_audited(df, path, {"rows": F.lit(True)})


def test_scope_opens_only_its_folders(spark):
    from segspark.plans import scans
    from segspark.plans.inputs import cell

    path, sf = scratch_dir(spark, "p"), "/root/testdata/sf0.001"
    sources.write_partitioned(scans.summary_levels(cell(spark, sf)), path, ["state", "sumlev"])
    df = scans.scope_rows(spark, sf, sources.read_partitioned(spark, path, scans.levels_schema()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "sumlev#" in plan.split("PartitionFilters", 1)[1]


def test_extract_joins_by_state_and_record(spark):
    base = scratch_dir(spark, "x")
    layout = [sources.Field("STUSAB", 2, 1), sources.Field("SUMLEV", 3, 3), sources.Field("LOGRECNO", 3, 6), sources.Field("COUNTY", 3, 9)]
    geo = [("AL", "750", "001", "005"), ("AL", "750", "002", "007"), ("AL", "050", "003", "005"), ("AK", "750", "001", "009"), ("AK", "750", "009", "009")]
    sources.write_fixed_width(spark.createDataFrame(geo, "STUSAB string, SUMLEV string, LOGRECNO string, COUNTY string"), f"{base}/geo", layout)
    one = [("AL", "001", 1, 10), ("AL", "003", 3, 30), ("AK", "001", 4, 40), ("AZ", "001", 5, 50)]
    two = [("AL", "001", 100), ("AL", "002", 200)]
    spark.createDataFrame(one, "s string, r string, a int, b int").write.csv(f"{base}/one")
    spark.createDataFrame(two, "s string, r string, c int").write.csv(f"{base}/two")
    record = ["STUSAB", "LOGRECNO"]
    x = sources.Extract(f"{base}/geo", layout, [sources.Segment(f"{base}/one", [*record, "A", "B"]), sources.Segment(f"{base}/two", [*record, "C"])])
    df = sources.read_extract(spark, x, {"B": "b", "C": "c"}, ["750"], ["COUNTY"])
    got = sorted((tuple(r) for r in df.collect()), key=str)
    # AK 009 is in no segment, AL 003 of another level, AZ without geography; codes keep their zeros.
    assert df.columns == [*record, "COUNTY", "SUMLEV", "b", "c"]
    assert got == [("AK", "001", "009", "750", 40, None), ("AL", "001", "005", "750", 10, 100), ("AL", "002", "007", "750", None, 200)]
    assert sources.read_extract(spark, x, {"C": "c"}, ["750", "050"], []).count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<STUSAB:string,LOGRECNO:string,B:bigint>" in plan
    with pytest.raises(ValueError):
        sources.read_extract(spark, x, {"D": "d"}, ["750"], [])
    with pytest.raises(ValueError):
        sources.stack_extracts(spark, {}, {"B": "b"}, ["750"], [])


def test_type_codes_must_match_names():
    with pytest.raises(ValueError):
        sources.schema_from_codes(["a", "b"], "c")


def test_column_labels(spark):
    df = sources.with_labels(spark.range(1), {"id": "an id"})
    assert df.schema["id"].metadata == {"comment": "an id"}


def test_pruned_scan_reads_two_columns(spark):
    df = sources.read_columns(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey", "l_quantity"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_equal_width_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "v double")
    assert [r.b for r in df.select(equal_width_bin(F.col("v"), F.lit(0.0), F.lit(1.0), 2).alias("b")).collect()] == [1, 1, 2, None]


# --- shapes ---


def shape_df(spark, key, shapes_):
    rows = [(i, [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in s]) for i, s in enumerate(shapes_)]
    return spark.createDataFrame(rows, f"{key} int, shape array<array<array<struct<x: double, y: double>>>>")


def test_pieces_of_shapes_with_holes_and_parts(spark):
    rng = np.random.default_rng(12)
    comb = [(-4, -3), (4, -3), (4, 3), (3, 3), (3, -2), (1, -2), (1, 3), (0, 3), (0, -2), (-4, -2)]
    square = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]
    diamond = [(0, -4), (4, 0), (0, 4), (-4, 0)]
    left = [
        [[diamond, square(-1, -1, 2)]],                                     # slanted sides and a hole
        [[diamond[::-1], square(-1, -1, 2)[::-1]], [square(5, 5, 1)]],      # the other direction, and a second part
        [[comb]], [[square(-3, -3, 3)], [square(0, -3, 3)]],                # two parts that share an edge
        [[square(-5, -5, 10), square(-5, -5, 4)]],                          # a hole at the border
        [], [[[(0, 0), (1, 1)]]],                                           # covers nothing
        *[[[regular(rng, 7)]] for _ in range(6)],
    ]
    right = [[[square(-1, -1, 3)]], [[square(0, 0, 6)]], [[diamond]], *[[[regular(rng, 5)]] for _ in range(8)]]
    a, b = shape_df(spark, "a", left), shape_df(spark, "b", right)
    pairs = spatial.overlay_pairs(shapes.with_shape_bounds(a), shapes.with_shape_bounds(b), "a", "b", cell=0.7)

    def want(s, w):
        """Parts less holes, each clipped by the convex window."""
        return sum((1 if i == 0 else -1) * clip(ring, w) for part in s for i, ring in enumerate(part) if len(ring) > 2)

    for strip in (0.37, 50.0):
        pieces = shapes.overlay_pieces(pairs, a, b, "a", "b", strip)
        got = {(r.a, r.b): r.area for r in shapes.piece_measures(pieces, "a", "b").collect()}
        for i, s in enumerate(left):
            for j, w in enumerate(right):
                assert got.get((i, j), 0.0) == pytest.approx(want(s, w[0][0]), abs=1e-8), (strip, i, j)
    area = {r.a: r.s for r in a.select("a", shapes.shape_area(F.col("shape")).alias("s")).collect()}
    assert area[0] == area[1] - 1 == 28 and area[3] == 18 and area[5] == area[6] == 0


def test_holes_on_both_sides_and_centre(spark):
    square = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]
    # A hole in one meets a hole in the other; a part that lies in the other's hole shares nothing with it.
    a = shape_df(spark, "a", [[[square(0, 0, 8), square(2, 2, 4)], [square(3, 3, 2)]], [[square(0, 0, 1)]]])
    b = shape_df(spark, "b", [[[square(1, 1, 8), square(3, 3, 4)]], [[square(1, 0, 1)]], [[square(2, 2, 4)]]])
    pairs = a.select("a").crossJoin(b.select("b"))
    got = {(r.a, r.b): r for r in shapes.piece_measures(shapes.overlay_pieces(pairs, a, b, "a", "b", 3.0), "a", "b").collect()}
    grid = (np.arange(0, 10, 0.5) + 0.25)
    x, y = np.meshgrid(grid, grid)
    box = lambda x0, y0, d: (x > x0) & (x < x0 + d) & (y > y0) & (y < y0 + d)
    both = (box(0, 0, 8) & ~box(2, 2, 4) | box(3, 3, 2)) & box(1, 1, 8) & ~box(3, 3, 4)
    r = got[(0, 0)]
    assert (r.area, r.cx, r.cy) == pytest.approx((both.sum() * 0.25, x[both].mean(), y[both].mean()))
    assert got[(0, 2)].area == pytest.approx(4.0) and (1, 1) not in got and (1, 2) not in got
