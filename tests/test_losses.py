"""No value is cut, dropped or merged without a word."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from segspark import session, sources
from segspark.functions import pad_code
from segspark.operators import compare, models, relate, spatial


def test_codes_are_padded_but_never_cut(spark):
    df = spark.createDataFrame([(7,), (1234567,), (12345678,), (None,)], "n long")
    assert [r.c for r in df.select(pad_code(F.col("n"), 7).alias("c")).collect()] == ["0000007", "1234567", "12345678", None]


def test_long_record_numbers_meet_only_their_own_geography(spark):
    numbers = [1234567, 12345678, 12345679]
    geo = spark.createDataFrame([(n, f"g{n}") for n in numbers], "LOGRECNO long, place string")
    rec = spark.createDataFrame([(n,) for n in numbers], "n long").select(pad_code(F.col("n"), 7).alias("LOGRECNO"))
    got = {(r.LOGRECNO, r.place) for r in relate.record_geography(rec, geo, "LOGRECNO", 7).collect()}
    assert got == {(str(n), f"g{n}") for n in numbers}


@pytest.mark.parametrize("kind, value", [("N", "1234567"), ("A", "abcdef")])
def test_a_value_wider_than_its_field_is_an_error(spark, tmp_path, kind, value):
    df = spark.createDataFrame([(value,)], "v string")
    with pytest.raises(PySparkException, match="wider than field"):
        sources.write_fixed_width(df, f"file:{tmp_path}/wide", [sources.Field("v", 5, 1, kind)])


def test_decimals_have_means(spark):
    df = spark.createDataFrame([("a", Decimal("1.50"), 1), ("a", Decimal("2.50"), 2)], "k string, d decimal(10,2), i int")
    assert float(compare.numeric_means(df, ["k"]).first().d) == 2.0


def test_a_level_that_is_not_listed_is_an_error(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("a", 4.0)], "f string, y double")
    with pytest.raises(PySparkException, match="not listed"):
        models.ols(df, F.col("y"), models.contrasts("f", ["a", "b"])).collect()


def test_models_with_too_few_rows_or_aliased_terms(spark):
    few = spark.createDataFrame([(1.0, 1.0, 2.0)], "y double, a double, b double")
    rows = models.ols(few, F.col("y"), {"a": F.col("a"), "b": F.col("b")}).collect()
    assert [r.term for r in rows] == ["(Intercept)", "a", "b"] and [r.n for r in rows] == [1, 1, 1]
    assert rows[1].estimate is None and rows[2].estimate is None
    assert models.ols(few.where("false"), F.col("y"), {"a": F.col("a")}).first().estimate is None
    rng = np.random.default_rng(0)
    a, c = rng.normal(size=50), rng.normal(size=50)
    y = 1 + 2 * a - c + rng.normal(size=50) * 0.1
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, a, 3 * a, c)], "y double, a double, b double, c double")
    both = {r.term: r for r in models.ols(df, F.col("y"), {k: F.col(k) for k in "abc"}).collect()}
    alone = {r.term: r for r in models.ols(df, F.col("y"), {k: F.col(k) for k in "ac"}).collect()}
    assert both["b"].estimate is None and both["b"].std_error is None
    for term in alone:
        assert both[term].estimate == pytest.approx(alone[term].estimate) and both[term].p == pytest.approx(alone[term].p)
    assert both["a"].bic == pytest.approx(alone["a"].bic)


def test_a_long_literal_dimension(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("k"))
    out = relate.attach_literal(df, "k", {str(i): f"v{i}" for i in range(10_500)}, "v")
    assert {r.k: r.v for r in out.collect()} == {"0": "v0", "1": "v1", "2": "v2"}


def test_neighbours_across_a_lattice_border(spark):
    ring = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 0.0)]
    shapes = [("a", ring(0.0)), ("b", ring(1.0 + 1e-8)), ("c", ring(1.0 - 1e-8 + 1)), ("d", ring(9.0))]
    df = spark.createDataFrame(shapes, "id string, ring array<struct<x: double, y: double>>")
    assert {tuple(r) for r in spatial.adjacency(df, "id").collect()} == {("a", "b"), ("b", "c")}


def test_scratch_folder_must_be_shared_on_a_cluster():
    class Conf(dict):
        get = lambda self, k, d=None: {"spark.master": "spark://host:7077"}.get(k, d)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session(), "x")
