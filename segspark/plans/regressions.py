"""Covariates, model frames and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.functions import tidy
from segspark.operators import compare, factored, models, relate, theil
from segspark.plans.inputs import CELL, CROSSWALK, FOCAL, FOUR, SOURCES, cell, crosswalk, rounded
from segspark.plans.registry import query
from segspark.plans.segregation import FOUR_SQL, focal_sql, rounded_cols
from segspark.plans.summaries import GROWTH, growth

# The shares among the covariates and the group each one counts.
SHARES = {"p_urgent": "1-URGENT", "p_high": "2-HIGH", "p_medium": "3-MEDIUM", "p_low": "5-LOW"}
NATION = theil.Hierarchy(scope=["tract"], mid="segment", leaf=["block"], group="race", sources=SOURCES)


def covariates(spark, sf):
    return compare.metro_covariates(cell(spark, sf), ["tract"], ["block"], "race", "census", FOCAL, SHARES)


SHARE_SQL = ", ".join(f"sum(case when race = '{g}' then census else 0 end) / nullif(sum(census), 0)::double {n}" for n, g in SHARES.items())
COVARIATES = f"""cov as (select tract, cast(sum(census) as bigint) total_pop,
 sum(case when race <> '{FOCAL}' then census else 0 end) / nullif(sum(case when race = '{FOCAL}' then census else 0 end), 0)::double nw_w_ratio,
 count(distinct block) block_count, {SHARE_SQL} from cell group by tract)"""
DIVERSITY = " ".join(f"- {p} * ln(nullif({p}, 0))" for p in SHARES)


@query("metro_covariates", f"with {CELL}, {COVARIATES} select tract, total_pop, block_count, {rounded(', '.join(['nw_w_ratio', *SHARES]))} from cov")
def q_covariates(spark, sf):
    return rounded_cols(covariates(spark, sf), ["nw_w_ratio", *SHARES])


@query("diversity", f"with {CELL}, {COVARIATES} select tract, round({DIVERSITY}, 6) + 0.0 as diversity from cov")
def q_diversity(spark, sf):
    return covariates(spark, sf).select("tract", tidy(compare.share_entropy([F.col(p) for p in SHARES])).alias("diversity"))


def model_frame(spark, sf):
    """Covariates, area type and the error of every measure, one row per scope."""
    types = crosswalk(spark, sf).select(F.col("county").alias("tract"), "type")
    errors = compare.measure_errors(theil.decompose(cell(spark, sf), NATION, FOUR, focal=FOCAL), ["tract"])
    frame = relate.attach_distinct(covariates(spark, sf), types, ["tract"], ["type"]).join(errors, "tract", "left")
    return frame.withColumn("diversity", compare.share_entropy([F.col(p) for p in SHARES]))


ERRORS = ", ".join(
    f"""max(case when "name" = 'DP' then "{m}" end) - max(case when "name" = 'CENSUS' then "{m}" end) "{m}\"""" for m in compare.MEASURES)
FRAME = f"""{CELL}, {CROSSWALK}, {COVARIATES}, nlong as (
 select tract, 'CENSUS' as "name", segment, block, race, census as "value" from cell where race in ({FOUR_SQL})
 union all select tract, 'DP', segment, block, race, dp from cell where race in ({FOUR_SQL})),
{focal_sql('nlong', keys='tract, "name"', mid='segment')},
err as (select tract, {ERRORS} from split group by tract),
frame as (select cov.*, x."type", err.* exclude (tract), {DIVERSITY} diversity from cov join crosswalk x on cov.tract = x.county left join err on cov.tract = err.tract)"""
FRAME_COLS = ["nw_w_ratio", *SHARES, "diversity", *compare.MEASURES]


@query("metro_model_frame", f"""with {FRAME} select tract, total_pop, block_count, "type", {rounded(', '.join(FRAME_COLS))} from frame""")
def q_frame(spark, sf):
    return rounded_cols(model_frame(spark, sf), FRAME_COLS)


@query("ols_simple", f"""with {FRAME}, growth as (select tract, block, sum(census) cp, sum(dp) dpop, sum(case when race = '{FOCAL}' then census end) fc
 from cell group by tract, block having sum(census) <> 0),
dd as (select 'error ~ log(pop)' as model, "H" y, ln(total_pop) x from frame union all select 'abs error ~ log(pop)', abs("H"), ln(total_pop) from frame
 union all select 'change ~ share', dpop - cp, fc / cp::double from growth)
select model, round(regr_slope(y, x), 6) + 0.0 as slope, round(regr_intercept(y, x), 6) + 0.0 as intercept, round(regr_r2(y, x), 6) + 0.0 as r2,
 cast(regr_count(y, x) as bigint) n from dd group by model""")
def q_ols_simple(spark, sf):
    frame = model_frame(spark, sf).select("H", F.ln("total_pop").alias("x"))
    g = growth(spark, sf)
    rows = frame.select(
        F.expr("inline(array(named_struct('model', 'error ~ log(pop)', 'y', H, 'x', x), named_struct('model', 'abs error ~ log(pop)', 'y', abs(H), 'x', x)))")
    ).unionByName(g.select(F.lit("change ~ share").alias("model"), F.col("popChange").cast("double").alias("y"), F.col("pFocal").alias("x")))
    return rounded_cols(models.ols_simple(rows, F.col("y"), F.col("x"), ["model"]), ["slope", "intercept", "r2"])


@query("ols_multi", f"""with {FRAME}, dd as (select abs("H") y, ln(total_pop) x1, ln(block_count) x2 from frame where "H" is not null),
s as (select count(*) n, avg(y) my, avg(x1) m1, avg(x2) m2, covar_samp(x1, x1) a, covar_samp(x1, x2) b, covar_samp(x2, x2) c,
 covar_samp(x1, y) p, covar_samp(x2, y) q, var_samp(y) yy from dd),
f as (select *, (p * c - q * b) / (a * c - b * b) b1, (q * a - p * b) / (a * c - b * b) b2 from s),
g as (select *, my - b1 * m1 - b2 * m2 b0, (n - 1) * (yy - b1 * p - b2 * q) rss from f),
h as (select *, rss / (n - 3) s2, (n - 1) * (a * c - b * b) det from g),
o as (select '(Intercept)' term, b0 estimate, sqrt(s2 * (1.0e0 / n + (m1 * m1 * c - 2 * m1 * m2 * b + m2 * m2 * a) / det)) se, * from h
 union all select 'log_pop', b1, sqrt(s2 * c / det), * from h union all select 'log_blocks', b2, sqrt(s2 * a / det), * from h)
select term, round(estimate, 6) + 0.0 as estimate, round(se, 6) + 0.0 as std_error, round(estimate / se, 5) + 0.0 as t,
 round(1 - rss / ((n - 1) * yy), 6) + 0.0 as r2, n from o""")
def q_ols_multi(spark, sf):
    terms = {"log_pop": F.ln("total_pop"), "log_blocks": F.ln("block_count")}
    out = models.ols(model_frame(spark, sf), F.abs("H"), terms)
    return rounded_cols(out.select("term", "estimate", "std_error", F.round("t", 5).alias("t"), "r2", "n"), ["estimate", "std_error", "t", "r2"])


def model_terms() -> dict:
    """The predictors of the four nested explanations of an error."""
    base = {"log_pop": F.ln("total_pop"), "log_blocks": F.ln("block_count")}
    ratio = F.col("nw_w_ratio")
    return {
        "ratio": {**base, "log_ratio": F.ln(ratio)},
        "ratio_sq": {**base, "nw_w_ratio": ratio, "nw_w_ratio_sq": F.pow(ratio, F.lit(2.0))},
        "shares": {**base, **{p: F.col(p) for p in list(SHARES)[1:]}},
        "diversity": {**base, "diversity": F.col("diversity")},
    }


# The terms above, as SQL over the frame.
TERM_SQL = {
    "log_pop": "ln(total_pop)", "log_blocks": "ln(block_count)", "log_ratio": "case when nw_w_ratio > 0 then ln(nw_w_ratio) end",
    "nw_w_ratio": "nw_w_ratio", "nw_w_ratio_sq": "nw_w_ratio * nw_w_ratio", "diversity": "diversity",
    "typeMicropolitan": """case when "type" in ('Metropolitan', 'Micropolitan') then cast("type" = 'Micropolitan' as double) end""",
} | {p: f'"{p}"' for p in list(SHARES)[1:]}
BASE_TERMS = ["log_pop", "log_blocks"]
EXPLANATIONS = {
    "ratio": [*BASE_TERMS, "log_ratio"], "ratio_sq": [*BASE_TERMS, "nw_w_ratio", "nw_w_ratio_sq"],
    "shares": [*BASE_TERMS, *list(SHARES)[1:]], "diversity": [*BASE_TERMS, "diversity"],
}
MODEL_SQL = {
    "H ~ type": ('"H"', ["typeMicropolitan"]), "H ~ type + pop": ('"H"', ["typeMicropolitan", "log_pop"]), "H ~ pop": ('"H"', ["log_pop"]),
    "abs H ~ pop": ('abs("H")', ["log_pop"]), "abs H ~ pop + blocks": ('abs("H")', BASE_TERMS),
} | {f"{r} ~ {label}": (f'"{r}"', terms) for r in ("H", "Pbg") for label, terms in EXPLANATIONS.items()}


def fits_sql(models_sql: dict) -> str:
    """Every coefficient by successive residuals: all other terms, the constant among them, are swept out one after the other, then the term itself.

    p is the t density integrated by Simpson's rule.
    """
    parts, ends = [], []
    for m, (label, (y, terms)) in enumerate(models_sql.items()):
        xs = ["1.0e0", *[TERM_SQL[t] for t in terms]]
        cols = ", ".join(f"cast({x} as double) x{i}" for i, x in enumerate(xs))
        known = " and ".join(f"isfinite(x{i}) and x{i} is not null" for i in range(len(xs)))
        parts.append(f"m{m} as (select * from (select cast({y} as double) y, {cols} from frame) where y is not null and isfinite(y) and {known})")
        parts.append(f"v{m} as (select count(*) n, avg(y) my, sum((y - my0) * (y - my0)) tss from (select *, avg(y) over () my0 from m{m}))")
        for t, term in enumerate(["(Intercept)", *terms]):
            order, last = [i for i in range(len(xs)) if i != t] + [t], f"m{m}"
            for k, i in enumerate(order):
                left = ["y", *[f"x{j}" for j in order[k + 1:]]]
                swept = ", ".join(f"{c} - x{i} * (sum({c} * x{i}) over () / sum(x{i} * x{i}) over ()) {c}" for c in left)
                name = f"r{m}_{t}_{k}"
                parts.append(f"{name} as (select {swept} from {last})")
                before, last = last, name
            parts.append(f"""e{m}_{t} as (select '{label}' model, '{term}' term, a.b estimate, sqrt(c.rss / (n - {len(xs)}) / a.xx) std_error, n, {len(xs)} k, c.rss, tss
 from (select sum(y * x{t}) / sum(x{t} * x{t}) b, sum(x{t} * x{t}) xx from {before}) a, (select sum(y * y) rss from {last}) c, v{m})""")
            ends.append(f"select * from e{m}_{t}")
    return f"""{', '.join(parts)}, fits as ({' union all '.join(ends)}),
full_fits as (select *, estimate / std_error t, n - k dof, n * ln(rss / n) + n + n * ln(2 * pi()) + (k + 1) * ln(n) bic from fits),
dens as (select *, exp(lgamma((dof + 1) / 2.0e0) - lgamma(dof / 2.0e0)) / sqrt(dof * pi()) c, abs(t) / 2000 h from full_fits)
select model, term, estimate, std_error, t, greatest(0, 1 - 2 * c * h / 3 * list_sum(list_transform(range(2001),
 lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(1 + (i * h) * (i * h) / dof, -(dof + 1) / 2.0e0)))) p,
 cast(n as bigint) n, 1 - rss / tss r2, rss, bic from dens"""


FIT_COLS = ["estimate", "std_error", "t", "p", "r2", "rss", "bic"]
FITS = "with {frame}, {fits}".replace("{frame}", FRAME)


@query("ols_coefficients", f"""select model, term, n, {', '.join(f'round({c}, 5) + 0.0 as {c}' for c in FIT_COLS)}
 from ({FITS.replace('{fits}', fits_sql(MODEL_SQL))})""")
def q_ols_coefficients(spark, sf):
    """Coefficient tables with p values and BIC of all models of the errors, from one pass."""
    fits = all_fits(spark, sf)
    return fits.select("model", "term", "n", *[tidy(F.col(c), 5).alias(c) for c in FIT_COLS])


def bic_of(response: str) -> str:
    some = {k: v for k, v in MODEL_SQL.items() if k in [f"{response} ~ {label}" for label in EXPLANATIONS]}
    return f"select distinct model, n, round(bic, 5) + 0.0 as bic from ({FITS.replace('{fits}', fits_sql(some))}) where term = '(Intercept)'"


def bic_rows(spark, sf, response: str):
    named = [f"{response} ~ {label}" for label in EXPLANATIONS]
    rows = all_fits(spark, sf).where(F.col("model").isin(named) & (F.col("term") == "(Intercept)"))
    return rows.select("model", "n", tidy(F.col("bic"), 5).alias("bic"))


@query("bic_explanations_h", bic_of("H"))
def q_bic_h(spark, sf):
    """BIC of the four explanations of the error of H."""
    return bic_rows(spark, sf, "H")


@query("bic_explanations_pbg", bic_of("Pbg"))
def q_bic_pbg(spark, sf):
    """BIC of the four explanations of the error of the between-group share."""
    return bic_rows(spark, sf, "Pbg")


@query("ols_coefficients_factored", f"""select model, term, n, {', '.join(f'round({c}, 5) + 0.0 as {c}' for c in FIT_COLS)}
 from ({FITS.replace('{fits}', fits_sql(MODEL_SQL))})""")
def q_ols_factored(spark, sf):
    """The same tables by merged triangular factors, as a ratio and its square stand in one model."""
    fits = all_fits(spark, sf, factored.ols_factored)
    return fits.select("model", "term", "n", *[tidy(F.col(c), 5).alias(c) for c in FIT_COLS])


def all_fits(spark, sf, fit=models.ols_models):
    pop, blocks = {"log_pop": F.ln("total_pop")}, {"log_blocks": F.ln("block_count")}
    kind = models.contrasts("type", ["Metropolitan", "Micropolitan"])
    h, size = F.col("H"), F.abs("H")
    jobs = {
        "H ~ type": (h, kind), "H ~ type + pop": (h, {**kind, **pop}), "H ~ pop": (h, pop),
        "abs H ~ pop": (size, pop), "abs H ~ pop + blocks": (size, {**pop, **blocks}),
    } | {
        f"{response} ~ {label}": (F.col(response), terms)
        for response in ("H", "Pbg") for label, terms in model_terms().items()
    }
    return fit(model_frame(spark, sf), jobs)


@query("ols_factor", f"""with {FRAME}, m as (select "type" ty, avg("H") m, count("H") n from frame group by all), b as (select min(ty) ty0, arg_min(m, ty) m0 from m)
select case when ty = ty0 then '(Intercept)' else 'type' || ty end term, round(case when ty = ty0 then m else m - m0 end, 6) + 0.0 as estimate, n from m, b""")
def q_ols_factor(spark, sf):
    return rounded_cols(models.ols_factor(model_frame(spark, sf), F.col("H"), "type"), ["estimate"])


def bic_predictors() -> dict:
    return {"log_pop": F.ln("total_pop"), "log_blocks": F.ln("block_count"), "log_ratio": F.ln("nw_w_ratio"), "diversity": F.col("diversity")}


@query("bic_table", f"""with {FRAME}, dd as (select "H" y, unnest(['log_pop', 'log_blocks', 'log_ratio', 'diversity']) model,
 unnest([ln(total_pop), ln(block_count), ln(nw_w_ratio), diversity]) x from frame),
s as (select model, regr_count(y, x) n, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) rss from dd group by model)
select model, cast(n as bigint) n, round(rss, 6) + 0.0 as rss, round(n * ln(rss / n) + n + n * ln(2 * pi()) + 3 * ln(n), 5) + 0.0 as bic from s""")
def q_bic(spark, sf):
    out = models.bic_simple(model_frame(spark, sf), F.col("H"), bic_predictors())
    return out.withColumns({"rss": tidy(F.col("rss")), "bic": tidy(F.col("bic"), 5)})


def newton_sql(steps: int) -> str:
    """Newton steps of the two-parameter logit, one table per step."""
    parts = [f"""{GROWTH}, d as (select case when "dPop" > "cPop" then 1.0e0 else 0.0e0 end y, focal / "cPop"::double x from growth where focal is not null),
i0 as (select 0.0e0 a, 0.0e0 b)"""]
    for k in range(steps):
        parts.append(f"""i{k + 1} as (select any_value(a) + (sum(g0) * sum(h11) - sum(g1) * sum(h01)) / (sum(h00) * sum(h11) - sum(h01) * sum(h01)) a,
 any_value(b) + (sum(g1) * sum(h00) - sum(g0) * sum(h01)) / (sum(h00) * sum(h11) - sum(h01) * sum(h01)) b from (
 select a, b, y - p g0, (y - p) * x g1, p * (1 - p) h00, p * (1 - p) * x h01, p * (1 - p) * x * x h11 from (select a, b, y, x, 1 / (1 + exp(-(a + b * x))) p from d, i{k})))""")
    return f"""with {', '.join(parts)}, hs as (select any_value(a) a, any_value(b) b, sum(p * (1 - p)) h00, sum(p * (1 - p) * x) h01, sum(p * (1 - p) * x * x) h11
 from (select a, b, x, 1 / (1 + exp(-(a + b * x))) p from d, i{steps}))
select '(Intercept)' term, round(a, 5) + 0.0 as estimate, round(sqrt(h11 / (h00 * h11 - h01 * h01)), 5) + 0.0 as std_error from hs
 union all select 'share', round(b, 5) + 0.0, round(sqrt(h00 / (h00 * h11 - h01 * h01)), 5) + 0.0 from hs"""


@query("logit_increase", newton_sql(8))
def q_logit(spark, sf):
    out = models.logit(growth(spark, sf), F.col("increase"), {"share": F.col("pFocal")})
    return out.select("term", tidy(F.col("estimate"), 5).alias("estimate"), tidy(F.col("std_error"), 5).alias("std_error"))
