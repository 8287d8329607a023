"""Queries that fit the demand model over its whole parameter ranges, and check the fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.operators import demand
from roadweave.plans.reference import _EXPOSED, _MODEL, _OBSERVED, _OD, _PAIRS, exposures, gravity_pairs, observed, query

#: Ranges and points of the global grid (fixed values).
N_RANGE, BETA_RANGE, N_POINTS, BETA_POINTS, PROFILE_POINTS = (0.0, 6.0), (0.0, 0.2), 101, 251, 5001


def _inputs(s, d):
    return gravity_pairs(s, d), exposures(s, d), observed(s, d)


def global_surface(s, d):
    return demand.surface(*_inputs(s, d), demand.grid_values(*N_RANGE, N_POINTS), demand.grid_values(*BETA_RANGE, BETA_POINTS))


def _surface_sql(n_points: int, beta_points: int) -> str:
    n = f"{N_RANGE[0]} + {N_RANGE[1] - N_RANGE[0]} * i / {max(1, n_points - 1)}.0" if n_points > 1 else "0.0"
    beta = f"{BETA_RANGE[0]} + {BETA_RANGE[1] - BETA_RANGE[0]} * k / {beta_points - 1}.0"
    return f"""{_MODEL}, grid as (select i, k, cast({n} as double) as n, cast({beta} as double) as beta from (select unnest(range(0, {n_points})) as i) cross join (select unnest(range(0, {beta_points})) as k)),
      down as (select i, k, sum(p * a * exp(n * ln(c) - beta * c)) as down from pairs cross join grid group by 1, 2),
      up as (select section, i, k, sum(share * p * a * exp(n * ln(c) - beta * c)) as up from pairs join exposed using (o, d) cross join grid group by 1, 2, 3),
      pts as (select grid.*, section, y, base, coalesce(up / down, 0) as g from observed cross join grid left join down using (i, k) left join up using (section, i, k)),
      sums as (select i, k, n, beta, sum(g * (y - base)) as gr, sum(g * g) as gg, sum((y - base) * (y - base)) as rr, sum(g * (y - base) / (y * y)) as gr2, sum(g * g / (y * y)) as gg2, sum((y - base) * (y - base) / (y * y)) as rr2 from pts group by 1, 2, 3, 4),
      surf as (select i, k, n, beta, q, rr - 2 * q * gr + q * q * gg as j, rr2 - 2 * q * gr2 + q * q * gg2 as rel_j from (select *, greatest(0, gr / gg) as q from sums))"""


_GLOBAL = _surface_sql(N_POINTS, BETA_POINTS)


@query(_GLOBAL + " select cast(i as integer) as i, cast(k as integer) as k, round(q, 2) as q, round(j, 2) as j from surf")
def tanner_global(s, d):
    """The profiled loss at all 101 x 251 points of the global grid."""
    return global_surface(s, d).select("i", "k", F.round("q", 2).alias("q"), F.round("j", 2).alias("j"))


@query(_surface_sql(1, PROFILE_POINTS) + " select cast(k as integer) as k, round(q, 2) as q, round(j, 2) as j, round(rel_j, 9) as rel_j from surf")
def beta_global(s, d):
    """The profiled loss at 5,001 values of beta."""
    t = demand.surface(*_inputs(s, d), [0.0], demand.grid_values(*BETA_RANGE, PROFILE_POINTS))
    return t.select("k", F.round("q", 2).alias("q"), F.round("j", 2).alias("j"), F.round("rel_j", 9).alias("rel_j"))


@query(_GLOBAL + ", f as (select unnest([1.01, 1.05, 1.10]) as factor) select cast(factor as double) as factor, count(*) as points, round(max(n) - min(n), 6) as n_width, round(max(beta) - min(beta), 6) as beta_width, round(case when isnan(corr(n, beta)) then null else corr(n, beta) end, 6) as r from surf cross join f where j <= factor * (select min(j) from surf) group by 1")
def surface_thresholds(s, d):
    """Width and correlation of n and beta among points within 1, 5 and 10 % of the least loss."""
    return demand.threshold_correlation(global_surface(s, d), [1.01, 1.05, 1.10])


_FAR = "(abs(surf.i - {s}.i) > 2 or abs(surf.k - {s}.k) > 2)"
_SEEDS = _GLOBAL + "".join(
    f", s{m} as (select * from surf" + (" where " + " and ".join(_FAR.format(s=f"(select * from s{x})").replace("(select * from s" + str(x) + ").i", f"(select i from s{x})").replace("(select * from s" + str(x) + ").k", f"(select k from s{x})") for x in range(1, m)) if m > 1 else "") + " order by j, i, k limit 1)"
    for m in range(1, 6)
)


@query(_SEEDS + " " + " union all ".join(f"select cast({m} as integer) as place, round(n, 6) as n, round(beta, 6) as beta, round(j, 2) as j from s{m}" for m in range(1, 6)))
def surface_seeds(s, d):
    """The five best grid points that lie more than two steps apart."""
    found = demand.seeds(global_surface(s, d).cache())
    return s.createDataFrame([(m, round(n, 6), round(b, 6), j) for m, (n, b, j) in enumerate(found, 1)], "place int, n double, beta double, j double").withColumn("j", F.round("j", 2))


@query()
def tanner_refined(s, d):
    """The least loss around the seeds by narrowing grids in n and beta; never above the best grid point."""
    p, e, o = (x.cache() for x in _inputs(s, d))
    surf = demand.surface(p, e, o, demand.grid_values(*N_RANGE, N_POINTS), demand.grid_values(*BETA_RANGE, BETA_POINTS)).cache()
    start = demand.seeds(surf)
    n, b, q, j = demand.refine_surface(p, e, o, start, N_RANGE, BETA_RANGE)
    return s.createDataFrame([(round(n, 6), round(b, 8), round(q, 3), j, start[0][2])], "n double, beta double, q double, j double, grid_j double")


@query(f"with {_PAIRS}, w as (select p * a * exp(-0.04 * c) as e, p * a * exp(0.0 * ln(c) - 0.04 * c) as t from pairs) select count(*) as pairs, max(abs(e - t)) <= 1e-12 as equal from w")
def nested_model(s, d):
    """The combined deterrence with n = 0 is the exponential one."""
    from roadweave.functions.codes import deterrence

    w = F.col("p") * F.col("a")
    t = gravity_pairs(s, d).select((w * deterrence(F.col("c"), F.lit(0.04))).alias("e"), (w * deterrence(F.col("c"), F.lit(0.04), F.lit(0.0))).alias("t"))
    return t.agg(F.count(F.lit(1)).alias("pairs"), (F.max(F.abs(F.col("e") - F.col("t"))) <= 1e-12).alias("equal"))


@query("select cast(b as double) as beta, cast(t as double) as total, true as holds from (select unnest([0.0, 0.02, 0.05, 0.1, 0.2]) as b) cross join (select unnest([1000.0, 1000000.0, 2000000.0]) as t)")
def origin_structure(s, d):
    """Origin sums of the constrained model against total times p, at five betas and three totals."""
    t = demand.origin_gaps(gravity_pairs(s, d), [0.0, 0.02, 0.05, 0.1, 0.2], [1e3, 1e6, 2e6])
    return t.select("beta", "total", (F.col("gap") <= 1e-9).alias("holds"))


_FIT = "(select section, y, base, base + {q} * coalesce(u / w, 0) as fitted from observed left join (select section, sum(share * p * a * exp({n} * ln(c) - {beta} * c)) as u from pairs join exposed using (o, d) group by 1) using (section) cross join (select sum(p * a * exp({n} * ln(c) - {beta} * c)) as w from pairs))"
_OLD, _NEW = {"n": "0.0", "beta": "0.04", "q": "1000.0"}, {"n": "1.0", "beta": "0.08", "q": "1500.0"}


@query(f"{_MODEL}, fit as {_FIT.format(**_OLD)} select section, round(fitted, 4) as fitted, round(y - fitted, 4) as residual, round((y - fitted) * (y - fitted) / (select sum((y - fitted) * (y - fitted)) from fit), 9) as share_of_sse from fit")
def residual_shares(s, d):
    """Each section's part of the squared error of a model."""
    t = demand.predictions(*_inputs(s, d), *[float(_OLD[x]) for x in ("n", "beta", "q")])
    return t.select("section", F.round("fitted", 4).alias("fitted"), F.round("residual", 4).alias("residual"), F.round("share_of_sse", 9).alias("share_of_sse"))


@query(f"{_MODEL}, a as {_FIT.format(**_OLD)}, b as {_FIT.format(**_NEW)} select section, round(abs(a.y - a.fitted), 4) as old_error, round(abs(b.y - b.fitted), 4) as new_error, abs(b.y - b.fitted) < abs(a.y - a.fitted) as improved from a join b using (section)")
def model_comparison(s, d):
    old, new = (demand.predictions(*_inputs(s, d), *[float(m[x]) for x in ("n", "beta", "q")]) for m in (_OLD, _NEW))
    t = demand.compare_models(old, new)
    return t.select("section", F.round("old_error", 4).alias("old_error"), F.round("new_error", 4).alias("new_error"), "improved")


@query(f"with {_PAIRS}, z as (select distinct o as z, p from pairs), y as (select distinct d as z, a from pairs) select z, round(p, 7) as row_sum, round(a, 7) as column_sum from z join y using (z)")
def balanced_margins(s, d):
    """Row and column sums of the doubly constrained flows after balancing until they agree."""
    t, _, _ = demand.balance_until(gravity_pairs(s, d), 0.04)
    rows = t.groupBy(F.col("o").alias("z")).agg(F.round(F.sum("f"), 7).alias("row_sum"))
    return rows.join(t.groupBy(F.col("d").alias("z")).agg(F.round(F.sum("f"), 7).alias("column_sum")), "z")


_SUMS = "sum(g * (y - base)) as gr, sum(g * g) as gg, sum((y - base) * (y - base)) as rr"


@query(f"{_GLOBAL}, lo as (select unnest([0, 1, 2]) as left_out), s2 as (select left_out, n, beta, {_SUMS} from pts join lo on section <> left_out group by 1, 2, 3), pr as (select left_out, n, beta, greatest(0, gr / gg) as q, rr - 2 * greatest(0, gr / gg) * gr + power(greatest(0, gr / gg), 2) * gg as j from s2) select cast(left_out as integer) as left_out, round(min(j), 2) as j from pr group by 1")
def leave_one_out_global(s, d):
    """The least loss over the global grid without each section in turn."""
    p, e, o = _inputs(s, d)
    ns, bs = demand.grid_values(*N_RANGE, N_POINTS), demand.grid_values(*BETA_RANGE, BETA_POINTS)
    out = None
    for left_out in (0, 1, 2):
        one = demand.surface(p, e.where(F.col("section") != left_out), o.where(F.col("section") != left_out), ns, bs).agg(F.round(F.min("j"), 2).alias("j")).select(F.lit(left_out).alias("left_out"), "j")
        out = one if out is None else out.unionAll(one)
    return out
