"""Gravity demand models: shares, profiled scale over parameter grids, search, identifiability.

Input pairs: o, d, p (production), a (attraction), c (cost).  Exposures: section, o, d,
share (p of the pair on the section).  Observations: section, y, base (flow that is known
already).  Grids are small by their meaning (thousands of parameters) and multiply the pair
table inside one aggregation; only sums per parameter leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.codes import deterrence
from roadweave.runtime import Scratch


def gravity_shares(pairs: DataFrame, beta: float) -> DataFrame:
    """p a exp(-beta c) over its sum over all pairs of different zones."""
    w = F.col("p") * F.col("a") * deterrence(F.col("c"), F.lit(beta))
    t = pairs.where("o <> d").withColumn("w", w)
    # One row of the sum is broadcast, so no task gets all pairs.
    return t.join(F.broadcast(t.agg(F.sum("w").alias("_all")))).withColumn("share", F.col("w") / F.col("_all")).drop("w", "_all")


def origin_constrained(pairs: DataFrame, beta: float, total: float) -> DataFrame:
    """Flows whose origin sums are total times p."""
    t = pairs.where("o <> d").withColumn("w", F.col("a") * deterrence(F.col("c"), F.lit(beta)))
    return t.withColumn("flow", total * F.col("p") * F.col("w") / F.sum("w").over(Window.partitionBy("o"))).drop("w")


def _with_grid(df: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    params = F.array(*[F.struct(F.lit(float(n)).alias("n"), F.lit(float(b)).alias("beta")) for n, b in grid])
    return df.withColumn("g", F.explode(params)).select(*df.columns, "g.n", "g.beta")


def profile(pairs: DataFrame, exposures: DataFrame, observed: DataFrame, grid: list[tuple[float, float]], relative: bool = False, constrained: bool = False) -> DataFrame:
    """(n, beta, q, j, rel_j) for every grid point.

    g = sum of exposure times share; q = max(0, sum g (y - base) / sum g^2), both weighted by
    1 / y^2 for the relative loss; j the loss at q, rel_j the relative loss there.
    """
    u = deterrence(F.col("c"), F.col("beta"), F.col("n"))
    base = pairs.where("o <> d")
    weight = (F.col("a") if constrained else F.col("p") * F.col("a")) * u
    by = ["n", "beta"] + (["o"] if constrained else [])
    down = _with_grid(base, grid).groupBy(*by).agg(F.sum(weight).alias("down"))
    hit = _with_grid(base.join(exposures, ["o", "d"]), grid)
    hit = hit.groupBy("section", *by).agg(F.sum(F.col("share") * weight * (F.col("p") if constrained else F.lit(1.0))).alias("up"))
    g = hit.join(down, by).groupBy("n", "beta", "section").agg(F.sum(F.col("up") / F.col("down")).alias("g"))
    # Sections that no pair reaches have g = 0 and still count in the loss.
    points = _with_grid(observed, grid).join(g, ["n", "beta", "section"], "left").na.fill(0.0, ["g"])
    k = (1 / (F.col("y") * F.col("y"))) if relative else F.lit(1.0)
    r = F.col("y") - F.col("base")
    sums = points.groupBy("n", "beta").agg(
        F.sum(k * F.col("g") * r).alias("gr"), F.sum(k * F.col("g") * F.col("g")).alias("gg"), F.sum(k * r * r).alias("rr"),
        F.sum(F.col("g") * r / F.col("y") ** 2).alias("gr2"), F.sum(F.col("g") ** 2 / F.col("y") ** 2).alias("gg2"), F.sum(r * r / F.col("y") ** 2).alias("rr2"),
    )
    q = F.greatest(F.lit(0.0), F.coalesce(F.try_divide("gr", "gg"), F.lit(0.0)))
    at = lambda rr, gr, gg: F.col(rr) - 2 * F.col("q") * F.col(gr) + F.col("q") * F.col("q") * F.col(gg)
    return sums.withColumn("q", q).select("n", "beta", "q", at("rr", "gr", "gg").alias("j"), at("rr2", "gr2", "gg2").alias("rel_j"))


def local_minima(prof: DataFrame, strict: bool = False) -> DataFrame:
    """Grid points whose loss is below (or at most) that of both neighbours in beta, per n."""
    w = Window.partitionBy("n").orderBy("beta")
    lo, hi = F.lag("j").over(w), F.lead("j").over(w)
    ok = (lambda x: F.col("j") < x) if strict else (lambda x: F.col("j") <= x)
    return prof.withColumns({"lo": lo, "hi": hi}).where(F.col("lo").isNotNull() & F.col("hi").isNotNull() & ok(F.col("lo")) & ok(F.col("hi"))).drop("lo", "hi")


def surface_minima(surface: DataFrame, i: str, k: str, value: str) -> DataFrame:
    """Strict minima among the eight neighbours on a grid of whole-number indices."""
    around = surface.select(F.explode(F.array(*[F.struct((F.col(i) + a).alias(i), (F.col(k) + b).alias(k)) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])).alias("at"), F.col(value).alias("other"))
    least = around.select(f"at.{i}", f"at.{k}", "other").groupBy(i, k).agg(F.min("other").alias("least"))
    return surface.join(least, [i, k]).where(F.col(value) < F.col("least")).drop("least")


def threshold_stats(prof: DataFrame, factors: list[float]) -> DataFrame:
    """Range of the parameters among points with a loss near the least; ``threshold_correlation`` tells how they move together."""
    least = prof.agg(F.min("j").alias("least"))
    t = prof.join(F.broadcast(least)).withColumn("factor", F.explode(F.array(*[F.lit(x) for x in factors]))).where(F.col("j") <= F.col("factor") * F.col("least"))
    return t.groupBy("factor").agg(F.count(F.lit(1)).alias("points"), F.min("beta").alias("beta_lo"), F.max("beta").alias("beta_hi"), F.round(F.min("q"), 6).alias("q_lo"), F.round(F.max("q"), 6).alias("q_hi"))


def threshold_correlation(prof: DataFrame, factors: list[float]) -> DataFrame:
    """Per factor: points with a loss near the least, widths in n and beta, and the correlation of the two (null if one is constant)."""
    least = prof.agg(F.min("j").alias("least"))
    t = prof.join(F.broadcast(least)).withColumn("factor", F.explode(F.array(*[F.lit(x) for x in factors]))).where(F.col("j") <= F.col("factor") * F.col("least"))
    g = t.groupBy("factor").agg(F.count(F.lit(1)).alias("points"), (F.max("n") - F.min("n")).alias("n_width"), (F.max("beta") - F.min("beta")).alias("beta_width"), F.corr("n", "beta").alias("r"))
    return g.select("factor", "points", F.round("n_width", 6).alias("n_width"), F.round("beta_width", 6).alias("beta_width"), F.round(F.nanvl("r", F.lit(None).cast("double")), 6).alias("r"))


def leave_one_out(pairs: DataFrame, exposures: DataFrame, observed: DataFrame, sections: list, grid: list[tuple[float, float]]) -> DataFrame:
    """The best grid point without each section in turn."""
    out = None
    for s in sections:
        p = profile(pairs, exposures.where(F.col("section") != s), observed.where(F.col("section") != s), grid)
        best = p.agg(F.min(F.struct("j", "n", "beta", "q")).alias("b")).select(F.lit(s).alias("left_out"), "b.beta", F.round("b.q", 6).alias("q"), F.round("b.j", 6).alias("j"))
        out = best if out is None else out.unionAll(best)
    return out


def golden_section(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-7) -> tuple[float, float]:
    """Least value of a unimodal function on an interval, ends included."""
    g = (math.sqrt(5) - 1) / 2
    ends = [(f(lo), lo), (f(hi), hi)]
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    v, x = min([(fc, c), (fd, d), *ends])
    return x, v


def refine(pairs: DataFrame, exposures: DataFrame, observed: DataFrame, lo: float, hi: float, rounds: int = 4, points: int = 17) -> tuple[float, float, float]:
    """(beta, q, j) by narrowing grids: each round is one Spark job over ``points`` parameters."""
    best = None
    for _ in range(rounds):
        step = (hi - lo) / (points - 1)
        grid = [(0.0, lo + k * step) for k in range(points)]
        r = profile(pairs, exposures, observed, grid).agg(F.min(F.struct("j", "beta", "q")).alias("b")).select("b.*").first()
        best = (r["beta"], r["q"], r["j"]) if best is None or r["j"] < best[2] else best
        lo, hi = max(lo, best[0] - step), min(hi, best[0] + step)
    return best


#: Rows of pairs that are weighed against the whole grid at once.
BLOCK_ROWS = 4_096


def grid_values(low: float, high: float, points: int) -> list[float]:
    """Evenly spaced values, both ends included."""
    return [low + (high - low) * k / (points - 1) for k in range(points)] if points > 1 else [low]


def surface(pairs: DataFrame, exposures: DataFrame, observed: DataFrame, ns: list[float], betas: list[float]) -> DataFrame:
    """(i, k, n, beta, q, j, rel_j) over a whole grid: as ``profile``, without repeating pairs per grid point.

    c^n exp(-beta c) splits into a factor of n and one of beta, so the sums of a block of
    pairs over the grid are one product of two small matrices, weighed by p a (and the
    exposure).  Each task adds up its blocks and gives one row per section and n, with the
    sums over all betas; only those meet in a shuffle.  Pairs must have c > 0.
    """
    n_values, b_values = np.array(ns, dtype=float), np.array(betas, dtype=float)
    width = len(betas)

    def moments(batches):
        sums: dict = {}
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK_ROWS):
                block = pdf.iloc[lo : lo + BLOCK_ROWS]
                c = block["c"].to_numpy(dtype=float)
                by_n, by_beta = np.exp(np.outer(n_values, np.log(c))), np.exp(-np.outer(c, b_values))
                weight = block["w"].to_numpy(dtype=float)
                for s in block["section"].unique():
                    mine = (block["section"] == s).to_numpy()
                    part = (by_n[:, mine] * weight[mine]) @ by_beta[mine]
                    sums[s] = part if s not in sums else sums[s] + part
        rows = [(int(s), i, m[i].tolist()) for s, m in sums.items() for i in range(len(n_values))]
        yield pd.DataFrame(rows, columns=["section", "i", "m"])

    base = pairs.where("o <> d and c > 0")
    weight = F.col("p") * F.col("a")
    # Section numbers from 1; 0 stands for the sum over all pairs.
    names = observed.select("section").distinct().withColumn("_s", F.dense_rank().over(Window.orderBy("section")))
    seen = base.join(exposures, ["o", "d"]).join(F.broadcast(names), "section").select("c", (weight * F.col("share")).alias("w"), F.col("_s").cast("int").alias("section"))
    rows = base.select("c", weight.alias("w"), F.lit(0).alias("section")).unionByName(seen)
    parts = rows.mapInPandas(moments, "section int, i int, m array<double>")
    long = parts.select("section", "i", F.posexplode("m").alias("k", "v")).groupBy("section", "i", "k").agg(F.sum("v").alias("v"))
    down = long.where("section = 0").select("i", "k", F.col("v").alias("down"))
    up = long.where("section > 0").select(F.col("section").alias("_s"), "i", "k", F.col("v").alias("up"))
    spots = down.select("i", "k", "down")
    at = observed.join(names, "section").select(F.col("_s").cast("int").alias("_s"), "y", F.col("base").alias("_base"))
    g = spots.join(F.broadcast(at)).join(up, ["_s", "i", "k"], "left").withColumn("g", F.coalesce(F.col("up") / F.col("down"), F.lit(0.0)))
    r, y2 = F.col("y") - F.col("_base"), F.col("y") * F.col("y")
    sums = g.groupBy("i", "k").agg(
        F.sum(F.col("g") * r).alias("gr"), F.sum(F.col("g") * F.col("g")).alias("gg"), F.sum(r * r).alias("rr"), F.sum(F.col("g") * r / y2).alias("gr2"), F.sum(F.col("g") ** 2 / y2).alias("gg2"), F.sum(r * r / y2).alias("rr2")
    )
    q = F.greatest(F.lit(0.0), F.coalesce(F.try_divide("gr", "gg"), F.lit(0.0)))
    value = lambda xs, i: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col(i) + 1)
    at_q = lambda rr, gr, gg: F.col(rr) - 2 * F.col("q") * F.col(gr) + F.col("q") * F.col("q") * F.col(gg)
    beta = value(betas, "k") if width <= 1000 else F.lit(float(betas[0])) + F.col("k") * F.lit((float(betas[-1]) - float(betas[0])) / (width - 1))
    return sums.withColumn("q", q).select("i", "k", value(ns, "i").alias("n"), beta.alias("beta"), "q", at_q("rr", "gr", "gg").alias("j"), at_q("rr2", "gr2", "gg2").alias("rel_j"))


def seeds(surf: DataFrame, count: int = 5, reach: int = 2) -> list[tuple[float, float, float]]:
    """(n, beta, j) of the best grid points that lie more than ``reach`` steps apart in n or beta, best first.

    Each is one aggregation of the surface without the neighbourhoods of those before.
    """
    out: list[tuple[int, int]] = []
    found = []
    for _ in range(count):
        free = surf
        for i, k in out:
            free = free.where(~((F.abs(F.col("i") - i) <= reach) & (F.abs(F.col("k") - k) <= reach)))
        best = free.agg(F.min(F.struct("j", "i", "k", "n", "beta")).alias("b")).select("b.*").first()
        if best is None or best["j"] is None:
            break
        out.append((best["i"], best["k"]))
        found.append((best["n"], best["beta"], best["j"]))
    return found


def refine_surface(pairs: DataFrame, exposures: DataFrame, observed: DataFrame, start: list[tuple[float, float, float]], n_range: tuple[float, float], beta_range: tuple[float, float], half: tuple[float, float] = (0.4, 0.01), points: int = 25, rounds: int = 4) -> tuple[float, float, float, float]:
    """(n, beta, q, j) of the least loss found by narrowing grids around each start, ends of the ranges included.

    A round looks at ``points`` squared places in one job and shrinks to two steps around the best.
    """
    best = None
    for n0, b0, _ in start:
        hn, hb = half
        for _ in range(rounds):
            ns = grid_values(max(n_range[0], n0 - hn), min(n_range[1], n0 + hn), points)
            bs = grid_values(max(beta_range[0], b0 - hb), min(beta_range[1], b0 + hb), points)
            r = surface(pairs, exposures, observed, ns, bs).agg(F.min(F.struct("j", "n", "beta", "q")).alias("b")).select("b.*").first()
            n0, b0, hn, hb = r["n"], r["beta"], 4 * hn / (points - 1), 4 * hb / (points - 1)
            if best is None or r["j"] < best[3]:
                best = (r["n"], r["beta"], r["q"], r["j"])
    return best


def predictions(pairs: DataFrame, exposures: DataFrame, observed: DataFrame, n: float, beta: float, q: float) -> DataFrame:
    """(section, y, fitted, residual, share_of_sse): each section's modelled count and its part of the squared error."""
    w = F.col("p") * F.col("a") * deterrence(F.col("c"), F.lit(float(beta)), F.lit(float(n)))
    t = pairs.where("o <> d and c > 0").withColumn("w", w)
    whole = F.broadcast(t.agg(F.sum("w").alias("_all")))
    g = t.join(exposures, ["o", "d"]).groupBy("section").agg(F.sum(F.col("share") * F.col("w")).alias("u"))
    fit = observed.join(g, "section", "left").join(whole).withColumn("fitted", F.col("base") + F.lit(float(q)) * F.coalesce(F.col("u") / F.col("_all"), F.lit(0.0)))
    fit = fit.withColumn("residual", F.col("y") - F.col("fitted"))
    sse = F.broadcast(fit.agg(F.sum(F.col("residual") * F.col("residual")).alias("_sse")))
    return fit.join(sse).select("section", "y", "fitted", "residual", F.try_divide(F.col("residual") * F.col("residual"), F.col("_sse")).alias("share_of_sse"))


def compare_models(old: DataFrame, new: DataFrame) -> DataFrame:
    """(section, old_error, new_error, improved) of two ``predictions``; an equal error isn't improved."""
    a = old.select("section", F.abs("residual").alias("old_error"))
    return a.join(new.select("section", F.abs("residual").alias("new_error")), "section").withColumn("improved", F.col("new_error") < F.col("old_error"))


def origin_gaps(pairs: DataFrame, betas: list[float], totals: list[float]) -> DataFrame:
    """(beta, total, gap): the greatest relative gap between an origin's modelled sum and total times p."""
    out = []
    for b in betas:
        per = origin_constrained(pairs, b, 1.0).groupBy("o").agg(F.sum("flow").alias("s"), F.max("p").alias("p"))
        out.append(per.select(F.lit(float(b)).alias("beta"), F.explode(F.array(*[F.lit(float(x)) for x in totals])).alias("total"), "s", "p"))
    t = out[0]
    for more in out[1:]:
        t = t.unionAll(more)
    return t.groupBy("beta", "total").agg(F.max(F.coalesce(F.abs(F.try_divide(F.col("total") * F.col("s") - F.col("total") * F.col("p"), F.col("total") * F.col("p"))), F.lit(0.0))).alias("gap"))


def normal_equations(sens: DataFrame) -> np.ndarray:
    """J'J of the sensitivities of all sections, summed in Spark: two by two, whatever their number."""
    s = sens.agg(F.sum(F.col("d_q") ** 2).alias("a"), F.sum(F.col("d_q") * F.col("d_beta")).alias("b"), F.sum(F.col("d_beta") ** 2).alias("c")).first()
    return np.array([[s["a"] or 0.0, s["b"] or 0.0], [s["b"] or 0.0, s["c"] or 0.0]])


def identifiability_of(normal: np.ndarray) -> dict[str, float]:
    """Rank, condition (raw and with unit columns) and cosine of the two columns behind J'J.

    Both columns are scaled to unit length before the eigenvalues are taken, so a great
    difference of units costs no digits; the raw condition follows from the same numbers.
    """
    a, b, c = normal[0, 0], normal[0, 1], normal[1, 1]
    if a <= 0 or c <= 0:
        return {"rank": int(a > 0) + int(c > 0), "condition": math.inf, "scaled_condition": math.inf, "cosine": math.nan}
    cos = abs(b) / math.sqrt(a * c)
    off = max(0.0, 1 - cos * cos)
    high = (a + c + math.sqrt((a - c) ** 2 + 4 * b * b)) / 2
    low = a * c * off / high
    return {"rank": 2 if off > 1e-14 else 1, "condition": math.sqrt(high / low) if low > 0 else math.inf, "scaled_condition": math.sqrt((1 + cos) / (1 - cos)) if cos < 1 else math.inf, "cosine": cos}


def sensitivities(pairs: DataFrame, exposures: DataFrame, beta: float, q: float) -> DataFrame:
    """Per section the modelled value and its derivatives by q and beta."""
    w = F.col("p") * F.col("a") * deterrence(F.col("c"), F.lit(beta))
    t = pairs.where("o <> d").withColumn("w", w)
    whole = t.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("c")).alias("s1"))
    per = t.join(exposures, ["o", "d"]).groupBy("section").agg(F.sum(F.col("share") * F.col("w")).alias("u0"), F.sum(F.col("share") * F.col("w") * F.col("c")).alias("u1"))
    g = F.col("u0") / F.col("s0")
    return per.join(F.broadcast(whole)).select("section", (q * g).alias("value"), g.alias("d_q"), (q * (g * F.col("s1") / F.col("s0") - F.col("u1") / F.col("s0"))).alias("d_beta"))


def identifiability(jacobian: np.ndarray) -> dict[str, float]:
    """Rank, singular values and condition of a small matrix, raw and with unit columns."""
    s = np.linalg.svd(jacobian, compute_uv=False)
    norms = np.linalg.norm(jacobian, axis=0)
    unit = jacobian / np.where(norms == 0, 1, norms)
    su = np.linalg.svd(unit, compute_uv=False)
    return {"rank": int(np.linalg.matrix_rank(jacobian)), "condition": float(s[0] / s[-1]) if s[-1] else math.inf, "scaled_condition": float(su[0] / su[-1]) if su[-1] else math.inf, "cosine": float(abs(unit[:, 0] @ unit[:, 1]))}


def hessian(f: Callable[[float, float], float], x: float, y: float, hx: float, hy: float) -> np.ndarray:
    """Second derivatives by central differences, scaled to the steps."""
    f0 = f(x, y)
    xx = f(x + hx, y) - 2 * f0 + f(x - hx, y)
    yy = f(x, y + hy) - 2 * f0 + f(x, y - hy)
    xy = (f(x + hx, y + hy) - f(x + hx, y - hy) - f(x - hx, y + hy) + f(x - hx, y - hy)) / 4
    return np.array([[xx, xy], [xy, yy]])


def attribution(contributions: DataFrame, section: str, value: Column) -> DataFrame:
    """Contributions ranked within each section with share and running share."""
    w = Window.partitionBy(section)
    order = w.orderBy(F.desc("v"), "o", "d")
    t = contributions.withColumn("v", value)
    share = F.col("v") / F.sum("v").over(w)
    t = t.withColumns({"rank": F.row_number().over(order), "share": share})
    return t.withColumn("running", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def concentration(attributed: DataFrame, section: str, level: float = 0.5, top: int = 10) -> DataFrame:
    """Herfindahl index, effective number, top share and how many make up ``level``."""
    g = attributed.groupBy(section).agg(
        F.sum(F.col("share") * F.col("share")).alias("hhi"), F.sum(F.when(F.col("rank") <= top, F.col("share"))).alias("top"), F.min(F.when(F.col("running") >= level - 1e-12, F.col("rank"))).alias("number_for_level")
    )
    return g.select(section, F.round("hhi", 6).alias("hhi"), F.round(1 / F.col("hhi"), 4).alias("effective_n"), F.round("top", 6).alias("top_share"), "number_for_level")


def balance(pairs: DataFrame, rounds: int, beta: float) -> DataFrame:
    """Doubly constrained flows after a fixed number of rounds; ``balance_until`` goes on until they fit."""
    t = pairs.where("o <> d").withColumn("f", deterrence(F.col("c"), F.lit(beta)))
    return _balanced(t, rounds, Scratch(pairs.sparkSession, "balance"))


def _balanced(t: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """Columns, then rows scaled to a and p, ``rounds`` times; every fifth round cuts the plan by a table in the shared folder."""
    for k in range(rounds):
        t = scratch.cut(t) if k and k % 5 == 0 else t
        t = t.withColumn("f", F.col("f") * F.col("a") / F.sum("f").over(Window.partitionBy("d")))
        t = t.withColumn("f", F.col("f") * F.col("p") / F.sum("f").over(Window.partitionBy("o")))
    return t


def balance_until(pairs: DataFrame, beta: float, tolerance: float = 1e-9, most_rounds: int = 500) -> tuple[DataFrame, int, float]:
    """(flows, rounds, gap): doubly constrained flows whose column sums are within ``tolerance`` of a, relative to it.

    Rows fit exactly after every round.  p and a are taken as shares with equal sums.  Raises
    RuntimeError if ``most_rounds`` don't do, as for columns that no pair reaches.
    """
    scratch = Scratch(pairs.sparkSession, "balance")
    t = scratch.cut(pairs.where("o <> d").withColumn("f", deterrence(F.col("c"), F.lit(beta))))
    done = 0
    while done < most_rounds:
        nxt = scratch.cut(_balanced(t, 4, scratch))
        scratch.drop(t)
        t, done = nxt, done + 4
        off = t.groupBy("d").agg(F.sum("f").alias("s"), F.max("a").alias("a")).agg(F.max(F.coalesce(F.abs(F.try_divide(F.col("s") - F.col("a"), F.col("a"))), F.abs("s"))).alias("gap")).first()["gap"]
        if off is None or off <= tolerance:
            return t, done, off or 0.0
    raise RuntimeError(f"columns are still off by {off} after {done} rounds")
