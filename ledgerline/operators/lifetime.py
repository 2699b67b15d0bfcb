"""Purchase and spend models of non-contractual customers, fitted over all of them on Spark.

BG/NBD (Fader, Hardie and Lee 2005) is used by what a customer's odds of having left are: with x repeat purchases, the last
at t_x, seen for T, they are a / (b + x - 1) * ((alpha + T) / (alpha + t_x))^(r + x), or 0 without a repeat. All other terms of
the likelihood depend on x alone, and as x is whole they are sums of logarithms over the purchases 0 .. x - 1, for which the
number of customers with more purchases than j is enough. Tasks therefore sum one term a customer; the rest comes from a
table with a row for each x.

Gamma-Gamma (Fader and Hardie 2013) is used by its total: the spend n * m of a customer over gamma has a beta-prime
distribution with shapes p * n and q. Its normalising constant depends on n alone and comes from a table as well.

Both have a ridge on the logarithms of their parameters. The search starts from moments of the data, within a thousandfold of
them, and takes damped Newton steps; a step asks Spark for the sums at a batch of points. Both models of many groups of
customers, such as those known at each of many days, are searched side by side: one job evaluates what all of them ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import asdict, dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.semantics import small_table
from ledgerline.functions.special import descent, lgamma
from ledgerline.operators.scoring import spearman
from ledgerline.storage import dropped, settled

RIDGE = 1e-3
DEPENDENT = 0.3  # trips and values that are more correlated than this speak against the spend model
NODES = 48


@dataclass(frozen=True)
class Fit:
    """Parameters of a model, or why there are none."""

    model: str
    status: str
    reason: str = ""
    converged: bool = False
    params: tuple[tuple[str, float], ...] = ()
    value: float = float("nan")
    rows: int = 0
    independence_warning: bool = False

    def __getitem__(self, name: str) -> float:
        return dict(self.params)[name]

    def row(self, spark: SparkSession) -> DataFrame:
        d = asdict(self) | {"params": dict(self.params)}
        return spark.createDataFrame([tuple(d.values())], "model string, status string, reason string, converged boolean, params map<string,double>, value double, rows long, independence_warning boolean")


Search = Generator[np.ndarray, np.ndarray, tuple[np.ndarray, float, bool]]


def _summed(rows: DataFrame, asked: dict[int, tuple[Callable[..., np.ndarray], int, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each search (term, number of its columns, points): the sum of the term over the search's rows at every point."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {s: np.zeros(len(points)) for s, (_, _, points) in asked.items()}
        for batch in batches:
            for s, part in batch.groupby("s", sort=False):
                if s in asked:
                    term, width, points = asked[s]
                    columns = [part[c].to_numpy(float) for c in "abc"[:width]]
                    sums[s] += [term(p, *columns).sum() for p in points]
        yield pd.DataFrame([(s, i, x) for s, v in sums.items() for i, x in enumerate(v)], columns=["s", "i", "v"])

    out = {s: np.zeros(len(points)) for s, (_, _, points) in asked.items()}
    for r in rows.mapInPandas(partial, "s int, i int, v double").groupBy("s", "i").agg(F.sum("v").alias("v")).collect():  # a row for each vector
        out[r["s"]][r["i"]] = r["v"]
    return out


def _search(starts: np.ndarray, least: np.ndarray) -> Search:
    """Asks for points and is sent what to minimise; gives parameters, the least value, and whether the search settled."""
    logs = np.log(np.maximum(starts, least * 1.01))
    v = yield logs
    low, high = np.maximum(logs.min(axis=0) - np.log(1e3), np.log(least)), logs.max(axis=0) + np.log(1e3)
    at, value, settled_ = yield from descent(logs[int(np.argmin(v))], low, high)
    return np.exp(at), value, settled_


@dataclass(frozen=True)
class _Problem:
    """One model of one group: where to begin, its term of a customer, and what numbers of purchases alone contribute."""

    term: Callable[..., np.ndarray]
    width: int
    starts: np.ndarray
    least: np.ndarray
    of_counts: Callable[[np.ndarray], float]
    n: int


def _searched(rows: DataFrame, problems: dict[int, _Problem], ridge: float) -> dict[int, tuple[np.ndarray, float, bool]]:
    """All searches side by side: each round is one job over all rows (s, a, b, c)."""
    searches = {s: _search(p.starts, p.least) for s, p in problems.items()}
    asked, done = {s: next(g) for s, g in searches.items()}, {}
    while asked:
        sums = _summed(rows, {s: (problems[s].term, problems[s].width, np.exp(logs)) for s, logs in asked.items()})
        now, asked = asked, {}
        for s, logs in now.items():
            p = problems[s]
            loss = ridge * p.n * (logs**2).sum(axis=1) - sums[s] - np.array([p.of_counts(x) for x in np.exp(logs)])
            try:
                asked[s] = searches[s].send(np.where(np.isfinite(loss), loss, 1e300))
            except StopIteration as end:
                done[s] = end.value
    return done


def _around(start: list[float], factor: float = 3.0) -> np.ndarray:
    """A start and what lies a factor to both sides of it, one parameter at a time."""
    base = np.array(start, float)
    return np.array([base, *[base * np.where(np.arange(len(base)) == i, f, 1.0) for i in range(len(base)) for f in (factor, 1 / factor)]])


# -- purchases


def log_odds_of_leaving(params: np.ndarray, x: np.ndarray, t_x: np.ndarray, T: np.ndarray) -> np.ndarray:
    """Logarithm of the odds that a customer has left; minus infinity without repeat purchases."""
    r, alpha, a, b = params
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(a) - np.log(b + (x - 1)) + (r + x) * np.log((alpha + T) / (alpha + t_x))
    return np.where(x > 0, odds, -np.inf)


def _history_term(params: np.ndarray, x: np.ndarray, t_x: np.ndarray, T: np.ndarray) -> np.ndarray:
    """The part of a customer's log-likelihood in which times appear."""
    r, alpha = params[:2]
    return np.logaddexp(0.0, log_odds_of_leaving(params, x, t_x, T)) - (r + x) * np.log(alpha + T)


def _purchases_term(params: np.ndarray, more: np.ndarray, n: int) -> float:
    """The part in which only numbers of purchases appear; ``more[j]`` customers have more than j."""
    r, alpha, a, b = params
    j = np.arange(len(more))
    return float((more * (np.log(r + j) + np.log(b + j) - np.log(a + b + j))).sum() + n * r * np.log(alpha))


def bgnbd_loglik(params: np.ndarray, x: np.ndarray, t_x: np.ndarray, T: np.ndarray) -> float:
    """Log-likelihood of histories in memory; fitting takes the same terms from Spark."""
    more = (x[None, :] > np.arange(int(x.max(initial=0)))[:, None]).sum(axis=1)
    return float(_history_term(params, x, t_x, T).sum()) + _purchases_term(params, more, len(x))


def _bgnbd_problem(n: int, mean: float, own: float, gone: float, bought: float, by_x: dict[int, int]) -> _Problem:
    more = np.zeros(max(by_x) if by_x else 0)
    for x, count in by_x.items():
        more[:x] += count
    mean = max(mean or 0.0, 1e-6)
    own = max(own, 0.01 * mean * mean)
    leaving = min(max((gone or 0) / max(bought or 0.0, 1.0), 0.01), 0.9)
    starts = _around([mean * mean / own, mean / own, 2 * leaving, 2 * (1 - leaving)])
    return _Problem(_history_term, 3, starts, np.full(4, 1e-3), lambda p: _purchases_term(p, more, n), n)


def _gamma_problem(n: int, mean: float, spread: float, by_n: dict[float, int]) -> _Problem:
    kinds, counts = (np.array(c, float) for c in zip(*sorted(by_n.items()), strict=True))
    q = 2 + mean * mean / max(spread or 0.0, 1e-6 * mean * mean)
    starts = _around([1.0, min(q, 50.0), mean * (min(q, 50.0) - 1)])
    return _Problem(_spend_term, 2, starts, np.array([1e-3, 1.01, 1e-3]), lambda p: _events_term(p, kinds, counts), n)


def fit_groups(customers: DataFrame, by: str, models: tuple[str, ...] = ("bgnbd", "gamma_gamma"), penalizer: float = RIDGE, least: dict[str, int] | None = None) -> dict[object, dict[str, Fit]]:
    """The models of each group of customers with x, t_x, T, n_trips and mean_trip_value; a group is told by ``by``.

    Three jobs prepare all searches, and each of their rounds is one. The spend model takes customers with two events or more.
    """
    least = {"bgnbd": 50, "gamma_gamma": 30} | (least or {})
    whole = lambda c: F.col(c).cast("double")
    parts = {
        "bgnbd": lambda: customers.filter("x IS NOT NULL AND t_x IS NOT NULL AND T >= 0").select(F.col(by).alias("g"), F.lit("bgnbd").alias("m"), whole("x").alias("a"), whole("t_x").alias("b"), whole("T").alias("c")),
        "gamma_gamma": lambda: customers.filter("n_trips >= 2 AND mean_trip_value > 0").select(F.col(by).alias("g"), F.lit("gamma_gamma").alias("m"), whole("n_trips").alias("a"), whole("mean_trip_value").alias("b"), F.lit(0.0).alias("c")),
    }
    rows = settled(reduce(DataFrame.unionByName, [parts[m]() for m in models]))
    rate = F.when(F.col("c") > 0, F.col("a") / F.col("c"))
    silent = F.count_if((F.col("c") > 0) & (F.col("a") > 0) & ((F.col("c") - F.col("b")) * F.col("a") > 3 * F.col("b")))
    stats = rows.groupBy("g", "m").agg(
        F.count(F.lit(1)).alias("n"), F.avg(rate).alias("rate"), F.var_samp(rate).alias("spread"), F.avg(rate / F.col("c")).alias("noise"), silent.alias("gone"), F.sum("a").alias("bought"), F.avg("b").alias("mean"), F.var_samp("b").alias("var")
    ).collect()  # a row for each group and model
    by_a: dict[tuple, dict[float, int]] = {}
    for r in rows.groupBy("g", "m", "a").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each number of purchases
        by_a.setdefault((r["g"], r["m"]), {})[r["a"]] = r["n"]
    found: dict[object, dict[str, Fit]] = {}
    problems, numbers = {}, []
    for r in sorted(stats, key=lambda r: (str(r["g"]), r["m"])):
        if r["n"] < least[r["m"]]:
            what = "customers" if r["m"] == "bgnbd" else "repeat customers"
            found.setdefault(r["g"], {})[r["m"]] = Fit(r["m"], "skipped", f"{r['n']} {what} are fewer than {least[r['m']]}", rows=r["n"])
            continue
        counts = by_a[r["g"], r["m"]]
        if r["m"] == "bgnbd":  # the spread of the rates themselves, without that of counting
            problem = _bgnbd_problem(r["n"], r["rate"], (r["spread"] or 0.0) - (r["noise"] or 0.0), r["gone"], r["bought"], {int(x): n for x, n in counts.items()})
        else:
            problem = _gamma_problem(r["n"], r["mean"], r["var"], counts)
        problems[len(numbers)] = problem
        numbers.append((r["g"], r["m"]))
    if problems:
        of = small_table(rows, ["g", "m"], "s int", [(g, m, i) for i, (g, m) in enumerate(numbers)])  # a row for each search
        numbered = settled(rows.join(of, ["g", "m"]).select("s", "a", "b", "c"))
        for s, (params, value, done) in _searched(numbered, problems, penalizer).items():
            g, m = numbers[s]
            names = ("r", "alpha", "a", "b") if m == "bgnbd" else ("p", "q", "gamma")
            found.setdefault(g, {})[m] = Fit(m, "fitted", "", done, tuple(zip(names, map(float, params), strict=True)), float(value), problems[s].n)
        dropped(numbered)
    dropped(rows)
    return found


def fit_bgnbd(customers: DataFrame, penalizer: float = RIDGE, least: int = 50) -> Fit:
    """The purchase model of customers with x, t_x and T."""
    found = fit_groups(customers.withColumn("__one", F.lit(0)), "__one", ("bgnbd",), penalizer, {"bgnbd": least})
    return found[0]["bgnbd"] if found else Fit("bgnbd", "skipped", f"0 customers are fewer than {least}")


@lru_cache(maxsize=4096)
def _beta_nodes(a: float, b: float, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of Gauss' quadrature under a beta distribution, from the recurrence of Jacobi's polynomials."""
    al, be, k = b - 1, a - 1, np.arange(nodes, dtype=float)
    s = 2 * k + al + be
    with np.errstate(all="ignore"):
        middle = np.where(s * (s + 2) == 0, 0.0, (be * be - al * al) / (s * (s + 2)))
        middle[0] = (be - al) / (al + be + 2)
        k, s = k[1:], s[1:]
        side = 4 * k * (k + al) * (k + be) * (k + al + be) / (s * s * (s + 1) * (s - 1))
        side[0] = 4 * (1 + al) * (1 + be) / ((2 + al + be) ** 2 * (3 + al + be))
    places, vectors = np.linalg.eigh(np.diag(middle) + np.diag(np.sqrt(side), 1) + np.diag(np.sqrt(side), -1))
    return (places + 1) / 2, vectors[0] ** 2


def bgnbd_predict(fit: Fit, x: np.ndarray, t_x: np.ndarray, T: np.ndarray, horizon: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability of being active, and expected purchases within the horizon; NaN where a + b + x is 1 or less.

    An active customer leaves after a purchase with probability p, which is Beta(a, b + x) by now, and purchases at a rate that
    is Gamma(r + x, alpha + T): the purchases expected given p are (1 - (1 + p h / (alpha + T))^-(r + x)) / p, and their mean
    over p is taken by quadrature, once for each x.
    """
    r, alpha, a, b = (fit[k] for k in ("r", "alpha", "a", "b"))
    alive = 1 / (1 + np.exp(log_odds_of_leaving(np.array([r, alpha, a, b]), x, t_x, T)))
    expected = np.full(len(x), np.nan)
    for kind in np.unique(x[a + b + x > 1]):
        at = x == kind
        p, weight = _beta_nodes(a, b + float(kind))
        p = np.maximum(p, 1e-300)
        given = -np.expm1(-(r + kind) * np.log1p(p[None, :] * horizon / (alpha + T[at])[:, None])) / p[None, :]
        expected[at] = given @ weight
    return alive, expected * alive


# -- spend


def _spend_term(params: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    p, q, gamma = params
    u = n * m / gamma
    return (p * n - 1) * np.log(u) - (p * n + q) * np.log1p(u)


def _events_term(params: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> float:
    """Customers by their number of events: the density of the mean from that of the total, with its constant."""
    p, q, gamma = params
    log_beta = lgamma(p * kinds) + lgamma(q) - lgamma(p * kinds + q)
    return float((counts * (np.log(kinds) - np.log(gamma) - log_beta)).sum())


def gamma_gamma_loglik(params: np.ndarray, n: np.ndarray, m: np.ndarray) -> float:
    """Log-likelihood of mean values m over n events, in memory."""
    kinds, counts = np.unique(n, return_counts=True)
    return float(_spend_term(params, n, m).sum()) + _events_term(params, kinds, counts)


def with_independence(fit: Fit, customers: DataFrame) -> Fit:
    """A fitted spend model with the rank correlation of trips and values, and whether it speaks against the model."""
    if fit.status != "fitted":
        return fit
    rho = spearman(customers.filter("n_trips >= 2 AND mean_trip_value > 0"), "n_trips", "mean_trip_value").first()[0]
    params = (*fit.params, ("spearman_trips_vs_mean_value", float("nan") if rho is None else float(rho)))
    return replace(fit, params=params, independence_warning=rho is not None and abs(rho) > DEPENDENT)


def fit_gamma_gamma(customers: DataFrame, penalizer: float = RIDGE, least: int = 30) -> Fit:
    """The spend model of customers with two events or more, and whether their trips and values are independent enough."""
    found = fit_groups(customers.withColumn("__one", F.lit(0)), "__one", ("gamma_gamma",), penalizer, {"gamma_gamma": least})
    fit = found[0]["gamma_gamma"] if found else Fit("gamma_gamma", "skipped", f"0 repeat customers are fewer than {least}")
    return with_independence(fit, customers)


def gamma_gamma_mean(p: Column, q: Column, gamma: Column, n: Column, mean: Column) -> Column:
    """Expected value of an event: the observed mean and that of all customers, the former counting more with each event."""
    own = p * n / (p * n + (q - 1))
    return own * mean + (1 - own) * p * gamma / (q - 1)


def gamma_gamma_predict(fit: Fit, n: Column, mean: Column) -> Column:
    """The same for a fit; the observed mean where there is no model."""
    return gamma_gamma_mean(*[F.lit(fit[k]) for k in ("p", "q", "gamma")], n, mean) if fit.status == "fitted" else mean
