"""Lagged dependence graphs: partial correlation tests and the PCMCI+ procedure for lags of one and more.

Written from the published algorithm: a condition-selection phase removes lagged
parents that some subset of the strongest others explains away, then momentary
conditional independence is tested given the parents of both sides. One group of
series is one call; groups are the unit of parallelism.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 3e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return 1.0 if df <= 0 or math.isnan(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def partial_correlation(x: np.ndarray, y: np.ndarray, z: np.ndarray | None) -> tuple[float, float]:
    """Correlation of the residuals of x and y on z (with mean), and its two-sided p."""
    n, k = len(x), 0 if z is None else z.shape[1]
    x, y = x - x.mean(), y - y.mean()
    if k:
        z = z - z.mean(axis=0)
        x, y = (v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (x, y))
    scale = math.sqrt(float(x @ x) * float(y @ y))
    if scale < 1e-12 or n - 2 - k < 1:
        return 0.0, 1.0
    r = max(-1.0, min(1.0, float(x @ y) / scale))
    df = n - 2 - k
    return r, 0.0 if abs(r) == 1 else t_two_sided(r * math.sqrt(df / (1 - r * r)), df)


class Lagged:
    """Rows of a multivariate series that have all lags in their own segment."""

    def __init__(self, data: np.ndarray, segment: np.ndarray | None, reach: int, strict: bool = True):
        self.data = data
        rows = np.arange(reach, len(data))
        if segment is not None and strict:  # a lag never crosses a segment's start
            rows = rows[segment[rows] == segment[rows - reach]]
        self.rows = rows

    def column(self, var: int, lag: int) -> np.ndarray:
        return self.data[self.rows - lag, var]

    def test(self, x: tuple[int, int], y: int, given: list[tuple[int, int]]) -> tuple[float, float]:
        z = np.stack([self.column(*g) for g in given], axis=1) if given else None
        return partial_correlation(self.column(*x), self.column(y, 0), z)


def pcmci(data: np.ndarray, tau_max: int = 3, alpha: float = 0.01, max_conds: int = 3, segment: np.ndarray | None = None, strict: bool = True) -> list[tuple[int, int, int, float, float]]:
    """(cause, effect, tau, value, p) of the lagged links that stand, self links included."""
    n = data.shape[1]
    lagged = Lagged(data, segment, 2 * tau_max, strict)
    if len(lagged.rows) < 5:
        return []
    parents: dict[int, list[tuple[int, int]]] = {}
    for y in range(n):
        strength = {(x, lag): math.inf for x in range(n) for lag in range(1, tau_max + 1)}
        if data[:, y].std() == 0:
            parents[y] = []
            continue
        left = [c for c in strength if data[:, c[0]].std() > 0]
        for size in range(max_conds + 1):
            gone = []
            for c in left:
                others = [o for o in left if o != c][:size]
                if len(others) < size:
                    break
                value, p = lagged.test(c, y, others)
                strength[c] = min(strength[c], abs(value))
                if p > alpha:
                    gone.append(c)
            left = sorted((c for c in left if c not in gone), key=lambda c: (-strength[c], c))
            if len(left) <= size:
                break
        parents[y] = left
    links = []
    for y in range(n):
        for c in parents[y]:
            shifted = [(v, lag + c[1]) for v, lag in parents[c[0]][:max_conds] if lag + c[1] <= 2 * tau_max]
            given = list(dict.fromkeys([g for g in parents[y] if g != c] + [g for g in shifted if g != c]))
            # the published test conditions on all; subsets of the effect's parents guard against conditioning on noise
            tested = [lagged.test(c, y, given)] + [lagged.test(c, y, list(s)) for m in range(min(2, max_conds) + 1) for s in combinations([g for g in parents[y] if g != c][:max_conds], m)]
            value, p = max(tested, key=lambda t: t[1])
            if p < alpha:
                links.append((c[0], y, c[1], value, p))
    return sorted(links, key=lambda k: (k[4], k[0], k[1], k[2]))


def group_links(cells: DataFrame, variables: list[str], tau_max: int = 3, alpha: float = 0.01, max_conds: int = 3, orientation: str = "standard", strict: bool = True) -> DataFrame:
    """Links of each group of series; cells: (group, node, segment, t, var, value), absent cells 0.

    orientation "transposed" swaps cause and effect, for graphs read the other way.
    """
    if orientation not in ("standard", "transposed"):
        raise ValueError(orientation)
    index = {v: i for i, v in enumerate(variables)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[["node", "segment", "t"]].drop_duplicates().sort_values(["node", "segment", "t"])
        at = {k: i for i, k in enumerate(keys.itertuples(index=False, name=None))}
        data = np.zeros((len(at), len(variables)))
        known = pdf[pdf["var"].isin(index)]
        rows = [at[k] for k in known[["node", "segment", "t"]].itertuples(index=False, name=None)]
        data[rows, known["var"].map(index).to_numpy(np.int64)] = known["value"].to_numpy(float)
        parts = pd.factorize(pd.MultiIndex.from_frame(keys[["node", "segment"]]))[0]
        found = pcmci(data, tau_max, alpha, max_conds, parts, strict)
        swap = orientation == "transposed"
        out = [(variables[y if swap else x], variables[x if swap else y], tau, v, p, "-->", pdf["group"].iloc[0], len(data)) for x, y, tau, v, p in found]
        return pd.DataFrame(out, columns=["cause", "effect", "tau", "val", "p_val", "edge", "group_id", "T_data_rows"])

    return cells.groupBy("group").applyInPandas(run, "cause string, effect string, tau int, val double, p_val double, edge string, group_id string, T_data_rows bigint")


def real_edges(links: DataFrame) -> DataFrame:
    """Links with an edge mark that is neither empty nor a conflict."""
    return links.where((F.col("edge") != "") & (F.col("edge") != "x-x"))


def lagged_correlation(x: str, y: str) -> Column:
    """The unconditional test value over aligned columns; null where one of them never changes."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
