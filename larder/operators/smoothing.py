"""Additive Holt-Winters with estimated parameters.

Per series the smoothing parameters and the initial states (level, trend and
the seven seasonal terms, which sum to zero) are those of least one-step
squared error.  With given smoothing parameters the errors are linear in the
initial states, so one pass of the recursion, over the series and over unit
states at once, gives a small least-squares problem with an exact answer; only
the three smoothing parameters are searched, by a Nelder-Mead simplex that
moves for many series together (each array operation steps all of them).

The recursion in error form, with season m::

    e = y - (level + trend + season[t - m])
    level += trend + alpha * e;  trend += alpha * beta * e;  season += gamma * e

with alpha and beta in (0, 1) and gamma in (0, 1 - alpha).

A series is an array of at most one number a calendar day, so a task holds
``SERIES`` of them at a time.  Series too short for a seasonal start (under
``MIN_SEASONAL`` points) or without a finite fit are tried without season,
then take the mean of their last week; under ``MIN_POINTS`` points or without
demand they take their mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C

SEASON = 7
MIN_POINTS = 14
MIN_SEASONAL = 16                # ten, and half a season lost at both ends
SERIES = 128
ITERATIONS = 120
TOLERANCE = 1e-7
EDGE = 1e-4
# Starts of the search: alpha, beta, gamma / (1 - alpha).
STARTS = [(a, b, g) for a in (0.05, 0.2, 0.5, 0.8) for b in (0.01, 0.1) for g in (0.05, 0.3)]


def _response(y: np.ndarray, par: np.ndarray, seasonal: bool):
    """One-step errors (time, series, 1 + states) and final states of the recursion.

    Column 0 follows the data from zero states; the others follow zero data
    from a unit state each.  The last seasonal term is minus the sum of the
    others.
    """
    n, s = y.shape
    k = 2 + (SEASON - 1) * seasonal
    alpha, beta, gamma = (par[:, i, None] for i in range(3))
    level, trend = np.zeros((s, 1 + k)), np.zeros((s, 1 + k))
    level[:, 1] = trend[:, 2] = 1
    season = np.zeros((SEASON, s, 1 + k))
    if seasonal:
        for j in range(SEASON - 1):
            season[j, :, 3 + j] = 1
            season[SEASON - 1, :, 3 + j] = -1
    errors = np.empty((n, s, 1 + k))
    slope = alpha * beta
    for t in range(n):
        own = season[t % SEASON]
        e = errors[t]
        np.add(level, trend, out=level)
        np.add(level, own, out=e)
        np.negative(e, out=e)
        e[:, 0] += y[t]
        level += alpha * e
        trend += slope * e
        if seasonal:
            own += gamma * e
    return errors, level, trend, season


def _solve(errors: np.ndarray):
    """Each series' best initial states and their sum of squared errors (infinite if none)."""
    by_series = errors.transpose(1, 2, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        gram = by_series @ by_series.transpose(0, 2, 1)
    fine = np.isfinite(gram).all((1, 2))
    gram = np.where(fine[:, None, None], gram, 0)
    inner, cross = gram[:, 1:, 1:], gram[:, 1:, 0]
    size = np.maximum(np.trace(inner, axis1=1, axis2=2), 1e-300)[:, None, None]
    states = -np.linalg.solve(inner + 1e-11 * size * np.eye(inner.shape[1]),
                              cross[..., None])[..., 0]
    # from the errors themselves: the Gram matrix would lose digits
    found = errors[..., 0] + np.einsum("tsk,sk->ts", errors[..., 1:], states)
    with np.errstate(over="ignore", invalid="ignore"):
        sse = (found * found).sum(0)
    return states, np.where(fine & np.isfinite(sse), sse, np.inf)


def _parameters(u: np.ndarray) -> np.ndarray:
    """From the whole line to alpha, beta and gamma in their bounds."""
    p = EDGE + (1 - 2 * EDGE) / (1 + np.exp(-np.clip(u, -30, 30)))
    return np.stack([p[..., 0], p[..., 1], p[..., 2] * (1 - p[..., 0])], axis=-1)


def _sse(y, u, seasonal):
    with np.errstate(over="ignore", invalid="ignore"):
        errors = _response(y, _parameters(u), seasonal)[0]
    return _solve(errors)[1]


def _simplex(y: np.ndarray, u: np.ndarray, sse: np.ndarray, seasonal: bool, iterations: int):
    """Nelder-Mead for all series at once; a series rests when its simplex is flat."""
    s, d = u.shape
    corners = np.repeat(u[:, None, :], d + 1, axis=1)
    corners[:, 1:] += 0.8 * np.eye(d)
    value = np.empty((s, d + 1))
    value[:, 0] = sse
    for j in range(1, d + 1):
        value[:, j] = _sse(y, corners[:, j], seasonal)
    every = np.arange(s)
    for _ in range(iterations):
        order = value.argsort(axis=1, kind="stable")
        corners = corners[every[:, None], order]
        value = value[every[:, None], order]
        spread = value[:, -1] - value[:, 0]
        live = every[~(spread <= TOLERANCE * np.abs(value[:, 0]) + 1e-12)]
        if not len(live):
            break
        c, v = corners[live], value[live]
        middle, worst = c[:, :-1].mean(1), c[:, -1]
        turned = 2 * middle - worst
        f_turned = _sse(y[:, live], turned, seasonal)
        grows, inner = f_turned < v[:, 0], f_turned >= v[:, -1]
        keep = ~grows & (f_turned < v[:, -2])
        step = np.where(grows, 2.0, np.where(inner, -0.5, 0.5))[:, None]
        second = middle + step * (middle - worst)
        f_second = np.full(len(live), np.inf)
        ask = ~keep
        if ask.any():
            f_second[ask] = _sse(y[:, live[ask]], second[ask], seasonal)
        better = f_second < np.minimum(f_turned, np.where(inner, v[:, -1], np.inf))
        taken = np.where(better[:, None], second, turned)
        f_taken = np.where(better, f_second, f_turned)
        accept = better | keep | grows
        corners[live[accept], -1], value[live[accept], -1] = taken[accept], f_taken[accept]
        shrink = live[~accept]
        if len(shrink):
            corners[shrink, 1:] = (corners[shrink, 1:] + corners[shrink, :1]) / 2
            for j in range(1, d + 1):
                value[shrink, j] = _sse(y[:, shrink], corners[shrink, j], seasonal)
    best = value.argmin(1)
    return corners[every, best], value[every, best]


def estimate(y: np.ndarray, seasonal: bool = True, iterations: int = ITERATIONS):
    """(parameters, one-step sum of squared errors) of each row of ``y`` (series, time)."""
    y = np.ascontiguousarray(np.asarray(y, float).T)
    starts = np.array(STARTS)
    grid = np.log(starts / (1 - starts))
    tried = np.array([_sse(y, np.repeat(g[None], y.shape[1], 0), seasonal) for g in grid])
    best = tried.argmin(0)
    u, sse = _simplex(y, grid[best], tried[best, np.arange(y.shape[1])], seasonal, iterations)
    return _parameters(u), sse


def _extrapolated(y, par, days, seasonal):
    errors, level, trend, season = _response(np.ascontiguousarray(y.T), par, seasonal)
    states, sse = _solve(errors)
    with_one = np.concatenate([np.ones((len(states), 1)), states], axis=1)
    level, trend = (level * with_one).sum(1), (trend * with_one).sum(1)
    season = (season * with_one).sum(2)
    ahead = np.arange(1, days + 1)
    out = level[:, None] + ahead * trend[:, None]
    if seasonal:
        out = out + season[(y.shape[1] + ahead - 1) % SEASON].T
    return np.where(np.isfinite(sse)[:, None], out, np.nan)


def forecast(y: np.ndarray, days: int) -> np.ndarray:
    """``days`` steps ahead for each row of ``y`` (series of one length), floored at zero."""
    y = np.asarray(y, float)
    s, n = y.shape
    out = np.full((s, days), np.nan)
    fitted = np.flatnonzero(y.sum(1) != 0) if n >= MIN_POINTS else np.empty(0, int)
    for seasonal in (True, False):
        left = fitted[np.isnan(out[fitted, 0])] if n >= MIN_SEASONAL or not seasonal else []
        for lo in range(0, len(left), SERIES):
            own = left[lo:lo + SERIES]
            out[own] = _extrapolated(y[own], estimate(y[own], seasonal)[0], days, seasonal)
    rest = np.isnan(out).any(1)
    last = y[:, -SEASON:] if n >= MIN_POINTS else y
    if n:
        mean = np.where(y.sum(1) != 0, last.mean(1), 0.0)
        out[rest] = mean[rest, None]
    return np.maximum(0.0, np.nan_to_num(out))


def holt_winters(dense: DataFrame, last, days: int = C.HORIZON_DAYS,
                 only: DataFrame | None = None) -> DataFrame:
    """``store, product, day_idx, pred_exp, date`` for every series, or those of ``only``."""
    keys = ["store", "product"]
    rows = dense.select(*keys, "date", "qty")
    if only is not None:
        rows = rows.join(only.select(*keys), keys, "left_semi")
    series = rows.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("date", "qty"))),
        lambda x: x["qty"].cast("double")).alias("y"))

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            y = columns["y"]
            values = y.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(y.value_lengths().to_numpy())])
            sizes, out = np.diff(ends), np.empty((batch.num_rows, days))
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                out[own] = forecast(np.array([values[ends[i]:ends[i + 1]] for i in own]
                                             ).reshape(len(own), n), days)
            again = pa.array(np.repeat(np.arange(batch.num_rows), days))
            yield pa.RecordBatch.from_arrays(
                [columns["store"].take(again), columns["product"].take(again),
                 pa.array(np.tile(np.arange(days, dtype=np.int32), batch.num_rows)),
                 pa.array(out.ravel())], names=[*keys, "day_idx", "pred_exp"])

    kinds = dict(dense.dtypes)
    out = series.mapInArrow(run, f"store {kinds['store']}, product {kinds['product']}, "
                                 "day_idx int, pred_exp double")
    return out.withColumn("date", F.date_add(last, F.col("day_idx") + 1))
