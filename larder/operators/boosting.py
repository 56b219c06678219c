"""Gradient boosting on binned features, grown a level at a time on Spark.

Rows are packed once into blocks of binned features (a byte a feature, at
most 64 bins from mergeable quantile sketches).  A level of a tree is one
pass over the blocks: every task sums gradient, weight and count by (node,
feature, bin) over its rows, and only these sums are added up in a tree of
tasks, so a pass moves a fixed number of sums a task, however many rows it has
read, and the driver receives nodes x features x bins sums.  Another pass a tree gives the leaves
their values.

* Huber loss: the turning point is the ``alpha`` quantile of the absolute
  residuals, a leaf's value its median residual plus the mean of the clipped
  rest.  Both come from a mergeable sketch of the residuals by leaf: weights
  and sums in bins whose bounds grow by ``SKETCH_BASE``.  The sketch also
  gives the next tree's turning point (a leaf's residuals all move by its
  value), so no pass is needed for it.
* Log loss: a leaf's value is one Newton step.

Row sampling goes by a hash of the row's key and the tree's number, so a fit
does not depend on how rows are dealt to tasks.  The executors keep the
blocks with their predictions so far and add a tree when it is grown; every
``REFRESH`` trees they are stored, which bounds what a lost executor's blocks
take to make again.  The model is a few arrays (trees x nodes), whatever the
input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize

MAX_BINS = 64
QUANTILE_ACCURACY = 10_000
BLOCK_ROWS = 65_536
REFRESH = 10
SKETCH_BASE, SKETCH_LEAST, SKETCH_BINS = 1.02, 1e-9, 2_200
NO_SPLIT = 255
DIGITS = 10                      # of leaf values and turning points, beyond the sums' noise


@dataclass(frozen=True)
class Params:
    """How to grow; ``alpha`` is the Huber quantile, ``sample`` the rows' share a tree."""
    trees: int = 100
    depth: int = 4
    rate: float = 0.1
    sample: float = 0.8
    min_leaf: int = 3
    loss: str = "huber"
    alpha: float = 0.9
    seed: int = 42


@dataclass
class Ensemble:
    """Complete binary trees: node k's children are 2k + 1 and 2k + 2, right if above its cut."""
    features: tuple[str, ...]
    bounds: list[np.ndarray]              # each feature's bin bounds; bin = bounds below the value
    start: float
    depth: int
    loss: str
    feature: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.uint8))
    value: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    gain: np.ndarray = field(default_factory=lambda: np.empty(0))

    def binned(self, columns) -> np.ndarray:
        """A byte a feature from columns of numbers (missing ones count as zero)."""
        return np.column_stack([
            np.searchsorted(b, np.nan_to_num(np.asarray(c, float)), "left").astype(np.uint8)
            for b, c in zip(self.bounds, columns)])

    def predict(self, columns) -> np.ndarray:
        """Huber: the quantity.  Log: the probability."""
        raw = self.start + evaluate(self.binned(columns), self.feature, self.cut, self.value,
                                    self.depth)
        return raw if self.loss == "huber" else _probability(raw)

    def importance(self) -> np.ndarray:
        """Each feature's share of the squared error that all splits took away."""
        total = self.gain.sum()
        return self.gain / total if total > 0 else self.gain


def _probability(raw):
    return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def _leaves(x, feature, cut, depth, upto=None):
    """Each row's node after ``upto`` levels (all of them), numbered within its level."""
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(depth if upto is None else upto):
        node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    return node - (2 ** (depth if upto is None else upto) - 1)


def evaluate(x, feature, cut, value, depth) -> np.ndarray:
    out = np.zeros(len(x))
    for f, c, v in zip(feature, cut, value):
        out += v[_leaves(x, f, c, depth)]
    return out


# --------------------------------------------------------------------------
# a mergeable sketch of residuals
# --------------------------------------------------------------------------

def sketch_bin(d: np.ndarray) -> np.ndarray:
    """Bins of about one percent of the value, in the values' order; 0 is the least."""
    size = np.abs(d)
    step = np.floor(np.log(np.maximum(size, SKETCH_LEAST) / SKETCH_LEAST) / np.log(SKETCH_BASE))
    step = np.where(size < SKETCH_LEAST, 0, np.minimum(step + 1, SKETCH_BINS - 1))
    return (SKETCH_BINS + np.sign(d) * step).astype(np.int64)


def quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The least value with at least ``share`` of the weight at or below it."""
    if not len(values) or weights.sum() <= 0:
        return 0.0
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(reached, share * reached[-1] * (1 - 1e-12))])


def huber_leaf(values, weights, delta: float) -> float:
    """Median residual plus the mean of the rest, clipped at the turning point."""
    middle = quantile(values, weights, 0.5)
    rest = values - middle
    return middle + float((weights * np.clip(rest, -delta, delta)).sum() / weights.sum())


# --------------------------------------------------------------------------
# passes over the blocks
# --------------------------------------------------------------------------

_PARTS = ("x", "y", "w", "h", "f")
_BLOCK = "x binary, y binary, w binary, h binary, f binary"


def _pack(model: Ensemble):
    def run(batches):
        pending, n = [], 0

        def block():
            columns = [np.concatenate(c) for c in zip(*pending)]
            y, w, h = columns[-3:]
            parts = (model.binned(columns[:-3]), y, w, h, np.full(len(y), model.start))
            return pa.RecordBatch.from_arrays(
                [pa.array([p.tobytes()], pa.binary()) for p in parts], names=list(_PARTS))

        for batch in batches:
            pending.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                pending, n = [], 0
        if n:
            yield block()
    return run


def _loaded(blocks: DataFrame, n_rows: float | None = None):
    """The blocks, kept by the executors in tasks of about BLOCK_ROWS rows at least (many small
    files would cost more to start than to read); a lost part is read again from its file."""
    rows = blocks.rdd.map(tuple)
    if n_rows is not None:
        rows = rows.coalesce(max(1, int(-(-n_rows // BLOCK_ROWS))))
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def _arrays(row, n_features):
    x, y, w, h, f = row
    y = np.frombuffer(y)
    return (np.frombuffer(x, np.uint8).reshape(len(y), n_features), y, np.frombuffer(w),
            np.frombuffer(h, np.int64), np.frombuffer(f))


def in_bag(h: np.ndarray, tree: int, params: Params) -> np.ndarray:
    """A pseudo-random share of the rows, by key and tree."""
    z = h.view(np.uint64) + np.uint64((params.seed * 1_000_003 + tree + 1)
                                      * 0x9E3779B97F4A7C15 % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) < np.uint64(int(params.sample * (2 ** 64 - 1)))


def _residual(y, f, params: Params, delta: float):
    if params.loss == "log":
        return y - _probability(f)
    return np.clip(y - f, -delta, delta)


def _merged(*parts):
    """Sums by slot (slots, three columns) added up."""
    slot, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    columns = zip(*(p[1] for p in parts))
    return slot, [np.bincount(at, np.concatenate(c), len(slot)) for c in columns]


def _sums(rows, model: Ensemble, collect) -> dict[str, np.ndarray]:
    """Sums of ``collect``'s columns by its slot: within a task, then over a tree of tasks.

    The sums are arrays of their own, not rows, which is why this is a tree
    aggregate and no grouping: nothing but one array a task is moved.
    """
    n = len(model.features)

    def run(part):
        total = None
        for row in part:
            own = collect(*_arrays(row, n))
            total = own if total is None else _merged(total, own)
        if total is not None:
            yield total

    none = (np.empty(0, np.int64), [np.empty(0)] * 3)
    slot, columns = rows.mapPartitions(run).treeAggregate(none, _merged, _merged)
    return {"slot": slot, **dict(zip("abc", columns))}


def _by_slot(slot, columns):
    """Slots and their sums, without empty ones."""
    size = int(slot.max()) + 1 if len(slot) else 0
    sums = [np.bincount(slot, c, size) for c in columns]
    found = np.flatnonzero(np.bincount(slot, minlength=size))
    return found, [s[found] for s in sums]


def _histograms(params, delta, tree, feature, cut, level):
    """Collector: gradient, weight and count by (node, feature, bin) of a level's nodes."""
    def collect(x, y, w, h, f):
        use = in_bag(h, tree, params)
        x, w = x[use], w[use]
        g = w * _residual(y[use], f[use], params, delta)
        node = _leaves(x, feature, cut, params.depth, level)
        one, found = np.ones(len(w)), []
        for k in range(x.shape[1]):
            found.append(_by_slot((node * x.shape[1] + k) * MAX_BINS + x[:, k], (g, w, one)))
        return (np.concatenate([s for s, _ in found]),
                [np.concatenate(c) for c in zip(*(c for _, c in found))])
    return collect


def _leaf_sums(params, tree, feature, cut):
    """Collector: the residuals' sketch by leaf, in and out of the bag; for log loss, sums."""
    def collect(x, y, w, h, f):
        leaf, bag = _leaves(x, feature, cut, params.depth), in_bag(h, tree, params)
        if params.loss == "log":
            p = _probability(f)
            return _by_slot(leaf[bag], ((w * (y - p))[bag], (w * p * (1 - p))[bag], w[bag]))
        d = y - f
        slot = (leaf * 2 + bag) * 2 * SKETCH_BINS + sketch_bin(d)
        return _by_slot(slot, (w * d, w, np.ones(len(w))))
    return collect


def best_splits(hist: np.ndarray, min_leaf: int):
    """(node, feature, cut, gain) of each node's best split of sums (3, nodes, features, bins).

    The gain is the weighted squared error that the split takes away; ties go
    to the first feature and cut.
    """
    left = np.cumsum(hist, axis=3)
    whole = left[..., -1:]
    right = whole - left
    (gl, wl, nl), (gr, wr, nr) = left, right
    legal = (nl >= min_leaf) & (nr >= min_leaf) & (wl > 0) & (wr > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(legal, wl * wr / (wl + wr) * (gl / wl - gr / wr) ** 2, -1.0)
    flat = gain.reshape(len(gain), -1)
    # sums differ in their last digits with the order of tasks: near-equal gains are ties
    best = (flat >= flat.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)
    for node, at in enumerate(best.tolist()):
        if flat[node, at] > 1e-12:
            yield node, at // MAX_BINS, at % MAX_BINS, float(flat[node, at])


# --------------------------------------------------------------------------
# fitting
# --------------------------------------------------------------------------

def bin_bounds(rows: DataFrame, features) -> list[np.ndarray]:
    """At most MAX_BINS - 1 quantiles a feature; one aggregate with mergeable sketches."""
    shares = [k / MAX_BINS for k in range(1, MAX_BINS)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, QUANTILE_ACCURACY)
                       .alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [], float)) for q in found]


def fit(rows: DataFrame, features, label: Column, weight: Column | None, key: list[str],
        params: Params, store=materialize) -> Ensemble | None:
    """The ensemble fitted to complete rows; None without rows.  ``key`` names a row."""
    features = tuple(features)
    model = Ensemble(features, bin_bounds(rows, features), 0.0, params.depth, params.loss)
    # dealt by key, so that blocks are of one size wherever the rows come from
    blocks = store(rows.repartition(*key).select(
        *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)],
        label.cast("double").alias("y"),
        (F.lit(1.0) if weight is None else weight).cast("double").alias("w"),
        F.xxhash64(*key).alias("h")).mapInArrow(_pack(model), _BLOCK), "boosting-blocks")
    held = _loaded(blocks)
    nodes, ends = 2 ** params.depth - 1, 2 ** params.depth
    trees = (np.zeros((0, nodes), np.int16), np.zeros((0, nodes), np.uint8), np.zeros((0, ends)))

    # the first prediction: median, or log odds
    def first(x, y, w, h, f):
        if params.loss == "log":
            return _by_slot(np.zeros(len(y), np.int64), (w * y, w, np.ones(len(y))))
        return _by_slot(sketch_bin(y), (w * y, w, np.ones(len(y))))
    sums = _sums(held, model, first)
    held.unpersist()
    n_rows = sums["c"].sum()
    if not n_rows:
        return None
    held = _loaded(blocks, n_rows)
    delta = 0.0
    if params.loss == "log":
        share = np.clip(sums["a"][0] / max(sums["b"][0], 1e-300), 1e-9, 1 - 1e-9)
        model.start = round(float(np.log(share / (1 - share))), DIGITS)
    else:
        use = sums["b"] > 0
        values, weights = sums["a"][use] / sums["b"][use], sums["b"][use]
        model.start = round(quantile(values, weights, 0.5), DIGITS)
        delta = round(quantile(np.abs(values - model.start), weights, params.alpha), DIGITS)
    held, spent = _advanced(held, len(features), lambda x: model.start), held
    model.gain = np.zeros(len(features))
    for tree in range(params.trees):
        feature, cut = np.zeros(nodes, np.int16), np.full(nodes, NO_SPLIT, np.uint8)
        for level in range(params.depth):
            found = _sums(held, model, _histograms(params, delta, tree, feature, cut, level))
            if spent is not None:                            # the new blocks are there now
                spent.unpersist()
                spent = None
            hist = np.zeros((3, 2 ** level * len(features) * MAX_BINS))
            for row, c in zip(hist, ("a", "b", "c")):
                row[found["slot"]] = found[c]
            splits = list(best_splits(
                hist.reshape(3, 2 ** level, len(features), MAX_BINS), params.min_leaf))
            for node, k, at, gain in splits:
                feature[2 ** level - 1 + node], cut[2 ** level - 1 + node] = k, at
                model.gain[k] += gain
            if not splits:
                break
        found = _sums(held, model, _leaf_sums(params, tree, feature, cut))
        value = np.zeros(ends)
        if params.loss == "log":
            value[found["slot"]] = params.rate * np.where(
                found["b"] > 1e-150, found["a"] / np.maximum(found["b"], 1e-150), 0.0)
        else:
            use = found["b"] > 0
            weights, leaf_bag = found["b"][use], found["slot"][use] // (2 * SKETCH_BINS)
            values, leaf = found["a"][use] / weights, leaf_bag // 2
            for k in np.unique(leaf[leaf_bag % 2 == 1]).tolist():
                own = leaf_bag == 2 * k + 1
                value[k] = params.rate * huber_leaf(values[own], weights[own], delta)
            delta = round(quantile(np.abs(values - value[leaf]), weights, params.alpha), DIGITS)
        value = value.round(DIGITS)
        trees = tuple(np.concatenate([old, new[None]]) for old, new in
                      zip(trees, (feature, cut, value)))
        if tree + 1 < params.trees:
            held, spent = _advanced(held, len(features), _one_tree(
                feature, cut, value, params.depth)), held
            if (tree + 1) % REFRESH == 0:
                blocks = store(held.map(lambda row: tuple(bytearray(p) for p in row)).toDF(_BLOCK),
                               "boosting-blocks")
                held.unpersist()
                held = _loaded(blocks, n_rows)
    held.unpersist()
    model.feature, model.cut, model.value = trees
    return model


def _one_tree(feature, cut, value, depth):
    return lambda x: value[_leaves(x, feature, cut, depth)]


def _advanced(held, n_features, step):
    """The blocks with ``step`` of their features added to their predictions."""
    def run(row):
        x, y, w, h, f = row
        return x, y, w, h, (np.frombuffer(f) + step(_arrays(row, n_features)[0])).tobytes()
    return held.map(run).persist(StorageLevel.MEMORY_AND_DISK)


def predicted(model: Ensemble, *columns: Column) -> Column:
    """The model's prediction as a column, evaluated in Arrow batches."""
    @F.pandas_udf("double")
    def run(frame):
        import pandas as pd
        return pd.Series(model.predict([frame[c] for c in frame.columns]))
    return run(F.struct(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
