"""SimHash near-dedup (operator 4): meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most ``2h`` bits apart have a common variant at
most ``h`` bits from each.  So every distinct fingerprint emits all variants
within ``h`` bits, and fingerprints that meet in a variant are candidates,
verified by their bit distance.

The shuffle on variants is done by *bucket*: some bits of the variant and a
few parities of all its bits (a linear code).  A fingerprint is sent once to
each bucket that one of its variants falls into, and the bucket's task makes
exactly those variants again: a code's syndromes say which flips lead from a
fingerprint to a bucket.  So all (radius 4: 2,081) variants take part, while
a small share of them is written to disk.  The parities spread the variants
of similar fingerprints evenly, so a large group of near copies is split over
all buckets of its prefix; the number of prefix bits grows with the number of
fingerprints, so the variants a bucket holds stay bounded.

Equal fingerprints are merged before anything is sent (a group of thousands
of copies is one fingerprint).  Within a bucket a variant links each of its
fingerprints to the least one, never all pairs, and of those links a spanning
forest is returned.  Every link is a verified pair, and no connection is
lost.  Components follow by hooking and pointer jumping on DataFrames.

Defined results: null, empty and blank texts have the fingerprint zero and
are linked like any other.  Rows repeated or with equal ids share a
fingerprint row each; ``component_id`` is the least non-null id reachable,
null only where no document of the component has an id.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, stored, words_of

SHINGLE = 4
MAX_BITS = 4
PARITIES = 6
BUCKET_VARIANTS = 4_000_000
MAX_ROUNDS = 60
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit set where over half of the shingles' XXH64 (seed 42) have it set."""
    words = words_of(text)
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    k = min(shingle, n)
    starts = [0, *(ends[:n - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1:].tolist())),
                         np.uint64, n - k + 1)
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
    by_byte += np.arange(8) * 256
    seen = np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS.astype(np.int64)).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text, shingle: int = SHINGLE):
    """Column of fingerprints as signed 64-bit numbers."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64)
                         .view(np.int64))
    return F.pandas_udf(run, T.LongType())(text)


class Ball:
    """The flips of at most ``radius`` of 64 bits, by the bucket step they make."""

    def __init__(self, radius: int, prefix_bits: int, parities: int = PARITIES):
        rng = np.random.default_rng(20)          # fixed: every task makes the same code
        self.prefix_bits, self.parities = prefix_bits, parities
        self.checks = rng.integers(0, 1 << 63, parities, dtype=np.uint64) * np.uint64(2) + \
            rng.integers(0, 2, parities, dtype=np.uint64)
        flips = [np.zeros(1, np.uint64)]
        ones = np.uint64(1) << np.arange(64, dtype=np.uint64)
        last = np.array([-1])
        for _ in range(radius):
            grown = [(f | one, i) for f, at in zip(flips[-1], last) for i, one in enumerate(ones)
                     if i > at]
            flips.append(np.array([g[0] for g in grown], np.uint64))
            last = np.array([g[1] for g in grown])
        self.flips = np.concatenate(flips)
        steps = self.bucket(self.flips)
        order = np.argsort(steps, kind="stable")
        self.flips = self.flips[order]
        self.steps, starts = np.unique(steps[order], return_index=True)
        self.starts = np.append(starts, len(order))

    def bucket(self, x: np.ndarray) -> np.ndarray:
        """Prefix bits and parities; bucket(a ^ b) == bucket(a) ^ bucket(b)."""
        out = (x >> np.uint64(64 - self.prefix_bits)) if self.prefix_bits else np.zeros_like(x)
        for check in self.checks:
            parity = (np.bitwise_count(x & check) & 1).astype(np.uint64)
            out = (out << np.uint64(1)) | parity
        return out.astype(np.int64)

    def flips_for(self, steps: np.ndarray) -> list[np.ndarray]:
        at = np.searchsorted(self.steps, steps)
        return [self.flips[self.starts[i]:self.starts[i + 1]] for i in at.tolist()]


@functools.lru_cache(4)
def _ball(radius: int, prefix_bits: int) -> Ball:
    return Ball(radius, prefix_bits)


def _send(ball_args):
    def run(batches):
        ball = _ball(*ball_args)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(x), 2000):
                part = x[i:i + 2000]
                to = ball.bucket(part)[:, None] ^ ball.steps[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.ravel()),
                     pa.array(np.repeat(part.view(np.int64), len(ball.steps)))],
                    names=["bucket", "fp"])
    return run


def spanning_links(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of the links (a[i], b[i]) of a spanning forest over nodes 0..n-1."""
    label, left, chosen = np.arange(n), np.arange(len(a)), []
    while len(left):
        la, lb = label[a[left]], label[b[left]]
        left, la, lb = left[la != lb], la[la != lb], lb[la != lb]
        if not len(left):
            break
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        # every component that is the higher end of a link hooks to one lower component
        order = np.argsort(high, kind="stable")
        hooked, first = np.unique(high[order], return_index=True)
        pick = order[first]
        chosen.append(left[pick])
        parent = np.arange(n)
        parent[hooked] = low[pick]
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        label = parent[label]
    return np.concatenate(chosen) if chosen else np.empty(0, np.int64)


def bucket_links(bucket: int, fps: np.ndarray, ball: Ball, max_bits: int) -> np.ndarray:
    """Verified links (rows of two fingerprints) found by the variants in one bucket."""
    fps = np.unique(fps)
    steps = ball.bucket(fps) ^ bucket
    variants, owners = [], []
    for step in np.unique(steps):
        own = np.flatnonzero(steps == step)
        flips = ball.flips_for(np.array([step]))[0]
        variants.append((fps[own][:, None] ^ flips[None, :]).ravel())
        owners.append(np.repeat(own, len(flips)))
    variants, owners = np.concatenate(variants), np.concatenate(owners).astype(np.int32)
    order = np.argsort(variants, kind="stable")
    variants, owners = variants[order], owners[order]
    same = np.flatnonzero(variants[1:] == variants[:-1]) + 1
    if not len(same):
        return np.empty((0, 2), np.uint64)
    # first entry of the run of equal variants that each repeated entry belongs to
    start = np.zeros(len(variants), np.int64)
    fresh = np.ones(len(variants), bool)
    fresh[same] = False
    start[fresh] = np.flatnonzero(fresh)
    head = owners[np.maximum.accumulate(start)[same]].astype(np.int64)
    tail = owners[same].astype(np.int64)
    pair = np.unique(np.minimum(head, tail) * len(fps) + np.maximum(head, tail))
    a, b = pair // len(fps), pair % len(fps)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
    a, b = a[near & (a != b)], b[near & (a != b)]
    keep = spanning_links(a, b, len(fps))
    return np.stack([fps[a[keep]], fps[b[keep]]], axis=1)


def _meet(ball_args, max_bits):
    def run(key, table):
        fps = table.column("fp").to_numpy().view(np.uint64)
        links = bucket_links(int(key[0].as_py()), fps, _ball(*ball_args), max_bits)
        signed = np.ascontiguousarray(links).view(np.int64)
        return pa.table({"a": pa.array(signed[:, 0]), "b": pa.array(signed[:, 1])})
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS,
          bucket_variants: int = BUCKET_VARIANTS) -> DataFrame:
    """Verified links (a, b) that connect all distinct fingerprints ``fp`` within ``max_bits``."""
    radius = (max_bits + 1) // 2
    n = fps.count()
    per_bucket = n * len(Ball(radius, 0).flips) / (1 << PARITIES)
    prefix_bits = max(0, min(40, int(np.ceil(np.log2(max(1.0, per_bucket / bucket_variants))))))
    args = (radius, prefix_bits)
    sent = fps.mapInArrow(_send(args), "bucket long, fp long")
    return sent.groupBy("bucket").applyInArrow(_meet(args, max_bits), "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root) for every node of ``edges``: root is the component's least node.

    Each round every root hooks to the least root next to it and labels jump
    to their root's root, so rounds grow with the logarithm of a component's
    diameter.  All steps are joins and map-side combined minima.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")), "links")
    labels = stored(both.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(max_rounds):
        at = labels.select(F.col("node").alias("b"), F.col("root").alias("far"))
        seen = both.join(at, "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        near = labels.join(seen, "node").select("node", "root", F.least("root", "far").alias("low"))
        hooks = near.groupBy("root").agg(F.min("low").alias("low"))
        hooked = near.join(hooks.withColumnRenamed("low", "next"), "root").select(
            "node", "root", F.least("low", "next").alias("next"))
        above = labels.select(F.col("node").alias("next"), F.col("root").alias("top"))
        stepped = stored(hooked.join(above, "next", "left").select(
            "node", F.least("next", F.coalesce("top", "next")).alias("root"),
            (F.least("next", F.coalesce("top", "next")) != F.col("root")).alias("changed")),
            "labels")
        labels = stepped.select("node", "root")
        if stepped.where("changed").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed), fingerprint (16 hex digits), root, component_id for every row."""
    prints = stored(docs.select(F.col(doc_id).alias("doc_id"),
                                fingerprint_column(F.col(text), shingle).alias("fp")),
                    "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints.select("fp").distinct(), max_bits))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: the one with the least id.  Columns as in ``docs``.

    Of several rows with that id in the component one stays; where no row of
    a component has an id, one of its rows stays.
    """
    found = stored(near_duplicates(docs, doc_id, text, shingle, max_bits)
                   .select("doc_id", "fp", "root", "component_id"), "components")
    by_id = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component_id"))
    single = by_id.where("n = 1 AND doc_id = component_id").select("doc_id")
    kept = docs.join(single, docs[doc_id] == single["doc_id"], "left_semi")
    odd = by_id.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_odd"))
    if odd.isEmpty():
        return kept
    # Ids that are null or repeated do not name a row: look at these rows' fingerprints.
    mark = fresh_name(docs, "_fp")
    rows = (docs.join(odd, docs[doc_id].eqNullSafe(odd["_odd"]), "left_semi")
            .withColumn(mark, fingerprint_column(F.col(f"`{text}`"), shingle)))
    roots = found.select(F.col("fp").alias("_of"), "root", "component_id").distinct()
    least = fresh_name(rows, "_root")
    rows = rows.join(roots.withColumnsRenamed({"root": least, "component_id": least + "c"}),
                     F.col(mark) == F.col("_of"))
    rows = rows.where(F.col(f"`{doc_id}`").eqNullSafe(F.col(least + "c"))).dropDuplicates([least])
    return kept.unionByName(rows.select(*[F.col(f"`{c}`") for c in docs.columns]))
