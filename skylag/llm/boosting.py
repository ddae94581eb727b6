"""Gradient-boosted trees for two classes: ``fit`` on arrays, ``fit_rows`` on a table of any size by the same steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skylag.llm.tables import written


@dataclass
class Trees:
    """Complete binary trees as arrays: feature and split per inner node, value per leaf."""
    base: float
    depth: int
    features: np.ndarray  # trees x (2^depth - 1)
    splits: np.ndarray
    values: np.ndarray  # trees x 2^depth
    at: np.ndarray  # calibration: scores, rising
    share: np.ndarray  # calibrated probability at these scores, never falling

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, splits, values in zip(self.features, self.splits, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, features[node]] > splits[node])
            total += values[node - (2 ** self.depth - 1)]
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.scores(x), self.at, self.share) if len(x) else np.empty(0)


Block = tuple[float, int, int]  # calibration: highest score, positives, rows


def pooled(blocks: Iterable[Block]) -> list[Block]:
    """Pool adjacent violators, one block per score by rising score. Counts are whole, so parts pooled one by one and then together
    give the same."""
    out: list[Block] = []
    for score, positive, n in blocks:
        while out and out[-1][1] * n >= positive * out[-1][2]:
            _, p2, n2 = out.pop()
            positive, n = positive + p2, n + n2
        out.append((score, positive, n))
    return out


def calibrate(trees: Trees, blocks: list[Block]) -> None:
    if blocks:
        trees.at, trees.share = np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


#: Splits are looked for at so many equal shares of a feature's values; bins are numbered in a byte, no split is the last number.
SHARES, NO_SPLIT = 33, 255
ROUNDS, DEPTH, RATE, LEAST = 40, 3, 0.3, 5


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many of a feature's cuts lie below each value, so that ``x > cuts[j]`` where the bin is above j."""
    return np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]).astype(np.uint8)


def _node(bins: np.ndarray, features: np.ndarray, splits: np.ndarray, depth: int) -> np.ndarray:
    """Where rows arrive in a tree over bins after ``depth`` steps."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        node = 2 * node + 1 + (bins[rows, features[node]] > splits[node])
    return node


Grown = tuple[np.ndarray, np.ndarray, np.ndarray]  # features, splits (bins) and values of a tree


def _sums(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, base: float, grown: list[Grown], tree: tuple[np.ndarray, np.ndarray],
          level: int, depth: int) -> np.ndarray:
    """Gradients, their weights and rows by node of a level, feature and bin.

    Gradients are rounded to multiples of 2^-24, so that their sums are exact and do not depend on how rows are dealt to tasks.
    """
    score = np.full(len(bins), base)
    for features, splits, values in grown:
        score += values[_node(bins, features, splits, depth) - (2 ** depth - 1)]
    p = 1 / (1 + np.exp(-score))
    width, nodes = bins.shape[1], 2 ** level
    node = _node(bins, *tree, level) - (nodes - 1)
    place = (((node * width)[:, None] + np.arange(width)) * SHARES + bins).ravel()
    return np.stack([np.bincount(place, np.repeat(v, width), nodes * width * SHARES).reshape(nodes, width, SHARES)
                     for v in (_exact(y - p) * weight, _exact(p * (1 - p)) * weight, weight)])


def _exact(values: np.ndarray) -> np.ndarray:
    return np.rint(values * (1 << 24)) / (1 << 24)


def _boosted(cuts: list[np.ndarray], base: float, sums: Callable[..., np.ndarray], rounds: int, depth: int, rate: float,
             least: int) -> Trees:
    """Trees from what ``sums(base, grown, tree, level, depth)`` finds over all rows for a level of a tree."""
    inner = 2 ** depth - 1
    grown: list[Grown] = []
    for _ in range(rounds):
        features, splits, values = np.zeros(inner, np.int64), np.full(inner, NO_SPLIT), np.zeros(2 ** depth)
        for level in range(depth):
            g, h, n = sums(base, grown, (features, splits), level, depth)
            for k, (gk, hk, nk) in enumerate(zip(g, h, n)):
                node, best = 2 ** level - 1 + k, 1e-6
                all_g, all_h, all_n = gk[0].sum(), hk[0].sum(), nk[0].sum()
                right = (0.0, 0.0)
                for f, c in enumerate(cuts):
                    if not len(c) or all_n < 2 * least:
                        continue
                    gr, hr, nr = (v[f][::-1].cumsum()[::-1][1:len(c) + 1] for v in (gk, hk, nk))
                    gain = gr ** 2 / (hr + 1) + (all_g - gr) ** 2 / (all_h - hr + 1) - all_g ** 2 / (all_h + 1)
                    gain[(nr < least) | (all_n - nr < least)] = 0
                    if gain.max() > best:
                        best, at = gain.max(), int(gain.argmax())
                        features[node], splits[node], right = f, at, (gr[at], hr[at])
                if level == depth - 1:
                    values[2 * k:2 * k + 2] = (rate * (all_g - right[0]) / (all_h - right[1] + 1), rate * right[0] / (right[1] + 1))
        grown.append((features, splits, values))
    places = np.array([[cuts[f][s] if s != NO_SPLIT else np.inf for f, s in zip(features, splits)] for features, splits, _ in grown])
    return Trees(base, depth, np.array([g[0] for g in grown]), places, np.array([g[2] for g in grown]), np.zeros(1), np.full(1, 0.5))


def _base(positive: float, n: float) -> float:
    rate_of = min(max(positive / n if n else 0.5, 1e-3), 1 - 1e-3)
    return float(np.log(rate_of / (1 - rate_of)))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE,
        least: int = LEAST) -> Trees:
    """Boost on the rows outside ``held``; calibrate on those in it (on all where that leaves one class)."""
    fx, fy = x[~held], y[~held].astype(float)
    cuts = [np.unique(np.quantile(fx[:, f], np.linspace(0, 1, SHARES)))[:-1] if len(fx) else np.empty(0) for f in range(x.shape[1])]
    bins, weight = _bins(fx, cuts), np.ones(len(fx))
    trees = _boosted(cuts, _base(fy.sum(), len(fy)), lambda *state: _sums(bins, fy, weight, *state), rounds, depth, rate, least)
    check = held if len(set(y[held].tolist())) == 2 else np.ones(len(y), bool)
    scores, place, n = np.unique(trees.scores(x[check]), return_inverse=True, return_counts=True)
    calibrate(trees, pooled(zip(scores.tolist(), np.bincount(place, y[check], len(n)).astype(int).tolist(), n.tolist())))
    return trees


# Spark -------------------------------------------------------------------------------

#: Rows of bins that lie in one cell of the table that the trees are grown on.
BLOCK = 1 << 16


def fit_rows(rows: DataFrame, width: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, least: int = LEAST) -> Trees:
    """``fit`` on all rows (``x`` of ``width`` numbers, ``label``, ``held``) of a written table, not calibrated.

    Cuts are exact quantiles. Equal rows of bins are one row with a count; each level of a tree is one aggregation of them to
    sums per node, feature and bin, and only these reach the driver, as many whatever the number of rows.
    """
    training = rows.filter("NOT held")
    shares = F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, SHARES)])
    facts = training.agg(F.count(F.lit(1)), F.sum("label"), *[F.percentile(F.col("x")[f], shares) for f in range(width)]).first()
    cuts = [np.unique(q)[:-1] if q else np.empty(0) for q in facts[2:]]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in _bins(x, cuts)], pa.binary()), batch.column("label")],
                                             names=["bins", "label"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            cells = [b"".join(table["bins"].to_pylist()), *(table[c].to_numpy().astype(np.float64).tobytes() for c in ("label", "n"))]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["bins", "label", "n"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield block()
        if held:
            yield block()

    counted = training.select("x", "label").mapInArrow(binned, "bins binary, label int").groupBy("bins", "label").agg(
        F.count(F.lit(1)).alias("n"))
    dense = written(counted.mapInArrow(blocks, "bins binary, label binary, n binary"), "bins")

    def sums(*state) -> np.ndarray:
        level = state[3]
        shape = (3, 2 ** level, width, SHARES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for cells in zip(*(batch.column(c).to_pylist() for c in ("bins", "label", "n"))):
                    y, n = (np.frombuffer(c, np.float64) for c in cells[1:])
                    total += _sums(np.frombuffer(cells[0], np.uint8).reshape(-1, width), y, n, *state)
            flat = total.reshape(3, -1)
            place = np.flatnonzero(flat[2])
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *(pa.array(v[place]) for v in flat)],
                                             names=["place", "g", "h", "n"])

        found = dense.mapInArrow(run, "place int, g double, h double, n double").groupBy("place").agg(
            *[F.sum(c).alias(c) for c in ("g", "h", "n")]).collect()
        flat = np.zeros((3, int(np.prod(shape[1:]))))
        for place, *values in found:
            flat[:, place] = values
        return flat.reshape(shape)

    return _boosted(cuts, _base(facts[1] or 0, facts[0]), sums, rounds, depth, rate, least)


def blocks_of(scores: DataFrame) -> list[Block]:
    """The calibration from ``score``, ``positive`` and ``n``: pooled in ranges of scores, then their blocks on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pooled(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("score", "positive", "n"))))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["score", "positive", "n"])

    each = scores.groupBy("score").agg(F.sum("positive").alias("positive"), F.sum("n").alias("n"))
    parts = each.repartitionByRange("score").sortWithinPartitions("score").mapInArrow(run, "score double, positive bigint, n bigint")
    return pooled(sorted(map(tuple, parts.collect())))
