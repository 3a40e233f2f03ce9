"""Quality: Bradley-Terry scores from preference pairs.

Every document is a row of text figures (see ``features``).  A preference pair
is a document labelled good and one labelled bad; the chance that the first wins
is the logistic function of the difference of their scores, and a score is
linear in the figures, so fitting is logistic regression on differences of
figures.  The cut between good and bad is the quantile of the scores at the
share of bad labels, put at ``THRESHOLD``; the slope is fitted on the labels.

Every labelled document and every pair of a good and a bad one is learned from.
Pairs are not listed: within a cell of scores ``CELL`` wide the logistic function is
a polynomial to rounding, so the loss over all pairs has its gradient and curvature
from the moments of each class in each cell.  A step of Newton's method is one scan
of the stored figures, combined on the cluster; the cut is counted out exactly.
Only moments and counts, neither texts nor rows of figures, come to the driver.

Defined cases: a null text is an empty one; a very long text is one row of figures,
read as a whole; with labels of one class only, every score is that class's share;
of equal scores at the cut all fall on one side; repeated rows are each scored, and
one text is learned from for each id (the one of least figures), with the least of
its labels; an empty table of documents gives no row; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.3
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\x0b\x0c\r"
_STOPS = b".,;:?'\"-()"
WIDTH = 26
#: Width of a cell of scores and the polynomials that stand for a function in it.
CELL, DEGREES = 2.0, 16
#: Cells whose moments a task holds at a time, and nodes of good rows that are taken against all of the bad ones.
MOST_CELLS, BLOCK = 512, 256
#: Chebyshev nodes of a cell, and what turns moments of polynomials into weights at the nodes.
_NODES = np.cos(np.pi * (np.arange(DEGREES) + 0.5) / DEGREES)
_TO_NODES = chebvander(_NODES, DEGREES - 1) * (np.where(np.arange(DEGREES) > 0, 2.0, 1.0) / DEGREES)


def features(text: bytes | None) -> list[float]:
    """Shares of letter kinds, words, repeats and lines, each also as its root; log length; 1."""
    text = text or b""
    n = max(1, len(text))

    def share(kind: bytes) -> float:
        return (len(text) - len(text.translate(None, kind))) / n

    words = text.split()
    m = max(1, len(words))
    lines = text.split(b"\n")
    up, low, digit, space, stop = map(share, (_UPPER, _LOWER, _DIGIT, _SPACE, _STOPS))
    shares = [
        up, low, digit, space, stop, max(0.0, (0.0 if not text else 1.0) - up - low - digit - space - stop),
        len(set(words)) / m, sum(map(eq, words, words[1:])) / m, len(set(lines)) / len(lines), min(1.0, len(lines) / m),
        min(1.0, sum(map(len, words)) / m / 20), text.count(b". ") / m,
    ]
    return [*shares, *(x**0.5 for x in shares), np.log1p(len(text)), 1.0]


@dataclass
class Model:
    weights: np.ndarray | None
    cut: float = 0.0
    slope: float = 1.0
    base_rate: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base_rate)
        return common.sigmoid(self.slope * (dot(x, self.weights) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)))


def dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sum of each row, to the last bit the same in any batch."""
    return (np.ascontiguousarray(x) * w).sum(axis=1)


def bradley_terry(x: np.ndarray, good: np.ndarray, pairs: int, seed: int = 7, l2: float = 1.0) -> np.ndarray:
    """Weights of the figures of rows in memory: logistic loss on differences over random pairs; ``fit`` takes all pairs."""
    rng = np.random.default_rng(seed)
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    spread = x.std(axis=0)
    spread[spread < 1e-9] = np.inf
    z = (x - x.mean(axis=0)) / spread
    n = min(pairs, 20 * max(len(a), len(b)))
    d = z[rng.choice(a, n)] - z[rng.choice(b, n)]
    # Each difference counts in both directions, so no constant is learned.
    d = np.column_stack([np.concatenate([d, -d]), np.zeros(2 * n)])
    y = np.concatenate([np.ones(n), np.zeros(n)])
    return common.logistic_fit(d, y, np.full(2 * n, 1.0), l2)[:-1] / spread


def moments(z: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each cell of scores ``s``: its polynomials, summed over its rows times 1, the figures and their products."""
    i, j = np.triu_indices(z.shape[1])
    cell = np.floor(s / CELL).astype(np.int64)
    for c in np.unique(cell).tolist():
        at = cell == c
        mine = z[at]
        yield c, chebvander(s[at] / (CELL / 2) - (2 * c + 1), DEGREES - 1).T @ np.column_stack([np.ones(len(mine)), mine, mine[:, i] * mine[:, j]])


def pair_slopes(good: dict[int, np.ndarray], bad: dict[int, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss, summed over every pair of a good and a bad row, from their moments by cell."""

    def nodes(side):
        return np.concatenate([CELL * (c + 0.5) + CELL / 2 * _NODES for c in side]), np.concatenate([_TO_NODES @ m for m in side.values()])

    (at_good, a), (at_bad, b) = nodes(good), nodes(bad)
    one, figures, products = 0, slice(1, width + 1), slice(width + 1, None)
    gradient, own, cross = np.zeros(width), np.zeros(a.shape[1] - width - 1), np.zeros((width, width))
    for k in range(0, len(a), BLOCK):
        some = a[k : k + BLOCK]
        p = common.sigmoid(at_bad[None, :] - at_good[k : k + BLOCK, None])
        h = p * (1 - p)
        gradient += (some[:, one] @ p) @ b[:, figures] - (p @ b[:, one]) @ some[:, figures]
        own += (h @ b[:, one]) @ some[:, products] + (some[:, one] @ h) @ b[:, products]
        cross += some[:, figures].T @ (h @ b[:, figures])
    curvature = np.zeros((width, width))
    curvature[np.triu_indices(width)] = own
    return gradient, curvature + np.triu(curvature, 1).T - cross - cross.T


def newton(size: int, slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], rounds: int = 100) -> np.ndarray:
    """Where a convex loss is least; ``slopes`` gives its gradient and curvature.  A step that ends as steep on the other side is halved."""
    w = np.zeros(size)
    g, h = slopes(w)
    step = np.linalg.solve(h, g)
    for _ in range(rounds):
        step *= min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            return w - step
        g2, h2 = slopes(w - step)
        if -(g2 @ step) > 0.9 * (g @ step):
            step = step / 2
        else:
            w, g, step = w - step, g2, np.linalg.solve(h2, g2)
    return w


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def labelled_figures(docs: DataFrame, known: DataFrame) -> DataFrame:
    """x (figures) and label of each document that ``known`` (doc_id, label; an id once) names; texts are not shuffled."""

    def run(batch):
        x = [features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return {"doc_id": batch.column(0), "x": pa.array(x, pa.list_(pa.float64()))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    x = common.map_texts(docs.where(F.col("doc_id").isNotNull()), ["doc_id", "text"], run, f"doc_id {kind}, x array<double>")
    return x.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("label").alias("label")).select("x", "label")


def _spread(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bad and good rows, and mean and deviation of each figure."""

    def merged(one, two):
        (n, mean, square), (m, mean2, square2) = one, two
        total, apart = n.sum() + m.sum(), mean2 - mean
        return n + m, mean + apart * (m.sum() / total), square + square2 + apart**2 * (n.sum() * m.sum() / total)

    def run(batches):
        got = None
        for batch in batches:
            if batch.num_rows:
                x, label = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                mean = x.mean(axis=0)
                new = np.bincount(label, minlength=2).astype(float), mean, ((x - mean) ** 2).sum(axis=0)
                got = merged(got, new) if got else new
        if got:
            yield pa.RecordBatch.from_pydict({k: [v.tolist()] for k, v in zip(("n", "mean", "square"), got, strict=True)})

    got = None
    for r in rows.mapInArrow(run, "n array<double>, mean array<double>, square array<double>").collect():
        new = tuple(map(np.array, r))
        got = merged(got, new) if got else new
    n, mean, square = got or (np.zeros(2), np.zeros(WIDTH), np.zeros(WIDTH))
    return n, mean, np.sqrt(square / max(1.0, n.sum()))


def all_pairs(rows: DataFrame, n: np.ndarray, mean: np.ndarray, spread: np.ndarray, pairs: int, l2: float = 1.0) -> np.ndarray:
    """Weights of the figures: logistic loss on the differences of every pair, which together weigh as ``pairs`` of them against ``l2``."""
    spread = np.where(spread < 1e-9, np.inf, spread)
    weight = 2.0 * min(pairs, 20 * n.max()) / (n[0] * n[1])
    width = len(mean)

    def slopes(v):
        def run(batches):
            sums: dict[tuple[int, int], np.ndarray] = {}

            def parts():
                for (c, k), m in sums.items():
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int64()), "label": pa.array([k], pa.int32()), "part": pa.array([m.ravel()], pa.list_(pa.float64()))})

            for batch in batches:
                z, label = (_matrix(batch.column(0)) - mean) / spread, batch.column(1).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    for c, m in moments(z[label == k], z[label == k] @ v):
                        sums[c, k] = sums[c, k] + m if (c, k) in sums else m
                if len(sums) > MOST_CELLS:
                    yield from parts()
                    sums.clear()
            yield from parts()

        def total(table):
            m = sum(_matrix(part).sum(axis=0) for part in table.column("part").chunks)
            return pa.table({"cell": table.column("cell").slice(0, 1), "label": table.column("label").slice(0, 1), "part": pa.array([m], pa.list_(pa.float64()))})

        schema = "cell long, label int, part array<double>"
        side: tuple[dict, dict] = ({}, {})
        for r in rows.mapInArrow(run, schema).groupBy("cell", "label").applyInArrow(total, schema).toArrow().to_batches():
            for c, k, m in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), _matrix(r.column(2)), strict=True):
                side[k][c] = m.reshape(DEGREES, -1)
        g, h = pair_slopes(side[1], side[0], width)
        return weight * g + l2 * v, weight * h + l2 * np.eye(width)

    return newton(width, slopes) / spread


def _scored(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """Score ``s`` of each row, ``place`` (a whole number in the order of the scores) and label."""

    def run(batches):
        for batch in batches:
            s = dot(_matrix(batch.column(0)), w) + 0.0
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(_turned(s.view(np.int64))), batch.column(1)], names=["s", "place", "label"])

    return rows.mapInArrow(run, "s double, place long, label int")


def _turned(bits: np.ndarray) -> np.ndarray:
    """Bits of floating-point numbers as whole numbers in their order, and back."""
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def middle(scored: DataFrame, n: int) -> float:
    """Half way between the ``n``-th least score and the next, both found exactly by counts of the leading 16, 32, 48 and 64 bits."""
    before, place = 0, None
    for shift in (48, 32, 16, 0):
        some = scored if place is None else scored.where(F.shiftright("place", shift + 16) == place)
        got = some.groupBy(F.shiftright("place", shift).alias("start")).count().toPandas().sort_values("start")
        upto = before + got["count"].to_numpy().cumsum()
        k = int(np.searchsorted(upto, n))
        before, place = int(upto[k - 1]) if k else before, int(got["start"].iloc[k])
    after = scored.where(F.col("place") > place).agg(F.min("place")).first()[0] if upto[k] == n else place
    return float(_turned(np.array([place, place if after is None else after], np.int64)).view(np.float64).mean())


def _slope(scored: DataFrame, cut: float, l2: float = 1e-3) -> float:
    """Slope of the logistic model of the labels on the distance from the cut, over all rows."""

    def slopes(w):
        t = F.col("s") - F.lit(cut)
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), t * F.lit(float(w[0])) + F.lit(float(w[1]))))))
        at = scored.select(t.alias("t"), (p - F.col("label")).alias("e"), (p * (1 - p)).alias("h"))
        sums = at.agg(F.sum(F.expr("e * t")), F.sum("e"), F.sum(F.expr("h * t * t")), F.sum(F.expr("h * t")), F.sum("h")).first()
        ridge = np.array([l2, 1e-6])
        return np.array(sums[:2]) + ridge * w, np.array([[sums[2], sums[3]], [sums[3], sums[4]]]) + np.diag(ridge)

    return float(newton(2, slopes)[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", pairs: int = 60_000) -> Model:
    """``labels`` (doc_id and the label) holds the rows to learn from; ``pairs`` is the weight of all pairs together."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min((F.col(label) > 0).cast("int")).alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(share.values())
    if len(share) < 2:
        return Model(None, base_rate=share.get(1, 0) / total if total else 0.0)
    rows = common.stored(labelled_figures(docs, known), "quality-figures")
    n, mean, spread = _spread(rows)
    if not n.all():
        common.discard(rows)
        return Model(None, base_rate=share[1] / total)
    w = all_pairs(rows, n, mean, spread, pairs)
    scored = common.stored(_scored(rows, w), "quality-scores")
    cut = middle(scored, int(n[0]))
    slope = _slope(scored, cut)
    common.discard(rows, scored)
    return Model(w, cut, max(1e-3, slope), share[1] / total)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""

    def run(batch):
        x = np.array([features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, WIDTH)
        return {"doc_id": batch.column(0), "score": pa.array(model.score(x), pa.float64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_texts(docs, ["doc_id", "text"], run, f"doc_id {kind}, score double")
