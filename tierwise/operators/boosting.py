"""Glass-box additive model by histogram boosting, no interactions.

Rows are binned once and written as one small array each. A round is one pass
over them: every task adds up gradients and Hessians of the multinomial loss
by (bag, feature, bin, class), Spark sums these tables, and the driver, which
holds features x bins x classes numbers a bag, takes a damped Newton step on
every shape function. A step that does not lower the bag's loss is undone and
halved, so the loss of the accepted rounds falls strictly.

Outer bags hold back different rows (by a hash of the row, so repeated rows
stay together); a bag keeps the round with the least loss on its held-back
rows and ends after ``patience`` rounds without a better one. The model is the
mean of the bags, centred on the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import written
from .models import K, AdditiveModel

MOST_BINS = 127          # a bin number is one signed byte
LOSS, HELD_LOSS = -1, -2  # "features" of the rows that carry a bag's losses
TABLE = "bag int, feature int, bin int, class int, n long, g double, h double"


@dataclass
class Boosted:
    """The fitted model, and a row (bag, round, loss, held_loss, step) for each accepted round."""
    model: AdditiveModel
    rounds: list[tuple[int, int, float, float, float]] = field(default_factory=list)


@dataclass
class _Bag:
    scores: np.ndarray                  # accepted, [feature][bin][class]
    tried: np.ndarray
    step: float
    grow: float = 1.5
    loss: float = float("inf")
    g: np.ndarray | None = None
    h: np.ndarray | None = None
    round: int = 0
    best: np.ndarray | None = None
    best_loss: float = float("inf")
    best_round: int = 0
    done: bool = False


def quantile_edges(df: DataFrame, features: list[str], n_bins: int, accuracy: int = 2_000) -> dict[str, list[float]]:
    """Inner bin edges per feature from approximate quantiles, all features in one aggregate."""
    if not 2 <= n_bins <= MOST_BINS:
        raise ValueError(f"n_bins must lie in 2..{MOST_BINS}")
    at = [i / n_bins for i in range(1, n_bins)]
    r = df.agg(*[F.percentile_approx(F.col(f"`{f}`"), at, accuracy).alias(f"q{i}") for i, f in enumerate(features)],
               *[F.min(F.col(f"`{f}`").cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    found = {f: sorted({float(v) for v in r[f"q{i}"] or []}) for i, f in enumerate(features)}
    return {f: [v for v in found[f] if v > r[f"m{i}"]] for i, f in enumerate(features)}


def bins_of(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Per feature with edges a column ``__bin<i>``: the number of edges at or below the value, by binary search; a null
    falls into the lowest bin, NaN into the highest."""
    from pyspark.ml.feature import Bucketizer
    cut = [(i, f, e) for i, (f, e) in enumerate(edges.items()) if e]
    if not cut:
        return df
    x = {i: F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("-inf"))) for i, f, _ in cut}
    known = df.withColumns({f"__x{i}": F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v) for i, v in x.items()})
    return Bucketizer(splitsArray=[[-float("inf"), *map(float, e), float("inf")] for _, _, e in cut], inputCols=[f"__x{i}" for i, _, _ in cut],
                      outputCols=[f"__bin{i}" for i, _, _ in cut]).transform(known)


def binned(df: DataFrame, edges: dict[str, list[float]], label: str, bags: int = 1, held_pct: int = 0) -> DataFrame:
    """Rows as (bins, label, held): one byte per feature, and for each bag whether the row is held back from it."""
    bins = F.array(*[(F.col(f"__bin{i}") if e else F.lit(0)).cast("tinyint") for i, e in enumerate(edges.values())])
    own = F.xxhash64(*[F.col(f"`{f}`") for f in edges], F.col(label))
    held = F.array(*[F.pmod(F.xxhash64(own, F.lit(b)), F.lit(100)) < held_pct for b in range(bags)])
    return bins_of(df.filter(F.col(label).isNotNull()), edges).select(bins.alias("bins"), F.col(label).cast("int").alias("label"), held.alias("held"))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def histograms(rows: DataFrame, intercept: list[float], scores: list[np.ndarray]) -> DataFrame:
    """Per (bag, feature, bin, class): all rows (n), and over the rows not held back the sums of the loss's gradient
    (p - y) and Hessian p (1 - p) at the bag's scores. Feature -1 and -2 carry the bag's summed losses in ``g`` and
    rows in ``n``, over the rows not held back and held back."""
    icpt, at = np.array(intercept), np.stack(scores)
    n_bags, n_features, n_bins, n_classes = at.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((n_features, n_bins))
        g, h = (np.zeros((n_bags, n_features, n_bins, n_classes)) for _ in range(2))
        loss = np.zeros((n_bags, 2, 2))
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            bins = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(m, n_features)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            held = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(m, n_bags)
            cell = bins.astype(np.int64) + np.arange(n_features) * n_bins
            n += np.bincount(cell.ravel(), minlength=n_features * n_bins).reshape(n.shape)
            for b in range(n_bags):
                z = np.tile(icpt, (m, 1))
                for f in range(n_features):
                    z += at[b, f, bins[:, f]]
                p = softmax(z)
                own = -np.log(np.maximum(p[np.arange(m), y], 1e-300))
                for side, mask in enumerate((~held[:, b], held[:, b])):
                    loss[b, side] += own[mask].sum(), mask.sum()
                used = ~held[:, b]
                slope = (p - (y[:, None] == np.arange(n_classes)))[used]
                curve = (p * (1 - p))[used]
                flat = cell[used].ravel()
                for k in range(n_classes):
                    for table, part in ((g, slope), (h, curve)):
                        table[b, :, :, k] += np.bincount(flat, np.repeat(part[:, k], n_features),
                                                         minlength=n_features * n_bins).reshape(n_features, n_bins)
        f, i = np.nonzero(n)
        if not len(f):
            return
        rows_ = [(b, f, i, k, n[f, i], g[b, f, i, k], h[b, f, i, k]) for b in range(n_bags) for k in range(n_classes)]
        rows_ += [(b, np.array([s]), np.array([0]), 0, loss[b, j, 1:], loss[b, j, :1], np.zeros(1))
                  for b in range(n_bags) for j, s in enumerate((LOSS, HELD_LOSS))]
        columns = [np.concatenate([np.broadcast_to(r[c], r[1].shape) for r in rows_]) for c in range(7)]
        kinds = [pa.int32()] * 4 + [pa.int64()] + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds)],
                                         names=["bag", "feature", "bin", "class", "n", "g", "h"])

    return rows.mapInArrow(run, TABLE).groupBy("bag", "feature", "bin", "class").agg(
        F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


def class_intercept(rows: DataFrame) -> list[float]:
    """Log share of each class among the binned rows; a class without rows gets a share of practically zero."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        raise ValueError("no row with a label to fit on")
    return [float(np.log(counts[k] / total)) if counts.get(k) else -1e9 for k in range(K)]


def flat_scores(edges: dict[str, list[float]]) -> np.ndarray:
    """Scores of zero, [feature][bin][class], as wide as the feature with the most bins."""
    return np.zeros((len(edges), max(len(e) for e in edges.values()) + 1, K))


def dense(cells, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians of one bag's histogram rows as arrays shaped like the scores."""
    g, h = np.zeros_like(like), np.zeros_like(like)
    at = cells["feature"], cells["bin"], cells["class"]
    g[at], h[at] = cells["g"], cells["h"]
    return g, h


def newton(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    """The step that would end each bin's gradient if the others stood still."""
    return -g / (h + reg)


def fit_boosted(train: DataFrame, features: list[str], label: str = "label", n_bins: int = 32, rounds: int = 25,
                bags: int = 4, held_pct: int = 15, patience: int = 4, reg: float = 1.0, step: float = 0.25,
                name: str = "boosted", edges: dict[str, list[float]] | None = None) -> Boosted:
    """Fit the shape functions of ``features``; at most ``rounds`` accepted rounds a bag. With ``held_pct`` 0 nothing
    is held back and all rounds are run."""
    edges = edges or quantile_edges(train, features, n_bins)
    rows = written(binned(train, edges, label, bags, held_pct), "boost-rows")
    icpt = class_intercept(rows)
    zero = flat_scores(edges)
    state = [_Bag(zero, zero, step) for _ in range(bags)]
    found = Boosted(AdditiveModel(name, list(edges), edges, {}, icpt, bucketize=True))
    n = np.zeros(zero.shape[:2])
    for _ in range(4 * rounds + 4):         # undone steps cost a pass too
        table = histograms(rows, icpt, [s.tried for s in state]).toPandas()
        for b, s in enumerate(state):
            own = table[table["bag"] == b]
            if not s.done:
                _accept(s, own, b, found, rounds, patience, reg)
        cells = table[(table["bag"] == 0) & (table["class"] == 0) & (table["feature"] >= 0)]
        n[cells["feature"], cells["bin"]] = cells["n"]
        if all(s.done for s in state):
            break
    mean = np.mean([s.best if s.best is not None else s.scores for s in state], axis=0)
    offset = (n[:, :, None] * mean).sum(axis=1) / n[0].sum()
    mean -= offset[:, None, :]
    found.model.intercept = [v + o for v, o in zip(icpt, offset.sum(axis=0).tolist())]
    found.model.scores = {f: mean[i, :len(e) + 1].tolist() for i, (f, e) in enumerate(edges.items())}
    return found


def _accept(s: _Bag, own, b: int, found: Boosted, rounds: int, patience: int, reg: float) -> None:
    """Take or undo the bag's tried step by its loss, and try the next."""
    def mean(kind: int) -> float:
        r = own[own["feature"] == kind]
        return float(r["g"].sum() / r["n"].sum()) if len(r) and r["n"].sum() else float("nan")

    loss, held = mean(LOSS), mean(HELD_LOSS)
    if loss < s.loss:
        s.scores, s.loss = s.tried, loss
        s.g, s.h = dense(own[own["feature"] >= 0], s.scores)
        found.rounds.append((b, s.round, loss, held, s.step))
        if held != held or held < s.best_loss:
            s.best, s.best_loss, s.best_round = s.scores, held, s.round
        if s.round >= rounds or s.round - s.best_round >= patience:
            s.done = True
        s.step = min(1.0, s.step * s.grow) if s.round else s.step
        s.round += 1
    else:
        s.step, s.grow = s.step / 2, 1.1  # near the largest step that works from here on
        s.done = s.step < 1e-6
    s.tried = s.scores if s.done else s.scores + s.step * newton(s.g, s.h, reg)
