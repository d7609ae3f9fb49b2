"""Local surrogate explanations (I10) for a batch of applicants.

As the public LIME library does it for tabular data with quartile bins: per
applicant ``num_samples`` perturbations (sample 0 is the applicant); each
feature's bin is drawn with the training frequencies and a value inside it
from a normal with the bin's mean and std, truncated to the bin's range.  The
surrogate is a weighted ridge (alpha 1, intercept) on the binary "same bin as
the applicant" features, which are not scaled; weights are an exponential
kernel (width 0.75*sqrt(d)) of their Euclidean distance.  Up to six features
are chosen by forward selection, more by the weights of a first ridge (alpha
0.01); the surrogate is then fitted on the chosen ones only.

Applicants are dealt out in chunks of samples; a task draws, scores and
reduces a chunk to its normal equations (a (d+2)-wide matrix), and an
applicant's matrices are added up and solved.  Seeds come from (applicant,
chunk), so results don't depend on partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .explain import quartile_bins
from .models import LinearModel, score

CHUNK = 1000


class Bins:
    """Quartile bins of the training rows: cuts, frequencies and moments (features x 4)."""

    def __init__(self, features: list[str], stats: list, cuts: dict[str, list[float]]):
        self.cuts = np.array([cuts[f] for f in features])
        shape = (len(features), 4)
        self.freq, self.mean, self.std, self.low, self.high = (np.zeros(shape) for _ in range(5))
        number = {f: i for i, f in enumerate(features)}
        for r in stats:
            at = number[r["feature"]], r["bin"]
            self.freq[at], self.mean[at], self.std[at] = r["n"], r["mean"], r["std"] or 0.0
            self.low[at], self.high[at] = r["min"], r["max"]
        self.upto = np.cumsum(self.freq / self.freq.sum(axis=1, keepdims=True), axis=1)

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :, None] > self.cuts[None]).sum(axis=2)

    def draw(self, rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Bins and values of n perturbations."""
        d = len(self.cuts)
        bins = np.minimum((rng.random((n, d))[:, :, None] >= self.upto[None]).sum(axis=2), 3)
        mean, std, low, high = (t[np.arange(d), bins] for t in (self.mean, self.std, self.low, self.high))
        values = rng.normal(mean, std)
        for _ in range(30):
            out = (values < low) | (values > high)
            if not out.any():
                break
            values[out] = rng.normal(mean[out], std[out])
        return bins, np.clip(values, low, high)


def probabilities(model, x: np.ndarray) -> np.ndarray:
    """Class probabilities of rows, as the model's column expressions give them."""
    if isinstance(model, LinearModel):
        z = x @ np.array(model.coef).T + np.array(model.intercept)
    else:
        z = np.tile(np.array(model.intercept, dtype=float), (len(x), 1))
        for j, f in enumerate(model.features):
            z += np.array(model.scores[f])[np.searchsorted(np.array(model.edges[f]), x[:, j], side="right")]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def normal_equations(model, bins: Bins, x: np.ndarray, cls: int, seed: list[int], n: int, first: bool) -> np.ndarray:
    """Weighted sums of products of (1, same-bin features, probability) over one chunk of samples."""
    drawn, values = bins.draw(np.random.default_rng(seed), n)
    if first:
        drawn[0], values[0] = bins.of(x[None])[0], x
    same = (drawn == bins.of(x[None])).astype(float)
    y = probabilities(model, values)[:, cls]
    width = 0.75 * np.sqrt(len(x))
    weight = np.sqrt(np.exp(-(1 - same).sum(axis=1) / width ** 2))
    full = np.column_stack([np.ones(n), same, y])
    return full.T @ (full * weight[:, None])


def solve(total: np.ndarray, num_features: int) -> tuple[list[tuple[int, float]], float]:
    """Chosen features with their weights, largest first, and the intercept, from summed normal equations."""
    sw, mean = total[0, 0], total[0] / total[0, 0]
    centred = total - sw * np.outer(mean, mean)
    xx, xy, yy, d = centred[1:-1, 1:-1], centred[1:-1, -1], centred[-1, -1], len(total) - 2

    def ridge(chosen: list[int], alpha: float) -> np.ndarray:
        a = xx[np.ix_(chosen, chosen)] + alpha * np.eye(len(chosen))
        return np.linalg.lstsq(a, xy[chosen], rcond=None)[0]

    if num_features <= 6:
        chosen: list[int] = []
        while len(chosen) < min(num_features, d):
            def left(i: int) -> float:
                some = chosen + [i]
                b = ridge(some, 0.0)
                return yy - 2 * b @ xy[some] + b @ xx[np.ix_(some, some)] @ b
            chosen.append(min((i for i in range(d) if i not in chosen), key=lambda i: (left(i), i)))
    else:
        rough = ridge(list(range(d)), 0.01)
        chosen = sorted(range(d), key=lambda i: (-abs(rough[i]), i))[:num_features]
    beta = ridge(chosen, 1.0)
    order = sorted(range(len(chosen)), key=lambda k: (-abs(beta[k]), chosen[k]))
    return [(chosen[k], float(beta[k])) for k in order], float(mean[-1] - mean[1:-1][chosen] @ beta)


def lime_batch(train: DataFrame, rows: DataFrame, ids: DataFrame, model, key: str, num_samples: int = 5000,
               num_features: int = 12, cls: int | None = None, seed: int = 42) -> DataFrame:
    """(key, class, rank, feature, weight, intercept) for each applicant in ``ids``."""
    feats = list(model.features)
    stats, cuts = quartile_bins(train, feats)
    bins = Bins(feats, stats.collect(), cuts)                            # features x 4 rows
    asked = score(rows.join(ids, key, "left_semi"), model, [key] + feats)
    kind = dict(asked.dtypes)[key]
    chunks = -(-num_samples // CHUNK)
    work = asked.select(key, (F.col("pred") if cls is None else F.lit(cls)).cast("int").alias("class"),
                        F.array(*[F.col(f).cast("double") for f in feats]).alias("x"),
                        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).repartition(key, "chunk")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = min(CHUNK, num_samples - r["chunk"] * CHUNK)
                sums = normal_equations(model, bins, np.array(r["x"]), r["class"],
                                        [seed, r["chunk"], zlib.crc32(str(r[key]).encode())], n, r["chunk"] == 0)
                yield pa.RecordBatch.from_arrays([pa.array([r[key]], batch.schema.field(0).type), pa.array([r["class"]], pa.int32()),
                                                  pa.array([sums.tobytes()], pa.binary())], names=[key, "class", "sums"])

    def finish(group: tuple, table: pa.Table) -> pa.Table:
        d = len(feats) + 2
        total = sum(np.frombuffer(s.as_buffer()).reshape(d, d) for s in table["sums"].combine_chunks())
        weights, intercept = solve(total, num_features)
        return pa.table([pa.array([table[key][0].as_py()] * len(weights), table.schema.field(key).type),
                         pa.array([table["class"][0].as_py()] * len(weights), pa.int32()),
                         pa.array(range(1, len(weights) + 1), pa.int32()), pa.array([feats[i] for i, _ in weights], pa.string()),
                         pa.array([w for _, w in weights], pa.float64()), pa.array([intercept] * len(weights), pa.float64())],
                        names=[key, "class", "rank", "feature", "weight", "intercept"])

    sums = work.mapInArrow(reduce, f"`{key}` {kind}, class int, sums binary")
    return sums.groupBy(key, "class").applyInArrow(
        finish, f"`{key}` {kind}, class int, rank int, feature string, weight double, intercept double")
