"""Mixing to target weights with soft membership.

A classifier trained on the labelled table gives each document a posterior over domains. Document i with t_i words and
posterior p_i adds r_i t_i p_i to the expected words of the domains. Projected-gradient least squares fits nonnegative rates r, as near
to one as can be (squares weighted by words), whose totals match the targets. A step moves all rates against the gradient,
r_i = max(0, 1 + p_i u) with u changed by the residual of the K totals, and is preconditioned by the K x K moment matrix of the rows
with a rate above zero, without which rare domains would take thousands of steps. Its length is the best of a few that one pass
tries. So an iteration is one distributed sum of a few times K x K numbers, and no rate is stored or collected: each row's rate follows
from u. Iterations end when the totals are within the tolerance, or when no step gets nearer: then no rates reach the targets,
and of the fits as near as the nearest (to the tolerance) the one with rates nearest to one is taken; a warning gives the miss.

The default total keeps the words of the first domain as they are. With `thin`, no rate is above one: documents are only thinned
out, the targets are bounds on the shares of all domains but the first, and only domains over their share lose words (`thinned`).
Texts are classified once; posterior and word count are written beside the rows, and rates are plain column expressions.

A rate within `snap` of a whole number counts as that number; other rates are rounded up or down by a hash of the row, so expected
copies equal the rate to `snap`.

Defined cases: null and empty texts have no words; they have the rate of their posterior and change no total. Repeated rows
are rows of their own and round alike. No labels: all posteriors are equal, nothing is known, and all
rates are one. An empty table gives an empty result. Extra
columns are kept (internal names start with `_mx_`); input columns named like an output are replaced.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, bounded_batches, chunks, text_bytes, written
from .subword import labelled_sample, train

CHUNK = 2_000_000
DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.92, "low": 0.05, "toxic": 0.03}


def domain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and label: 2 for toxic, else 1 for low quality, else 0; null for anything else."""
    return labels.select(id_col, F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("label"))


def _judged(model, text: str, keep: bool):
    """Rows with n (words) and p (posterior), with or without their text."""

    def run(batches):
        for table in chunks(batches, text, CHUNK):
            data, off = text_bytes(table[text])
            n = Words(data, off, hashes=False).counts
            p = model.value.probabilities(table[text])
            t = (table if keep else table.drop_columns([text])).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], [*t.schema.names, "_mx_n", "_mx_p"])

    return run


def rates_of(p: np.ndarray, u: np.ndarray, most: float = np.inf) -> np.ndarray:
    """The projected point: 1 + p u between 0 and `most`."""
    return np.clip(1 + p @ u, 0, most)


#: Lengths of a step that one pass tries.
_TRIES = (1.0, 0.5, 0.25, 0.0625, 0.0078125)


def _totals(points: np.ndarray, features, most: float):
    """For each u in points: sums of t h(1 + q u) (h is the integral of the projection), of t r q and of t q q over rows strictly inside the bounds."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n").to_numpy().astype(float)
                q = features(batch.column("p").flatten().to_numpy().reshape(batch.num_rows, -1))
                out = []
                for u in points:
                    z = 1 + q @ u
                    r = np.clip(z, 0, most)
                    inside = (z > 0) & (z <= most)
                    y = q[inside]
                    out += [[(n * (r * r / 2 + r * np.maximum(z - r, 0))).sum()], (r * n) @ q, ((y * n[inside, None]).T @ y).ravel()]
                yield pa.record_batch([pa.array([np.concatenate(out).tolist()], pa.list_(pa.float64()))], names=["s"])

    return run


def _summed(table: DataFrame, points: np.ndarray, features, most: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    k = points.shape[1]
    size = 1 + k + k * k
    rows = table.mapInArrow(_totals(points, features, most), "s array<double>")
    got = np.array([x or 0.0 for x in rows.agg(*[F.sum(F.col("s")[i]) for i in range(size * len(points))]).first()]).reshape(len(points), size)
    return [(g[0], g[1 : 1 + k], g[1 + k :].reshape(k, k)) for g in got]


def _steps(table: DataFrame, start, target: np.ndarray, enough: float, ridge: float, features, most: float):
    """u, its totals and their miss, where sum t h - u target + ridge u^2 / 2 is least, or the first within `enough`."""
    u, (value, now, h) = np.zeros(len(target)), start
    while np.abs(now - target).sum() > enough and np.abs(now - target + ridge * u).sum() > enough / 1000:
        step = np.linalg.solve(h + ridge * np.eye(len(u)), target - now - ridge * u)
        points = np.array([u + a * step for a in _TRIES])
        tried = _summed(table, points, features, most)
        heights = [v - target @ x + ridge / 2 * x @ x for x, (v, _, _) in zip(points, tried, strict=True)]
        best, height = int(np.argmin(heights)), value - target @ u + ridge / 2 * u @ u
        if not heights[best] < height - 1e-13 * abs(height):
            break
        u, (value, now, h) = points[best], tried[best]
    return u, now, np.abs(now - target).sum()


def _same(p: np.ndarray) -> np.ndarray:
    return p


def fit_rates(posteriors: DataFrame, weights: np.ndarray, total: float | None = None, tolerance: float = 2e-3):
    """(u, target totals, fitted totals) for a table of n (words) and p (posterior); rates are max(0, 1 + p u)."""
    k = len(weights)
    start = _summed(posteriors, np.zeros((1, k)), _same, np.inf)[0]
    now, h = start[1:]
    target = weights * (total if total is not None else (now[0] / weights[0] if weights[0] > 0 else now.sum()))
    if np.linalg.eigvalsh(h)[-1] <= 0:
        return np.zeros(k), target, now
    enough = tolerance * target.sum()
    u, now, miss = _steps(posteriors, start, target, enough, 1e-9 * np.trace(h), _same, np.inf)
    if miss > enough:  # out of reach: of the fits that come as near, the one whose rates are nearest to one
        for power in range(1, 9):
            other = _steps(posteriors, start, target, enough, 10.0**-power * np.trace(h), _same, np.inf)
            if other[2] <= miss + enough:
                u, now, miss = other
                break
    if miss > enough:
        warnings.warn(f"no rates reach the target mixture: totals {now.round(1).tolist()} for targets {target.round(1).tolist()}, {miss / target.sum():.1%} off", RuntimeWarning, stacklevel=2)
    return u, target, now


def _over(weights: np.ndarray, which: tuple[int, ...]):
    """What a word of posterior p adds to each domain's excess over its share beside the first domain."""

    def features(p: np.ndarray) -> np.ndarray:
        return p[:, which] * weights[0] - p[:, :1] * weights[list(which)]

    return features


def thinned(posteriors: DataFrame, weights: np.ndarray, tolerance: float = 2e-3):
    """(u over all domains, fitted totals) of rates min(1, max(0, 1 + p u)) nearest to one, with which no domain but the first has
    more than weights[k] / weights[0] times the words of the first. Domains under that are left as they are."""
    k = len(weights)
    totals = _summed(posteriors, np.zeros((1, k)), _same, 1.0)[0][1]
    which = tuple(i for i in range(1, k) if totals[i] * weights[0] > totals[0] * weights[i])
    u = np.zeros(k)
    while which:
        features = _over(weights, which)
        start = _summed(posteriors, np.zeros((1, len(which))), features, 1.0)[0]
        v, now, miss = _steps(posteriors, start, np.zeros(len(which)), tolerance * weights[0] * totals.sum(), 1e-9 * max(1e-300, np.trace(start[2])), features, 1.0)
        u = np.zeros(k)
        for i, x in zip(which, v, strict=True):
            u[i] += x * weights[0]
            u[0] -= x * weights[i]
        if miss > tolerance * weights[0] * totals.sum():
            warnings.warn(f"thinning out leaves domains over their share, by {now.round(1).tolist()} words", RuntimeWarning, stacklevel=2)
        left = tuple(i for i, x in zip(which, v, strict=True) if x < 0)  # a multiplier above 0 would thin out others to raise this one
        if left == which:
            break
        which, u = left, np.zeros(k)
    return u, _summed(posteriors, u[None, :], _same, 1.0)[0][1]


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text: str = "text", id_col: str = "doc_id", sample_rows: int = 6000, snap: float = 0.05, thin: bool = False, keep_text: bool = True) -> DataFrame:
    """docs (without text, if not `keep_text`) with domain (the likeliest), posterior, n_words, rate and copies (the rate as a whole number)."""
    targets = targets or TARGETS
    docs = docs.drop("domain", "posterior", "n_words", "rate", "copies")
    bounded_batches(docs.sparkSession)
    weights = np.array([targets[d] for d in DOMAINS])
    weights = weights / weights.sum()
    texts, marks = labelled_sample(docs, domain_labels(labels, id_col), sample_rows, id_col, text, classes=len(DOMAINS))
    model = docs.sparkSession.sparkContext.broadcast(train(texts, marks, len(DOMAINS), rate=6.0, epochs=12, seed=2))
    keyed = docs.withColumn("_mx_u", (F.pmod(F.xxhash64(id_col, text, F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))))
    fields = [f for f in keyed.schema.fields if keep_text or f.name != text]
    judged = written(keyed.mapInArrow(_judged(model, text, keep_text), StructType([*fields, *StructType.fromDDL("_mx_n long, _mx_p array<double>").fields])))
    model.destroy()
    table = judged.select(F.col("_mx_n").alias("n"), F.col("_mx_p").alias("p"))
    if not len(marks):
        u = np.zeros(len(weights))
    else:
        u = thinned(table, weights)[0] if thin else fit_rates(table, weights)[0]
    point = sum((F.col("_mx_p")[k] * F.lit(float(x)) for k, x in enumerate(u)), F.lit(1.0))
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), point) if thin else point)
    whole = F.round("rate").cast("long")
    copies = F.when(F.abs(F.col("rate") - whole) <= snap, whole).otherwise(F.floor(F.col("rate") + F.col("_mx_u")))
    domain = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.array_position("_mx_p", F.array_max("_mx_p")).cast("int"))
    out = judged.withColumns({"domain": domain, "posterior": F.col("_mx_p"), "n_words": F.col("_mx_n"), "rate": rate}).withColumn("copies", copies)
    return out.drop("_mx_u", "_mx_n", "_mx_p")
