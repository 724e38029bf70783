"""Logistic fits by Newton steps: per step one job adds up losses, gradients and Hessians of many problems at once.

A task multiplies its Arrow batches and returns a few hundred sums whatever its rows, Spark adds them up, and the driver
solves one small system per problem.  Problems share the rows and differ in the fold they leave out, the class weights and
the penalty; each is damped and stopped on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A fit ends when no entry of the mean gradient exceeds this, or when a full step moves no weight by more.
TOLERANCE = 1e-10
#: Rows multiplied at once.
ROWS = 8192


@dataclass(frozen=True)
class Problem:
    """Fit on the rows outside a fold (None: on all rows), classes weighted, penalty / 2 times the squared weights."""
    fold: int | None
    weight_of_0: float
    weight_of_1: float
    penalty: float


@dataclass(frozen=True)
class Fit:
    """Weights, the intercept last."""
    weights: list[float]
    steps: int
    converged: bool


def summed(rows: DataFrame, per_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of per_block(matrix of so many rows, one column per column of rows), a vector."""
    def run(batches):
        import pyarrow as pa
        total = None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                block = whole.slice(at, ROWS)
                part = per_block(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in block.columns], 1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["k", "s"])

    sums = rows.mapInArrow(run, "k int, s double").groupBy("k").agg(F.expr("sum(s) AS s")).collect()
    out = np.zeros(len(sums))
    for r in sums:
        out[r["k"]] = r["s"]
    return out


def logistic_sums(x: np.ndarray, target: np.ndarray, weight: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper Hessian of each problem, one after the other.

    x is rows x p, target and weight are rows x problems (a weight of 0 leaves a row out), b is problems x p.
    """
    z = x @ b.T
    p = 1.0 / (1.0 + np.exp(-np.abs(z)))
    p = np.where(z >= 0, p, 1.0 - p)
    loss = (weight * (np.logaddexp(0.0, z) - target * z)).sum(0)
    gradient = (weight * (p - target)).T @ x
    curve = weight * p * (1.0 - p)
    upper = np.triu_indices(x.shape[1])
    return np.concatenate([np.concatenate([[loss[j]], gradient[j], ((x * curve[:, j:j + 1]).T @ x)[upper]]) for j in range(len(b))])


def newton(evaluate: Callable[[np.ndarray], np.ndarray], problems: int, p: int, penalty: np.ndarray, scale: np.ndarray,
           most_steps: int, tolerance: float = TOLERANCE) -> list[Fit]:
    """Minimise all problems from 0.  evaluate(b) returns logistic_sums; penalty is problems x p; scale divides gradients.

    A step that raises a problem's loss is halved until it does not; a problem that is done keeps its weights.
    """
    upper, size = np.triu_indices(p), 1 + p + p * (p + 1) // 2
    b, step = np.zeros((problems, p)), np.zeros((problems, p))
    best = np.full(problems, np.inf)
    done, taken = np.zeros(problems, bool), np.zeros(problems, int)
    kept = b.copy()
    for _ in range(most_steps + 1):
        sums = evaluate(b).reshape(problems, size)
        for j in np.flatnonzero(~done):
            loss = sums[j, 0] + 0.5 * float(penalty[j] @ b[j] ** 2)
            if not loss <= best[j] + 1e-12 * abs(best[j]):
                step[j] /= 2.0
                if np.abs(step[j]).max() <= tolerance * (1.0 + np.abs(kept[j]).max()):
                    b[j], done[j] = kept[j], True
                else:
                    b[j] = kept[j] + step[j]
                continue
            best[j], kept[j] = min(loss, best[j]), b[j]
            gradient = sums[j, 1:1 + p] + penalty[j] * b[j]
            if np.abs(gradient).max() <= tolerance * scale[j]:
                done[j] = True
                continue
            hessian = np.zeros((p, p))
            hessian[upper] = sums[j, 1 + p:]
            hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty[j])
            step[j] = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            if np.abs(step[j]).max() <= tolerance * (1.0 + np.abs(b[j]).max()):
                done[j] = True
                continue
            b[j], taken[j] = b[j] + step[j], taken[j] + 1
        if done.all():
            break
    return [Fit([float(v) for v in kept[j]], int(taken[j]), bool(done[j])) for j in range(problems)]


def fit_logistic(rows: DataFrame, columns: Sequence[str], problems: Sequence[Problem], most_steps: int = 100) -> list[Fit]:
    """One fit per problem over rows with y, columns and, where a problem leaves one out, fold; intercepts go unpenalised.

    Rows with a NULL or NaN in any of these are an error: their sums would be NaN.
    """
    folds = np.array([-1 if q.fold is None else q.fold for q in problems])
    w0, w1 = (np.array([getattr(q, name) for q in problems]) for name in ("weight_of_0", "weight_of_1"))
    fold = "fold" if any(q.fold is not None for q in problems) else "-2"
    own = rows.selectExpr("y", f"int({fold}) AS fold", *columns)

    def evaluate(b: np.ndarray) -> np.ndarray:
        def block(m: np.ndarray) -> np.ndarray:
            y = m[:, :1]
            weight = np.where(m[:, 1:2] == folds, 0.0, np.where(y == 1.0, w1, w0))
            return logistic_sums(np.column_stack([m[:, 2:], np.ones(len(m))]), y, weight, b)
        sums = summed(own, block)
        if not np.isfinite(sums).all():
            raise ValueError("a feature or label of the rows to fit is NULL, NaN or infinite")
        return sums

    p = len(columns) + 1
    penalty = np.array([[q.penalty] * len(columns) + [0.0] for q in problems])
    # the weights of a problem add up to about its rows: the gradient's unit
    n = summed(own, lambda m: np.where(m[:, 1:2] == folds, 0.0, np.where(m[:, :1] == 1.0, w1, w0)).sum(0))
    return newton(evaluate, len(problems), p, penalty, np.maximum(n, 1.0), most_steps)


def held_out_counts(rows: DataFrame, columns: Sequence[str], weights: Sequence[Sequence[float]], folds: Sequence[int]) -> list[tuple]:
    """(hits of 1, hits of 0, errors) of each model on the rows of its fold, all in one job."""
    b, of = np.array(weights), np.array(folds)

    def block(m: np.ndarray) -> np.ndarray:
        up = np.column_stack([m[:, 2:], np.ones(len(m))]) @ b.T > 0
        y, own = m[:, :1] == 1.0, m[:, 1:2] == of
        return np.concatenate([(own & y & up).sum(0), (own & ~y & ~up).sum(0), (own & (y != up)).sum(0)]).astype(float)

    sums = summed(rows.selectExpr("y", "fold", *columns), block).reshape(3, len(of))
    return [tuple(float(v) for v in sums[:, j]) for j in range(len(of))]


def soft_targets(positives: int, negatives: int) -> tuple[float, float]:
    """What a calibration aims at for rows of class 1 and of class 0."""
    return (positives + 1.0) / (positives + 2.0), 1.0 / (negatives + 2.0)


def fit_sigmoids(rows: DataFrame, columns: Sequence[str], weights: Sequence[Sequence[float]], targets: Sequence[tuple[float, float]],
                 most_steps: int = 100) -> list[Fit]:
    """Slope and offset of a sigmoid over each fold model's margins on its own fold, against soft targets; all folds per job."""
    b, folds = np.array(weights), np.arange(len(weights))
    high, low = (np.array(t) for t in zip(*targets))
    own = rows.selectExpr("y", "fold", *columns)

    def evaluate(ab: np.ndarray) -> np.ndarray:
        def block(m: np.ndarray) -> np.ndarray:
            mine = m[:, 1].astype(int)
            margin = (np.column_stack([m[:, 2:], np.ones(len(m))]) * b[mine]).sum(1)
            target = np.where(m[:, :1] == 1.0, high, low)
            return logistic_sums(np.column_stack([margin, np.ones(len(m))]), target, (m[:, 1:2] == folds).astype(float), ab)
        return summed(own, block)

    n = summed(own, lambda m: (m[:, 1:2] == folds).sum(0).astype(float))
    return newton(evaluate, len(folds), 2, np.zeros((len(folds), 2)), np.maximum(n, 1.0), most_steps)
