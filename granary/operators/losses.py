"""Losses of given vectors, per batch. A batch has a bounded number of rows, and is one matrix in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.vectors import cosine
from granary.operators.ranges import ranked
from granary.operators.retrieval import matrix, units


def batches(rows: DataFrame, order: list, size: int) -> DataFrame:
    """Adds batch_no and slot (from 0): consecutive rows in order, `size` a batch; a short last batch is dropped."""
    r = ranked(rows, order, "_n").withColumn("batch_no", F.expr(f"(_n - 1) div {size}")).withColumn("slot", F.expr(f"cast((_n - 1) % {size} as int)"))
    return r.filter(F.col("batch_no") < rows.count() // size).drop("_n")


def _each(rows: DataFrame, f, names: list[str]) -> DataFrame:
    """f(table of one batch, in the order of slots) gives one number per name."""

    def one(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(parts)).sort_by("slot")
        values = f(t)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), *(pa.array([float(v)]) for v in values)], names=["batch_no", *names])

    return rows.groupBy("batch_no").applyInArrow(one, "batch_no bigint, " + ", ".join(f"{n} double" for n in names))


def _log_softmax(s: np.ndarray) -> np.ndarray:
    top = s.max(1, keepdims=True)
    return s - top - np.log(np.exp(s - top).sum(1, keepdims=True))


def relational(rows: DataFrame, student: str, teacher: str, tau: float = 0.05, w_kl: float = 1.0, w_mse: float = 10.0, dims: list[int] | None = None) -> DataFrame:
    """(batch_no, kl, mse, loss): how far the similarities within a batch are from the teacher's; a row's similarity to itself is left
    out. With `dims` the mean over these nested sizes of the student's vectors."""

    def f(t: pa.Table) -> tuple[float, ...]:
        m, g = matrix(t.column(student)), units(matrix(t.column(teacher)))
        return tuple(np.mean([one(units(m[:, :d]), g) for d in dims or [m.shape[1]]], axis=0))

    def one(s: np.ndarray, g: np.ndarray) -> tuple[float, float, float]:
        ss, st = s @ s.T, g @ g.T
        off = ~np.eye(len(ss), dtype=bool)
        a, b = _log_softmax(np.where(off, ss / tau, -1e4)), _log_softmax(np.where(off, st / tau, -1e4))
        kl = (np.exp(b) * (b - a))[off].sum() / len(ss)
        mse = ((ss - st)[off] ** 2).mean()
        return kl, mse, w_kl * kl + w_mse * mse

    return _each(rows, f, ["kl", "mse", "loss"])


def margin_mse(rows: DataFrame, query: str, positive: str, negative: str, teacher: str) -> DataFrame:
    """One row: n, the mean margin (cosine to the positive less that to the negative), and the mean square of its distance from the teacher's."""
    q, p, n = F.col(query), F.col(positive), F.col(negative)
    m = rows.select((cosine(q, p) - cosine(q, n)).alias("m"), F.col(teacher).alias("t"))
    return m.agg(F.count("*").alias("n"), F.avg("m").alias("mean_margin"), F.avg(F.pow(F.col("m") - F.col("t"), 2)).alias("margin_mse"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(batch_no, rho): rank correlation of the similarities off the diagonal under two vectors of each row, ties in order of place."""

    def f(t: pa.Table) -> tuple[float]:
        off = ~np.eye(len(t), dtype=bool)
        ranks = [np.argsort(np.argsort(np.round((units(matrix(t.column(c))) @ units(matrix(t.column(c))).T)[off], 9), kind="stable"), kind="stable") for c in (a, b)]
        x, y = (r - r.mean() for r in ranks)
        return (float(x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-12)),)

    return _each(rows, f, ["rho"])


def gist_infonce(rows: DataFrame, query: str, positive: str, guide_q: str, guide_p: str, dims: list[int], tau: float = 0.02, margin: float = 0.0) -> DataFrame:
    """(batch_no, loss, masked): in-batch contrastive loss averaged over nested sizes; candidates that the guide finds closer than the own positive, less the margin, are no negatives."""

    def f(t: pa.Table) -> tuple[float, float]:
        g = units(matrix(t.column(guide_q))) @ units(matrix(t.column(guide_p))).T
        mask = g > np.diag(g)[:, None] - margin
        np.fill_diagonal(mask, False)
        q, p = matrix(t.column(query)), matrix(t.column(positive))
        each = []
        for d in dims:
            s = np.where(mask, -np.inf, units(q[:, :d]) @ units(p[:, :d]).T / tau)
            each.append(-np.diag(_log_softmax(s)).mean())
        return float(np.mean(each)), float(mask.sum())

    return _each(rows, f, ["loss", "masked"])


def sparse_infonce(rows: DataFrame, query: str, positive: str, tau: float = 0.02) -> DataFrame:
    """(batch_no, ce, flops, nnz): contrastive loss of sparse non-negative vectors by dot product over the root of their size, the FLOPS measure, and the mean number of weights over 0."""

    def f(t: pa.Table) -> tuple[float, float, float]:
        q, p = matrix(t.column(query)), matrix(t.column(positive))
        ce = -np.diag(_log_softmax(q @ p.T / np.sqrt(q.shape[1]) / tau)).mean()
        return ce, (q.mean(0) ** 2).sum() + (p.mean(0) ** 2).sum(), ((q > 0).sum() + (p > 0).sum()) / (2 * len(q))

    return _each(rows, f, ["ce", "flops", "nnz"])
