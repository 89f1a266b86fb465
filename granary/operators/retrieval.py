"""Nearest neighbours and retrieval metrics of a stated set of queries against all vectors, at nested sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.vectors import TINY
from granary.session import materialize, small

#: Queries and vectors that are multiplied with each other at a time.
BLOCK, SLICE = 2048, 1024


def matrix(col: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a matrix of doubles; lists of another length than the first are zero rows."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(np.asarray(col.offsets))
    width = dim or (int(n.max()) if len(n) else 0)
    if len(n) and (n == width).all() and col.null_count == 0:
        return np.asarray(col.flatten(), np.float64).reshape(len(n), width)
    return np.array([x if x is not None and len(x) == width else [0.0] * width for x in col.to_pylist()], np.float64).reshape(len(n), width)


def units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), TINY)


def _blocks(queries: DataFrame, key: str) -> Iterator[list]:
    n = max(1, -(-queries.count() // BLOCK))
    for b in range(n):
        if rows := queries.filter(F.pmod(F.xxhash64(F.lit(5), key), F.lit(n)) == b).orderBy(key).collect():
            yield rows


def stated(vectors: DataFrame, key: str = "vec_id", every: int = 100) -> DataFrame:
    """The stated queries: the rows whose id is divisible by `every`."""
    return vectors.filter(F.col(key) % every == 0)


def _all(parts: list[DataFrame], vectors: DataFrame, schema: str) -> DataFrame:
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_HITS = "dim int, query bigint, doc bigint, score double, same boolean, kind string"


def scan(vectors: DataFrame, dims: list[int], k: int, key: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 100) -> DataFrame:
    """(dim, query, doc, score, same, kind): per partition the k nearest other vectors of each query (kind 'near') and the nearest
    of its own label (kind 'own'), by cosine rounded to 9 digits, ties by id. Blocks of queries are broadcast; vectors stay."""
    parts = []
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    for block in _blocks(stated(rows, "id", every), "id"):
        ids, labels = np.array([r["id"] for r in block]), np.array([r["label"] for r in block], object)
        full = np.array([r["v"] for r in block], np.float64)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, labels, {d: units(full[:, :d]) for d in dims}))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, labels, queries = shared.value
            best: dict[tuple[int, str], list] = {}
            for b in (x.slice(i, SLICE) for x in batches for i in range(0, len(x), SLICE)):
                doc, m = b.column("id").to_numpy(), matrix(b.column("v"), None)
                same = labels[:, None] == np.array(b.column("label").to_pylist(), object)[None, :]
                other = ids[:, None] != doc[None, :]
                for d in dims:
                    s = np.round(queries[d] @ units(m[:, :d]).T, 9)
                    for kind, ok, n in (("near", other, k), ("own", other & same, 1)):
                        open_ = np.where(ok, s, -np.inf)
                        # of each row what is not under its n-th highest: n, or more only where scores are equal
                        bar = np.partition(open_, -n, axis=1)[:, -n] if open_.shape[1] > n else np.full(len(ids), -np.inf)
                        q, j = np.nonzero(ok & (open_ >= bar[:, None]))
                        old = best.get((d, kind))
                        q, dd, sc, sm = q, doc[j], s[q, j], same[q, j]
                        if old:
                            q, dd, sc, sm = (np.concatenate(x) for x in zip(old, (q, dd, sc, sm)))
                        order = np.lexsort((dd, -sc, q))
                        q, dd, sc, sm = q[order], dd[order], sc[order], sm[order]
                        keep = np.arange(len(q)) - np.searchsorted(q, q) < n
                        best[d, kind] = [q[keep], dd[keep], sc[keep], sm[keep]]
            for (d, kind), (q, dd, sc, sm) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), d, np.int32)), pa.array(ids[q]), pa.array(dd), pa.array(sc), pa.array(sm.astype(bool)), pa.array([kind] * len(q), pa.string())], names=["dim", "query", "doc", "score", "same", "kind"])

        parts.append(rows.mapInArrow(near, _HITS))
    return _all(parts, vectors, _HITS)


def neighbours(hits: DataFrame, k: int) -> DataFrame:
    """(dim, query, rank, doc, score, same): the k nearest of each query over all partitions."""
    w = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "doc")
    return hits.filter("kind = 'near'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("kind")


def first_relevant(vectors: DataFrame, hits: DataFrame, dims: list[int], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(dim, query, first): the place of each query's first vector of its own label among all others: 1 + those that come before it."""
    w = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "doc")
    own = materialize(hits.filter("kind = 'own'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("dim", "query", "doc", "score"), "own")
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    queries = rows.join(small(own.select(F.col("query").alias("id")).distinct()), "id", "left_semi")
    parts = []
    for block in _blocks(queries, "id"):
        ids = np.array([r["id"] for r in block])
        full = np.array([r["v"] for r in block], np.float64)
        asked = own.join(F.broadcast(vectors.sparkSession.createDataFrame([(int(i),) for i in ids], "query bigint")), "query").collect()
        place = {q: i for i, q in enumerate(ids.tolist())}
        bar = {d: (np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)) for d in dims}
        for r in asked:
            if r["query"] in place:
                bar[r["dim"]][0][place[r["query"]]], bar[r["dim"]][1][place[r["query"]]] = r["score"], r["doc"]
        shared = vectors.sparkSession.sparkContext.broadcast((ids, {d: units(full[:, :d]) for d in dims}, bar))

        def before(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, queries, bar = shared.value
            n = {d: np.zeros(len(ids), np.int64) for d in dims}
            for b in (x.slice(i, SLICE) for x in batches for i in range(0, len(x), SLICE)):
                doc, m = b.column("id").to_numpy(), matrix(b.column("v"), None)
                other = ids[:, None] != doc[None, :]
                for d in dims:
                    s = np.round(queries[d] @ units(m[:, :d]).T, 9)
                    score, at = bar[d][0][:, None], bar[d][1][:, None]
                    n[d] += (other & ((s > score) | ((s == score) & (doc[None, :] < at)))).sum(1)
            for d in dims:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), d, np.int32)), pa.array(ids), pa.array(n[d])], names=["dim", "query", "n"])

        parts.append(rows.mapInArrow(before, "dim int, query bigint, n bigint"))
    counted = _all(parts, vectors, "dim int, query bigint, n bigint").groupBy("dim", "query").agg((F.sum("n") + 1).alias("first"))
    return counted.join(own.select("dim", "query"), ["dim", "query"], "left_semi")


def metrics(vectors: DataFrame, dims: list[int], k: int = 10, key: str = "vec_id", label: str = "label", every: int = 100, empty_mrr: float = 0.0) -> DataFrame:
    """(dim, n_queries, n_without, p, ndcg, mrr, chance): precision and nDCG at k, and mean reciprocal rank over the whole ranking.

    Relevant are the other vectors of the query's label. nDCG is binary with the ideal of min(relevant, k). A query without a
    relevant vector counts 0 in all (`empty_mrr` as its reciprocal rank); n_without is their number."""
    hits = materialize(scan(vectors, dims, k, key, label, every=every), "hits")
    near = neighbours(hits, k)
    queries = stated(vectors, key, every).filter("embedding is not null").select(F.col(key).alias("query"), F.col(label).alias("_l"))
    sizes = vectors.filter("embedding is not null").groupBy(F.col(label).alias("_l")).agg((F.count("*") - 1).alias("n_rel"))
    total = vectors.filter("embedding is not null").count()
    asked = queries.join(small(sizes), "_l", "left").select("query", F.coalesce("n_rel", F.lit(0)).alias("n_rel"))
    gain = 1 / F.log2(F.col("rank") + 1)
    got = near.groupBy("dim", "query").agg(F.sum(F.col("same").cast("int")).alias("hits"), F.sum(F.when(F.col("same"), gain).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    per = got.join(asked, "query").join(first_relevant(vectors, hits, dims, key), ["dim", "query"], "left")
    none = F.col("n_rel") == 0
    return per.groupBy("dim").agg(
        F.count("*").alias("n_queries"),
        F.sum(none.cast("int")).alias("n_without"),
        F.round(F.avg(F.col("hits") / k), 9).alias("p"),
        F.round(F.avg(F.when(none, 0.0).otherwise(F.col("dcg") / F.when(~none, ideal))), 9).alias("ndcg"),
        F.round(F.avg(F.when(none, F.lit(empty_mrr)).otherwise(1 / F.col("first"))), 9).alias("mrr"),
        F.round(F.avg(F.col("n_rel") / (total - 1)), 9).alias("chance"),
    )


def at_k(near: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """(dim, k, recall, precision, accuracy, mrr): of ranked neighbours (dim, query, rank, same), with `relevant` (query, n_rel)."""
    r = near.join(small(relevant), "query").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(F.col("rank") <= F.col("k"))
    hit = F.col("same").cast("int")
    q = r.groupBy("dim", "k", "query").agg(F.sum(hit).alias("hits"), F.max("n_rel").alias("n_rel"), F.min(F.when(F.col("same"), F.col("rank"))).alias("first"))
    mean = lambda c: F.round(F.avg(c), 9)
    return q.groupBy("dim", "k").agg(mean(F.when(F.col("n_rel") > 0, F.col("hits") / F.col("n_rel")).otherwise(0.0)).alias("recall"), mean(F.col("hits") / F.col("k")).alias("precision"), mean(F.col("first").isNotNull().cast("double")).alias("accuracy"), mean(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def retention(metric: DataFrame, value: str, small_dim: int, full_dim: int) -> DataFrame:
    """One row: a metric at the small size, at the full size, and their ratio."""
    at = lambda d: F.max(F.when(F.col("dim") == d, F.col(value)))
    return metric.agg(at(small_dim).alias("at_small"), at(full_dim).alias("at_full")).withColumn("retention", F.round(F.col("at_small") / F.col("at_full"), 9))


def pivoted(metric: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A matrix of tasks by sizes; the sizes are given, so that no pass looks for them."""
    return metric.groupBy(row).pivot(column, columns).agg(F.first(value))


def macro_average(metric: DataFrame, by: str, value: str, baselines: DataFrame | None = None) -> DataFrame:
    """(by, average, place): the unweighted mean over tasks, ranked with the baselines."""
    mean = metric.groupBy(by).agg(F.round(F.avg(value), 9).alias("average"))
    mean = mean if baselines is None else mean.unionByName(baselines)
    return mean.withColumn("place", F.rank().over(Window.orderBy(F.desc("average"))))  # one row per system


def lift(metrics: DataFrame, metric: str = "p") -> DataFrame:
    """(dim, lift): a metric over that of a random order (`chance`)."""
    return metrics.select("dim", (F.col(metric) / F.col("chance")).alias("lift"))
