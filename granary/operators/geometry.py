"""Geometry of a table of vectors, from sums over coordinates: no pair of vectors is ever formed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.vectors import doubles, unit
from granary.operators.retrieval import matrix, units
from granary.session import materialize

#: Classes whose sums a task holds before it hands them on.
HELD = 4096
#: Classes whose centroids may be broadcast.
MAX_CLASSES = 100_000


def coordinates(vectors: DataFrame, *keep: str, vector: str = "embedding", normalise: bool = False) -> DataFrame:
    """(keep, pos, x): one row per coordinate, positions from 0."""
    v = unit(F.col(vector)) if normalise else doubles(F.col(vector))
    return vectors.select(*keep, F.posexplode(v).alias("pos", "x"))


def mean_pairwise_cosine(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: n and the mean cosine of all pairs of different rows, (|sum of unit vectors|² - n) / (n (n - 1)). Null under two rows."""
    sums = coordinates(vectors, vector=vector, normalise=True).groupBy("pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("c"))
    t = sums.agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("c").alias("n"))
    return t.select("n", F.round(F.when(F.col("n") > 1, (F.col("s2") - F.col("q")) / (F.col("n") * (F.col("n") - 1))), 9).alias("mean_cosine"))


def variances(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(pos, variance): the variance of each coordinate, by n."""
    return coordinates(vectors, vector=vector).groupBy("pos").agg(F.var_pop("x").alias("variance"))


def nesting(var: DataFrame, dims: list[int]) -> DataFrame:
    """(k, var_fraction, concentration): the share of the variance in the first k coordinates, and that over k / D. One row per coordinate goes in."""
    run = var.withColumn("_c", F.sum("variance").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    share = F.col("_c") / var.agg(F.sum("variance")).scalar()
    at = run.withColumn("k", F.col("pos") + 1).filter(F.col("k").isin(dims)).select("k", share.alias("s"), var.agg(F.count("*")).scalar().alias("d"))
    return at.select("k", F.round("s", 9).alias("var_fraction"), F.round(F.col("s") / (F.col("k") / F.col("d")), 9).alias("concentration"))


def gini(var: DataFrame) -> DataFrame:
    """One row: the Gini coefficient of the coordinates' variances, 0 if all are equal."""
    r = var.withColumn("i", F.row_number().over(Window.orderBy("variance", "pos")))  # one row per coordinate
    t = r.agg(F.sum(F.col("i") * F.col("variance")).alias("a"), F.sum("variance").alias("b"), F.count("*").alias("n"))
    return t.select("n", F.round(2 * F.col("a") / (F.col("n") * F.col("b")) - (F.col("n") + 1) / F.col("n"), 9).alias("gini"))


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, pos, c): the mean vector of each class, one row per coordinate. Each task adds up its own vectors per class first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s, _ in sums.values()], pa.list_(pa.float64())), pa.array([n for _, n in sums.values()])], names=["label", "s", "n"])

        for b in batches:
            m, names = matrix(b.column(1)), np.array(b.column(0).to_pylist(), object)
            known = dict.fromkeys(names.tolist())
            place = {x: i for i, x in enumerate(known)}
            of = np.array([place[x] for x in names.tolist()], np.int64)
            order = np.argsort(of, kind="stable")
            total = np.add.reduceat(m[order], np.flatnonzero(np.r_[True, np.diff(of[order]) > 0])) if len(of) else m
            for name, t, c in zip(known, total, np.bincount(of)):
                s, n = sums.get(name, (0, 0))
                sums[name] = s + t, n + int(c)
            if len(sums) > HELD:
                yield out()
                sums.clear()
        if sums:
            yield out()

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(label).cast("string").alias("label"), doubles(F.col(vector)).alias("v"))
    parts = rows.mapInArrow(add, "label string, s array<double>, n bigint").select(F.col("label").cast(vectors.schema[label].dataType).alias(label), "n", F.posexplode("s").alias("pos", "x"))
    return parts.groupBy(label, "pos").agg((F.sum("x") / F.sum("n")).alias("c"))


def _by_centroid(vectors: DataFrame, cents: DataFrame, label: str, key: str, vector: str, kind: str, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(key, label, value): `of` (vectors, the place of each one's class, centroids) per Arrow batch, with the centroids broadcast.
    Vectors without a label are left out."""
    rows = cents.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("v")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    shared = vectors.sparkSession.sparkContext.broadcast(({r["label"]: i for i, r in enumerate(rows)}, np.array([r["v"] for r in rows], np.float64)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, c = shared.value
        for b in batches:
            own = np.array([place[x] for x in b.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of(matrix(b.column(2), c.shape[1]), own, c))], names=["k", "label", "value"])

    v = vectors.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("string").alias("label"), doubles(F.col(vector)).alias("v"))
    return v.mapInArrow(each, f"k {v.schema['k'].dataType.simpleString()}, label string, value {kind}").select(F.col("k").alias(key), F.col("label").cast(vectors.schema[label].dataType).alias(label), "value")


def centroid_pairs(cents: DataFrame, label: str = "label") -> DataFrame:
    """(a, b, cosine, distance) for each two classes, a before b. Classes are few; coordinates join on their position."""
    a, b = cents.select(F.col(label).alias("a"), "pos", F.col("c").alias("x")), cents.select(F.col(label).alias("b"), "pos", F.col("c").alias("y"))
    j = a.join(b, "pos").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.pow(F.col("x") - F.col("y"), 2)).alias("dd"))
    return j.select("a", "b", F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 9).alias("cosine"), F.round(F.sqrt("dd"), 9).alias("distance"))


def fisher(vectors: DataFrame, label: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: n_classes, within (mean over classes of the mean distance to the centroid), between (mean distance of two centroids), fisher = between / within."""
    c = materialize(centroids(vectors, label, vector), "centroids")
    d = _by_centroid(vectors, c, label, key, vector, "double", lambda m, own, cents: np.linalg.norm(m - cents[own], axis=1)).withColumnRenamed("value", "d")
    within = d.groupBy(label).agg(F.avg("d").alias("d")).agg(F.avg("d").alias("within"), F.count("*").alias("n_classes"))
    both = within.select("n_classes", "within", centroid_pairs(c, label).agg(F.avg("distance")).scalar().alias("between"))
    return both.select("n_classes", F.round("within", 8).alias("within"), F.round("between", 8).alias("between"), F.round(F.col("between") / F.greatest("within", F.lit(1e-9)), 8).alias("fisher"))


def centroid_ranks(vectors: DataFrame, label: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, label, rank): the competition rank of each vector's own class among all classes, by cosine to their centroids: one
    matrix product per Arrow batch."""

    def ranks(m: np.ndarray, own: np.ndarray, cents: np.ndarray) -> np.ndarray:
        s = np.round(m @ units(cents).T, 9)
        return (s > s[np.arange(len(own)), own][:, None]).sum(1) + 1

    c = materialize(centroids(vectors, label, vector), "centroids")
    return _by_centroid(vectors, c, label, key, vector, "bigint", ranks).withColumnRenamed("value", "rank")


def class_pair(cents: DataFrame, a: object, b: object, label: str = "label") -> DataFrame:
    """(a, b, cosine, distance) of the centroids of two named classes."""
    return centroid_pairs(cents.filter(F.col(label).isin(a, b)), label)


def moments(vectors: DataFrame, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """n, the mean and the covariance (by n), from one D x D sum per partition."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0, 0
        for b in batches:
            m = matrix(b.column(0))
            n, s, q = n + len(m), s + m.sum(0), q + m.T @ m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], names=["n", "s", "q"])

    parts = vectors.filter(F.col(vector).isNotNull()).select(doubles(F.col(vector)).alias("v")).mapInArrow(add, "n bigint, s array<double>, q array<double>")
    total = parts.select("n", F.posexplode("s")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("x")).orderBy("pos").collect()
    if not total:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, mean = total[0]["n"], np.array([r["x"] for r in total]) / total[0]["n"]
    q = np.array([r["x"] for r in parts.select(F.posexplode("q")).groupBy("pos").agg(F.sum("col").alias("x")).orderBy("pos").collect()])
    return n, mean, q.reshape(len(mean), len(mean)) / n - np.outer(mean, mean)


def spectrum(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: n, dims, effective_rank (exp of the entropy of the covariance's eigenvalues), and the dimensions for 90, 95 and 99 % of the variance."""
    n, mean, cov = moments(vectors, vector)
    p = np.sort(np.clip(np.linalg.eigvalsh(cov), 0, None))[::-1] if n else np.zeros(0)
    p = p / max(p.sum(), 1e-12) if len(p) else p
    p = p[p > 0]
    run = np.cumsum(p)
    row = (int(n), len(mean), float(np.exp(-(p * np.log(p)).sum())) if len(p) else None, *(int(np.searchsorted(run, x) + 1) if len(p) else None for x in (0.9, 0.95, 0.99)))
    return vectors.sparkSession.createDataFrame([row], "n bigint, dims int, effective_rank double, dims_90 int, dims_95 int, dims_99 int")


def linear_probe(vectors: DataFrame, label: str = "label", key: str = "vec_id", vector: str = "embedding", folds: int = 3, iterations: int = 100) -> DataFrame:
    """(fold, n, accuracy, chance): multinomial logistic regression on unit vectors, by folds of a hash of the key."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    rows = vectors.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.pmod(F.xxhash64(F.lit(3), key), F.lit(folds)).cast("int").alias("fold"), F.col(label).cast("string").alias("y"), array_to_vector(unit(F.col(vector))).alias("features"))
    rows = StringIndexer(inputCol="y", outputCol="label").fit(rows).transform(rows)
    classes = rows.select("label").distinct().count()
    out = []
    for f in range(folds):
        model = LogisticRegression(maxIter=iterations, family="multinomial").fit(rows.filter(F.col("fold") != f))
        r = model.transform(rows.filter(F.col("fold") == f)).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()
        out.append((f, r["n"], r["a"], 1 / classes))
    return vectors.sparkSession.createDataFrame(out, "fold int, n bigint, accuracy double, chance double")


def mean_pool(states: DataFrame, by: str, mask: str, vector: str) -> DataFrame:
    """(by, pos, mean): the mean of the unmasked state vectors of each text, one row per coordinate. A text that is masked as a whole has none."""
    return centroids(states.filter(F.col(mask)), by, vector).withColumnRenamed("c", "mean")


def sparse_pool(logits: DataFrame, by: str, term: str, logit: str, mask: str | None = None) -> DataFrame:
    """(by, term, weight): per text and term the highest log(1 + max(logit, 0)) over its unmasked positions; zero weights are left out."""
    rows = logits if mask is None else logits.filter(F.col(mask))
    return rows.groupBy(by, term).agg(F.max(F.log1p(F.greatest(F.col(logit), F.lit(0.0)))).alias("weight")).filter("weight > 0")
