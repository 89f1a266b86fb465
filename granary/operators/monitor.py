"""Training health, rates, progress, milestones, outages, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.ranges import ranked, running
from granary.session import small

#: Exponents that the power law is tried with.
EXPONENTS = [round(0.05 + 0.05 * i, 2) for i in range(30)]


def trend(evals: DataFrame, series: str, step: str, loss: str) -> DataFrame:
    """Adds to each evaluation the loss four evaluations before (`back_4`), the best so far, and the change against the first. A series has one row per evaluation, which are few."""
    w = Window.partitionBy(series).orderBy(step)
    return evals.withColumn("back_4", F.lag(loss, 4).over(w)).withColumn("best_so_far", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("vs_first", F.col(loss) / F.first(loss).over(w))


def health(evals: DataFrame, series: str, step: str, loss: str) -> DataFrame:
    """(series, n, latest, best, improvement, health) of each series of evaluation losses.

    DIVERGING: over 1.25 times the best; from five evaluations on PLATEAU if they improved by less than 0.1 %, else
    improving; before that improving or watch; unknown under two."""
    t = trend(evals.filter(F.col(loss).isNotNull()), series, step, loss)
    last = t.groupBy(series).agg(F.count("*").alias("n"), F.max_by(loss, step).alias("latest"), F.min(loss).alias("best"), F.max_by("back_4", step).alias("_old"))
    gain = F.when(F.col("n") >= 5, (F.col("_old") - F.col("latest")) / F.greatest("_old", F.lit(1e-9)))
    state = (
        F.when(F.col("n") < 2, "unknown")
        .when(F.col("latest") > F.col("best") * 1.25, "DIVERGING")
        .when((F.col("n") >= 5) & (F.col("improvement") < 0.001), "PLATEAU")
        .when((F.col("n") >= 5) | (F.col("latest") <= F.col("best")), "improving")
        .otherwise("watch")
    )
    return last.withColumn("improvement", gain).withColumn("health", state).drop("_old")


def median_rate(events: DataFrame, series: str, ts: str, key: str, last: int = 12) -> DataFrame:
    """(series, n_gaps, median_rate): the median of the last `last` rates (1 / seconds between neighbours)."""
    newest = events.filter(F.col(ts).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(series).orderBy(F.desc(ts), F.desc(key)))).filter(F.col("_n") <= last + 1)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = F.lag(at).over(Window.partitionBy(series).orderBy("_n")) - at
    return newest.withColumn("_gap", gap / 1e6).filter("_gap > 0").groupBy(series).agg(F.count("*").alias("n_gaps"), F.round(F.median(1 / F.col("_gap")), 9).alias("median_rate"))


#: Kinds of layers of the encoder: how many there are, and how far a token sees (None: the whole sequence).
LAYERS: list[tuple[int, int | None]] = [(7, None), (15, 128)]


def flops_per_token(seq: Column, hidden: int = 768, inner: int = 1152, layers: list[tuple[int, int | None]] = LAYERS) -> Column:
    """Training FLOPs of one token, three passes of two operations each. A layer multiplies by its weights (four square matrices
    of attention, three of the gated inner layer), and forms and applies one attention score per token that is seen."""
    weights = 4 * hidden**2 + 3 * hidden * inner
    return F.lit(3) * sum(F.lit(n) * (F.lit(2 * weights) + F.lit(4 * hidden) * (seq if span is None else F.lit(span))) for n, span in layers)


def throughput(rows: DataFrame, peak_tflops: float, seq: str = "seq", rate: str = "tok_s") -> DataFrame:
    """Adds tflops, mfu and the rate against that of the shortest sequence. One row per setting."""
    t = rows.withColumn("tflops", F.round(flops_per_token(F.col(seq)) * F.col(rate) / 1e12, 9))
    return t.withColumn("mfu", F.round(F.col("tflops") / peak_tflops, 9)).withColumn("vs_first", F.round(F.col(rate) / F.first(rate).over(Window.orderBy(seq)), 9))


def progress(rows: DataFrame, step: str, most: int, seconds: str, tokens_per_step: int) -> DataFrame:
    """Adds percent, tokens seen, tokens per second and the seconds left."""
    return (
        rows.withColumn("percent", F.round(100.0 * F.col(step) / most, 6))
        .withColumn("tokens_seen", F.col(step) * tokens_per_step)
        .withColumn("tok_s", F.round(F.col("tokens_seen") / F.greatest(F.col(seconds), F.lit(1e-9)), 6))
        .withColumn("eta_s", F.round((most - F.col(step)) * F.col(seconds) / F.greatest(F.col(step), F.lit(1)), 6))
    )


def target_steps(spark: SparkSession, most: int, every: int, tails: int = 20, dense: int = 30_000) -> DataFrame:
    """(step): all saved steps up to `dense`, doublings of the first, a regular tail of about `tails` steps, and the last one; only multiples of `every` exist."""
    tail = max(every, round(most / tails / every) * every)
    steps = spark.range(every, min(dense, most) + 1, every).toDF("step")
    doubled = spark.range(0, 40).filter(F.lit(float(every)) * F.pow(F.lit(2.0), F.col("id")) <= most).select((F.lit(every) * F.pow(F.lit(2.0), F.col("id"))).cast("bigint").alias("step"))
    rest = spark.range(tail, most + 1, tail).toDF("step")
    last = spark.createDataFrame([(most - most % every,)], "step bigint")
    return steps.union(doubled).union(rest).union(last).filter((F.col("step") > 0) & (F.col("step") % every == 0)).distinct()


def not_done(targets: DataFrame, done: DataFrame, key: str = "step") -> DataFrame:
    """What is still to do. Empty when all is done."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def completion(targets: DataFrame, done: DataFrame, key: str = "step") -> DataFrame:
    """One row: n_open, the targets that are not done, and whether all are (complete)."""
    return not_done(targets.select(key).distinct(), done, key).agg(F.count("*").alias("n_open")).withColumn("complete", F.col("n_open") == 0)


def id_sets(rows: DataFrame, label: str, key: str) -> DataFrame:
    """(label, ids): the distinct ids of each class in order. For classes of a vocabulary, whose sets fit a row."""
    return rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.array_sort(F.collect_set(key)).alias("ids"))


def milestones(rows: DataFrame, order: list[str], parts: int = 10) -> DataFrame:
    """Adds the number of tenths that are done with a row, and keeps the first row of each tenth from 1 on."""
    n = rows.count()
    r = ranked(rows, [F.col(o) for o in order], "rank")
    share = F.expr(f"(rank * {parts}) div {max(n, 1)}")
    first = r.withColumn("milestone", share).withColumn("_before", F.expr(f"((rank - 1) * {parts}) div {max(n, 1)}"))
    return first.filter("milestone > _before").drop("_before")


def streaks(rows: DataFrame, by: str, order: list[str], failed: Column, least: int) -> DataFrame:
    """(by, n_ok_before, length, start, end): runs of at least `least` failures in a row of one `by`.

    A run is the failures with the same number of successes before them in (by, order): that number comes from ranges of
    the whole order, and the runs from a grouping with map-side combination, so that no key is gathered in one task."""
    r = running(rows.withColumn("_failed", F.coalesce(failed, F.lit(False))), [F.col(by), *(F.col(o) for o in order)], {"n_ok_before": F.when(~F.coalesce(failed, F.lit(False)), 1).otherwise(0).cast("bigint")})
    runs = r.filter("_failed").groupBy(by, "n_ok_before").agg(F.count("*").alias("length"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"))
    return runs.filter(F.col("length") >= least)


def power_law(evals: DataFrame, series: str, step: str, loss: str, at: float, skip: float = 0.15) -> DataFrame:
    """(series, a, b, c, sse, predicted): loss = a step^-b + c fitted after the first `skip` of the steps, and its value at step `at`.

    For each exponent of a fixed grid the best a and c follow from sums in closed form; the exponent with the least squared
    error wins (the smaller one of equals). Fits with a < 0 don't count."""
    kept = evals.join(small(evals.groupBy(series).agg((F.max(step) * skip).alias("_from"))), series).filter(F.col(step) > F.col("_from"))
    x = kept.select(series, F.col(loss).cast("double").alias("y"), F.col(step).cast("double").alias("t"), F.explode(F.array(*map(F.lit, EXPONENTS))).alias("b")).withColumn("x", F.pow("t", -F.col("b")))
    f = x.groupBy(series, "b").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("c"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"))
    f = f.withColumn("sse", F.round(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), 9)).filter("a >= 0")
    best = f.withColumn("_n", F.row_number().over(Window.partitionBy(series).orderBy("sse", "b"))).filter("_n = 1")
    return best.select(series, "a", "b", "c", "sse", (F.col("a") * F.pow(F.lit(float(at)), -F.col("b")) + F.col("c")).alias("predicted"))


def error_lines(lines: DataFrame, text: str, pattern: str = r"(?i)\b(error|exception|traceback|out of memory)\b") -> DataFrame:
    """One row: lines, and those with an error."""
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(F.col(text).rlike(pattern)).alias("n_errors"))
