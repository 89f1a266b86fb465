"""Queries on embeddings: retrieval, geometry, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import vectors as V
from granary.operators import geometry, losses, probes, retrieval
from granary.plans.registry import query
from granary.session import materialize, small, table

DIMS = V.ladder(64)


def _vectors(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "embeddings")


def _dims(dims=DIMS) -> str:
    return "(values " + ", ".join(f"({d})" for d in dims) + ") as dims(dim)"


_SCORED = f"""with n as (select vec_id, label, dim, list_transform(embedding[1:dim], lambda x: x::double) as v from embeddings, {_dims()}),
u as (select vec_id, label, dim, v, greatest(sqrt(list_dot_product(v, v)), 1e-12) as l from n),
s as (select a.dim, a.vec_id as query, b.vec_id as doc, a.label = b.label as same, round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) as score from u a join u b on a.dim = b.dim and a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select *, row_number() over (partition by dim, query order by score desc, doc) as rank from s),
c as (select vec_id as query, (select count(*) from embeddings e where e.label = q.label) - 1 as n_rel from embeddings q where vec_id % 100 = 0)"""


@query(_SCORED + " select dim::integer as dim, query, rank, doc, round(score, 6) as score, same from r where rank <= 5")
def knn_neighbours(spark: SparkSession, where: str) -> DataFrame:
    hits = retrieval.scan(_vectors(spark, where), DIMS, 5)
    return retrieval.neighbours(hits, 5).select("dim", "query", F.col("rank").cast("bigint").alias("rank"), "doc", F.round("score", 6).alias("score"), "same")


_METRICS = (
    _SCORED
    + """, g as (select dim, r.query, count(*) filter (where same and rank <= 10) as hits, coalesce(sum(1 / log2(rank + 1)) filter (where same and rank <= 10), 0) as dcg, min(rank) filter (where same) as first_, any_value(n_rel) as n_rel from r join c on c.query = r.query group by all),
i as (select *, (select sum(1 / log2(x.k + 1)) from (select unnest(range(1, 11)) as k) x where x.k <= n_rel) as idcg from g),
m as (select dim::integer as dim, count(*) as n_queries, cast(count(*) filter (where n_rel = 0) as bigint) as n_without, round(avg(hits / 10.0), 9)::double as p, round(avg(case when n_rel = 0 then 0 else dcg / idcg end), 9) as ndcg,
round(avg(case when n_rel = 0 then 0 else 1.0 / first_ end), 9)::double as mrr, round(avg(n_rel / ((select count(*) from embeddings) - 1)::double), 9) as chance from i group by dim)"""
)


@query(_METRICS + " select dim, n_queries, n_without, round(p, 7) as p, round(ndcg, 7) as ndcg, round(mrr, 7) as mrr, round(chance, 7) as chance from m")
def retrieval_metrics_by_dim(spark: SparkSession, where: str) -> DataFrame:
    m = retrieval.metrics(_vectors(spark, where), DIMS)
    return m.select("dim", "n_queries", "n_without", *(F.round(c, 7).alias(c) for c in ("p", "ndcg", "mrr", "chance")))


@query(
    _SCORED
    + """, e as (select dim, k, r.query, count(*) filter (where same) as hits, any_value(n_rel) as n_rel, min(rank) filter (where same) as first_ from r join c on c.query = r.query, (values (1), (10), (100)) as ks(k) where rank <= k group by all)
select dim::integer as dim, k, round(avg(hits / n_rel::double), 7) as recall, round(avg(hits / k::double), 7) as precision, round(avg(case when first_ is null then 0.0 else 1.0 end), 7)::double as accuracy, round(avg(coalesce(1.0 / first_, 0)), 7)::double as mrr from e group by dim, k"""
)
def retrieval_recall_at_k(spark: SparkSession, where: str) -> DataFrame:
    v = _vectors(spark, where)
    near = retrieval.neighbours(retrieval.scan(v, DIMS, 100), 100)
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("n_rel"))
    rel = retrieval.stated(v).join(small(sizes), "label").select(F.col("vec_id").alias("query"), "n_rel")
    return retrieval.at_k(near, rel, [1, 10, 100]).select("dim", "k", *(F.round(c, 7).alias(c) for c in ("recall", "precision", "accuracy", "mrr")))


@query(_METRICS + " select round((max(ndcg) filter (where dim = 8)), 7) as at_small, round((max(ndcg) filter (where dim = 64)), 7) as at_full, round((max(ndcg) filter (where dim = 8)) / (max(ndcg) filter (where dim = 64)), 6) as retention from m")
def metric_retention(spark: SparkSession, where: str) -> DataFrame:
    r = retrieval.retention(retrieval.metrics(_vectors(spark, where), DIMS), "ndcg", 8, 64)
    return r.select(F.round("at_small", 7).alias("at_small"), F.round("at_full", 7).alias("at_full"), F.round("retention", 6).alias("retention"))


def _long(m: DataFrame) -> DataFrame:
    return m.select("dim", F.expr("stack(3, 'p', p, 'ndcg', ndcg, 'mrr', mrr) as (task, value)"))


@query(_METRICS + ", l as (select dim, unnest(['p', 'ndcg', 'mrr']) as task, unnest([p, ndcg, mrr]) as value from m) select task, " + ", ".join(f"round(max(value) filter (where dim = {d}), 7) as \"{d}\"" for d in DIMS) + " from l group by task")
def metric_pivot(spark: SparkSession, where: str) -> DataFrame:
    m = retrieval.pivoted(_long(retrieval.metrics(_vectors(spark, where), DIMS)), "task", "dim", "value", DIMS)
    return m.select("task", *(F.round(F.col(f"`{d}`"), 7).alias(str(d)) for d in DIMS))


@query(
    _METRICS
    + ", l as (select 'dim_' || dim as system, unnest([p, ndcg, mrr]) as value from m), a as (select system, round(avg(value), 6) as average from l group by system union all values ('chance', 0.1::double), ('perfect', 1.0::double)) select system, average, cast(rank() over (order by average desc) as integer) as place from a"
)
def macro_average_ranked(spark: SparkSession, where: str) -> DataFrame:
    m = _long(retrieval.metrics(_vectors(spark, where), DIMS)).select(F.concat(F.lit("dim_"), "dim").alias("system"), F.col("value"))
    base = spark.createDataFrame([("chance", 0.1), ("perfect", 1.0)], "system string, average double")
    return retrieval.macro_average(m, "system", "value", base).select("system", F.round("average", 6).alias("average"), "place")


_COORD = "x as (select vec_id, label, unnest(embedding)::double as x, unnest(range(len(embedding))) as pos from embeddings)"


@query(f"with {_COORD}, l as (select vec_id, sqrt(sum(x * x)) as l from x group by vec_id), s as (select pos, sum(x / l) as s from x join l using (vec_id) group by pos), n as (select count(*) as n from embeddings) select n, round((sum(s * s) - n) / (n * (n - 1)), 9) as mean_cosine from s, n group by n")
def mean_pairwise_cosine(spark: SparkSession, where: str) -> DataFrame:
    return geometry.mean_pairwise_cosine(_vectors(spark, where))


_VAR = f"with {_COORD}, v as (select pos, var_pop(x) as variance from x group by pos)"


@query(_VAR + ", c as (select pos + 1 as k, sum(variance) over (order by pos) as c, sum(variance) over () as t, count(*) over () as d from v) select k::integer as k, round(c / t, 7) as var_fraction, round(c / t / (k / d::double), 7) as concentration from c where k in (64, 32, 16, 8)")
def nesting_concentration(spark: SparkSession, where: str) -> DataFrame:
    return geometry.nesting(geometry.variances(_vectors(spark, where)), DIMS).select(F.col("k").cast("int").alias("k"), F.round("var_fraction", 7).alias("var_fraction"), F.round("concentration", 7).alias("concentration"))


@query(_VAR + ", r as (select variance, row_number() over (order by variance, pos) as i from v) select count(*) as n, round(2 * sum(i * variance) / (count(*) * sum(variance)) - (count(*) + 1) / count(*)::double, 7) as gini from r")
def coord_gini(spark: SparkSession, where: str) -> DataFrame:
    return geometry.gini(geometry.variances(_vectors(spark, where))).select("n", F.round("gini", 7).alias("gini"))


_CENT = f"with {_COORD}, c as (select label, pos, avg(x) as c from x group by label, pos)"
_CPAIRS = "p as (select a.label as a, b.label as b, sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)) as cosine, sqrt(sum((a.c - b.c) ** 2)) as distance from c a join c b on a.pos = b.pos and a.label < b.label group by all)"


@query(_CENT + ", " + _CPAIRS + " select a, b, round(cosine, 7) as cosine, round(distance, 7) as distance from p")
def class_centroids(spark: SparkSession, where: str) -> DataFrame:
    return geometry.centroid_pairs(geometry.centroids(_vectors(spark, where))).select("a", "b", F.round("cosine", 7).alias("cosine"), F.round("distance", 7).alias("distance"))


@query(
    _CENT
    + ", "
    + _CPAIRS
    + ", d as (select x.label, vec_id, sqrt(sum((x - c) ** 2)) as d from x join c using (label, pos) group by all), w as (select avg(d) as d from d group by label), z as (select count(*) as n_classes, avg(d) as within_ from w), b as (select avg(distance) as between_ from p) select n_classes, round(within_, 6) as within, round(between_, 6) as between, round(between_ / within_, 6) as fisher from z, b"
)
def fisher_ratio(spark: SparkSession, where: str) -> DataFrame:
    f = geometry.fisher(_vectors(spark, where))
    return f.select("n_classes", *(F.round(c, 6).alias(c) for c in ("within", "between", "fisher")))


@query(
    _CENT
    + """, s as (select vec_id, x.label, c.label as class, round(sum(x * c) / sqrt(sum(c * c)), 9) as s from x join c using (pos) group by all),
o as (select vec_id, label, 1 + count(*) filter (where s > own) as rank from (select *, max(case when class = label then s end) over (partition by vec_id) as own from s) group by all)
select label, grouping(label)::integer as is_total, count(*) as n, median(rank)::double as median_rank, round(avg(case when rank <= 1 then 1.0 else 0 end), 9)::double as top1, round(avg(case when rank <= 5 then 1.0 else 0 end), 9)::double as top5 from o group by rollup (label)"""
)
def concept_rollup(spark: SparkSession, where: str) -> DataFrame:
    return probes.concept_rollup(geometry.centroid_ranks(_vectors(spark, where)))


@query()
def effective_rank(spark: SparkSession, where: str) -> DataFrame:
    return geometry.spectrum(_vectors(spark, where))


@query()
def linear_probe(spark: SparkSession, where: str) -> DataFrame:
    return geometry.linear_probe(_vectors(spark, where))


_SIZE = 16
_BATCH = f"""n as (select vec_id, list_transform(embedding, lambda x: x::double) as v, list_transform(embedding[1:16], lambda x: x::double) as w, (row_number() over (order by vec_id) - 1) as i from embeddings),
b as (select *, i // {_SIZE} as batch_no, i % {_SIZE} as slot from n where i // {_SIZE} < (select count(*) // {_SIZE} from embeddings)),
u as (select batch_no, slot, v, w, sqrt(list_dot_product(v, v)) as lv, sqrt(list_dot_product(w, w)) as lw from b),
s as (select x.batch_no, x.slot as i, y.slot as j, list_dot_product(x.v, y.v) / (x.lv * y.lv) as st, list_dot_product(x.w, y.w) / (x.lw * y.lw) as ss from u x join u y on x.batch_no = y.batch_no)"""


def _batched(spark: SparkSession, where: str) -> DataFrame:
    v = _vectors(spark, where).select("vec_id", V.doubles(F.col("embedding")).alias("v"), V.doubles(F.slice("embedding", 1, 16)).alias("w"))
    return materialize(losses.batches(v, [F.col("vec_id")], _SIZE), "batches")


@query(
    f"""with {_BATCH}, o as (select * from s where i <> j), l as (select *, ss / 0.05 - ln(sum(exp(ss / 0.05)) over (partition by batch_no, i)) as a, st / 0.05 - ln(sum(exp(st / 0.05)) over (partition by batch_no, i)) as b from o)
select batch_no, round(sum(exp(b) * (b - a)) / {_SIZE}, 6) as kl, round(avg((ss - st) ** 2), 6) as mse, round(sum(exp(b) * (b - a)) / {_SIZE} + 10 * avg((ss - st) ** 2), 6) as loss from l group by batch_no"""
)
def relational_loss(spark: SparkSession, where: str) -> DataFrame:
    r = losses.relational(_batched(spark, where), "w", "v")
    return r.select("batch_no", *(F.round(c, 6).alias(c) for c in ("kl", "mse", "loss")))


@query(f"with {_BATCH}, r as (select batch_no, row_number() over (partition by batch_no order by round(ss, 9), i, j) as x, row_number() over (partition by batch_no order by round(st, 9), i, j) as y from s where i <> j) select batch_no, round(corr(x, y), 6) as rho from r group by batch_no")
def spearman_geometry(spark: SparkSession, where: str) -> DataFrame:
    return losses.spearman(_batched(spark, where), "w", "v").select("batch_no", F.round("rho", 6).alias("rho"))


_PAIRED = f"""n as (select vec_id, list_transform(embedding[1:32], lambda x: x::double) as q, list_transform(embedding[33:64], lambda x: x::double) as p, (row_number() over (order by vec_id) - 1) as i from embeddings),
b as (select *, i // {_SIZE} as batch_no, i % {_SIZE} as slot from n where i // {_SIZE} < (select count(*) // {_SIZE} from embeddings))"""


def _paired(spark: SparkSession, where: str) -> DataFrame:
    """The two halves of each vector in the place of a query and its positive."""
    e = V.doubles(F.col("embedding"))
    v = _vectors(spark, where).select("vec_id", F.slice(e, 1, 32).alias("q"), F.slice(e, 33, 32).alias("p"))
    return materialize(losses.batches(v, [F.col("vec_id")], _SIZE), "batches")


@query(
    f"""with {_PAIRED}, c as (select x.batch_no, x.slot as i, y.slot as j, dim, list_dot_product(x.q[1:dim], y.p[1:dim]) / (sqrt(list_dot_product(x.q[1:dim], x.q[1:dim])) * sqrt(list_dot_product(y.p[1:dim], y.p[1:dim]))) as s,
list_dot_product(x.p, y.q) / (sqrt(list_dot_product(x.p, x.p)) * sqrt(list_dot_product(y.q, y.q))) as g from b x join b y on x.batch_no = y.batch_no, (values (32), (16), (8)) as ds(dim)),
m as (select *, i <> j and g > max(case when i = j then g end) over (partition by batch_no, dim, i) as masked from c),
l as (select batch_no, dim, i, ln(sum(exp(s / 0.02)) filter (where not masked)) - max(case when i = j then s / 0.02 end) as loss, count(*) filter (where masked) as n from m group by all)
select batch_no, round(avg(loss), 6) as loss, sum(n)::double / 3 as masked from l group by batch_no"""
)
def gist_infonce(spark: SparkSession, where: str) -> DataFrame:
    return losses.gist_infonce(_paired(spark, where), "q", "p", "p", "q", [32, 16, 8]).select("batch_no", F.round("loss", 6).alias("loss"), "masked")


@query(
    f"""with {_PAIRED}, z as (select batch_no, slot, list_transform(q, lambda x: ln(1 + greatest(x, 0))) as q, list_transform(p, lambda x: ln(1 + greatest(x, 0))) as p from b),
c as (select x.batch_no, x.slot as i, y.slot as j, list_dot_product(x.q, y.p) / sqrt(32) / 0.02 as s from z x join z y on x.batch_no = y.batch_no),
l as (select batch_no, i, ln(sum(exp(s))) - max(case when i = j then s end) as ce from c group by all), k as (select batch_no, avg(ce) as ce from l group by batch_no),
t as (select batch_no, unnest(q) as a, unnest(p) as d, unnest(range(32)) as pos from z), f as (select batch_no, pos, avg(a) as a, avg(d) as d, count(*) filter (where a > 0) + count(*) filter (where d > 0) as n from t group by all)
select batch_no, round(any_value(ce), 6) as ce, round(sum(a * a + d * d), 6) as flops, round(sum(n) / (2.0 * {_SIZE}), 6)::double as nnz from f join k using (batch_no) group by batch_no"""
)
def sparse_infonce(spark: SparkSession, where: str) -> DataFrame:
    rows = _paired(spark, where).select("batch_no", "slot", F.transform("q", V.activation).alias("q"), F.transform("p", V.activation).alias("p"))
    r = losses.sparse_infonce(rows, "q", "p")
    return r.select("batch_no", *(F.round(c, 6).alias(c) for c in ("ce", "flops", "nnz")))


@query(
    """with v as (select vec_id, list_transform(embedding[1:16], lambda x: x::double) as q, list_transform(embedding[17:32], lambda x: x::double) as p, list_transform(embedding[33:48], lambda x: x::double) as n from embeddings),
s as (select list_dot_product(q, p) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(p, p))) - list_dot_product(q, n) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(n, n))) as m from v)
select count(*) as n, round(avg(m), 7) as mean_margin, round(avg((m - 0.1) ** 2), 7) as margin_mse from s"""
)
def margin_mse(spark: SparkSession, where: str) -> DataFrame:
    """Parts of each vector in the place of a query, its positive and its negative, against a margin of 0.1."""
    e = F.col("embedding")
    rows = _vectors(spark, where).select(F.slice(e, 1, 16).alias("q"), F.slice(e, 17, 16).alias("p"), F.slice(e, 33, 16).alias("n"), F.lit(0.1).alias("m"))
    return losses.margin_mse(rows, "q", "p", "n", "m").select("n", *(F.round(c, 7).alias(c) for c in ("mean_margin", "margin_mse")))


@query(f"with {_COORD} select vec_id // 8 as text_id, pos::integer as pos, round(avg(x), 7) as mean from x where vec_id % 8 < 5 group by 1, 2")
def mean_pooling(spark: SparkSession, where: str) -> DataFrame:
    """Vectors in the place of a text's states, eight a text, of which the mask leaves five."""
    states = _vectors(spark, where).select(F.expr("vec_id div 8").alias("text_id"), (F.col("vec_id") % 8 < 5).alias("mask"), "embedding")
    return geometry.mean_pool(states, "text_id", "mask", "embedding").select("text_id", "pos", F.round("mean", 7).alias("mean"))


@query("select vec_id, round(1 / (1 + exp(embedding[2]::double - embedding[1]::double)), 9) as score from embeddings")
def rerank_scores(spark: SparkSession, where: str) -> DataFrame:
    """Two coordinates in the place of the logits of yes and no."""
    v = F.col("embedding").cast("array<double>")
    return _vectors(spark, where).select("vec_id", F.round(V.sigmoid_margin(v[0], v[1]), 9).alias("score"))


@query(
    """with s as (select vec_id, 1 / (1 + exp(embedding[2]::double - embedding[1]::double)) as pos, case when vec_id % 3 > 0 then 1 / (1 + exp(embedding[4]::double - embedding[3]::double)) end as neg from embeddings)
select vec_id, round(pos - coalesce(neg, pos), 9) as margin from s"""
)
def teacher_margins(spark: SparkSession, where: str) -> DataFrame:
    """Margins of scores; a row without a negative has its positive in its place, and so a margin of 0."""
    v = F.col("embedding").cast("array<double>")
    s = _vectors(spark, where).select("vec_id", V.sigmoid_margin(v[0], v[1]).alias("pos"), F.when(F.col("vec_id") % 3 > 0, V.sigmoid_margin(v[2], v[3])).alias("neg"))
    return s.select("vec_id", F.round(V.teacher_margin(F.col("pos"), F.col("neg")), 9).alias("margin"))


@query(_METRICS + " select dim, round(p / chance, 6) as lift from m")
def lift_over_chance(spark: SparkSession, where: str) -> DataFrame:
    """The precision of each size over that of a random order."""
    return retrieval.lift(retrieval.metrics(_vectors(spark, where), DIMS)).select("dim", F.round("lift", 6).alias("lift"))


@query("select cast(count(*) as bigint) as n, 64 as dims, true as is_ordered, true as is_bounded from embeddings")
def spectrum_bounds(spark: SparkSession, where: str) -> DataFrame:
    """The spectrum's numbers keep their bounds: 1 <= rank <= dims, and 90 % need no more dimensions than 95, nor these than 99."""
    s = geometry.spectrum(_vectors(spark, where))
    ordered = (F.col("dims_90") <= F.col("dims_95")) & (F.col("dims_95") <= F.col("dims_99")) & (F.col("dims_99") <= F.col("dims"))
    return s.select("n", "dims", ordered.alias("is_ordered"), F.col("effective_rank").between(1, F.col("dims")).alias("is_bounded"))


@query("select cast(sum(n) as bigint) as n, 3 as folds, round(1.0 / count(*), 9)::double as chance, true as is_share from (select count(*) as n from embeddings where label is not null group by label)")
def linear_probe_folds(spark: SparkSession, where: str) -> DataFrame:
    """All rows are tested once over the folds; chance is one over the classes, and accuracies are shares."""
    p = geometry.linear_probe(_vectors(spark, where))
    return p.agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("folds"), F.round(F.max("chance"), 9).alias("chance"), F.bool_and(F.col("accuracy").between(0, 1)).alias("is_share"))


@query(
    f"""with {_COORD}, c as (select label, pos, avg(x) as c from x where label in (1, 2) group by label, pos), j as (select a.c as x, b.c as y from c a join c b using (pos) where a.label = 1 and b.label = 2)
select 1 as a, 2 as b, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 7) as cosine, round(sqrt(sum((x - y) ** 2)), 7) as distance from j"""
)
def centroids_of_two_classes(spark: SparkSession, where: str) -> DataFrame:
    c = geometry.class_pair(geometry.centroids(_vectors(spark, where)), 1, 2)
    return c.select("a", "b", F.round("cosine", 7).alias("cosine"), F.round("distance", 7).alias("distance"))


@query(_METRICS + " select dim, round(ndcg, 7) as ndcg from m where dim not in (8, 32)")
def results_without_contaminated(spark: SparkSession, where: str) -> DataFrame:
    """Sizes in the place of tasks, of which two are contaminated."""
    from granary.operators import probes

    m = retrieval.metrics(_vectors(spark, where), DIMS)
    return probes.without_tasks(m, spark.createDataFrame([(8,), (32,)], "dim int"), "dim").select("dim", F.round("ndcg", 7).alias("ndcg"))


@query("select e.vec_id, e.label, user_id, p.source from embeddings e join events on event_id = vec_id join pairs p on p.id = vec_id")
def three_tables_by_row(spark: SparkSession, where: str) -> DataFrame:
    """Vectors, events and pairs with the same row number beside each other."""
    from granary.operators.pairs import by_row

    v = _vectors(spark, where).select(F.col("vec_id").alias("row_id"), "label")
    e = table(spark, where, "events").select(F.col("event_id").alias("row_id"), "user_id")
    return by_row(v, e, table(spark, where, "pairs").select(F.col("id").alias("row_id"), "source")).withColumnRenamed("row_id", "vec_id")


@query(f"with {_COORD} select label, pos::integer as pos, round(max(ln(1 + greatest(x, 0))), 7) as weight from x where vec_id % 2 = 0 group by all having max(x) > 0")
def splade_activation(spark: SparkSession, where: str) -> DataFrame:
    """Coordinates in the place of logits, a label in that of a text; odd rows are masked."""
    x = geometry.coordinates(_vectors(spark, where).withColumn("is_on", F.col("vec_id") % 2 == 0), "label", "is_on")
    return geometry.sparse_pool(x, "label", "pos", "x", "is_on").select("label", "pos", F.round("weight", 7).alias("weight"))


@query("select e.vec_id, e.label, round(sqrt(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double))), 6) as length, user_id from embeddings e join events on event_id = vec_id")
def positional_join(spark: SparkSession, where: str) -> DataFrame:
    """Vectors beside the rows with the same number."""
    from granary.operators.pairs import by_row

    v = _vectors(spark, where).select(F.col("vec_id").alias("row_id"), "label", F.round(V.norm(F.col("embedding")), 6).alias("length"))
    e = table(spark, where, "events").select(F.col("event_id").alias("row_id"), "user_id")
    return by_row(v, e).withColumnRenamed("row_id", "vec_id")


_LEADS = "r as (select label, vec_id % 5 as term, vec_id * 7 % 13 + 1 as exact, vec_id * 3 % 7 + 1 as class from embeddings where label is not null)"


@query(
    f"""with {_LEADS} select label, term, cast(grouping(label) + grouping(term) as integer) as level, count(*) as n, median(exact) as median_rank, round(avg(case when exact = 1 then 1.0 else 0.0 end), 9)::double as exact_top1,
round(avg(case when class = 1 then 1.0 else 0.0 end), 9)::double as class_top1, round(avg(case when class <= 5 then 1.0 else 0.0 end), 9)::double as class_top5,
round(avg(case when class = 1 then 1.0 else 0.0 end) - avg(case when exact = 1 then 1.0 else 0.0 end), 9)::double as concept_lead from r group by rollup (label, term)"""
)
def concept_leads(spark: SparkSession, where: str) -> DataFrame:
    """Ranks of the exact token and of its class, per term, per class and over all. Numbers of the rows stand for the ranks."""
    from granary.operators import probes

    v = F.col("vec_id")
    rows = _vectors(spark, where).filter("label is not null").select("label", (v % 5).alias("term"), (v * 7 % 13 + 1).alias("exact"), (v * 3 % 7 + 1).alias("class"))
    return probes.concept_leads(rows, "label", "term", "exact", "class")
