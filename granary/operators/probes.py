"""Token statistics, losses by bucket, contexts of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import let
from granary.functions.text import lexical_tokens
from granary.operators.ranges import ranked
from granary.session import small

#: Upper ends of the frequency ranks of a bucket, and its name.
BUCKETS = [(100, "top_100"), (1000, "100_1k"), (10000, "1k_10k")]


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n): how often each lexical token occurs."""
    return docs.filter(F.col(text).isNotNull()).select(F.explode(lexical_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    """One row: n_tokens, n_types, entropy of the unigrams in nats, its perplexity, and the entropy of equal shares.

    From sums of n and n ln n, so that no second pass over the total is needed."""
    s = counts.agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"), F.sum(F.col("n") * F.ln("n")).alias("_nln"))
    h = F.ln("n_tokens") - F.col("_nln") / F.col("n_tokens")
    return s.select("n_tokens", "n_types", F.round(h, 9).alias("entropy"), F.round(F.exp(h), 6).alias("perplexity"), F.round(F.ln("n_types"), 9).alias("uniform"))


def bucket(rank: Column) -> Column:
    c = F
    for end, name in BUCKETS:
        c = c.when(rank <= end, name)
    return c.otherwise("10k_up")


def frequency_buckets(counts: DataFrame) -> DataFrame:
    """(bucket, n_types, n_tokens, mean_log_rank): tokens by their rank, most frequent first, ties by token."""
    r = ranked(counts, [-F.col("n"), F.col("token")])
    return r.groupBy(bucket(F.col("rank")).alias("bucket")).agg(F.count("*").alias("n_types"), F.sum("n").alias("n_tokens"), F.round(F.sum(F.col("n") * F.ln("rank")) / F.sum("n"), 9).alias("mean_log_rank"))


def term_contexts(docs: DataFrame, placed: DataFrame, terms: list[str], per_term: int, margin: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, rn, doc_id, pos): the first `per_term` places of each term in the token stream that have `margin` tokens on both sides.

    docs: (key, text); placed: their token_start and n_tokens. Terms are found where the texts lie; of each document at most
    `per_term` places of a term, and no text, go on to the ranking, where each part of the order first keeps its own
    `per_term`, so that a frequent term is ranked nowhere as a whole."""
    total = placed.agg(F.max(F.col("token_start") + F.col("n_tokens"))).first()[0] or 0
    tok = lexical_tokens(F.col(text))
    found = let(tok, lambda t: F.filter(F.transform(t, lambda x, i: F.struct(x.alias("term"), i.alias("i"))), lambda s: s["term"].isin(terms)))
    hit = docs.select(key, found.alias("f")).filter(F.size("f") > 0).join(placed.select(key, "token_start"), key)
    place = F.transform("f", lambda s: F.struct(s["term"].alias("term"), (F.col("token_start") + 1 + s["i"]).alias("pos")))
    inside = F.filter(place, lambda s: s["pos"].between(margin, total - margin - 1))
    own = F.flatten(F.transform(F.array(*map(F.lit, terms)), lambda t: F.slice(F.filter(inside, lambda s: s["term"] == t), 1, per_term)))
    at = hit.select(F.col(key).alias("doc_id"), F.explode(own).alias("p")).select("doc_id", "p.*").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(256)))
    for by in (["term", "_part"], ["term"]):
        at = at.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("pos"))).filter(F.col("rn") <= per_term)
    return at.select("term", "rn", "doc_id", "pos")


def weighted_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, loss, n, mean_loss, top1[, top5]): sums of `loss` and shares of `hit`, and of `hit5` where the rows have it."""
    share = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 6).alias(name)
    more = [share("hit5", "top5")] if "hit5" in rows.columns else []
    return rows.groupBy(*by).agg(F.sum("loss").alias("loss"), F.count("*").alias("n"), F.round(F.sum("loss") / F.count("*"), 6).alias("mean_loss"), share("hit", "top1"), *more)


def unweighted_mean(losses: DataFrame) -> DataFrame:
    """One row: the mean over groups of their mean losses, each counting the same."""
    return losses.agg(F.avg("mean_loss").alias("mean_loss"), F.count("*").alias("n_groups"))


def position_quarter(pos: Column, length: Column) -> Column:
    """1 to 4: the quarter of a block in which a position is."""
    return F.floor(pos * 4 / length).cast("int") + 1


def region(offset: Column, regions: list[tuple[str, int, int]]) -> Column:
    """The name of the region [start, end) that holds an offset; null outside of all."""
    c = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, start, end in regions:
        c = c.when((offset >= start) & (offset < end), name)
    return c


def class_ranks(scores: DataFrame, term: str, label: str, best: str = "score") -> DataFrame:
    """Adds the competition rank of each row's score within its term: 1 + the number of greater ones."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(term).orderBy(F.desc(best))))


def concept_rollup(ranks: DataFrame, by: str = "label") -> DataFrame:
    """(label, n, median_rank, top1, top5) per label and in total (label null, is_total 1)."""
    return ranks.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), F.count("*").alias("n"), F.median("rank").alias("median_rank"), F.round(F.avg((F.col("rank") <= 1).cast("double")), 9).alias("top1"), F.round(F.avg((F.col("rank") <= 5).cast("double")), 9).alias("top5"))


def concept_leads(rows: DataFrame, label: str, term: str, exact: str, of_class: str) -> DataFrame:
    """(label, term, level, n, median_rank, exact_top1, class_top1, class_top5, concept_lead): per term (level 0), per class (1) and
    over all (2). `exact` is the rank of the right token, `of_class` that of the best token of its class; the lead is how much
    more often the class comes first than the token."""
    share = lambda c, n: F.avg((F.col(c) <= n).cast("double"))
    level = (F.grouping(label) + F.grouping(term)).cast("int").alias("level")
    own = [F.round(share(exact, 1), 9).alias("exact_top1"), F.round(share(of_class, 1), 9).alias("class_top1"), F.round(share(of_class, 5), 9).alias("class_top5")]
    return rows.rollup(label, term).agg(level, F.count("*").alias("n"), F.median(exact).alias("median_rank"), *own, F.round(share(of_class, 1) - share(exact, 1), 9).alias("concept_lead"))


def by_frequency(rows: DataFrame, counts: DataFrame, token: str = "token") -> DataFrame:
    """(bucket, n, loss, mean_loss, top1): losses by the frequency rank of their token. rows are summed per token before they are joined with the ranks."""
    per = rows.groupBy(token).agg(F.sum("loss").alias("loss"), F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("hits"))
    r = ranked(counts, [-F.col("n"), F.col("token")]).select(F.col("token").alias(token), bucket(F.col("rank")).alias("bucket"))
    s = per.join(r, token).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("hits").alias("_hits"))
    return s.select("bucket", "n", "loss", F.round(F.col("loss") / F.col("n"), 6).alias("mean_loss"), F.round(F.col("_hits") / F.col("n"), 6).alias("top1"))


def by_position(rows: DataFrame, pos: str, length: int) -> DataFrame:
    """(quarter, n, mean_loss, top1): losses by the quarter of a block in which their position is."""
    return weighted_loss(rows.withColumn("quarter", position_quarter(F.col(pos), F.lit(length))), ["quarter"])


def unmasked(rows: DataFrame, label: str = "label", ignored: int = -100) -> DataFrame:
    """Rows whose label counts."""
    return rows.filter(F.col(label) != ignored)


def without_tasks(results: DataFrame, contaminated: DataFrame, task: str = "task") -> DataFrame:
    """Results of tasks that no training data touched."""
    return results.join(small(contaminated.select(task).distinct()), task, "left_anti")
