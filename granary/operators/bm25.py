"""BM25: a stated set of queries against all passages of their source, in blocks of queries.

Joining queries and postings on terms would emit nearly every pair of a source through its frequent terms. Instead each
block of queries (a bounded number) is broadcast as an inverted index, the passages are scored where they lie, and only the
best of each partition move."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import lexical_tokens, order_key, space_tokens
from granary.session import materialize, small

K1, B = 1.5, 0.75
#: Queries in a block, some 300 bytes of index each, and pairs (passage, query) that are added up at a time.
BLOCK, CELLS = 8192, 1 << 21
#: Passages of a source that are looked at first to fill up a query's negatives.
POOL = 64


def blocks_of(queries: DataFrame, key: str, size: int = BLOCK) -> Iterator[list]:
    """The queries, `size` or so at a time, on the driver."""
    n = max(1, -(-queries.count() // size))
    for b in range(n):
        yield queries.filter(F.pmod(F.xxhash64(F.lit(5), key), F.lit(n)) == b).orderBy(key).collect()


def _keep_best(hits: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    q, d, s = (np.concatenate(x) for x in zip(*hits))
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return [(q[place < k], d[place < k], s[place < k])]


def scan(passages: DataFrame, queries: list[tuple[int, str, dict[str, float]]], k: int, averages: dict[str, float], places: dict[tuple[str, str], list[int]] | None = None) -> DataFrame:
    """(query, doc, score): the k best passages of each query within its partition.

    passages: (source, doc, tokens[, banned]), `banned` being labels whose queries may not get the passage, of which `places`
    has the queries by source and label. queries: (key, source, weight of each term); only scores over 0 count, rounded to 9
    digits, ties by doc. Each batch is scored source by source: its terms are joined with the queries' postings as arrays, and
    the products added up by (passage, query)."""
    of_source: dict[str, dict[str, list]] = {}
    for i, (_, source, weights) in enumerate(queries):
        for term, w in weights.items():
            of_source.setdefault(source, {}).setdefault(term, []).append((i, w))
    index = {}
    for source, terms in of_source.items():
        n = np.array([len(x) for x in terms.values()])
        index[source] = (pa.array(list(terms)), np.cumsum(n) - n, n, np.array([i for x in terms.values() for i, _ in x]), np.array([w for x in terms.values() for _, w in x]))
    keys = np.array([q for q, _, _ in queries], np.int64)
    shared = passages.sparkSession.sparkContext.broadcast((index, averages, keys, places))

    def of_batch(b: pa.RecordBatch, index: dict, averages: dict, keys: np.ndarray, places: dict | None) -> Iterator[tuple[np.ndarray, ...]]:
        docs, tokens = b.column("doc").to_numpy(), b.column("tokens")
        length = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
        sources = b.column("source").to_pylist()
        start = np.cumsum(length) - length
        flat = tokens.flatten()
        for source in index.keys() & set(sources):
            terms, first, n, at, weight = index[source]
            own = np.flatnonzero(np.array([s == source for s in sources]) & (length > 0))
            for rows in np.array_split(own, max(1, -(-len(own) * len(keys) // CELLS))):
                row = np.repeat(np.arange(len(rows)), length[rows])
                take = np.repeat(start[rows] - np.cumsum(length[rows]) + length[rows], length[rows]) + np.arange(len(row))
                term = pc.fill_null(pc.index_in(flat.take(pa.array(take)), terms), -1).to_numpy()
                found, tf = np.unique(row[term >= 0] * len(terms) + term[term >= 0], return_counts=True)
                row, term = found // len(terms), found % len(terms)
                norm = K1 * (1 - B + B * length[rows][row] / averages[source])
                m = n[term]
                post = np.repeat(first[term] - np.cumsum(m) + m, m) + np.arange(m.sum())
                total = np.bincount(np.repeat(row, m) * len(keys) + at[post], np.repeat(tf * (K1 + 1) / (tf + norm), m) * weight[post], len(rows) * len(keys)).reshape(len(rows), len(keys))
                if places:
                    for i, labels in enumerate(b.column("banned").take(pa.array(rows)).to_pylist()):
                        for label in labels or ():
                            total[i, places.get((source, label), [])] = 0
                total = np.round(total, 9)
                i, q = np.nonzero(total > 0)
                yield q, docs[rows[i]], total[i, q]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: list[tuple[np.ndarray, ...]] = []
        held = 0
        for b in batches:
            for hit in of_batch(b, *shared.value):
                hits.append(hit)
                held += len(hit[0])
                if held > 500_000:
                    hits = _keep_best(hits, k)
                    held = len(hits[0][0])
        if hits:
            q, d, s = _keep_best(hits, k)[0]
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[2][q]), pa.array(d), pa.array(s)], names=["query", "doc", "score"])

    return passages.mapInArrow(score, "query bigint, doc bigint, score double")


def best(hits: DataFrame, k: int) -> DataFrame:
    """Adds `rank`: the k best of each query, by score, ties by doc."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Corpus:
    """Passages (source, doc, tokens) with their statistics per source."""

    def __init__(self, pairs: DataFrame, key: str = "id", text: str = "positive", tokens=lexical_tokens):
        rows = pairs.filter(F.col(text).isNotNull() & F.col("source").isNotNull())
        self.rows = rows.select("source", F.col(key).alias("doc"), tokens(F.col(text)).alias("tokens"), F.md5(text).alias("digest"))
        stats = self.rows.groupBy("source").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg")).limit(100_001).collect()
        if len(stats) > 100_000:
            raise ValueError("more than 100,000 sources")
        self.n = {r["source"]: r["n"] for r in stats}
        self.avg = {r["source"]: r["avg"] or 1.0 for r in stats}

        self.dfs = materialize(self.rows.select("source", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("source", "term").agg(F.count("*").alias("df")), "df")

    def df(self, block: list) -> dict[tuple[str, str], int]:
        """How many passages of its source have a term, for the terms of one block of queries. The counts of all terms are written once."""
        asked = self.rows.sparkSession.createDataFrame(sorted({(q["source"], t) for q in block for t in q["tokens"]}), "source string, term string")
        return {(r["source"], r["term"]): r["df"] for r in self.dfs.join(small(asked), ["source", "term"]).collect()}


def weigh(block: list, corpus: Corpus, dfs: dict[tuple[str, str], int], repeated: bool = False, floor: dict[str, float] | None = None) -> list[tuple[int, str, dict[str, float]]]:
    """The queries of a block with the weight of each term. Plain: ln(1 + (N - df + .5) / (df + .5)), each term once. With
    `floor`: ln((N - df + .5) / (df + .5)), negative ones raised to the floor of the source, times the term's count."""
    out = []
    for q in block:
        weights = {}
        for term, tf in Counter(q["tokens"]).items():
            df, n = dfs.get((q["source"], term)), corpus.n.get(q["source"], 0)
            if df:
                idf = np.log((n - df + 0.5) / (df + 0.5)) if floor is not None else np.log(1 + (n - df + 0.5) / (df + 0.5))
                weights[term] = float((floor[q["source"]] if floor is not None and idf < 0 else idf) * (tf if repeated else 1))
        out.append((q["query"], q["source"], weights))
    return out


def query_rows(pairs: DataFrame, key: str = "id", text: str = "anchor", every: int = 100, tokens=lexical_tokens) -> DataFrame:
    """The stated queries: the rows whose id is divisible by `every`, with text and source."""
    return pairs.filter((F.col(key) % every == 0) & F.col(text).isNotNull() & F.col("source").isNotNull()).select(F.col(key).alias("query"), "source", "label", tokens(F.col(text)).alias("tokens"))


def top(pairs: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query, rank, doc, score): for each stated anchor the k positives of its source with the highest BM25. Queries that share no term with their source have no row."""
    corpus, queries = Corpus(pairs), query_rows(pairs, every=every)
    found = [scan(corpus.rows.select("source", "doc", "tokens"), weigh(b, corpus, corpus.df(b)), k, corpus.avg) for b in blocks_of(queries, "query") if b]
    return best(_union(found, pairs), k)


def okapi(pairs: DataFrame, k: int = 10, every: int = 100, epsilon: float = 0.25) -> DataFrame:
    """(query, rank, doc, score) under the Okapi variant: split at white space, repeated query terms count, and negative idf is raised to epsilon times the mean idf of its source."""
    corpus, queries = Corpus(pairs, tokens=space_tokens), query_rows(pairs, every=every, tokens=space_tokens)
    df = corpus.dfs
    n = F.element_at(F.create_map(*(F.lit(x) for kv in corpus.n.items() for x in kv)), F.col("source")) if corpus.n else F.lit(0)
    mean = df.groupBy("source").agg(F.avg(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("m")).collect()
    floor = {r["source"]: epsilon * r["m"] for r in mean}
    found = []
    for b in blocks_of(queries, "query"):
        if b:
            found.append(scan(corpus.rows.select("source", "doc", "tokens"), weigh(b, corpus, corpus.df(b), True, floor), k, corpus.avg))
    return best(_union(found, pairs), k)


def hard_negatives(pairs: DataFrame, k: int = 2, every: int = 100, seed: int = 11, anchors_too: bool = False) -> DataFrame:
    """(query, rank, doc, score): the k best passages of the source that are no positive of the anchor's label.

    Guards: a passage whose text is a positive of any row with the anchor's label in its source is banned, which covers the
    row itself and all rows of its label; with `anchors_too` also an anchor's text, and rows of the label in all sources. A
    null label is a label of its own. Where fewer than k passages share a term, others of the source fill up in the source's
    seeded order, with score -1.

    Equal texts are scored once: of each text of a source the k smallest ids stand for it, found with a top-k per text. The
    labels that may not get a text are written beside it once; each block of queries reads what is written."""
    corpus, queries = Corpus(pairs), materialize(query_rows(pairs, every=every), "queries")
    spark = pairs.sparkSession
    w = Window.partitionBy("source", "digest").orderBy("doc")
    copies = corpus.rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    label = F.coalesce("label", F.lit(""))
    rows = pairs.select("source", label.alias("label"), F.explode(F.array("positive", "anchor") if anchors_too else F.array("positive")).alias("text")).filter("text is not null")
    asked = queries.select("source", label.alias("label")).distinct()
    if anchors_too:
        texts = rows.join(asked.withColumnRenamed("source", "_of"), "label").select(F.col("_of").alias("source"), "label", F.md5("text").alias("digest"))
    else:
        texts = rows.filter("source is not null").join(asked, ["source", "label"]).select("source", "label", F.md5("text").alias("digest"))
    not_for = materialize(texts.distinct().groupBy("source", "digest").agg(F.collect_list("label").alias("banned")), "banned")
    passages = materialize(copies.join(not_for, ["source", "digest"], "left").select("source", "doc", "tokens", "banned"), "passages")
    found = []
    for block in blocks_of(queries, "query"):
        if block:
            places: dict[tuple[str, str], list[int]] = {}
            for i, q in enumerate(block):
                places.setdefault((q["source"], q["label"] or ""), []).append(i)
            found.append(scan(passages, weigh(block, corpus, corpus.df(block)), k, corpus.avg, places))
    hits = materialize(best(_union(found, pairs), k).select("query", "doc", "score"), "hits")
    out = [hits.withColumn("_o", F.lit(""))]
    have = hits.groupBy("query").agg(F.count("*").alias("n"))
    lacking = queries.select("query", "source", label.alias("label")).join(have, "query", "left").filter(f"coalesce(n, 0) < {k}").drop("n")
    order = materialize(passages.select("source", "doc", "banned", order_key(seed, F.col("doc")).alias("_o")), "order")
    most = POOL
    while True:  # nearly always once: a query goes on only if what was looked at is banned or a hit
        lacking = materialize(lacking, "lacking")
        if lacking.isEmpty():
            break
        pool = order.join(small(lacking.select("source").distinct()), "source", "left_semi").withColumn("_part", F.pmod(F.xxhash64("doc"), F.lit(64)))
        for by in (["source", "_part"], ["source"]):
            pool = pool.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_o", "doc"))).filter(F.col("_n") <= most)
        pool = materialize(pool.drop("_part"), "pool")  # at most `most` rows a source
        free = lacking.join(pool, "source").filter(~F.coalesce(F.array_contains("banned", F.col("label")), F.lit(False))).join(hits.select("query", "doc"), ["query", "doc"], "left_anti")
        free = free.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("_o", "doc"))).filter(F.col("_n") <= k)
        free = materialize(free.select("query", "doc", F.lit(-1.0).alias("score"), "_o"), "free")
        full = pool.groupBy("source").agg(F.count("*").alias("_c")).filter(F.col("_c") >= most).select("source")  # there is more
        enough = free.unionByName(out[0].select("query", "doc", "score", "_o")).groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query")
        rest = lacking.join(full, "source", "left_semi").join(enough, "query", "left_anti")
        out.append(free.join(rest, "query", "left_anti"))
        lacking, most = rest, most * 16
    padded = _union(out, pairs)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "_o", "doc")
    return padded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "doc", "score")


def search(queries: DataFrame, corpus: DataFrame, relevant: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(hits, metrics) of text queries (query, tokens) against a corpus (doc, tokens), with the relevant pairs (query, doc).

    hits: (query, rank, doc, score, relevant); metrics: one row with the queries, their mean reciprocal rank and recall among
    the first k. A query without a relevant passage among them counts 0."""
    one = F.lit("all").alias("source")
    c = Corpus.__new__(Corpus)
    c.rows = materialize(corpus.select(one, "doc", "tokens"), "corpus")
    s = c.rows.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg")).first()
    c.n, c.avg = {"all": s["n"]}, {"all": s["avg"] or 1.0}
    c.dfs = materialize(c.rows.select("source", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("source", "term").agg(F.count("*").alias("df")), "df")
    found = [scan(c.rows, weigh(b, c, c.df(b)), k, c.avg) for b in blocks_of(queries.select("query", one, "tokens"), "query") if b]
    hits = best(_union(found, corpus), k).join(relevant.select("query", "doc").distinct().withColumn("_r", F.lit(True)), ["query", "doc"], "left")
    hits = materialize(hits.select("query", "rank", "doc", "score", F.coalesce("_r", F.lit(False)).alias("relevant")), "hits")
    own = relevant.select("query", "doc").distinct().groupBy("query").agg(F.count("*").alias("m"))
    per = own.join(hits.filter("relevant").groupBy("query").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "query", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return hits, per.agg(F.count("*").alias("n_queries"), F.round(F.avg(zero(1 / F.col("first"))), 9).alias("mrr"), F.round(F.avg(zero(F.col("n") / F.col("m"))), 9).alias("recall"))


def _union(found: list[DataFrame], like: DataFrame) -> DataFrame:
    if not found:
        return like.sparkSession.createDataFrame([], "query bigint, doc bigint, score double")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
