"""Queries on training pairs: building, negatives, BM25, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import batching, bm25
from granary.operators import pairs as P
from granary.plans.registry import SPACE, collapsed, query, tokens
from granary.session import table, texts


def _strip(c: str) -> str:
    return f"nullif(replace(replace({c}, '[QUERY] ', ''), '[PASSAGE] ', ''), '')"


@query(f"select id, {_strip('anchor')} as anchor, {_strip('positive')} as positive from pairs")
def pairs_without_prefixes(spark: SparkSession, where: str) -> DataFrame:
    return P.bare(texts(spark, where, "pairs")).select("id", "anchor", "positive")


@query(f"select id, '[QUERY] ' || {collapsed(_strip('anchor'))} as anchor, '[PASSAGE] ' || {collapsed(_strip('positive'))} as positive, label from pairs where length({_strip('anchor')}) > 5 and length({_strip('positive')}) > 20 and source <> 'clause_match'")
def qa_pairs_asymmetric(spark: SparkSession, where: str) -> DataFrame:
    p = P.bare(texts(spark, where, "pairs")).filter("length(anchor) > 5 and length(positive) > 20 and source <> 'clause_match'")
    return p.select("id", T.query_text(F.col("anchor")).alias("anchor"), T.passage_text(F.col("positive")).alias("positive"), "label")


@query(
    """with r as (select label, id, row_number() over (partition by label order by md5('6|' || id), id) as rank from pairs where label is not null)
select label, min(case when rank % 2 = 1 then id end) as first, min(case when rank % 2 = 0 then id end) as second from r group by label, (rank + 1) // 2 having count(*) = 2"""
)
def label_pairs_symmetric(spark: SparkSession, where: str) -> DataFrame:
    return P.label_pairs(texts(spark, where, "pairs"), "label", "id", 6)


_ITEMS = {"section_1": "business", "section_1A": "risk factors", "section_1B": "staff comments", "section_2": "properties", "section_3": "legal proceedings", "section_5": "market for equity", "section_7": "discussion of results", "section_7A": "market risk", "section_8": "financial statements", "section_9A": "controls"}
#: The question that a section of a filing answers.
QUESTIONS = {k: f"What does the filing say under {v}?" for k, v in _ITEMS.items()}


@query(
    "with u as (unpivot (select filename, " + ", ".join(QUESTIONS) + " from filings) on " + ", ".join(QUESTIONS) + " into name section value text)"
    + f" select filename, section, '[QUERY] ' || case section {' '.join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in QUESTIONS.items())} end as anchor, '[PASSAGE] ' || {collapsed('substr(text, 1, 3000)')} as positive from u where length({collapsed('text')}) > 100"
)
def section_unpivot_pairs(spark: SparkSession, where: str) -> DataFrame:
    return P.section_pairs(table(spark, where, "filings"), QUESTIONS)


@query("select id, source, label from pairs where label in (select label from pairs group by label having count(*) >= 2)")
def pairs_of_shared_labels(spark: SparkSession, where: str) -> DataFrame:
    return P.with_members(texts(spark, where, "pairs").filter("label is not null"), "label").select("id", "source", "label")


@query(
    """with o as (select id, arg_max(negatives, (coalesce(len(negatives), -1), to_json(negatives)::varchar)) as negatives from mined_negatives group by id),
e as (select id, unnest(negatives) as other, unnest(range(len(negatives))) as pos from o), j as (select e.id, pos, positive from e left join pairs on pairs.id = other)
select o.id, """
    + ", ".join(f"max(case when pos = {k} then positive end) as negative_{k}" for k in range(4))
    + " from o left join j on o.id = j.id group by o.id"
)
def negatives_pivot(spark: SparkSession, where: str) -> DataFrame:
    return P.negatives(texts(spark, where, "pairs"), table(spark, where, "mined_negatives"))


def _bm25(toks, idf: str, unique: bool) -> str:
    return f"""with p as (select id, source, label, {_strip("anchor")} as a, {_strip("positive")} as t from pairs where source is not null),
dt as (select source, id, unnest({toks("t")}) as term from p where t is not null), tf as (select source, id, term, count(*) as tf from dt group by all),
dl as (select source, id, len({toks("t")}) as dl from p where t is not null), st as (select source, count(*) as n, avg(dl) as av from dl group by source),
df as (select source, term, count(*) as df from tf group by all), ix as (select source, term, df, n, av, {idf} as idf from df join st using (source)),
qt as (select id as query, source, unnest({toks("a")}) as term from p where id % 100 = 0 and a is not null), q as (select query, source, term, {"1" if unique else "count(*)"} as qf from qt group by all),
s as (select query, tf.id as doc, round(sum(qf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av)))), 9) as score from q join ix using (source, term) join tf using (source, term) join dl on dl.source = tf.source and dl.id = tf.id group by all)"""


_IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
_SPACED = lambda c: rf"list_filter(string_split_regex(lower({c}), '{SPACE}'), lambda w: w <> '')"
_OKAPI = "case when ln((n - df + 0.5) / (df + 0.5)) < 0 then 0.25 * avg(ln((n - df + 0.5) / (df + 0.5))) over (partition by source) else ln((n - df + 0.5) / (df + 0.5)) end"


@query(_bm25(tokens, _IDF, True) + ", r as (select *, row_number() over (partition by query order by score desc, doc) as rank from s where score > 0) select query, rank, doc, round(score, 6) as score from r where rank <= 10")
def bm25_scores_topk(spark: SparkSession, where: str) -> DataFrame:
    return bm25.top(P.bare(texts(spark, where, "pairs"))).select("query", F.col("rank").cast("bigint").alias("rank"), "doc", F.round("score", 6).alias("score"))


@query(_bm25(_SPACED, _OKAPI, False) + ", r as (select *, row_number() over (partition by query order by score desc, doc) as rank from s where score > 0) select query, rank, doc, round(score, 6) as score from r where rank <= 10")
def bm25_okapi_rank(spark: SparkSession, where: str) -> DataFrame:
    return bm25.okapi(P.bare(texts(spark, where, "pairs"))).select("query", F.col("rank").cast("bigint").alias("rank"), "doc", F.round("score", 6).alias("score"))


@query(
    _bm25(tokens, _IDF, True)
    + """, bt as (select distinct source, coalesce(label, '') as label, t from p where t is not null),
el as (select q.id as query, d.id as doc from p q join p d using (source) where q.id % 100 = 0 and q.a is not null and d.t is not null and not exists (from bt where bt.source = q.source and bt.label = coalesce(q.label, '') and bt.t = d.t)),
cp as (select id, row_number() over (partition by source, t order by id) as nth from p where t is not null),
c as (select el.query, el.doc, coalesce(case when s.score > 0 then s.score end, -1.0) as score, md5('11|' || el.doc) as o from el join cp on cp.id = el.doc and nth <= 2 left join s on s.query = el.query and s.doc = el.doc),
r as (select *, row_number() over (partition by query order by score desc, case when score > 0 then '' else o end, doc) as rank from c) select query, rank, doc, round(score, 6) as score from r where rank <= 2"""
)
def bm25_hard_negatives(spark: SparkSession, where: str) -> DataFrame:
    found = bm25.hard_negatives(P.bare(texts(spark, where, "pairs")))
    return found.select("query", F.col("rank").cast("bigint").alias("rank"), "doc", F.round("score", 6).alias("score"))


@query(
    """with r as (select vec_id, label, row_number() over (partition by label order by md5('12|' || vec_id), vec_id) as batch_round from embeddings where label is not null),
n as (select *, row_number() over (partition by batch_round order by md5('13|' || vec_id), vec_id) as k, count(*) over (partition by batch_round) as c from r)
select vec_id, label, batch_round, (k - 1) // 8 as batch_no from n where (k - 1) // 8 < c // 8"""
)
def label_free_batches(spark: SparkSession, where: str) -> DataFrame:
    return batching.label_free(table(spark, where, "embeddings"), "label", "vec_id", 8, 12)


_ONCE = "o as (select id, arg_max(negatives, (coalesce(len(negatives), -1), to_json(negatives)::varchar)) as negatives from mined_negatives group by id), e as (select id, unnest(negatives) as other, unnest(range(len(negatives))) as pos from o)"


@query(
    f"""with {_ONCE} select 'p' || id as corpus_id, length(positive) as n_chars from pairs where length(positive) > 0
union all select 'n' || e.id || '-' || pos, length(positive) from e join pairs on pairs.id = other where length(positive) > 0"""
)
def retrieval_corpus(spark: SparkSession, where: str) -> DataFrame:
    """Passages to search: all positives, and the mined negatives of each id."""
    return P.corpus(texts(spark, where, "pairs"), table(spark, where, "mined_negatives")).select("corpus_id", F.length("text").cast("bigint").alias("n_chars"))


_SEARCH = f"""with {_ONCE}, p as (select id, {_strip("anchor")} as a, {_strip("positive")} as t from pairs),
c as (select id * 1024 as doc, t from p where length(t) > 0 union all select e.id * 1024 + 1 + pos, t from e join p on p.id = other where length(t) > 0),
dt as (select doc, unnest({tokens("t")}) as term from c), tf as (select doc, term, count(*) as tf from dt group by all), dl as (select doc, len({tokens("t")}) as dl from c), st as (select count(*) as n, avg(dl) as av from dl),
ix as (select term, count(*) as df, any_value(n) as n, any_value(av) as av, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, st group by term),
q as (select distinct id as query, unnest({tokens("a")}) as term from p where id % 100 = 0 and a is not null),
s as (select query, doc, round(sum(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av)))), 9) as score from q join ix using (term) join tf using (term) join dl using (doc) group by all),
r as (select *, row_number() over (partition by query order by score desc, doc) as rank from s where score > 0), h as (select query, rank, doc, score, doc = query * 1024 as relevant from r where rank <= 10)"""


def _searched(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    bare = P.bare(texts(spark, where, "pairs"))
    place = F.when(F.col("corpus_id").startswith("p"), F.lit(0)).otherwise(F.regexp_extract("corpus_id", r"-(\d+)$", 1).cast("bigint") + 1)
    corpus = P.corpus(bare, table(spark, where, "mined_negatives")).select((F.regexp_extract("corpus_id", r"^.(\d+)", 1).cast("bigint") * 1024 + place).alias("doc"), T.lexical_tokens(F.col("text")).alias("tokens"))
    asked = bare.filter("id % 100 = 0 and anchor is not null").select(F.col("id").alias("query"), T.lexical_tokens(F.col("anchor")).alias("tokens"), F.length("positive").alias("n"))
    return bm25.search(asked, corpus, asked.filter("n > 0").select("query", (F.col("query") * 1024).alias("doc")))


@query(_SEARCH + " select query, rank, doc, round(score, 6) as score, relevant from h")
def retrieval_query_corpus(spark: SparkSession, where: str) -> DataFrame:
    """The stated anchors against all positives and negatives, with whether a hit is the anchor's own positive."""
    return _searched(spark, where)[0].select("query", F.col("rank").cast("bigint").alias("rank"), "doc", F.round("score", 6).alias("score"), "relevant")


@query(
    _SEARCH
    + ", m as (select id as query from p where id % 100 = 0 and a is not null and length(t) > 0), f as (select query, min(rank) as first from h where relevant group by query) select count(*) as n_queries, round(avg(coalesce(1.0 / first, 0)), 9) as mrr, round(avg(case when first is null then 0.0 else 1.0 end), 9) as recall from m left join f using (query)"
)
def retrieval_query_metrics(spark: SparkSession, where: str) -> DataFrame:
    return _searched(spark, where)[1]


@query(
    _bm25(tokens, _IDF, True)
    + f""", al as (select coalesce(label, '') as label, unnest([{_strip("anchor")}, {_strip("positive")}]) as t from pairs), bt as (select distinct label, t from al where t is not null),
el as (select q.id as query, d.id as doc from p q join p d using (source) where q.id % 100 = 0 and q.a is not null and d.t is not null and not exists (from bt where bt.label = coalesce(q.label, '') and bt.t = d.t)),
cp as (select id, row_number() over (partition by source, t order by id) as nth from p where t is not null),
c as (select el.query, el.doc, coalesce(case when s.score > 0 then s.score end, -1.0) as score, md5('11|' || el.doc) as o from el join cp on cp.id = el.doc and nth <= 2 left join s on s.query = el.query and s.doc = el.doc),
r as (select *, row_number() over (partition by query order by score desc, case when score > 0 then '' else o end, doc) as rank from c) select query, rank, doc, round(score, 6) as score from r where rank <= 2"""
)
def bm25_negatives_python_spec(spark: SparkSession, where: str) -> DataFrame:
    """Guards over all sources, with anchors as well as positives banned."""
    found = bm25.hard_negatives(P.bare(texts(spark, where, "pairs")), anchors_too=True)
    return found.select("query", F.col("rank").cast("bigint").alias("rank"), "doc", F.round("score", 6).alias("score"))


_LEAST = {"clause_match": 50, "clause_qa": 20}


@query(f"select id, source from pairs where length({_strip('positive')}) > case source when 'clause_match' then 50 when 'clause_qa' then 20 else 0 end")
def pair_minima(spark: SparkSession, where: str) -> DataFrame:
    """Pairs whose positive has more characters than its builder asks for; empty ones are dropped."""
    return P.longer_than(P.bare(texts(spark, where, "pairs")), _LEAST).select("id", "source")
