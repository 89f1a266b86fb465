"""Queries on documents: near-duplicates, ingestion, sampling, packing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import dedup, ingest, pack, probes, ranges, sampling
from granary.plans.registry import DOCUMENTS, SPACE, collapsed, documents, query, runs_key, tokens
from granary.session import materialize, small, table, texts

ORDER = ["src_rank", "doc_id"]
_PARAGRAPH = r"\n[\s\x0B]*\n"


def _units(split: str, key: str = runs_key("unit")) -> str:
    return rf"""with {DOCUMENTS}, s as (select source, src_rank, doc_id, string_split_regex(text, '{split}') as l from d),
p as (select source, src_rank, doc_id, unnest(l) as raw, unnest(range(len(l))) as unit_pos from s),
c as (select * exclude (raw), {collapsed("raw")} as unit from p),
n as (select *, case when length(unit) >= 120 then {key} end as norm from c where unit <> ''),
k as (select *, norm is null or row_number() over (partition by norm order by src_rank, doc_id, unit_pos) = 1 as kept from n)"""


def _marked(spark: SparkSession, where: str, split: str, key=T.runs_of_collapsed) -> DataFrame:
    return dedup.marks(documents(spark, where), ORDER, "source", split=split, key=key)


@query(_units(_PARAGRAPH) + " select doc_id, unit_pos, kept, norm is null as is_short from k")
def near_dedup_units(spark: SparkSession, where: str) -> DataFrame:
    return _marked(spark, where, T.PARAGRAPH).select("doc_id", F.col("unit_pos").cast("bigint").alias("unit_pos"), "kept", "is_short")


@query(_units(_PARAGRAPH) + " select source, doc_id, string_agg(unit, chr(10) || chr(10) order by unit_pos) as text, count(*) as n_units from k where kept group by source, doc_id having length(string_agg(unit, chr(10) || chr(10) order by unit_pos)) >= 200")
def near_dedup_docs(spark: SparkSession, where: str) -> DataFrame:
    docs = documents(spark, where).select("source", *ORDER, "text")
    return dedup.documents(docs, dedup.marks(docs, ORDER), ORDER).select("source", "doc_id", "text", "n_units")


@query(_units(r"\n") + " select doc_id, unit_pos, kept, norm is null as is_short from k")
def near_dedup_lines(spark: SparkSession, where: str) -> DataFrame:
    return _marked(spark, where, T.LINE).select("doc_id", F.col("unit_pos").cast("bigint").alias("unit_pos"), "kept", "is_short")


_DIGITS = r"lower(regexp_replace(trim(regexp_replace(regexp_replace(unit, '[^\p{L}\p{Nd}\s]', '', 'g'), '\s+', ' ', 'g')), '\p{Nd}', '#', 'g'))"


@query(_units(_PARAGRAPH, _DIGITS) + " select doc_id, unit_pos, kept, norm is null as is_short from k")
def near_dedup_digit_mode(spark: SparkSession, where: str) -> DataFrame:
    return _marked(spark, where, T.PARAGRAPH, T.normalise_digits).select("doc_id", F.col("unit_pos").cast("bigint").alias("unit_pos"), "kept", "is_short")


@query(
    _units(_PARAGRAPH)
    + """, o as (select doc_id from k where kept group by doc_id having length(string_agg(unit, chr(10) || chr(10) order by unit_pos)) >= 200)
select source, cast(grouping(source) as integer) as is_total, count(distinct doc_id) as docs_in, count(distinct case when doc_id in (from o) then doc_id end) as docs_out,
cast(sum(case when kept then length(unit) else 0 end) as bigint) as kept_chars, cast(sum(case when not kept then length(unit) else 0 end) as bigint) as dropped_chars,
round(100.0 * sum(case when not kept then length(unit) else 0 end) / sum(length(unit)), 6)::double as dropped_pct, cast(sum(case when kept and norm is not null then 1 else 0 end) as bigint) as unique_units,
round(sum(case when kept then length(unit) else 0 end) / (select sum(length(unit)) from k where kept)::double, 9) as kept_share from k group by rollup (source)"""
)
def dedup_stats_by_source(spark: SparkSession, where: str) -> DataFrame:
    return dedup.stats(_marked(spark, where, T.PARAGRAPH))


@query(
    """with a as (select source, count(*) as n_raw from documents where text is not null group by source),
b as (select source, count(*) as n_read from documents where text is not null and trim(regexp_replace(text, '[\\s\\x0B\\p{Z}]+', ' ', 'g')) <> '' group by source)
select coalesce(a.source, '(none)') as source, coalesce(n_raw, 0) as n_raw, coalesce(n_read, 0) as n_read, coalesce(n_raw, 0) - coalesce(n_read, 0) as n_missing from a full outer join b on a.source is not distinct from b.source"""
)
def dedup_doc_count_guard(spark: SparkSession, where: str) -> DataFrame:
    docs = documents(spark, where)
    read = docs.filter(F.exists(dedup.unit_array(F.col("text")), lambda u: u != ""))
    return dedup.count_guard(docs, read)


@query("select coalesce(source, '(none)') as source, count(*) as n_raw, count(*) as n_read, 0 as n_missing from documents where text is not null group by all")
def dedup_guard_holds(spark: SparkSession, where: str) -> DataFrame:
    """Each source's documents are all among those that the marking of units has read, or the query ends with an error."""
    docs = documents(spark, where)
    read = docs.select("source", "doc_id", F.explode(dedup.unit_array(F.col("text")))).select("source", "doc_id").distinct()
    return dedup.guarded(dedup.count_guard(docs, read))


@query(
    """with e as (select doc_id, source, length(text) as n, sum(length(text)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding) as b
from documents where length(trim(text)) >= 200 and source is not null) select doc_id, source, cast(n as bigint) as n_chars, cast(coalesce(b, 0) as bigint) as before from e where coalesce(b, 0) < 40000"""
)
def ingest_min_length_budget(spark: SparkSession, where: str) -> DataFrame:
    """Each source up to 40,000 characters. Its running sums come from one sorted pass per source range, keyed by source first."""
    docs = ingest.long_enough(texts(spark, where, "documents").filter("source is not null")).withColumn("n", F.length("text").cast("bigint"))
    return ingest.budget_per_source(docs, "source", ["doc_id"], F.col("n"), 40_000).select("doc_id", "source", F.col("n").alias("n_chars"), "before")


@query(
    """with e as (select doc_id, source, length(text) as n from documents where length(trim(text)) >= 200 and source in ('web_essays', 'web_forums')),
f as (select *, coalesce(sum(n) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from e) select doc_id, source, cast(before as bigint) as before from f where before < 30000"""
)
def ingest_two_sources(spark: SparkSession, where: str) -> DataFrame:
    docs = ingest.long_enough(texts(spark, where, "documents")).select("doc_id", "source", F.length("text").cast("bigint").alias("n"))
    halves = ingest.union_of_halves(docs.filter("source = 'web_essays'"), docs.filter("source = 'web_forums'"), ["doc_id"], F.col("n"), 60_000)
    return halves.select("doc_id", "source", "before")


_SECTIONS = [*(f"section_{x}" for x in "1 1A 1B 2 3 4 5 6 7 7A 8 9 9A 9B 10 11 12 13 14 15".split())]


@query("select filename, concat_ws(chr(10) || chr(10), " + ", ".join(f"case when {collapsed(c)} <> '' then {c} end" for c in _SECTIONS) + ") as text from filings")
def filing_texts(spark: SparkSession, where: str) -> DataFrame:
    f = table(spark, where, "filings")
    return f.select("filename", ingest.sections_text(f, _SECTIONS).alias("text"))


@query(
    """select source, count(*) as n_docs, count(text) as n_texts, cast(coalesce(sum(length(text)), 0) as bigint) as n_chars, cast(coalesce(sum(strlen(text)), 0) as bigint) as n_bytes,
cast(coalesce(max(length(text)), 0) as bigint) as longest, cast(grouping(source) as integer) as is_total,
round(coalesce(sum(length(text)), 0) / greatest((select sum(length(text)) from documents), 1)::double, 9) as share from documents group by rollup (source)"""
)
def corpus_stats(spark: SparkSession, where: str) -> DataFrame:
    return ingest.corpus_stats(texts(spark, where, "documents"))


@query(
    """with p as (select doc_id, text, unnest(range(greatest(cast(ceil(length(text) / 1000.0) as bigint), 1))) as piece_no from documents where text is not null)
select doc_id, piece_no, length(substr(text, piece_no * 1000 + 1, 1000)) as n_chars, md5(substr(text, piece_no * 1000 + 1, 1000)) as digest from p"""
)
def split_long_documents(spark: SparkSession, where: str) -> DataFrame:
    """Pieces of 1,000 characters, since the test texts rarely have 50,000."""
    cut = pack.split_long(texts(spark, where, "documents").select("doc_id", "text"), 1000)
    return cut.select("doc_id", F.col("piece_no").cast("bigint").alias("piece_no"), F.length("piece").cast("bigint").alias("n_chars"), F.md5("piece").alias("digest"))


@query(
    r"""select doc_id, length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) as n_controls,
regexp_matches(text, '\\[nrtu"]') or contains(text, chr(65533)) as is_torn from documents where text is not null"""
)
def control_characters(spark: SparkSession, where: str) -> DataFrame:
    d = texts(spark, where, "documents").filter("text is not null")
    return d.select("doc_id", (F.length("text") - F.length(T.without_controls(F.col("text")))).cast("bigint").alias("n_controls"), T.torn(F.col("text")).alias("is_torn"))


_QUOTA = {"financial_edgar": 60, "general_web": 50, "legal_caselaw": 40, "legal_contracts": 30, "legal_regulations": 20, "financial_pol": 10}
_SNAP = """w as (select doc_id, domain, text, unnest(range(greatest(cast(ceil(length(text) / 600.0) as bigint), 1))) as window_no from documents where length(text) > 0 and domain is not null),
c as (select doc_id, domain, window_no, substr(text, window_no * 600 + 1, 600) as c0 from w),
h as (select *, case when instr(c0, ' ') between 1 and 40 then substr(c0, instr(c0, ' ') + 1) else c0 end as c1 from c),
t as (select *, case when instr(reverse(c1), ' ') between 1 and 40 then substr(c1, 1, length(c1) - instr(reverse(c1), ' ')) else c1 end as c2 from h),
x as (select doc_id, domain, window_no, trim(regexp_replace(c2, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g')) as chunk from t where not (regexp_matches(c2, '\\\\[nrtu"]') or contains(c2, chr(65533))))"""


def _windows(docs: DataFrame) -> DataFrame:
    w = sampling.windows(docs.select("doc_id", "domain", "text"), 600)
    return w.select("doc_id", "domain", F.col("window_no").cast("bigint").alias("window_no"), sampling.clean_chunk(F.col("chunk")).alias("chunk")).filter(F.length("chunk") >= 400)


@query(
    f"""with {_SNAP}, f as (select *, row_number() over (partition by md5(substr(chunk, 1, 512)) order by doc_id, window_no) as first_ from x where length(chunk) >= 400),
q as (select *, row_number() over (partition by domain order by md5('7|' || doc_id || '|' || window_no), doc_id, window_no) as rn from f where first_ = 1)
select doc_id, domain, window_no, chunk from q where rn <= case domain {" ".join(f"when '{k}' then {v}" for k, v in _QUOTA.items())} else 0 end"""
)
def chunk_sample_stratified(spark: SparkSession, where: str) -> DataFrame:
    """Windows are chosen by their numbers and the keys of their heads; only the chosen ones' texts are read again."""
    docs, order = texts(spark, where, "documents").filter("domain is not null"), ["doc_id", "window_no"]
    heads = materialize(_windows(docs).select("doc_id", "domain", "window_no", T.head_key(F.col("chunk")).alias("head")), "heads")
    chosen = materialize(sampling.quota(sampling.distinct_heads(heads, order), "domain", _QUOTA, 7, *order).select(*order), "chosen")
    own = docs.join(small(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    return _windows(own).join(small(chosen), order).select("doc_id", "domain", "window_no", "chunk")


@query(
    """with s as (select doc_id, text, cast(('0x' || substr(md5('9|' || doc_id), 1, 8)) as bigint) as h from documents where text is not null),
p as (select doc_id, h % (greatest(length(text) - 500, 0) + 1) as start, substr(text, start + 1, 500) as cut from s)
select doc_id, start, case when start > 0 and instr(cut, ' ') between 1 and 40 then substr(cut, instr(cut, ' ') + 1) else cut end as passage from p"""
)
def passage_sample_with_offset(spark: SparkSession, where: str) -> DataFrame:
    start, passage = sampling.passage(F.col("text"), F.col("doc_id"), 9, 500)
    return texts(spark, where, "documents").filter("text is not null").select("doc_id", start.alias("start"), passage.alias("passage"))


@query(
    """with s as (select doc_id, text, cast(('0x' || substr(md5('5|' || doc_id), 1, 8)) as bigint) as h from documents where length(text) > 0)
select doc_id, round(-ln((h + 1.0) / 4294967297.0) / length(text), 12)::double as weight_key from s order by weight_key, doc_id limit 100"""
)
def length_biased_sample(spark: SparkSession, where: str) -> DataFrame:
    return sampling.by_length(texts(spark, where, "documents"), 5, 100, "doc_id").select("doc_id", "weight_key")


@query(
    """with o as (select doc_id, source, length(text) as n, row_number() over (partition by source order by doc_id) as turn, coalesce(sum(length(text)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as own
from documents where text is not null and source is not null), b as (select *, coalesce(sum(n) over (order by turn, source, doc_id rows between unbounded preceding and 1 preceding), 0) as before from o where own < 30000)
select doc_id, source, turn, cast(before as bigint) as before from b where before < 400000"""
)
def tokenizer_round_robin_sample(spark: SparkSession, where: str) -> DataFrame:
    docs = texts(spark, where, "documents").filter("text is not null and source is not null").select("doc_id", "source", F.length("text").cast("bigint").alias("n"))
    return sampling.round_robin(docs, "source", ["doc_id"], F.col("n"), 30_000, 400_000).select("doc_id", "source", F.col("turn").cast("bigint").alias("turn"), "before")


@query("select doc_id, case when row_number() over (order by md5('3|' || doc_id), doc_id) <= 50 then 'val' else 'train' end as split from documents")
def holdout_split(spark: SparkSession, where: str) -> DataFrame:
    return sampling.holdout(texts(spark, where, "documents").select("doc_id"), 3, 50, "doc_id")


@query("select doc_id, case when row_number() over (order by md5('4|' || doc_id), doc_id) <= ceil(0.02 * (select count(*) from documents)) then 'test' else 'train' end as split from documents")
def fraction_split(spark: SparkSession, where: str) -> DataFrame:
    return sampling.fraction(texts(spark, where, "documents").select("doc_id"), 4, 0.02, "doc_id")


@query("select doc_id, row_number() over (order by md5('1|' || doc_id), doc_id) as rank from documents")
def global_shuffle(spark: SparkSession, where: str) -> DataFrame:
    return ranges.ranked(sampling.shuffled(texts(spark, where, "documents").select("doc_id"), 1, "doc_id"), [F.col("place"), F.col("doc_id")]).drop("place")


@query("select doc_id from documents order by md5('2|' || doc_id), doc_id limit 64")
def seeded_head(spark: SparkSession, where: str) -> DataFrame:
    return sampling.head(texts(spark, where, "documents").select("doc_id"), 2, 64, "doc_id").select("doc_id")


_TOKENS = f"w as (select unnest({tokens('text')}) as token from documents where text is not null), f as (select token, count(*) as n from w group by token)"


@query(f"with {_TOKENS}, p as (select n / (sum(n) over ())::double as p, n from f) select cast(sum(n) as bigint) as n_tokens, count(*) as n_types, round(-sum(p * ln(p)), 9) as entropy, round(exp(-sum(p * ln(p))), 6) as perplexity, round(ln(count(*)), 9) as uniform from p")
def token_counts_entropy(spark: SparkSession, where: str) -> DataFrame:
    return probes.entropy(probes.token_counts(texts(spark, where, "documents")))


@query(
    f"""with {_TOKENS}, r as (select token, n, row_number() over (order by n desc, token) as rank from f)
select case when rank <= 100 then 'top_100' when rank <= 1000 then '100_1k' when rank <= 10000 then '1k_10k' else '10k_up' end as bucket, count(*) as n_types, cast(sum(n) as bigint) as n_tokens, round(sum(n * ln(rank)) / sum(n), 9) as mean_log_rank from r group by 1"""
)
def token_frequency_buckets(spark: SparkSession, where: str) -> DataFrame:
    return probes.frequency_buckets(probes.token_counts(texts(spark, where, "documents")))


_STREAM = f"""with s as (select doc_id, source, coalesce(source, '') as src, text, case when text is null then 0 else len({tokens("text")}) + 2 end as n_tokens from documents),
o as (select *, coalesce(sum(n_tokens) over (order by src, doc_id rows between unbounded preceding and 1 preceding), 0) as token_start from s)"""


def _docs(spark: SparkSession, where: str) -> DataFrame:
    return texts(spark, where, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("src"), "text")


def _stream(spark: SparkSession, where: str) -> DataFrame:
    return pack.stream(_docs(spark, where), "doc_id", ["src", "doc_id"])


@query(_STREAM + " select doc_id, cast(n_tokens as bigint) as n_tokens, cast(token_start as bigint) as token_start from o")
def token_offsets(spark: SparkSession, where: str) -> DataFrame:
    return _stream(spark, where).select("doc_id", "n_tokens", "token_start")


@query(
    _STREAM
    + f""", t as (select unnest(list_concat(list_concat(['<s>'], {tokens("text")}), ['</s>'])) as token, token_start + unnest(range(n_tokens)) as pos from o where text is not null)
select cast(pos // 512 as bigint) as block_id, array_to_string(list(token order by pos), ' ') as tokens from t group by 1 having count(*) = 512"""
)
def pack_blocks(spark: SparkSession, where: str) -> DataFrame:
    return pack.blocks(_docs(spark, where), "doc_id", ["src", "doc_id"], 512).select("block_id", F.array_join("tokens", " ").alias("tokens"))


@query(
    _STREAM
    + """, m as (select sum(n_tokens) as total from o), b as (select total, total // 512 as nb, least(20, total // 512) as vb from m)
select 50257 as vocab_size, 512 as block_size, 'uint16' as dtype, cast(total as bigint) as total_tokens, cast((nb - vb) * 512 as bigint) as train_tokens, cast(vb * 512 as bigint) as val_tokens, cast(nb - vb as bigint) as train_blocks, cast(vb as bigint) as val_blocks from b"""
)
def pack_meta(spark: SparkSession, where: str) -> DataFrame:
    return pack.meta(_stream(spark, where), 512, 20, 50257)


@query(
    _STREAM
    + """, m as (select (sum(n_tokens) // 512 - least(20, sum(n_tokens) // 512)) * 512 as train from o)
select doc_id, cast(greatest(least(token_start + n_tokens, train) - token_start, 0) as bigint) as train_tokens, cast(n_tokens - greatest(least(token_start + n_tokens, train) - token_start, 0) as bigint) as val_tokens from o, m where n_tokens > 0"""
)
def pack_tail_split(spark: SparkSession, where: str) -> DataFrame:
    placed = materialize(_stream(spark, where).select("doc_id", "n_tokens", "token_start"), "stream")
    train = pack.meta(placed, 512, 20, 50257).first()["train_tokens"]
    own = F.greatest(F.least(F.col("token_start") + F.col("n_tokens"), F.lit(train)) - F.col("token_start"), F.lit(0))
    return placed.filter("n_tokens > 0").select("doc_id", own.alias("train_tokens"), (F.col("n_tokens") - own).alias("val_tokens"))


_TERMS = ["assignment", "confidentiality", "indemnification", "warranty", "escrow", "arbitration", "covenant", "lien", "tribunal", "goodwill"]


@query(
    _STREAM.replace("list_filter", "list_filter")
    + f""", t as (select doc_id, unnest({tokens("text")}) as token, token_start + 1 + unnest(range(n_tokens - 2)) as pos from o where text is not null),
m as (select max(token_start + n_tokens) as total from o), h as (select token as term, doc_id, pos from t, m where token in ({", ".join(f"'{x}'" for x in _TERMS)}) and pos between 16 and total - 17),
r as (select *, row_number() over (partition by term order by pos) as rn from h) select term, rn, doc_id, cast(pos as bigint) as pos from r where rn <= 20"""
)
def domain_term_contexts(spark: SparkSession, where: str) -> DataFrame:
    return probes.term_contexts(_docs(spark, where), _stream(spark, where), _TERMS, 20, 16).select("term", F.col("rn").cast("bigint").alias("rn"), "doc_id", "pos")


@query(
    """select doc_id, """
    + ", ".join(f"cast(len(regexp_extract_all(lower(text), '\\b{t}\\b')) as bigint) as n_{t}" for t in _TERMS[:4])
    + " from documents where text is not null"
)
def domain_term_counts(spark: SparkSession, where: str) -> DataFrame:
    low = F.lower("text")
    return texts(spark, where, "documents").filter("text is not null").select("doc_id", *(F.regexp_count(low, F.lit(rf"\b{t}\b")).cast("bigint").alias(f"n_{t}") for t in _TERMS[:4]))


@query("select doc_id, cast(('0x' || substr(md5('8|' || doc_id), 1, 8)) as bigint) % 1000 < 300 as is_masked from documents")
def token_mask(spark: SparkSession, where: str) -> DataFrame:
    return sampling.masked(texts(spark, where, "documents").select("doc_id"), 8, 300, "doc_id")


@query("select domain, count(distinct source) as n_sources, count(distinct md5(text)) as n_texts, count(distinct lang) as n_langs from documents group by domain")
def distinct_counts(spark: SparkSession, where: str) -> DataFrame:
    return texts(spark, where, "documents").groupBy("domain").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct(F.md5("text")).alias("n_texts"), F.countDistinct("lang").alias("n_langs"))


@query(
    """with q as (select domain, doc_id, length(text) as n, ntile(4) over (order by doc_id) as quarter from documents where text is not null)
select coalesce(domain, '(none)') as domain, cast(sum(n) as bigint) as loss, count(*) as n, round(sum(n) / count(*)::double, 6) as mean_loss, round(avg(case when n > 1000 then 1.0 else 0.0 end), 6)::double as top1, round(avg(case when n > 400 then 1.0 else 0.0 end), 6)::double as top5 from q group by 1"""
)
def loss_by_domain(spark: SparkSession, where: str) -> DataFrame:
    """Weighted loss and accuracy per domain, with a text's length in the place of a loss."""
    return probes.weighted_loss(_losses(spark, where), ["domain"])


def _losses(spark: SparkSession, where: str) -> DataFrame:
    n = F.length("text")
    return texts(spark, where, "documents").filter("text is not null").select(F.coalesce("domain", F.lit("(none)")).alias("domain"), n.cast("bigint").alias("loss"), (n > 1000).alias("hit"), (n > 400).alias("hit5"))


@query("select round(avg(m), 6) as mean_loss, count(*) as n_groups from (select round(avg(length(text)), 6) as m from documents where text is not null group by coalesce(domain, '(none)'))")
def loss_unweighted(spark: SparkSession, where: str) -> DataFrame:
    """The mean over domains, each counting the same."""
    return probes.unweighted_mean(probes.weighted_loss(_losses(spark, where), ["domain"])).withColumn("mean_loss", F.round("mean_loss", 6))


@query("select count(*) as n, cast(sum(n_chars) as bigint) as loss from documents where n_chars is not null and n_chars <> 0")
def loss_of_unmasked(spark: SparkSession, where: str) -> DataFrame:
    """Rows whose label counts; a length of 0 stands for the mark of what doesn't."""
    d = table(spark, where, "documents").filter("n_chars is not null").select(F.col("n_chars").alias("label"))
    return probes.unmasked(d, "label", 0).agg(F.count("*").alias("n"), F.sum("label").alias("loss"))


@query(
    f"""with {_TOKENS}, r as (select token, n, row_number() over (order by n desc, token) as rank from f), b as (select case when rank <= 100 then 'top_100' when rank <= 1000 then '100_1k' when rank <= 10000 then '1k_10k' else '10k_up' end as bucket, * from r)
select bucket, cast(sum(n) as bigint) as n, cast(sum(n * length(token)) as bigint) as loss, round(sum(n * length(token)) / sum(n)::double, 6) as mean_loss, round(sum(case when length(token) > 4 then n else 0 end) / sum(n)::double, 6) as top1 from b group by bucket"""
)
def loss_by_frequency(spark: SparkSession, where: str) -> DataFrame:
    """A token's length in the place of its loss, by its rank in frequency."""
    d = texts(spark, where, "documents")
    t = d.filter("text is not null").select(F.explode(T.lexical_tokens(F.col("text"))).alias("token"))
    return probes.by_frequency(t.select("token", F.length("token").cast("bigint").alias("loss"), (F.length("token") > 4).alias("hit")), probes.token_counts(d))


@query(_STREAM + f""", t as (select unnest({tokens("text")}) as token, token_start + 1 + unnest(range(n_tokens - 2)) as pos from o where text is not null) select cast(pos as bigint) as token_ord, token from t where pos % 64 = 0 and pos < 64 * 500""")
def token_stride_sample(spark: SparkSession, where: str) -> DataFrame:
    """Every 64th token of the stream, 500 at most; marks at such places are left out."""
    placed = _stream(spark, where).filter("n_tokens > 0").select("doc_id", "token_start")
    rows = _docs(spark, where).filter("text is not null").join(placed, "doc_id")
    got = sampling.strided_tokens(rows, T.marked_tokens(F.col("text"), "<s>", "</s>"), 64, 500)
    return got.filter("token not in ('<s>', '</s>')")


_BLOCKS = (
    _STREAM
    + f""", t as (select unnest(list_concat(list_concat(['<s>'], {tokens("text")}), ['</s>'])) as token, token_start + unnest(range(n_tokens)) as pos from o where text is not null),
b as (select cast(pos // 512 as bigint) as block_id, md5(array_to_string(list(token order by pos), ' ')) as digest from t group by 1 having count(*) = 512)"""
)


@query(_BLOCKS + " select block_id, digest from b where block_id in (0, 7, 11)")
def blocks_by_id(spark: SparkSession, where: str) -> DataFrame:
    """Three blocks read by their numbers from the written table."""
    b = materialize(pack.blocks(_docs(spark, where), "doc_id", ["src", "doc_id"], 512), "blocks")
    return pack.by_id(b, 0, 7, 11).select("block_id", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(_BLOCKS + ", n as (select count(*) as n from b) select block_id, digest from b, n where block_id >= n - least(20, n) and block_id < n - least(20, n) + 5")
def validation_blocks_head(spark: SparkSession, where: str) -> DataFrame:
    """The first five of the twenty validation blocks."""
    train = pack.meta(_stream(spark, where), 512, 20, 50257).first()["train_blocks"]
    b = materialize(pack.blocks(_docs(spark, where), "doc_id", ["src", "doc_id"], 512), "blocks")
    return pack.validation_head(b, train, 5).select("block_id", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("select doc_id, coalesce(source, '') as src from (select doc_id, source, row_number() over (order by coalesce(source, ''), doc_id) as n from documents) where n % 7 = 1 and n <= 7 * 99 + 1")
def stride_sample(spark: SparkSession, where: str) -> DataFrame:
    docs = texts(spark, where, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("src"))
    return sampling.stride(docs, [F.col("src"), F.col("doc_id")], 7, 100)


@query(
    f"""with {DOCUMENTS}, t as (select unnest({tokens("text")}) as token, unnest(range(len({tokens("text")}))) % 512 as pos from d)
select cast(floor(pos * 4 / 512) as integer) + 1 as quarter, cast(sum(length(token)) as bigint) as loss, count(*) as n, round(sum(length(token)) / count(*)::double, 6) as mean_loss, round(avg(case when length(token) > 4 then 1.0 else 0.0 end), 6)::double as top1 from t group by 1"""
)
def loss_by_position(spark: SparkSession, where: str) -> DataFrame:
    """A token's length in the place of its loss, by the quarter of a block of 512."""
    t = texts(spark, where, "documents").filter("text is not null").select(F.posexplode(T.lexical_tokens(F.col("text"))).alias("i", "token"))
    return probes.by_position(t.select((F.col("i") % 512).alias("pos"), F.length("token").cast("bigint").alias("loss"), (F.length("token") > 4).alias("hit")), "pos", 512)


@query(
    "select doc_id, term, count(*) as n from (select doc_id, lower(unnest(regexp_extract_all(text, '(?i)\\b(" + "|".join(sorted(_TERMS, key=lambda t: (-len(t), t))) + ")\\b'))) as term from documents where text is not null) group by all"
)
def domain_term_hits(spark: SparkSession, where: str) -> DataFrame:
    hits = texts(spark, where, "documents").filter("text is not null").select("doc_id", F.explode(T.term_hits(F.col("text"), _TERMS)).alias("term"))
    return hits.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
