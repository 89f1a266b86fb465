"""Queries on single texts: cuts, fragments, prompts, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import synth
from granary.plans.registry import query
from granary.session import table, texts

_FIRMS, _MADE = ["Alpha Corp.", "Beta Ltd.", "Gamma LLC"], ["the Buyer", "the Seller"]


def _docs(spark: SparkSession, where: str) -> DataFrame:
    return texts(spark, where, "documents").filter("text is not null").select("doc_id", "text", "source", "n_chars")


@query("select doc_id, md5(substr(text, 1, (select max(n) from unnest(range(least(length(text), 60) + 1)) u(n) where strlen(substr(text, 1, n)) <= 60)::bigint)) as digest from documents where text is not null")
def texts_cut_to_bytes(spark: SparkSession, where: str) -> DataFrame:
    """The longest start of whole characters with at most 60 bytes."""
    return _docs(spark, where).select("doc_id", F.md5(T.truncate_bytes(F.col("text"), 60)).alias("digest"))


@query(r"""select doc_id, length(regexp_extract(substr(to_json(substr(text, 1, 300))::varchar, 2), '(?s)^((?:[^"\\]|\\.)*)', 1)) as n_chars from documents where text is not null and not regexp_matches(substr(text, 1, 300), '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]')""")
def quoted_prefixes(spark: SparkSession, where: str) -> DataFrame:
    """A text's start as a JSON string, up to the first quote that is not escaped."""
    head = F.expr("substring(to_json(array(substring(text, 1, 300))), 3)")
    plain = _docs(spark, where).filter(~F.substring("text", 1, 300).rlike(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"))  # the engines write these escapes differently
    return plain.select("doc_id", F.length(T.until_quote(head)).cast("bigint").alias("n_chars"))


@query("select doc_id, md5(substr(text, 1, 200)) as digest from documents where text is not null")
def fragments_unescaped(spark: SparkSession, where: str) -> DataFrame:
    """A fragment of an escaped string whose last escape is torn comes back without it."""
    inner = F.regexp_extract(F.to_json(F.array(F.substring("text", 1, 200))), r'(?s)^\["(.*)"\]$', 1)
    return _docs(spark, where).select("doc_id", F.md5(T.unescape(F.concat(inner, F.lit("\\")))).alias("digest"))


@query("select id, trim(anchor, ' ') as question, trim(positive, ' ') as context from pairs where anchor is not null and positive is not null and not contains(positive, chr(10) || 'Question:')")
def prompts_parsed(spark: SparkSession, where: str) -> DataFrame:
    """The question of a highlighting prompt and the context of a prompt with one."""
    p = texts(spark, where, "pairs").filter("anchor is not null and positive is not null").filter(~F.contains("positive", F.lit("\nQuestion:")))
    ask = F.concat(F.lit("Highlight the parts (if any) that matter here.\nDetails: "), F.col("anchor"))
    told = F.concat(F.lit("Read this.\nContext: "), F.col("positive"), F.lit("\nQuestion: why?"))
    return p.select("id", T.question_of(ask).alias("question"), T.context_of(told).alias("context"))


@query("select id, trim(string_split(anchor, chr(10))[1], ' ') as answer from pairs where anchor is not null")
def answers_cleaned(spark: SparkSession, where: str) -> DataFrame:
    """A generated query between quotes, with a lead-in and further lines."""
    p = texts(spark, where, "pairs").filter("anchor is not null")
    made = F.concat(F.lit('  "Query: '), F.col("anchor"), F.lit('\nand more"  '))
    return p.select("id", T.first_answer_line(made).alias("answer"))


@query("select doc_id, format('{:,}', n_chars * 1000) as n from documents where n_chars is not null and text is not null")
def thousands_separated(spark: SparkSession, where: str) -> DataFrame:
    return _docs(spark, where).filter("n_chars is not null").select("doc_id", T.commas(F.col("n_chars") * 1000).alias("n"))


@query("select source, 'Write ' || src_rank || ' passages on ' || coalesce(domain, '') || ' as ' || source || '.' as prompt from source_targets")
def prompts_made(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "source_targets").select("source", synth.prompt("Write %d passages on %s as %s.", F.col("src_rank"), F.coalesce("domain", F.lit("")), F.col("source")).alias("prompt"))


@query("select distinct 'synth-' || lower(string_split(label, ' ')[1]) || '-' || lower(string_split(source, ' ')[1]) as slug, string_split(source || '/' || label, '/')[-1] as name from pairs where label is not null and source is not null")
def slugs_made(spark: SparkSession, where: str) -> DataFrame:
    p = table(spark, where, "pairs").filter("label is not null and source is not null").select("label", "source").distinct()
    return p.select(T.slug(F.col("label"), F.col("source")).alias("slug"), T.model_name(F.concat_ws("/", "source", "label")).alias("name")).distinct()


_H = lambda name, n: f"cast(('0x' || substr(md5('17|{name}|' || doc_id), 1, 8)) as bigint) % {n}"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"select doc_id, case when {_H('which', 1000)} < 550 then {_LIST(_FIRMS)}[{_H('first', 3)} + 1] else {_LIST(_MADE)}[{_H('other', 2)} + 1] end as party from documents")
def entities_picked(spark: SparkSession, where: str) -> DataFrame:
    """A party per document: with a chance of 0.55 a firm."""
    return table(spark, where, "documents").select("doc_id", T.weighted_pick(_FIRMS, 0.55, _MADE, 17, F.col("doc_id")).alias("party"))


_CATEGORIES = {"leases": ["warehouse", "office"], "loans": ["bridge", "term", "revolving"], "deeds": ["gift"]}


@query(
    f"""with c as (select unnest(range(1000)) as cell_id), p as (select cell_id, {_LIST(_CATEGORIES)}[cast(('0x' || substr(md5('18|category|' || cell_id), 1, 8)) as bigint) % 3 + 1] as category from c),
d as (select * from (values {", ".join(f"('{k}', {_LIST(v)})" for k, v in _CATEGORIES.items())}) t(category, kinds)), j as (select cell_id, category, kinds, cast(('0x' || substr(md5('18|kind|' || cell_id), 1, 8)) as bigint) as h from p join d using (category))
select cell_id, category, kinds[h % len(kinds) + 1] as kind from j"""
)
def taxonomy_cells_joined(spark: SparkSession, where: str) -> DataFrame:
    """Cells whose kind is drawn from those of their category."""
    c = synth.cells(spark, 1000, 18, {"category": list(_CATEGORIES)})
    kinds = spark.createDataFrame([(k, v) for k, v in _CATEGORIES.items()], "category string, kinds array<string>")
    return synth.with_attribute(c, kinds, "category", "kinds", "kind", 18).select("cell_id", "category", "kind")
