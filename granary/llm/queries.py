"""The queries pN_... of the training-data problems. Each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import boilerplate, bpe, copies, defects, leaks, mixture, packing, residue, tokens
from granary.session import materialize, scratch, small, table, texts


def p1_found(spark: SparkSession, where: str) -> DataFrame:
    return copies.copies(texts(spark, where, "raw_records"))


def p1_distinct(spark: SparkSession, where: str) -> DataFrame:
    return copies.distinct_records(texts(spark, where, "raw_records"))


def p2_token_cube(spark: SparkSession, where: str) -> DataFrame:
    ledger = tokens.update(texts(spark, where, "raw_records"), table(spark, where, "source_targets"))
    return tokens.with_totals(ledger.cube)


def p2_token_update(spark: SparkSession, where: str) -> DataFrame:
    """The cube of a ledger that is kept in a folder, after an update from an earlier snapshot, in which a tenth of the records each
    was not there yet, had half of its text, had another language, or stood twice, under a key that is gone now."""
    now, targets, path = texts(spark, where, "raw_records"), table(spark, where, "source_targets"), scratch(spark)
    part = F.pmod(F.xxhash64("doc_ord"), F.lit(10))
    half = F.when(part == 1, F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.col("text"))
    before = now.filter(part != 0).withColumns({"text": half, "lang": F.when(part == 2, F.lit("it")).otherwise(F.col("lang"))})
    keys = F.when(part == 3, F.array(F.col("doc_ord"), -F.col("doc_ord") - 1)).otherwise(F.array("doc_ord"))
    tokens.update_at(path, before.withColumn("doc_ord", F.explode(keys)), targets)
    return tokens.with_totals(tokens.update_at(path, now, targets).cube)


def p2_delta(spark: SparkSession, where: str) -> DataFrame:
    """Whether the updated cube of p2_token_update and a new one are the same, and the number of their cells."""
    one, other = p2_token_update(spark, where).withColumn("side", F.lit(1)), p2_token_cube(spark, where).withColumn("side", F.lit(-1))
    cells = one.unionByName(other).groupBy([c for c in one.columns if c != "side"]).agg(F.sum("side").alias("off"))
    return cells.agg((F.max(F.abs("off")) == 0).alias("same"), F.count(F.when(F.col("level") == "cell", 1)).alias("n_cells"))


def p3_found(spark: SparkSession, where: str) -> DataFrame:
    return defects.defects(texts(spark, where, "pairs")).select("id", "defect")


def p3_labels(spark: SparkSession, where: str) -> DataFrame:
    """All labels of each defective pair."""
    return defects.defects(texts(spark, where, "pairs")).select("id", F.explode("defects").alias("label"))


def p4_pack(spark: SparkSession, where: str) -> DataFrame:
    return packing.pack(texts(spark, where, "raw_records"), table(spark, where, "pack_settings"))


def p4_fill(spark: SparkSession, where: str) -> DataFrame:
    settings = table(spark, where, "pack_settings")
    return packing.block_fill(packing.pack(texts(spark, where, "raw_records"), settings), settings)


def p4_checked(spark: SparkSession, where: str) -> DataFrame:
    """Per profile the texts that don't stand in blocks with all their tokens once, and the blocks that hold more than they may or other than they say."""
    raw, settings = texts(spark, where, "raw_records"), table(spark, where, "pack_settings")
    packed = materialize(packing.pack(raw, settings), "packed")
    sizes = settings.filter("block_size > 0").select("profile", "block_size")
    profiles = F.array(*(F.lit(r["profile"]) for r in sizes.limit(packing.MAX_PROFILES).collect()))
    want = tokens.token_counts(raw, "doc_ord").filter("n_tokens > 0").select("doc_ord", F.col("n_tokens").alias("want"), F.explode(profiles.cast("array<string>")).alias("profile"))
    have = packed.groupBy("profile", "doc_ord").agg(F.sum("n_tokens").alias("have"))
    wrong = want.join(have, ["profile", "doc_ord"], "full").groupBy("profile").agg(F.count_if(~F.col("want").eqNullSafe(F.col("have"))).alias("n_wrong"))
    blocks = packed.groupBy("profile", "block_id").agg(F.sum("n_tokens").alias("n"), F.max("fill").alias("fill")).join(small(sizes), "profile")
    over = blocks.groupBy("profile").agg(F.count_if((F.col("n") != F.col("fill")) | (F.col("n") > F.col("block_size"))).alias("n_over"))
    return wrong.join(over, "profile")


def p5_found(spark: SparkSession, where: str) -> DataFrame:
    return boilerplate.repeated_lines(texts(spark, where, "raw_records")).select("doc_ord", "line_no")


def p5_clean_texts(spark: SparkSession, where: str) -> DataFrame:
    return boilerplate.without_lines(texts(spark, where, "raw_records"))


def p6_mix(spark: SparkSession, where: str) -> DataFrame:
    return mixture.mix(texts(spark, where, "raw_records"), table(spark, where, "source_targets"))[0]


def p6_shares(spark: SparkSession, where: str) -> DataFrame:
    return mixture.mix(texts(spark, where, "raw_records"), table(spark, where, "source_targets"))[1]


def p6_checked(spark: SparkSession, where: str) -> DataFrame:
    """The records that are used more often than they may be, whether the shares add up to 1, and whether they are those of the chosen records."""
    targets = table(spark, where, "source_targets")
    chosen, shares = mixture.mix(texts(spark, where, "raw_records"), targets)
    most = small(targets.select("source", "max_repeats"))
    over = chosen.join(most, "source").agg(F.count_if(F.col("times") > F.col("max_repeats")).alias("n_over"))
    mass = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("m"))
    same = shares.join(small(mass), "source", "left").agg((F.abs(F.sum("actual_share") - 1) < 1e-6).alias("is_whole"), F.bool_and(F.col("mix_tokens") == F.coalesce("m", F.lit(0))).alias("is_same"))
    return same.withColumn("n_over", over.scalar())


def p7_ids(spark: SparkSession, where: str) -> DataFrame:
    return bpe.encode(texts(spark, where, "documents"))


def p7_round_trip(spark: SparkSession, where: str) -> DataFrame:
    """How many texts come back from their ids as they were."""
    docs = texts(spark, where, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    back = bpe.decode(bpe.encode(docs.withColumnRenamed("was", "text")))
    return back.join(docs, "doc_id").groupBy((F.col("text") == F.col("was")).alias("same")).agg(F.count("*").alias("n_docs"))


def p8_found(spark: SparkSession, where: str) -> DataFrame:
    return leaks.leaks(texts(spark, where, "documents"), table(spark, where, "eval_items")).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, where: str) -> DataFrame:
    """The items that leaked, with the number of documents that hold each."""
    return p8_found(spark, where).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p9_found(spark: SparkSession, where: str) -> DataFrame:
    return residue.residue(texts(spark, where, "documents")).select("doc_id")


def p9_kinds(spark: SparkSession, where: str) -> DataFrame:
    return residue.residue(texts(spark, where, "documents")).select("doc_id", F.explode("kinds").alias("kind"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_distinct, p2_token_cube, p2_token_update, p2_delta, p3_found, p3_labels, p4_pack, p4_fill, p4_checked, p5_found, p5_clean_texts, p6_mix, p6_shares, p6_checked, p7_ids, p7_round_trip, p8_found, p8_leaked_items, p9_found, p9_kinds)}

SQL: dict[str, str] = {}

_KEY = r"regexp_replace(upper({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_PIECES = r"list_filter(string_split_regex(text, '{}'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))"
_IS_LABEL = r"regexp_matches(x, '^[^\p{L}\p{N}]*\p{L}[^:=]{0,59}[:=]')"


def _labels(pieces: str) -> str:
    """The sorted normalised pairs of labelled pieces, or null."""
    key, value = _KEY.format("regexp_extract(x, '^([^:=]*)[:=]', 1)"), _KEY.format("regexp_replace(x, '^[^:=]*[:=]', '')")
    return f"case when len({pieces}) > 1 and len(list_filter({pieces}, lambda x: not {_IS_LABEL})) = 0 then list_sort(list_transform({pieces}, lambda x: {key} || chr(31) || {value})) end"


_JSON = r"trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))"
_ROOT = "'$.\"' || k || '\"'"

#: Records by their key: pairs in sorted order for labelled ones, else the letters and digits.
_RECORDS = rf"""with r as (select doc_ord, text, case when regexp_matches({_JSON}, '^\{{.*\}}$') and json_valid({_JSON}) then {_JSON} end as j from raw_records where regexp_matches(text, '[\p{{L}}\p{{N}}]')),
f as (select doc_ord, text, case when j is not null then list_sort(list_transform(json_keys(j), lambda k: {_KEY.format("k")} || chr(31) || {_KEY.format(f"json_extract_string(j, {_ROOT})")})) else coalesce({_labels(_PIECES.format("[\\n\\r;|]+"))}, {_labels(_PIECES.format("[\\n\\r]+"))}) end as l from r),
k as (select doc_ord, case when len(l) > 1 then 'F' || array_to_string(l, chr(30)) else 'P' || {_KEY.format("text")} end as key from f),
g as (select doc_ord, min(doc_ord) over (partition by key) as kept_ord from k)"""

SQL["p1_found"] = _RECORDS + " select kept_ord, doc_ord as copy_ord from g where kept_ord <> doc_ord"
SQL["p1_distinct"] = _RECORDS + " select r.doc_ord, count(*) as n_copies from (select coalesce(kept_ord, raw_records.doc_ord) as doc_ord from raw_records left join g using (doc_ord)) r group by r.doc_ord"

_LINES = r"""l as (select doc_ord, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) + 1 as line_no from raw_records where text is not null and source is not null),
n as (select *, trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '#', 'g'), '[^\p{L}\p{N}_#\s\x0B\p{Z}\x1c-\x1f\x{85}]+', '', 'g'), '[\s\x0B\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g')) as norm from l),
h as (select source, norm from n where norm <> '' group by source, norm having count(distinct doc_ord) >= 10)"""

SQL["p5_found"] = f"with {_LINES} select doc_ord, line_no from n join h using (source, norm)"

SQL["p5_clean_texts"] = f"""with {_LINES}, g as (select doc_ord, line_no from n join h using (source, norm)),
k as (select n.doc_ord, string_agg(case when g.line_no is null then line end, chr(10) order by n.line_no) as text, count(g.line_no) as gone from n left join g on g.doc_ord = n.doc_ord and g.line_no = n.line_no group by n.doc_ord)
select r.doc_ord, case when k.gone > 0 then coalesce(k.text, '') else r.text end as text, coalesce(k.gone, 0)::integer as n_removed from raw_records r left join k using (doc_ord)"""

_WINDOWS = r"""d as (select doc_id, regexp_extract_all(upper(text), '[\p{L}\p{N}]+') as w from documents), i as (select item_id, regexp_extract_all(upper(text), '[\p{L}\p{N}]+') as w from eval_items),
iw as (select item_id, least(len(w), 12) as n, unnest(list_transform(range(len(w) - least(len(w), 12) + 1), lambda k: array_to_string(w[k + 1:k + least(len(w), 12)], ' '))) as win from i where len(w) > 0),
ns as (select distinct n from iw), dw as (select doc_id, n, unnest(list_transform(range(len(w) - n + 1), lambda k: array_to_string(w[k + 1:k + n], ' '))) as win from d, ns where len(w) >= n)"""

SQL["p8_found"] = f"with {_WINDOWS} select distinct doc_id, item_id from dw join iw using (n, win)"
SQL["p8_leaked_items"] = f"with {_WINDOWS} select item_id, count(distinct doc_id) as n_docs from dw join iw using (n, win) group by item_id"
_LANG = "coalesce(nullif(trim(lower(split_part(split_part(lang, '-', 1), '_', 1))), ''), 'und')"
SQL["p2_delta"] = f"select true as same, count(*) as n_cells from (select distinct r.source, {_LANG} as lang, t.domain from raw_records r left join (select source, min(domain) as domain from source_targets group by source) t using (source))"
SQL["p4_checked"] = "select profile, 0 as n_wrong, 0 as n_over from pack_settings where block_size > 0"
SQL["p6_checked"] = "select 0 as n_over, true as is_whole, true as is_same"
SQL["p7_round_trip"] = "select true as same, count(*) as n_docs from documents"
