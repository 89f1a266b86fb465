"""Queries that write files of each kind and read them back: sources, sinks, listings."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import ingest, sampling
from granary.operators import monitor as M
from granary.plans.registry import query, tokens
from granary.session import scratch, table, texts
from granary.sources import readers, sinks

_RECORD = "doc_id bigint, text string, source string"


def _docs(spark: SparkSession, where: str) -> DataFrame:
    return texts(spark, where, "documents").select("doc_id", "text", "source")


@query("select doc_id, md5(text) as digest, source from documents")
def jsonl_scan(spark: SparkSession, where: str) -> DataFrame:
    """Documents as JSON lines, read with a known schema."""
    path = scratch(spark)
    _docs(spark, where).write.json(path)
    return readers.jsonl(spark, path, _RECORD)[0].select("doc_id", F.md5("text").alias("digest"), "source")


@query("select count(*) as n_lines, count(*) filter (where doc_id % 3 = 0) as n_broken from documents")
def jsonl_broken_lines(spark: SparkSession, where: str) -> DataFrame:
    """A third of the lines ends too early; they are kept apart."""
    path = scratch(spark)
    line = F.to_json(F.struct("doc_id", "source"))
    _docs(spark, where).select(F.when(F.col("doc_id") % 3 == 0, F.expr("substring(to_json(struct(doc_id, source)), 1, 8)")).otherwise(line).alias("value")).write.text(path)
    good, broken = readers.jsonl(spark, path, _RECORD)
    n = good.agg(F.count("*").alias("n")).withColumn("n_broken", broken.agg(F.count("*")).scalar())
    return n.select((F.col("n") + F.col("n_broken")).alias("n_lines"), "n_broken")


@query("select doc_id, md5(text) as digest from documents where doc_id % 4 < 2")
def jsonl_gzip_budget(spark: SparkSession, where: str) -> DataFrame:
    """Four gzip shards in order of their names, read until a budget is reached that the second one crosses."""
    path = scratch(spark)
    for k in range(4):
        _docs(spark, where).filter(F.col("doc_id") % 4 == k).coalesce(1).write.option("compression", "gzip").json(f"{path}/shard-{k}")
    files = readers.shards(spark, path, "*.json.gz")
    first = files.orderBy("path").first()["length"]
    return readers.jsonl(spark, readers.within_budget(files, first + 1), _RECORD)[0].select("doc_id", F.md5("text").alias("digest"))


@query("select count(*) as n_texts, count(distinct md5(text)) as n_distinct, (select count(*) from documents where text is null) as n_skipped from documents where text is not null")
def jsonl_xz_shards(spark: SparkSession, where: str) -> DataFrame:
    """xz shards, written by the tasks; lines without a text are counted, and ids are unique over all shards."""
    path = scratch(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = pa.fs.FileSystem.from_uri(f"{path}/{name}.jsonl.xz")
                fs.create_dir(at.rsplit("/", 1)[0])
                with fs.open_output_stream(at, compression=None) as out:
                    out.write(lzma.compress("\n".join(lines).encode()))
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    import pyarrow.fs  # noqa: F401

    lines = _docs(spark, where).select(F.concat(F.lit("shard-"), F.col("doc_id") % 64).alias("name"), F.to_json(F.struct("text")).alias("line"))
    lines.groupBy("name").agg(F.collect_list("line").alias("lines")).mapInArrow(write, "name string").count()
    rows, skipped = readers.xz_jsonl(spark, path, "docs")
    n = rows.agg(F.count("*").alias("n_texts"), F.countDistinct(F.md5("text")).alias("n_distinct"), F.countDistinct("id").alias("ids"))
    return n.filter("ids = n_texts").select("n_texts", "n_distinct", skipped.agg(F.count("*")).scalar().alias("n_skipped"))


@query("select md5(text) as digest from documents where doc_id % 3 = 1")
def parquet_one_column(spark: SparkSession, where: str) -> DataFrame:
    """The text column of the shards of one config and split."""
    path, d = scratch(spark), _docs(spark, where)
    for k, name in enumerate(("case/test", "case/train", "law/train")):
        d.filter(F.col("doc_id") % 3 == k).write.parquet(f"{path}/{name}.parquet")
    names = [r["path"] for r in readers.shards(spark, path, "*.parquet").select("path").collect()]
    chosen = [n for n in names if "/case/train.parquet/" in n]
    return readers.parquet_field(spark, chosen, "text").select(F.md5("text").alias("digest"))


@query("select filename, md5('11|' || filename) as place from (select distinct filename from filings)")
def file_order_shuffled(spark: SparkSession, where: str) -> DataFrame:
    return ingest.shuffled_files(table(spark, where, "filings").select("filename").distinct(), 11, "filename")


@query("select count(*) as n_lines, cast(sum(doc_id) as bigint) as id_sum from documents")
def line_scan_in_ranges(spark: SparkSession, where: str) -> DataFrame:
    """A file of lines read in ranges of 64 KB: no line is lost or read twice where ranges meet."""
    path = scratch(spark)
    _docs(spark, where).select("doc_id", "text").coalesce(1).write.json(path)
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    return readers.jsonl(own, path, _RECORD)[0].agg(F.count("*").alias("n_lines"), F.sum("doc_id").alias("id_sum"))


@query("select vec_id from embeddings where vec_id < 300")
def vector_prefix(spark: SparkSession, where: str) -> DataFrame:
    """What a cache that is still being written has for certain."""
    return readers.prefix_rows(table(spark, where, "embeddings").select("vec_id"), "vec_id", 300, 10**9)


@query("select r_regionkey * 1000 as step, r_name as name from region")
def step_results_by_name(spark: SparkSession, where: str) -> DataFrame:
    """A result file per step, whose step is in the file's name."""
    path = scratch(spark)
    for r in table(spark, where, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("name"))).alias("j")).collect():
        sinks.write_text(spark, f"{path}/probe_step{r['r_regionkey'] * 1000}.json", r["j"])
    return readers.step_results(spark, path).select(F.col("step").cast("int").alias("step"), "name")


@query("select event_id as step, event_id / 4.0 as loss from events")
def log_scan(spark: SparkSession, where: str) -> DataFrame:
    """Numbers found in the lines of a log."""
    path = scratch(spark)
    table(spark, where, "events").select(F.format_string("step %d | loss %.2f | ok", "event_id", F.col("event_id") / 4.0)).write.text(path)
    got = readers.log_numbers(spark, path, r"loss ([\d.]+)")
    return got.select(F.regexp_extract("line", r"step (\d+)", 1).cast("bigint").alias("step"), F.col("value").alias("loss"))


@query("select id, label, source from pairs where id % 10 = 0")
def labelled_rows_of_split(spark: SparkSession, where: str) -> DataFrame:
    """Labelled rows written by split, of which only one folder is read."""
    path = scratch(spark)
    split = F.when(F.col("id") % 10 == 0, "test").otherwise("train")
    sinks.write_splits(table(spark, where, "pairs").select("id", "label", "source").withColumn("split", split), path)
    return readers.labelled(spark, path, "test").select("id", "label", "source")


@query("select case when id % 10 = 0 then 'test' else 'train' end as split, count(*) as n from pairs group by 1")
def splits_written(spark: SparkSession, where: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_splits(table(spark, where, "pairs").select("id", F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query(
    """with e as (select doc_id, source, text, coalesce(sum(strlen(text)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before
from documents where length(trim(text)) >= 200 and source is not null) select doc_id, source, md5(text) as digest from e where before < 30000"""
)
def sources_written(spark: SparkSession, where: str) -> DataFrame:
    """Each source up to 30,000 bytes as JSON lines in a folder of its own."""
    path = scratch(spark)
    sinks.write_sources(_docs(spark, where), path, 30_000, "doc_id")
    return spark.read.schema(_RECORD).json(path).select("doc_id", "source", F.md5("text").alias("digest"))


@query("select md5(text) as digest, source, cast(doc_id as varchar) as id from documents where text is not null")
def records_written(spark: SparkSession, where: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_records(_docs(spark, where).filter("text is not null").withColumn("id", F.col("doc_id").cast("string")), path)
    return readers.jsonl(spark, path)[0].select(F.md5("text").alias("digest"), "source", "id")


@query("select id as block_id, len(negatives) as n_tokens, list_aggregate(list_transform(negatives, lambda x: printf('%02x%02x', x % 50000 % 256, x % 50000 // 256)), 'string_agg', '') as data from mined_negatives where len(negatives) > 0")
def token_shards_uint16(spark: SparkSession, where: str) -> DataFrame:
    """Lists of numbers as little-endian 16-bit tokens."""
    rows = table(spark, where, "mined_negatives").filter(F.size("negatives") > 0).select(F.col("id").alias("block_id"), F.transform("negatives", lambda x: x % 50_000).alias("tokens"))
    return sinks.token_shards(rows).select("block_id", "n_tokens", F.lower(F.hex("data")).alias("data"))


@query("select vec_id, 64 * 2 as n_bytes from embeddings where vec_id < 600")
def vector_cache(spark: SparkSession, where: str) -> DataFrame:
    """Vectors cached batch by batch in half precision, one batch twice; read up to the pointer, which the last batch has not reached."""
    path, v = scratch(spark), table(spark, where, "embeddings").select("vec_id", "embedding")
    for batch in (0, 1, 1, 2):
        sinks.cache_vectors(v.filter(F.expr("vec_id div 200") == batch), path, batch, "vec_id")
    sinks.cache_vectors(v.filter(F.expr("vec_id div 200") == 3), path, 3, "vec_id", mark=False)
    return readers.cached_vectors(spark, path, "vec_id").select("vec_id", F.octet_length("data").alias("n_bytes"))


@query("select r_regionkey as step, case when r_regionkey < 2 then 'old' else 'new' end as run from region")
def results_appended_once(spark: SparkSession, where: str) -> DataFrame:
    """Results of steps that are there already are not computed again."""
    path, r = scratch(spark), table(spark, where, "region").select(F.col("r_regionkey").alias("step"))
    sinks.append_missing(r.filter("step < 2").withColumn("run", F.lit("old")), path)
    sinks.append_missing(r.withColumn("run", F.lit("new")), path)
    return spark.read.parquet(path)


@query("select '# Corpus' || chr(10) || chr(10) || '| what | value |' || chr(10) || '|-|-|' || chr(10) || '| n_docs | ' || count(*) || ' |' || chr(10) || '| n_texts | ' || count(text) || ' |' || chr(10) as page from documents")
def status_page(spark: SparkSession, where: str) -> DataFrame:
    path = scratch(spark)
    row = table(spark, where, "documents").agg(F.count("*").alias("n_docs"), F.count("text").alias("n_texts"))
    sinks.write_text(spark, f"{path}/status.md", sinks.status(row, "Corpus"))
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "page")


@query("select id, source, null as score from pairs where id % 2 = 0 union all by name select id, source, id / 2.0 as score from pairs where id % 2 = 1")
def pair_sources_joined(spark: SparkSession, where: str) -> DataFrame:
    """Pairs of several builders in one table; a column that one lacks is null there."""
    p = table(spark, where, "pairs").select("id", "source")
    return ingest.union_all([p.filter("id % 2 = 0"), p.filter("id % 2 = 1").withColumn("score", F.col("id") / 2.0)])


@query("select id, 'a' as builder from (select id from pairs where source = 'clause_qa' order by id limit 25) union all select id, 'b' from (select id from pairs where source = 'clause_match' order by id limit 25)")
def first_rows_of_builders(spark: SparkSession, where: str) -> DataFrame:
    """The first 25 rows of each builder."""
    p = table(spark, where, "pairs").select("id", "source")
    return ingest.first_of_each({"a": p.filter("source = 'clause_qa'"), "b": p.filter("source = 'clause_match'")}, ["id"], 25, "builder").select("id", "builder")


@query("select label, array_to_string(list(distinct id order by id), ',') as ids from pairs where label is not null group by label")
def id_sets_of_classes(spark: SparkSession, where: str) -> DataFrame:
    """The sorted ids of each class."""
    return M.id_sets(table(spark, where, "pairs"), "label", "id").select("label", F.array_join("ids", ",").alias("ids"))


@query("select (select count(*) from region where r_regionkey not in (select r_regionkey from region where r_regionkey < 3)) as n_open, false as complete")
def completion_test(spark: SparkSession, where: str) -> DataFrame:
    """Whether all targets are done, and how many are not."""
    r = table(spark, where, "region").select(F.col("r_regionkey").alias("step"))
    return M.completion(r, r.filter("step < 3"))


@query(f"select doc_id, md5(array_to_string(list_concat(list_concat(['[CLS]'], {tokens('text')}), ['[SEP]']), ' ')) as digest from documents where text is not null")
def tokens_with_marks(spark: SparkSession, where: str) -> DataFrame:
    """The lexical tokens of each document between the encoder's two marks."""
    return _docs(spark, where).filter("text is not null").select("doc_id", F.md5(F.array_join(T.marked_tokens(F.col("text")), " ")).alias("digest"))


@query("select doc_id, array_to_string([case when cast(('0x' || substr(md5('8|3|' || doc_id || '|' || i), 1, 8)) as bigint) % 1000 < 300 then 'x' else '-' end for i in range(16)], '') as mask from documents")
def token_mask_positions(spark: SparkSession, where: str) -> DataFrame:
    """The masked ones of 16 positions per document, in epoch 3."""
    positions = F.sequence(F.lit(0), F.lit(15))
    return table(spark, where, "documents").select("doc_id", F.array_join(F.transform(sampling.masked_positions(positions, 8, 3, 300, F.col("doc_id")), lambda m: F.when(m, "x").otherwise("-")), "").alias("mask"))
