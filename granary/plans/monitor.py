"""Queries on events and generated rows: health, rates, milestones, synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import monitor as M
from granary.operators import synth
from granary.plans.registry import query
from granary.session import table, texts

_DAILY = "e as (select event_type, date_diff('day', timestamp '2000-01-01', date_trunc('day', ts::timestamp)) as day, avg(value) as loss from events group by all)"


def _daily(spark: SparkSession, where: str) -> DataFrame:
    """Mean value per type and day, in the place of evaluation losses."""
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2000-01-01"))).cast("bigint")
    return table(spark, where, "events").groupBy("event_type", day.alias("day")).agg(F.avg("value").alias("loss"))


@query(f"with {_DAILY} select event_type, day, round(loss, 6) as loss, round(lag(loss, 4) over w, 6) as back_4, round(min(loss) over (partition by event_type order by day rows between unbounded preceding and current row), 6) as best_so_far, round(loss / first_value(loss) over w, 6) as vs_first from e window w as (partition by event_type order by day)")
def eval_trend(spark: SparkSession, where: str) -> DataFrame:
    t = M.trend(_daily(spark, where), "event_type", "day", "loss")
    return t.select("event_type", "day", *(F.round(c, 6).alias(c) for c in ("loss", "back_4", "best_so_far", "vs_first")))


@query(
    f"""with {_DAILY}, l as (select *, lag(loss, 4) over (partition by event_type order by day) as old from e),
s as (select event_type, count(*) as n, arg_max(loss, day) as latest, min(loss) as best, arg_max(coalesce(old, -1), day) as old from l group by event_type), g as (select *, case when n >= 5 then (old - latest) / greatest(old, 1e-9) end as improvement from s)
select event_type, n, round(latest, 6) as latest, round(best, 6) as best, round(improvement, 6) as improvement, case when n < 2 then 'unknown' when latest > best * 1.25 then 'DIVERGING' when n >= 5 and improvement < 0.001 then 'PLATEAU' when n >= 5 or latest <= best then 'improving' else 'watch' end as health from g"""
)
def train_health(spark: SparkSession, where: str) -> DataFrame:
    h = M.health(_daily(spark, where), "event_type", "day", "loss")
    return h.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("latest", "best", "improvement")), "health")


@query(
    """with r as (select event_type, event_id, epoch_us(ts) as us, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events), g as (select event_type, (lag(us) over (partition by event_type order by n) - us) / 1e6 as gap from r where n <= 13)
select event_type, count(*) as n_gaps, round(median(1 / gap), 6) as median_rate from g where gap > 0 group by event_type"""
)
def rate_median_last_n(spark: SparkSession, where: str) -> DataFrame:
    return M.median_rate(table(spark, where, "events"), "event_type", "ts", "event_id").withColumn("median_rate", F.round("median_rate", 6))


@query(
    """with s as (select event_type, 1024 * cast(pow(2, row_number() over (order by event_type) - 1) as bigint) as seq, round(avg(value) * 100, 6) as tok_s from events group by event_type),
f as (select *, (6 * 22 * (4 * 768 * 768 + 3 * 768 * 1152) + 12 * 768 * (7 * seq + 15 * 128)) * tok_s / 1e12 as t from s)
select seq, tok_s, round(t, 9) as tflops, round(round(t, 9) / 100, 9) as mfu, round(tok_s / first_value(tok_s) over (order by seq), 9) as vs_first from f"""
)
def throughput_mfu(spark: SparkSession, where: str) -> DataFrame:
    """Mean values of the event types, in the place of rates at doubled sequence lengths."""
    from pyspark.sql import Window

    t = table(spark, where, "events").groupBy("event_type").agg(F.round(F.avg("value") * 100, 6).alias("tok_s"))
    t = t.withColumn("seq", (F.lit(1024) * F.pow(F.lit(2.0), F.row_number().over(Window.orderBy("event_type")) - 1)).cast("bigint"))
    return M.throughput(t.select("seq", "tok_s"), 100.0)


@query(
    """with s as (select user_id, count(*) as step, date_diff('second', min(ts), max(ts))::double as seconds from events group by user_id)
select user_id, step, round(100.0 * step / 271000, 6)::double as percent, step * 65536 as tokens_seen, round(step * 65536 / greatest(seconds, 1e-9), 3) as tok_s, round((271000 - step) * seconds / greatest(step, 1), 3) as eta_s, repeat('█', cast(floor(least(step / 200.0, 1) * 10) as integer)) || repeat('░', 10 - cast(floor(least(step / 200.0, 1) * 10) as integer)) as bar from s"""
)
def training_progress(spark: SparkSession, where: str) -> DataFrame:
    s = table(spark, where, "events").groupBy("user_id").agg(F.count("*").alias("step"), (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).cast("double").alias("seconds"))
    p = M.progress(s, "step", 271_000, "seconds", 65_536)
    return p.select("user_id", "step", "percent", "tokens_seen", F.round("tok_s", 3).alias("tok_s"), F.round("eta_s", 3).alias("eta_s"), T.progress_bar(F.col("step") / 200, 10).alias("bar"))


@query(
    """with t as (select unnest(range(2000, 30001, 2000)) as step union select cast(2000 * pow(2, unnest(range(0, 8))) as bigint) union select unnest(range(14000, 271001, 14000)) union select 271000 - 271000 % 2000)
select step from t where step <= 271000 and step % 2000 = 0 and step not in (select distinct 8000 * (user_id % 10) from events)"""
)
def archive_targets(spark: SparkSession, where: str) -> DataFrame:
    done = table(spark, where, "events").select((F.col("user_id") % 10 * 8000).alias("step"))
    return M.not_done(M.target_steps(spark, 271_000, 2000), done)


@query(
    """with r as (select event_id, row_number() over (order by ts, event_id) as rank, count(*) over () as n from events)
select event_id, rank, cast((rank * 10) // n as bigint) as milestone from r where (rank * 10) // n > ((rank - 1) * 10) // n"""
)
def milestones(spark: SparkSession, where: str) -> DataFrame:
    return M.milestones(table(spark, where, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "rank", "milestone")


@query(
    """with r as (select user_id, ts, event_id, coalesce(value < 60, false) as failed, sum(case when coalesce(value < 60, false) then 0 else 1 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as ok from events)
select user_id, count(*) as length, min(ts) as start, max(ts) as "end" from r where failed group by user_id, coalesce(ok, 0) having count(*) >= 4"""
)
def outage_streaks(spark: SparkSession, where: str) -> DataFrame:
    """Four or more values under 60 in a row of one user, in the place of failed probes of a server."""
    s = M.streaks(table(spark, where, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], F.col("value") < 60, 4)
    return s.select("user_id", "length", "start", "end")


_GRID = ", ".join(f"({b})" for b in M.EXPONENTS)


@query(
    f"""with {_DAILY}, s as (select event_type, day - min(day) over (partition by event_type) + 1 as step, loss from e), k as (select *, max(step) over (partition by event_type) * 0.15 as lo from s),
x as (select event_type, b::double as b, loss as y, pow(step::double, -b::double) as x from k, (values {_GRID}) as g(b) where step > lo),
f as (select event_type, b, regr_slope(y, x) as a, regr_intercept(y, x) as c, round(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 9) as sse from x group by all),
r as (select *, row_number() over (partition by event_type order by sse, b) as n from f where a >= 0) select event_type, round(a, 4) as a, b, round(c, 4) as c, round(sse, 5) as sse, round(a * pow(1000.0, -b) + c, 4) as predicted from r where n = 1"""
)
def power_law_fit(spark: SparkSession, where: str) -> DataFrame:
    from pyspark.sql import Window

    d = _daily(spark, where).withColumn("step", F.col("day") - F.min("day").over(Window.partitionBy("event_type")) + 1)
    p = M.power_law(d, "event_type", "step", "loss", 1000)
    return p.select("event_type", F.round("a", 4).alias("a"), "b", F.round("c", 4).alias("c"), F.round("sse", 5).alias("sse"), F.round("predicted", 4).alias("predicted"))


@query("select count(*) as n_lines, cast(count(*) filter (where regexp_matches(text, '(?i)\\b(error|exception|traceback|out of memory)\\b')) as bigint) as n_errors from (select unnest(string_split(text, chr(10))) as text from documents)")
def error_line_count(spark: SparkSession, where: str) -> DataFrame:
    return M.error_lines(texts(spark, where, "documents").filter("text is not null").select(F.explode(F.split("text", "\n")).alias("text")), "text")


_REPLY = """'Here you are:' || chr(10) || '```json' || chr(10) || '{"passage": "' || repeat('Clause ' || event_type || ' ', cast(event_id % 30 as integer)) || '", "queries": ["short", "what does event ' || event_id || ' say?", "' || repeat('long ', 70) || '"]' || case when event_id % 3 = 0 then '' else ', "hard_negative": "' || repeat('Other ', cast(event_id % 41 as integer)) || '"' end || case when event_id % 7 = 0 then '' else '}' end || chr(10) || '```'"""


@query(
    f"""with r as (select event_id, regexp_extract({_REPLY}, '(?s)(\\{{.*\\}})', 1) as j from events), v as (select event_id, j from r where json_valid(j) and j <> ''),
p as (select event_id, trim(json_extract_string(j, '$.passage')) as passage, list_filter(list_transform(cast(json_extract_string(j, '$.queries[*]') as varchar[]), lambda q: trim(q)), lambda q: length(q) between 8 and 300) as queries, trim(json_extract_string(j, '$.hard_negative')) as hard from v)
select event_id, length(passage) as n_passage, array_to_string(queries, '|') as queries, case when length(hard) >= 120 then hard end as hard_negative from p where length(passage) >= 120 and len(queries) > 0"""
)
def cluster_json_parse(spark: SparkSession, where: str) -> DataFrame:
    """Replies built from events: fenced, with prose before, some cut off, some without a hard negative."""
    reply = F.concat(
        F.lit('Here you are:\n```json\n{"passage": "'), F.repeat(F.concat(F.lit("Clause "), "event_type", F.lit(" ")), (F.col("event_id") % 30).cast("int")),
        F.lit('", "queries": ["short", "what does event '), F.col("event_id").cast("string"), F.lit(' say?", "'), F.lit("long " * 70), F.lit('"]'),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(', "hard_negative": "'), F.repeat(F.lit("Other "), (F.col("event_id") % 41).cast("int")), F.lit('"'))),
        F.when(F.col("event_id") % 7 == 0, "").otherwise("}"), F.lit("\n```"),
    )
    c = table(spark, where, "events").select("event_id", synth.parse_cluster(reply).alias("c")).filter("c is not null")
    return c.select("event_id", F.length("c.passage").cast("bigint").alias("n_passage"), F.array_join("c.queries", "|").alias("queries"), F.col("c.hard_negative").alias("hard_negative"))


_CATEGORIES = ["leases", "loans", "supply", "filings", "rulings", "notices", "deeds"]
_STYLES = ["formal", "plain", "terse"]


@query(
    f"""with c as (select unnest(range(1000)) as cell_id), p as (select list_value({", ".join(f"'{x}'" for x in _CATEGORIES)})[cast(('0x' || substr(md5('15|category|' || cell_id), 1, 8)) as bigint) % 7 + 1] as category from c),
d as (select unnest(list_value({", ".join(f"'{x}'" for x in [*_CATEGORIES, "treaties"])})) as category) select d.category, count(p.category) as n from d left join p using (category) group by d.category"""
)
def taxonomy_coverage(spark: SparkSession, where: str) -> DataFrame:
    c = synth.cells(spark, 1000, 15, {"category": _CATEGORIES, "style": _STYLES})
    return synth.coverage(c, "category", spark.createDataFrame([(x,) for x in [*_CATEGORIES, "treaties"]], "category string"))


_LINE = """case event_id % 10 when 0 then '' when 1 then '{"k": ' || event_id when 2 then 'not json' else '{"k": ' || event_id || ', "t": "' || event_type || '"}' end"""


@query(f"with l as (select {_LINE} as line from events) select count(*) as n_lines, cast(count(*) filter (where line = '') as bigint) as n_blank, cast(count(*) filter (where line <> '' and not json_valid(line)) as bigint) as n_broken, cast(count(*) filter (where json_valid(line)) as bigint) as n_kept from l")
def clean_snapshot(spark: SparkSession, where: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    m = F.col("event_id") % 10
    line = F.when(m == 0, "").when(m == 1, F.concat(F.lit('{"k": '), k)).when(m == 2, "not json").otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "t": "'), "event_type", F.lit('"}')))
    return synth.snapshot(table(spark, where, "events").select(line.alias("line")))[1]


@query("select date_trunc('hour', ts::timestamp) as hour, event_type, count(*) as n, round(sum(value), 4) as total, cast(max(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as most_k from events group by all")
def event_windows(spark: SparkSession, where: str) -> DataFrame:
    """Tumbling windows of an hour."""
    e = table(spark, where, "events").select(F.date_trunc("hour", "ts").alias("hour"), "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("hour", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("k").alias("most_k"))
