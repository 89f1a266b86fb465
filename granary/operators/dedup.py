"""Near-duplicate units: the first occurrence wins. Only keys move; texts stay with their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import let
from granary.functions.text import PARAGRAPH, collapse, runs_of_collapsed
from granary.session import materialize, small

#: Units under MIN_UNIT characters are kept without comparison; documents under MIN_DOC after removal are dropped.
MIN_UNIT, MIN_DOC = 120, 200


def unit_array(text: Column, split: str = PARAGRAPH) -> Column:
    """The units of a text, collapsed; blank ones stay as empty strings, so that places are those of the split."""
    return F.transform(F.split(text, split), lambda u: collapse(u))


def marks(docs: DataFrame, order: list[str], *keep: str, text: str = "text", split: str = PARAGRAPH, key=runs_of_collapsed, min_unit: int = MIN_UNIT) -> DataFrame:
    """(keep, order, unit_pos, n_chars, is_short, kept): one row per non-blank unit, without its text.

    `key` gets a collapsed unit. Short units are kept; of units with the same key the first by (`order`, unit_pos), which should be unique and not null.
    The first is found by a minimum with map-side combination, so that a unit that a third of all documents share is
    pre-aggregated before it moves, and is joined back by its place, which no two rows share. Short units never enter the
    exchange of keys. Null texts have no units."""
    # within the array, so that each unit's key is computed once, however often it is used below
    keyed = F.transform(unit_array(F.col(text), split), lambda u: F.struct(F.length(u).cast("bigint").alias("n"), F.when(F.length(u) >= min_unit, key(u)).alias("k")))
    hashed = F.transform(keyed, lambda u: F.struct(u["n"].alias("n_chars"), F.when(u["k"].isNotNull(), F.xxhash64(u["k"])).alias("_h"), F.unhex(F.md5(u["k"])).alias("_m")))
    u = docs.filter(F.col(text).isNotNull()).select(*keep, *order, F.posexplode(hashed).alias("unit_pos", "_u")).filter("_u.n_chars > 0").select(*keep, *order, "unit_pos", "_u.*")
    u = materialize(u, "units")
    place = [*order, "unit_pos"]
    first = u.filter("_m is not null").groupBy("_h", "_m").agg(F.min(F.struct(*place)).alias("_r")).select("_r.*", F.lit(True).alias("_first"))
    short = F.col("_m").isNull()
    return u.join(first, place, "left").select(*keep, *place, "n_chars", short.alias("is_short"), (short | F.col("_first").isNotNull()).alias("kept"))


def documents(docs: DataFrame, marked: DataFrame, order: list[str], text: str = "text", split: str = PARAGRAPH, min_doc: int = MIN_DOC, joint: str = "\n\n") -> DataFrame:
    """`docs` with only the kept units of each text, joined again, and n_units; documents under `min_doc` characters are dropped.

    Dropped places are gathered per document and joined to the texts: by broadcast if few documents lose a unit, else in the
    one exchange of texts that there is."""
    gone = marked.filter("not kept").groupBy(*order).agg(F.collect_list("unit_pos").alias("_gone"))
    left = F.filter(unit_array(F.col(text), split), lambda u, i: (u != "") & ~F.coalesce(F.array_contains("_gone", i), F.lit(False)))
    joined = let(left, lambda x: F.struct(F.array_join(x, joint).alias(text), F.size(x).cast("bigint").alias("n_units")))
    rest = [c for c in docs.columns if c not in (text, "n_units")]
    out = docs.filter(F.col(text).isNotNull()).join(small(materialize(gone, "gone")), order, "left")
    # as a generator, since Catalyst would compute the texts twice for a filter on them
    return out.select(*rest, F.explode(F.filter(F.array(joined), lambda s: (F.length(s[text]) >= min_doc) & (s["n_units"] > 0))).alias("_s")).select(*rest, "_s.*")


def stats(marked: DataFrame, by: str = "source", doc: str = "doc_id", min_doc: int = MIN_DOC) -> DataFrame:
    """Per source and in total (`by` null, is_total 1): documents in and out, kept and dropped characters, dropped share, unique long units, and the share of all kept characters (the mix).

    Documents are summed up first, so that the counts per source need no distinct."""
    n = F.col("n_chars")
    size = lambda is_: F.sum(F.when(is_, n).otherwise(0))
    per = marked.groupBy(by, doc).agg(
        size(F.col("kept")).alias("kept_chars"),
        size(~F.col("kept")).alias("dropped_chars"),
        F.sum(F.when(F.col("kept") & ~F.col("is_short"), 1).otherwise(0)).alias("unique_units"),
        F.sum(F.when(F.col("kept"), n + 2).otherwise(0)).alias("_joined"),
    )
    total = F.sum("kept_chars") + F.sum("dropped_chars")
    out = per.rollup(by).agg(
        F.grouping(by).cast("int").alias("is_total"),
        F.count("*").alias("docs_in"),
        F.sum((F.col("_joined") - 2 >= min_doc).cast("bigint")).alias("docs_out"),
        F.sum("kept_chars").alias("kept_chars"),
        F.sum("dropped_chars").alias("dropped_chars"),
        F.round(100.0 * F.sum("dropped_chars") / total, 6).alias("dropped_pct"),
        F.sum("unique_units").alias("unique_units"),
    )
    out = materialize(out, "stats")
    all_ = out.agg(F.max(F.when(F.col("is_total") == 1, F.col("kept_chars")))).scalar()
    return out.withColumn("kept_share", F.round(F.col("kept_chars") / all_, 9))


def count_guard(raw: DataFrame, read: DataFrame, by: str = "source") -> DataFrame:
    """(source, n_raw, n_read, n_missing): documents of each source before and after a step; a null source is '(none)'."""
    side = lambda df, name: df.groupBy(F.coalesce(by, F.lit("(none)")).alias(by)).agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return side(raw, "n_raw").join(side(read, "n_read"), by, "full").select(by, zero("n_raw"), zero("n_read")).withColumn("n_missing", F.col("n_raw") - F.col("n_read"))


def guarded(counts: DataFrame) -> DataFrame:
    """The counts of `count_guard`, or an error that names the first source of which a document is missing."""
    bad = F.raise_error(F.concat(F.lit("documents are missing of source "), F.col("source"), F.lit(": "), F.col("n_missing").cast("string")))
    return counts.withColumn("n_missing", F.when(F.col("n_missing") == 0, F.col("n_missing")).otherwise(bad.cast("bigint")))
