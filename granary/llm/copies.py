"""Problem 1: records that differ only in case, white space, punctuation or the order of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.skew import salted_join
from granary.session import materialize

#: The modulus of the multiset sums, a prime under 2**61, so that a sum of two residues fits a long.
PRIME = (1 << 61) - 1
_LABEL = r"^[^\p{L}\p{N}]*\p{L}[^:=]{0,59}[:=]"


def normal(c: Column) -> Column:
    """Letters and digits only, case folded (upper case, so that sharp s and SS agree)."""
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]+", "")


def _pairs(pieces: Column) -> Column:
    return F.transform(pieces, lambda x: F.struct(F.regexp_extract(x, r"^([^:=]*)[:=]", 1).alias("key"), F.regexp_replace(x, r"^[^:=]*[:=]", "").alias("value")))


def _labelled(text: Column, divider: str) -> Column:
    """The pieces of a text, if there are two or more and all of them are labelled; else null."""
    pieces = F.filter(F.split(text, divider), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return F.when((F.size(pieces) > 1) & F.forall(pieces, lambda x: x.rlike(_LABEL)), pieces)


def fields(text: Column) -> Column:
    """The normalised fields of a text, as array<struct<key, value>>.

    A text of labelled values (one a line, or divided by semicolons or bars, or one JSON object) gives one field for each
    label; any other text is a single field without a name. A text with a single label is prose."""
    spaced = F.regexp_replace(text, r"[\s\p{Z}]+", " ")
    json = F.when(text.rlike(r"^[\s\p{Z}﻿]*\{") & text.rlike(r"\}[\s\p{Z}]*$"), F.map_entries(F.from_json(F.regexp_replace(spaced, r"^[^{]+", ""), "map<string,string>")))
    lines = F.when(text.rlike(_LABEL), F.coalesce(_labelled(text, r"[\n\r;|]+"), _labelled(text, r"[\n\r]+")))
    raw = F.coalesce(json, _pairs(lines))
    named = F.transform(raw, lambda f: F.struct(normal(f["key"]).alias("key"), F.coalesce(normal(f["value"]), F.lit("")).alias("value")))
    named = F.filter(named, lambda f: (f["key"] != "") | (f["value"] != ""))
    prose = F.array(F.struct(F.lit("").alias("key"), normal(text).alias("value")))
    return F.when(F.size(named) > 1, named).otherwise(prose)


def fingerprints(records: DataFrame, key: str = "doc_ord", text: str = "text") -> DataFrame:
    """(ord, digests, fp_a, fp_b): the SHA-256 of every normalised field, and two sums of their hashes, which don't depend on the fields' order.

    Null texts and texts without a letter or digit are left out."""
    rec = records.select(F.col(key).alias("ord"), fields(F.col(text)).alias("f")).filter(F.exists("f", lambda f: (f["key"] != "") | (f["value"] != "")))
    rec = rec.select("ord", F.transform("f", lambda f: F.unhex(F.sha2(F.concat_ws("\u001f", f["key"], f["value"]), 256))).alias("digests"))
    total = lambda seed: F.aggregate("digests", F.lit(0).cast("bigint"), lambda a, d: F.pmod(a + F.pmod(F.xxhash64(F.lit(seed), d), F.lit(PRIME)), F.lit(PRIME)))
    return rec.select("ord", "digests", total(1).alias("fp_a"), total(2).alias("fp_b"))


def same_fields(a: Column, b: Column) -> Column:
    """Whether two arrays of digests are equal as multisets; nothing is sorted. Arrays without a repeated field need only hashed set differences; else the counts are compared."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return (F.size(a) == F.size(b)) & (
        ((F.size(a) == 1) & (a == b))
        | (
            (F.size(F.array_except(a, b)) == 0)
            & (F.size(F.array_except(b, a)) == 0)
            & ((F.size(F.array_distinct(a)) == F.size(a)) | F.forall(F.array_distinct(a), lambda x: count(a, x) == count(b, x)))
        )
    )


def copies(records: DataFrame, key: str = "doc_ord", text: str = "text") -> DataFrame:
    """(kept_ord, copy_ord): for each group of same records one row per record but the first (by `key`).

    Method: commutative multiset hash of the normalised fields, grouping by that fingerprint, then comparison of each
    member's fields with those of the group's first record. Members that only share the fingerprint are grouped and compared
    again among themselves, as often as there are different records of one fingerprint; nothing is sorted. Texts leave their
    partition only as digests. `key` should be unique: of rows with the same key and text, one is the first, and the others
    are its copies only if the key differs. Other columns don't matter; null texts, texts without letters or digits and an
    empty table give no rows."""
    rest, out = materialize(fingerprints(records, key, text), "fingerprints"), None
    while True:
        groups = rest.groupBy("fp_a", "fp_b").agg(F.min(F.struct("ord", "digests")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        groups = materialize(groups, "groups")
        member = salted_join(rest, groups, ["fp_a", "fp_b"], "n", "ord").filter(F.col("ord") != F.col("first.ord"))
        same = same_fields(F.col("digests"), F.col("first.digests"))
        other = F.when(~same, F.struct("ord", "digests", "fp_a", "fp_b"))
        checked = materialize(member.select(F.col("first.ord").alias("kept_ord"), F.col("ord").alias("copy_ord"), other.alias("other")), "checked")
        found = checked.filter("other is null").drop("other")
        out = found if out is None else out.unionByName(found)
        rest = checked.filter("other is not null").select("other.*")
        if rest.isEmpty():
            return out


def distinct_records(records: DataFrame, key: str = "doc_ord", text: str = "text") -> DataFrame:
    """(doc_ord, n_copies): each distinct record once, with the number of times it is there, itself included.

    Records without letters or digits aren't compared; each stands for itself."""
    found = materialize(copies(records, key, text), "copies")
    counts = found.groupBy(F.col("kept_ord").alias(key)).agg(F.count("*").alias("_more"))
    kept = records.select(key).join(found.select(F.col("copy_ord").alias(key)), key, "left_anti")
    return kept.join(counts, key, "left").select(key, (F.coalesce("_more", F.lit(0)) + 1).alias("n_copies"))
