"""Problem 5: lines that stand in many records of one source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.skew import salted_join
from granary.session import materialize

#: A line is repeated excessively from so many distinct records of one source on.
LEAST = 10
#: Lines that may be broadcast, as two or three numbers each; beyond that they are joined by a salted shuffle.
SET_ROWS = 1_000_000
#: The cells of a summary: one for each value of a 64-bit hash. Tests take fewer, so that lines share them.
CELLS = 1 << 64


_BLANK = r"[\s\p{Z}\x1c-\x1f\x85&&[^\n]]"


def normal_lines(text: Column) -> Column:
    """The lines of a text under normalisation P1, trimmed and collapsed again; a line without letters or digits is empty."""
    t = F.regexp_replace(F.lower(text), r"\p{Nd}+", "#")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_#\s\p{Z}\x1c-\x1f\x85]+", "")
    # runs of white space but for single spaces
    t = F.regexp_replace(t, rf" {_BLANK}+|{_BLANK[:-1]}&&[^ ]]{_BLANK}*", " ")
    return F.transform(F.split(t, "\n"), lambda x: F.trim(x))


def hashed_lines(records: DataFrame, key: str = "doc_ord", text: str = "text", source: str = "source") -> DataFrame:
    """(ord, source, a, b): 128 bits of hash for each line together with its source, 0 in both for lines that are empty after normalisation. Null texts and sources are left out."""
    r = records.filter(F.col(text).isNotNull() & F.col(source).isNotNull()).select(F.col(key).alias("ord"), F.col(source).alias("source"), normal_lines(F.col(text)).alias("lines"))
    return r.select("ord", "source", *_line_hashes())


def _line_hashes() -> list[Column]:
    of = lambda seed: F.transform("lines", lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.lit(seed), "source", x)))
    return [of(11).alias("a"), of(13).alias("b")]


def _cell(a: Column, cells: int) -> Column:
    return a if cells == CELLS else F.pmod(a, F.lit(cells))


def summary(lines: DataFrame, least: int = LEAST, cells: int = CELLS) -> DataFrame:
    """(cell, n): the heavy cells of the sources' summaries. A summary is a row of counters, each source with places of its own,
    as the hash of a line starts from its source. Only counters that are in use exist: each task adds up its own, those of
    all tasks are merged by addition, and a counter of `least` or more is heavy. A line in `least` records has a heavy
    cell, whatever else is counted there; a line twice in one record counts once.

    The counters are spread by hash over as many partitions as there is data for, so that a source with a third of all lines
    is merged by all tasks, and cells are never so full that light lines become candidates, at any size."""
    once = lines.select(F.explode(F.array_distinct(F.transform(F.filter("a", lambda x: x != 0), lambda x: _cell(x, cells)))).alias("cell"))
    return once.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _few(keys: DataFrame) -> bool:
    return keys.limit(SET_ROWS + 1).count() <= SET_ROWS


def candidates(lines: DataFrame, heavy: DataFrame, cells: int = CELLS) -> DataFrame:
    """(ord, source, line_no, a, b) of the lines whose cell is heavy. Up to SET_ROWS heavy cells are broadcast."""
    each = lines.select("ord", "source", F.posexplode("a").alias("at", "a"), "b").filter("a <> 0")
    each = each.select("ord", "source", (F.col("at") + 1).cast("bigint").alias("line_no"), "a", F.element_at("b", F.col("at") + 1).alias("b"), _cell(F.col("a"), cells).alias("cell"))
    found = each.join(F.broadcast(heavy.select("cell")), "cell") if _few(heavy) else salted_join(each, heavy, ["cell"], "n", "ord")
    return found.select("ord", "source", "line_no", "a", "b")


def confirmed(records: DataFrame, key: str = "doc_ord", text: str = "text", source: str = "source", least: int = LEAST, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(found, heavy), both written: the candidates' occurrences, and (a, b, n_records, n) of the lines that an exact count confirms."""
    lines = materialize(hashed_lines(records, key, text, source), "lines")
    found = materialize(candidates(lines, materialize(summary(lines, least, cells), "summary"), cells), "candidates")
    heavy = found.groupBy("a", "b").agg(F.countDistinct("ord").alias("n_records"), F.count("*").alias("n")).filter(F.col("n_records") >= least)
    return found, materialize(heavy, "heavy")


def repeated_lines(records: DataFrame, key: str = "doc_ord", text: str = "text", source: str = "source", least: int = LEAST, cells: int = CELLS) -> DataFrame:
    """(doc_ord, line_no, source, n_records): each occurrence of a line that stands in `least` or more distinct records of its source.

    Method: a mergeable summary of heavy lines per source picks candidates without missing any; a second pass counts the
    candidates exactly; the confirmed lines are broadcast while they are at most SET_ROWS, else joined with salts. Lines are
    numbered from 1, blank ones counted. Null texts, null sources and lines that are empty after normalisation are left
    out; a line twice in one record counts once; an empty table gives no rows. Rows with the same key are one record."""
    found, heavy = confirmed(records, key, text, source, least, cells)
    out = found.join(F.broadcast(heavy.drop("n")), ["a", "b"]) if _few(heavy) else salted_join(found, heavy, ["a", "b"], "n", "ord")
    return out.select(F.col("ord").alias(key), "line_no", "source", "n_records")


def without_lines(records: DataFrame, key: str = "doc_ord", text: str = "text", source: str = "source", least: int = LEAST, cells: int = CELLS) -> DataFrame:
    """(doc_ord, text, n_removed): each text without its repeated lines; the other lines stay as they are. A null text stays null.

    The confirmed lines are broadcast as a sorted array of numbers, and each text is cut where it lies. Beyond SET_ROWS confirmed
    lines their places are joined to the records by key, which moves the texts. A null source has no repeated lines."""
    found, heavy = confirmed(records, key, text, source, least, cells)
    if not _few(heavy):
        gone = salted_join(found, heavy, ["a", "b"], "n", "ord").groupBy(F.col("ord").alias(key)).agg(F.collect_set(F.col("line_no").cast("int")).alias("_gone"))
        r = records.select(key, text).join(gone, key, "left")
        lines = F.split(F.col(text), "\n")
        left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), "_gone"), lambda i: F.element_at(lines, i)), "\n")
        return r.select(key, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left).alias(text), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))
    pairs = heavy.select("a", "b").orderBy("a", "b").toArrow()  # at most SET_ROWS rows of 16 bytes
    shared = records.sparkSession.sparkContext.broadcast([pairs.column(c).to_numpy() for c in "ab"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, row, line = _hits(batch.column("a"), batch.column("b"), *shared.value)
            n = np.bincount(row[hit], minlength=len(batch))
            some = np.flatnonzero(n)
            kept = []
            for i, t in zip(some.tolist(), batch.column("t").take(pa.array(some)).to_pylist()):
                parts = t.split("\n")
                drop = set(line[hit[np.searchsorted(row[hit], i) : np.searchsorted(row[hit], i, "right")]].tolist())
                kept.append("\n".join(x for k, x in enumerate(parts) if k not in drop))
            mask = np.zeros(len(batch), bool)
            mask[some] = True
            yield pa.RecordBatch.from_arrays([batch.column("k"), pc.replace_with_mask(batch.column("t"), pa.array(mask), pa.array(kept, pa.string())), pa.array(n.astype(np.int32))], names=["k", "t", "n_removed"])

    r = records.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("source"))
    r = r.withColumn("lines", F.when(F.col("source").isNotNull(), normal_lines(F.col("t")))).select("k", "t", *_line_hashes())
    return r.mapInArrow(cut, f"k {r.schema['k'].dataType.simpleString()}, t string, n_removed int").select(F.col("k").alias(key), F.col("t").alias(text), "n_removed")


def _hits(a: pa.Array, b: pa.Array, known_a: np.ndarray, known_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hits, row, line): the places, in the batch's lines one after another, of those in the known pairs (sorted); for each line its row, and its number in that row from 0."""
    n = np.asarray(pc.fill_null(pc.list_value_length(a), 0))
    row, line = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x, y = np.asarray(a.flatten()), np.asarray(b.flatten())
    lo, hi = np.searchsorted(known_a, x, "left"), np.searchsorted(known_a, x, "right")
    hits = np.flatnonzero((hi > lo) & (x != 0))
    same = np.zeros(len(hits), bool)
    for k in range(int((hi - lo).max(initial=0))):  # lines of one first hash, nearly always one
        at = lo[hits] + k
        same |= (at < hi[hits]) & (known_b[np.minimum(at, len(known_b) - 1)] == y[hits])
    return hits[same], row, line
