"""Problem 8: passages of evaluation items inside documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import materialize, small

#: Words in a row that count as a passage; an item of fewer words is searched as a whole, in windows of its own size.
WINDOW = 12
#: Bits in which two fingerprints may differ. They are cut into RADIUS + 1 blocks, of which one must then be equal.
RADIUS = 3
#: Words in a shingle; a window of fewer words is one shingle.
SHINGLE = 5
#: Windows of items that one scan of the documents looks for, in an index of some 40 bytes each; more items take more scans.
SCAN_WINDOWS = 1 << 23
#: Words of documents that are fingerprinted at a time, and pairs of windows that are compared at a time.
STEP, PAIRS = 1 << 16, 1 << 22
BITS = 64


def words(text: Column) -> Column:
    """Maximal runs of letters or digits, case folded."""
    return F.regexp_extract_all(F.upper(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def hashes(of_words: Column) -> Column:
    return F.transform(of_words, lambda w: F.xxhash64(w))


def bit_counts(h: np.ndarray, wide: bool = False) -> np.ndarray:
    """How often each bit is set in the words before each place. Counts are kept in bytes (`wide`: in two) and may wrap, as only differences under that are taken."""
    kind = np.uint16 if wide else np.uint8
    total = np.zeros((len(h) + 1, BITS), kind)
    np.add.accumulate(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=total[1:], dtype=kind)
    return total


def simhash(total: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every window of `size` words, from the counts of their bits: a bit is set where more than half of the words have it."""
    return np.packbits(total[size:] - total[:-size] > size // 2, axis=1).view(np.uint64).ravel()


def shingles(rows: np.ndarray, k: int) -> np.ndarray:
    """The hashes of each k neighbouring words in each row; a row of fewer words is one shingle."""
    u, k = rows.view(np.uint64), min(k, rows.shape[1])
    out = np.zeros((len(u), u.shape[1] - k + 1), np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + u[:, j : j + out.shape[1]]
    return out


class Index:
    """The windows of the items by size: their places in the items' words, and their fingerprints in a multi-index over blocks of bits.

    Items of `window` words or more are cut into all their windows of that size; each shorter one is a window of its own size."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, window: int = WINDOW, radius: int = RADIUS, shingle: int = SHINGLE):
        """words: the hashes of all items' words one after another; counts: the words of each item."""
        self.words, self.radius, self.shingle, self.sizes = words, radius, shingle, {}
        self.first = np.cumsum(counts) - counts  # of each item
        self.edges = np.linspace(0, BITS, radius + 2).astype(int)
        left = np.repeat(self.first + counts, counts) - np.arange(len(words))  # words of the item from each place on
        whole = np.repeat(counts, counts)
        for size in sorted({window, *np.unique(counts[(counts > 0) & (counts < window)]).tolist()}):
            at = np.flatnonzero((left >= size) & (whole >= size if size == window else whole == size))
            if len(at):
                self.sizes[size] = self._blocks(at.astype(np.int32), size)

    def _rows(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.words[at[:, None] + np.arange(size)]

    def _blocks(self, at: np.ndarray, size: int) -> dict:
        fp = np.concatenate([simhash(bit_counts(self._rows(at[k : k + STEP], size).ravel(), True), size)[::size] for k in range(0, len(at), STEP)])
        key, df = np.unique(np.concatenate([shingles(self._rows(at[k : k + STEP], size), self.shingle)[:, 0] for k in range(0, len(at), STEP)]), return_counts=True)
        out = {"at": at, "fp": fp, "key": key, "weight": 1 / (1 + np.log(df)), "blocks": []}
        for lo, hi in zip(self.edges, self.edges[1:]):
            v = self._block(fp, lo, hi)
            order = np.argsort(v, kind="stable").astype(np.int32)
            # where each value begins, or where each upper part of it does
            cut = np.uint64(max(0, hi - lo - 16))
            starts = np.searchsorted(v[order] >> cut, np.arange((1 << min(16, hi - lo)) + 1, dtype=np.uint64)).astype(np.int32)
            out["blocks"].append((starts, cut, order))
        return out

    @staticmethod
    def _block(fp: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (fp >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)

    def near(self, fp: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (window of the document, window of an item) whose fingerprints differ in at most `radius` bits, each once; about PAIRS candidates at a time."""
        t = self.sizes[size]
        for b, (lo, hi) in enumerate(zip(self.edges, self.edges[1:])):
            starts, cut, order = t["blocks"][b]
            v = (self._block(fp, lo, hi) >> cut).astype(np.int64)
            begin, n = starts[v], starts[v + 1] - starts[v]
            maybe = np.flatnonzero(n)
            turn = np.cumsum(n[maybe], dtype=np.int64) // PAIRS
            for part in np.split(maybe, np.flatnonzero(np.diff(turn)) + 1) if len(maybe) else []:
                m = n[part].astype(np.int64)
                d = np.repeat(part, m)
                i = order[np.repeat(begin[part], m) + np.arange(len(d)) - np.repeat(np.cumsum(m) - m, m)]
                x = fp[d] ^ t["fp"][i]
                ok = np.flatnonzero((np.bitwise_count(x) <= self.radius) & (self._block(x, lo, hi) == 0))
                for lo_, hi_ in zip(self.edges[:b], self.edges[1:]):  # found by an earlier block already
                    ok = ok[self._block(x[ok], lo_, hi_) != 0]
                yield d[ok], i[ok]

    def similarity(self, doc_rows: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
        """Weighted Jaccard similarity of the two windows' shingles; a shingle weighs the less the more windows of items begin with it."""
        t = self.sizes[size]
        a, b = shingles(np.ascontiguousarray(doc_rows), self.shingle), shingles(self._rows(t["at"][own], size), self.shingle)

        def weight(x: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(t["key"], x), len(t["key"]) - 1)
            return np.where(t["key"][at] == x, t["weight"][at], 1.0)

        first = lambda x: ~np.any(np.tril(x[:, :, None] == x[:, None, :], -1), axis=2)  # noqa: E731  of equal shingles the first counts
        wa, wb = weight(a) * first(a), weight(b) * first(b)
        both = (wa * (a[:, :, None] == b[:, None, :]).any(2)).sum(1)
        return both / np.maximum(wa.sum(1) + wb.sum(1) - both, 1e-300)

    def search(self, h: np.ndarray, of: np.ndarray, similarity: float) -> list[tuple[np.ndarray, ...]]:
        """(document, item, place in the words, place in the item from 1, size, similarity) of the pairs of windows of that similarity.

        h: the words' hashes of all documents one after another; of: the document of each. The bits of a word are counted once, for all sizes."""
        out = []
        for start in range(0, len(h), STEP):
            part = h[start : start + STEP + max(self.sizes, default=1) - 1]
            total = bit_counts(part, max(self.sizes, default=1) > 255)
            for size in self.sizes:
                own = total[: STEP + size]  # the windows that begin in this step
                if len(own) <= size:
                    continue
                for d, i in self.near(simhash(own, size), size):
                    ok = of[start + d] == of[start + d + size - 1]
                    d, i = d[ok] + start, i[ok]
                    for k in range(0, len(d), STEP):
                        dk, ik = d[k : k + STEP], i[k : k + STEP]
                        s = self.similarity(h[dk[:, None] + np.arange(size)], ik, size)
                        ok = s >= similarity - 1e-9
                        at = self.sizes[size]["at"][ik[ok]]
                        item = np.searchsorted(self.first, at, "right") - 1
                        out.append((of[dk[ok]], item, dk[ok], at - self.first[item] + 1, np.full(len(item), size), s[ok]))
        return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", window: int = WINDOW, radius: int = RADIUS, similarity: float = 1.0, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, similarity): the documents that hold `window` consecutive words of an item, or all words of an item that
    has fewer; with `similarity` under 1, those that hold a window as similar to one of the item's as that.

    Method: the items' windows, each as long as its item up to `window` words, and the documents' windows of the same sizes
    get a SimHash; a multi-index over radius + 1 blocks finds every pair whose fingerprints differ in at most `radius` bits;
    weighted similarity of their shingles of `shingle` words verifies it. At a similarity of 1 the words themselves are then
    compared. One changed word of twelve moves some 7 of 64 bits, so that a search for such pairs needs a radius of 11 or
    more, shorter shingles, and more time: the candidates grow with the items' windows over 2 ** (64 / (radius + 1)).

    The items are a stated set of queries against all documents, in one scan up to SCAN_WINDOWS windows; documents never
    move. Null texts and texts without words hold nothing and leak nothing; rows with the same key are one document."""
    spark = docs.sparkSession
    if not 0 < similarity <= 1 or window < 1 or shingle < 1 or not 0 <= radius < BITS:
        raise ValueError("similarity must be over 0 and at most 1, window and shingle at least 1, radius 0 to 63")
    asked = materialize(items.select(F.col(item).alias("item"), words(F.col(text)).alias("item_words")).filter(F.size("item_words") > 0).withColumn("h", hashes(F.col("item_words"))), "items")
    windows = asked.agg(F.sum(F.size("h"))).first()[0] or 0
    scans = max(1, -(-windows // SCAN_WINDOWS))
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), hashes(words(F.col(text))).alias("h"))
    kind, item_kind = rows.schema["k"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()
    found = None
    for scan in range(scans):
        own = asked if scans == 1 else asked.filter(F.pmod(F.xxhash64("item"), F.lit(scans)) == scan)
        got = own.select("item", "h").toArrow().combine_chunks()  # about SCAN_WINDOWS words
        if not len(got):
            continue
        h = got.column("h").combine_chunks()
        h = h.chunk(0) if isinstance(h, pa.ChunkedArray) else h
        index = Index(np.asarray(h.flatten()), np.diff(np.asarray(h.offsets)).astype(np.int64), window, radius, shingle)
        shared = spark.sparkContext.broadcast((pa.array(got.column("item").to_pylist(), got.column("item").type), index))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, idx = shared.value
            for b in batches:
                col = b.column("h")
                offsets = np.asarray(col.offsets)
                of = np.repeat(np.arange(len(b)), np.diff(offsets))
                hits = idx.search(np.asarray(col.flatten()), of, similarity)
                if not sum(len(x[0]) for x in hits):
                    continue
                d, i, at, own_at, size, sim = (np.concatenate(x) for x in zip(*hits))
                order = np.lexsort((at, size, i, d))
                d, i, at, own_at, size, sim = (x[order] for x in (d, i, at, own_at, size, sim))
                at = at - (offsets[d] - offsets[0]) + 1
                starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1])])
                cuts = pa.array(np.r_[starts, len(d)].astype(np.int32))
                places = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (at, own_at, size)], names=["at", "own_at", "size"]))
                take = pa.array(d[starts])
                yield pa.RecordBatch.from_arrays([b.column("k").take(take), b.column("t").take(take), ids.take(pa.array(i[starts])), places, pa.array(np.maximum.reduceat(sim, starts))], names=["k", "t", "item", "places", "similarity"])

        one = rows.mapInArrow(search, f"k {kind}, t string, item {item_kind}, places array<struct<at:int,own_at:int,size:int>>, similarity double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.limit(0).select(key).join(items.limit(0).select(item), F.lit(False)).withColumn("similarity", F.lit(1.0))
    if similarity == 1:
        pairs = found.withColumn("w", words(F.col("t"))).join(small(asked.select("item", "item_words")), "item")
        found = pairs.filter(F.exists("places", lambda p: F.slice(F.col("w"), p["at"], p["size"]) == F.slice(F.col("item_words"), p["own_at"], p["size"])))
    return found.groupBy(F.col("k").alias(key), F.col("item").alias(item)).agg(F.round(F.max("similarity"), 9).alias("similarity"))
