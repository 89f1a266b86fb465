"""Problem 7: token ids of a whole corpus by a byte-level tokenizer, in Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.columns import let
from granary.llm.tokens import DEFAULT, FOLDER, parse_ranks, read_ranks
from granary.operators.skew import salted_join
from granary.session import materialize, spread

#: The tokenizer's pattern with white space as Unicode has it (Java's plain \s is ASCII), the most frequent branches first:
#: of the first four no two can match at one place, but for the third, which comes before the fourth as in the original.
WORDS = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: Words whose ids are looked up in place, and their bytes at most, so that the table is bounded; all others are joined.
CACHED, CACHED_BYTES = 1 << 16, 64
#: Bytes between the starts of the pieces that a longer word is folded in, and by how much each piece runs into the next.
#: Words whose pieces don't meet by the first are cut by the second; what doesn't meet even then is folded as a whole.
CUTS = [(240, 96), (1920, 384)]
_NONE = 1 << 30


class Lookup:
    """A bounded map as a literal: an array of small maps, one per bucket of the key's hash, so that a look-up doesn't scan all keys.

    The array is the one row of a small table. As a scalar subquery it is read once per query and becomes a literal in the
    tasks; written into the plan itself, some 100,000 entries would be printed with each description of the plan."""

    def __init__(self, spark: SparkSession, rows: DataFrame, key: str, value: str):
        """`rows`: (key, value) of the types named, of a bounded number, read to the driver."""
        got = rows.select("key", "value", F.xxhash64("key").alias("h")).collect()
        self.buckets = 1 << max(0, (2 * len(got)).bit_length() - 1)
        table: list[dict] = [{} for _ in range(self.buckets)]
        for r in got:
            table[r["h"] & (self.buckets - 1)][bytes(r["key"]) if key == "binary" else r["key"]] = r["value"]
        self.row = materialize(spark.createDataFrame([(table,)], f"t array<map<{key},{value}>>", verifySchema=False), "lookup")

    def beside(self, df: DataFrame, name: str) -> DataFrame:
        """`df` with the table as column `name`. It must be used once, as the value of a `let`: Catalyst then moves the
        subquery into that expression, and no row carries the table."""
        return df.withColumn(name, self.row.select("t").scalar())

    def get(self, table: Column, key: Column) -> Column:
        """The value of `key` in `table`, the variable of a `let`."""
        return F.element_at(F.element_at(table, (F.xxhash64(key).bitwiseAND(F.lit(self.buckets - 1)) + 1).cast("int")), key)


def pieces(b: Column, rank: Callable[[Column], Column]) -> Column:
    """The tokens of some bytes, as array<binary>, where `rank` gives the rank of some bytes or null: the single bytes, of which
    again and again the leftmost pair of the lowest rank is merged, until no pair has a rank. The ranks of all pairs are kept
    beside the parts; a merge asks for those of its two neighbours only."""
    none, no_ranks = F.lit(_NONE), F.array().cast("array<int>")
    of = lambda x: F.coalesce(rank(x), none)

    def merge(s: Column, i: Column) -> Column:
        parts, ranks = s["parts"], s["ranks"]

        def put(m: Column) -> Column:
            left = F.when(i > 1, F.array(of(F.concat(F.get(parts, i - 2), m)))).otherwise(no_ranks)
            right = F.when(i + 1 < F.size(parts), F.array(of(F.concat(m, F.get(parts, i + 1))))).otherwise(no_ranks)
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), i - 1), F.array(m), F.slice(parts, i + 2, F.size(parts))).alias("parts"),
                F.concat(F.slice(ranks, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(ranks, i + 2, F.size(parts))).alias("ranks"),
            )

        return let(F.concat(F.get(parts, i - 1), F.get(parts, i)), put)

    def go(s: Column, _: Column) -> Column:
        return let(F.array_min(s["ranks"]), lambda low: F.when(low < none, let(F.array_position(s["ranks"], low).cast("int"), lambda i: merge(s, i))).otherwise(s))

    def start(parts: Column) -> Column:
        ranks = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x, i: of(F.concat(F.get(parts, i), x)))
        return F.struct(parts.alias("parts"), ranks.alias("ranks"))

    single = F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.substring(b, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(b)), let(single, start), go, lambda s: s["parts"])


def rank_lookup(spark: SparkSession, name: str = DEFAULT, folder: str = FOLDER) -> Lookup:
    """The ranks of all pieces, at most some ten thousand, by their bytes."""
    rows = list(parse_ranks(read_ranks(name, folder)).items())
    return Lookup(spark, spark.createDataFrame(rows, "key binary, value int"), "binary", "int")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def _whole(of: DataFrame, rank: Lookup) -> DataFrame:
    """Adds the ids of `b`, folded in one go; bytes that are a token need no fold."""

    def ids(r: Column) -> Column:
        get = lambda x: rank.get(r, x)
        return let(get(F.col("b")), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(F.transform(pieces(F.col("b"), get), get)))

    return rank.beside(of, "_rank").withColumn("ids", let(F.col("_rank"), ids)).drop("_rank")


def _in_pieces(of: DataFrame, rank: Lookup, stride: int, overlap: int) -> DataFrame:
    """Adds the ids of `b` (longer than a piece), or null where two of its pieces don't meet.

    The pieces start every `stride` bytes and run `overlap` bytes into the next; each is folded by itself, many of a word
    side by side. Two neighbours are joined at a token that both have at the same place. The result is exact: a sequence of
    tokens is the encoding of its bytes if each two neighbours are the encoding of theirs, and of the tokens that come
    together here each two stood side by side in one piece's encoding."""
    n = F.greatest(F.lit(1), F.ceil((F.length("b") - overlap) / stride)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.struct(c.alias("c"), F.substring(F.col("b"), c * stride + 1, F.lit(stride + overlap)).alias("piece")))
    each = of.select("h", F.explode(cut).alias("x")).select("h", "x.c", "x.piece").repartition(of.sparkSession.sparkContext.defaultParallelism, "h", "c")

    def placed(r: Column) -> Column:
        get = lambda x: rank.get(r, x)
        at = lambda ps, i: F.aggregate(F.slice(ps, F.lit(1), i), F.col("c") * stride, lambda a, p: a + F.length(p))
        return let(pieces(F.col("piece"), get), lambda ps: F.transform(ps, lambda p, i: F.struct(at(ps, i).alias("at"), get(p).alias("id"))))

    each = rank.beside(each, "_rank").select("h", "c", let(F.col("_rank"), placed).alias("tokens"))
    each = materialize(each, "pieces").groupBy("h").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "tokens"))), lambda x: x["tokens"]).alias("t"))
    meet = F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x, i: F.get(F.array_intersect(F.get(F.col("t"), i), x), F.lit(0))["at"])
    each = each.withColumn("meet", meet)
    own = F.transform("t", lambda x, i: F.filter(x, lambda t: ((i == 0) | (t["at"] >= F.get(F.col("meet"), i - 1))) & ((i == F.size("meet")) | (t["at"] < F.get(F.col("meet"), i)))))
    ids = F.transform(F.flatten(own), lambda t: t["id"])
    each = each.select("h", F.when(~F.exists("meet", lambda m: m.isNull()), ids).alias("ids"))
    return of.join(each, "h", "left")


def fold_words(counted: DataFrame, name: str = DEFAULT, folder: str = FOLDER, rank: Lookup | None = None) -> DataFrame:
    """(word, n) with h (16 bytes of the word's hash) and ids: each distinct word is folded once, whatever its length. Written."""
    rank = rank or rank_lookup(counted.sparkSession, name, folder)
    rest = spread(counted).select("word", "n", F.unhex(F.md5("word")).alias("h"), F.encode("word", "UTF-8").alias("b"))
    most = sum(CUTS[0])
    done = materialize(_whole(rest.filter(F.length("b") <= most), rank).select("word", "n", "h", "ids"), "folded")
    rest = rest.filter(F.length("b") > most)
    for stride, overlap in [*CUTS, (None, None)]:
        rest = materialize(rest.select("word", "n", "h", "b"), "long")
        if rest.isEmpty():
            break
        tried = materialize(_in_pieces(rest, rank, stride, overlap) if stride else _whole(rest, rank), "long")
        done = done.unionByName(tried.filter("ids is not null").select("word", "n", "h", "ids"))
        rest = tried.filter("ids is null")
    return done


def _level(n: Column) -> Column:
    return F.floor(F.log2(n) * 8).cast("int")


def most_frequent(counted: DataFrame, most: int) -> Column:
    """Whether a word (word, n) is one of about the `most` most frequent ones, never more, of at most CACHED_BYTES. The count at which
    they end comes from the number of words at each level of counts (some hundred rows), so that nothing is sorted; of the
    level where they end a part is taken by hash."""
    short = F.octet_length("word") <= CACHED_BYTES
    levels = counted.filter(short).groupBy(_level(F.col("n")).alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    left, parts = most, 1 << 20
    for r in levels:
        if r["words"] > left:
            # of w words that a fair hash chooses with a share p, more than `left` come with next to no chance
            share = max(0.0, (left - 6 * left**0.5) / r["words"])
            return short & ((_level(F.col("n")) > r["level"]) | ((_level(F.col("n")) == r["level"]) & (F.pmod(F.xxhash64(F.lit(70), "word"), F.lit(parts)) < int(share * parts))))
        left -= r["words"]
    return short


def _found_in(found: Column, w: Column) -> Column:
    """The ids of a word among a text's joined ones, an array of small maps by hash."""
    return F.element_at(F.element_at(found, (F.pmod(F.xxhash64(w), F.size(found)) + 1).cast("int")), w)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = DEFAULT, folder: str = FOLDER, cached: int = CACHED) -> DataFrame:
    """(doc_id, ids): the ids of each text without special tokens; an empty list for an empty or null text. One row per row, whatever the key.

    Method: the distinct words are counted over all texts (map-side combined; no text is moved) and each is folded once by
    higher-order functions over its bytes, with the ranks as a literal map. The `cached` most frequent ones become a
    literal map too, by which each text is encoded where it lies. Texts with other words get those words' ids by a join on
    the word, once per distinct text; only such texts move, and a text or word of many rows is salted."""
    spark = docs.sparkSession
    rank = rank_lookup(spark, name, folder)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    counted = materialize(rows.select(F.explode(words(F.col("t"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    folded = fold_words(counted, rank=rank)
    top = most_frequent(counted, cached)
    known = Lookup(spark, folded.filter(top).select(F.col("word").alias("key"), F.col("ids").alias("value")), "string", "array<int>")

    def tried(k: Column) -> Column:
        def of(w: Column) -> Column:
            return let(F.transform(w, lambda x: known.get(k, x)), lambda got: F.struct(F.when(~F.exists(got, lambda x: x.isNull()), F.flatten(got)).alias("ids"), F.array_distinct(F.filter(w, lambda x, i: F.get(got, i).isNull())).alias("missing")))

        return let(words(F.col("t")), of)

    if folded.filter(~top).isEmpty():
        all_known = lambda k: F.flatten(F.transform(words(F.col("t")), lambda w: known.get(k, w)))
        return known.beside(rows, "_known").select(F.col("k").alias(key), let(F.col("_known"), all_known).alias("ids"))
    first = known.beside(rows, "_known").select("k", "t", let(F.col("_known"), tried).alias("x")).select("k", "x.ids", F.when(F.col("x.ids").isNull(), F.struct(F.unhex(F.md5("t")).alias("h"), "t", "x.missing")).alias("rest"))
    first = materialize(first, "first")
    rest = first.filter("ids is null").select("k", "rest.*")
    asked = rest.groupBy("h").agg(F.any_value("missing").alias("missing"), F.count("*").alias("rows")).select("h", "rows", F.explode("missing").alias("word"))
    asked = asked.withColumnsRenamed({"h": "of"}).withColumn("h", F.unhex(F.md5("word")))
    got = salted_join(asked, folded.filter(~top).select("h", "ids", "n"), ["h"], "n", "of").groupBy(F.col("of").alias("h")).agg(F.max("rows").alias("rows"), F.collect_list(F.struct("word", "ids")).alias("got"))
    size = F.least(F.size("got") / 16 + 1, F.lit(1024)).cast("int")
    got = got.select("h", "rows", F.transform(F.sequence(F.lit(0), size - 1), lambda b: F.map_from_entries(F.filter("got", lambda x: F.pmod(F.xxhash64(x["word"]), size) == b))).alias("found"))
    rest = known.beside(salted_join(rest.drop("missing"), got, ["h"], "rows", "k"), "_known")
    both = lambda k: F.flatten(F.transform(words(F.col("t")), lambda w: F.coalesce(known.get(k, w), _found_in(F.col("found"), w))))
    return first.filter("ids is not null").select("k", "ids").unionByName(rest.select("k", let(F.col("_known"), both).alias("ids"))).withColumnRenamed("k", key)


def decode(ids: DataFrame, key: str = "doc_id", name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """(doc_id, text): the binary pieces of the ids, one after another, read as UTF-8. An empty list gives an empty text."""
    known = parse_ranks(read_ranks(name, folder))
    pieces = [b""] * (1 + max(known.values()))
    for b, i in known.items():
        pieces[i] = b
    spark = ids.sparkSession
    table = materialize(spark.createDataFrame([(pieces,)], "t array<binary>", verifySchema=False), "pieces").scalar()
    joined = let(F.col("_pieces"), lambda t: F.unhex(F.array_join(F.transform("ids", lambda i: F.hex(F.element_at(t, i + 1))), "")))
    return ids.withColumn("_pieces", table).select(key, F.decode(joined, "UTF-8").alias("text"))
